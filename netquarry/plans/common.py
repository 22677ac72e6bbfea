"""The driver's tables in the roles of flow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: lineitem as a labelled flow table: numeric features, a low-cardinality pattern, a label, a provenance.
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PATTERN = ["l_quantity", "l_discount", "l_tax"]
LABEL, SOURCE = "l_returnflag", "l_linestatus"

HOUR = 3600 * 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as packets: user_id is the key, us the time in microseconds."""
    df = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return df.withColumn("us", F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())))


def counts_as_bigint(sql: str) -> str:
    """DuckDB's count_if gives a HUGEINT: writes it as a count of a CASE instead."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + len('count_if(') : end - 1]} THEN 1 END){sql[end:]}"
    return sql
