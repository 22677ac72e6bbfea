"""CSV and Parquet inputs, their schemas reconciled; outputs that don't overwrite."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, sorted, in any file system that Spark knows; an error if there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    out = sorted(s.getPath().toString() for s in found or [])
    if not out:
        raise FileNotFoundError(f"nothing matches {pattern}")
    return out


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, trimmed: its first line alone is read."""
    return [c.strip() for c in spark.read.option("header", True).csv(path).columns]


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with trimmed names and source_file; all columns are text unless there is a schema."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def schema_report(headers: dict[str, Sequence[str]]) -> dict:
    """common (in the order of the first file), union, and what each file has besides the common ones."""
    names = list(headers)
    common = [c for c in headers[names[0]] if all(c in headers[n] for n in names)] if names else []
    union = list(dict.fromkeys(c for n in names for c in headers[n]))
    return {"common": common, "union": union, "extra": {n: [c for c in headers[n] if c not in common] for n in names}}


def reconciled(spark: SparkSession, pattern: str, label: str | None = None) -> DataFrame:
    """All CSV files that match, their common columns and source_file; rows that repeat the header are dropped."""
    paths = files(spark, pattern)
    common = schema_report({p: header(spark, p) for p in paths})["common"]
    out = None
    for p in paths:
        part = csv(spark, p).select(*[F.col(f"`{c}`") for c in common], "source_file")
        out = part if out is None else out.unionByName(part)
    return out.where(~F.trim(F.col(f"`{label}`")).eqNullSafe(F.lit(label))) if label else out


def tagged(spark: SparkSession, kinds: dict[str, Sequence[str]], column: str = "Type") -> DataFrame:
    """CSV files by kind, with the kind in a column; columns that a file lacks are null."""
    out = None
    for kind, paths in kinds.items():
        for p in paths:
            part = csv(spark, p).withColumn(column, F.lit(kind))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def parquet(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One path, a pattern or several paths; only the given columns are read."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def footer(spark: SparkSession, path: str) -> dict:
    """Names and number of rows of Parquet files, from their footers: no column is read."""
    df = spark.read.parquet(path)
    return {"columns": df.columns, "rows": df.count()}


def batches(df: DataFrame, rows: int, function, schema: str) -> DataFrame:
    """function over Arrow batches of at most rows rows; each batch in, one batch out."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df.mapInArrow(lambda bs: (function(b) for b in bs), schema)


def mapping(spark: SparkSession, path: str) -> dict[str, int]:
    """A JSON object of labels and their numbers, which must be 0, 1, ... without a gap; at most 10,000 of them."""
    text = spark.read.option("wholetext", True).text(path).first()[0]
    told = json.loads(text)
    if len(told) > 10_000 or sorted(told.values()) != list(range(len(told))):
        raise ValueError("labels must be numbered from 0 without a gap")
    return told


def named(codes: Column, told: dict[str, int]) -> Column:
    """The label of a number; null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in told.items() for x in (v, k)]), codes)


def write_parquet(df: DataFrame, path: str, partition: Sequence[str] = (), if_there: str = "error") -> bool:
    """Parquet with zstd. if_there: "error", "skip" (False if it was there), "replace"."""
    mode = {"error": "errorifexists", "skip": "ignore", "replace": "overwrite"}[if_there]
    if if_there == "skip" and _exists(df.sparkSession, f"{path}/_SUCCESS"):
        return False
    df.write.option("compression", "zstd").partitionBy(*partition).mode(mode if if_there != "skip" else "overwrite").parquet(path)
    return True


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """CSV with a header in each part."""
    df.write.option("header", True).mode("append" if append else "errorifexists").csv(path)


def valid_or_rebuilt(spark: SparkSession, path: str, columns: Sequence[str], rows: int, build) -> DataFrame:
    """The table at path if it is whole and has the columns and rows expected; else build() is written there."""
    if _exists(spark, f"{path}/_SUCCESS"):
        df = spark.read.parquet(path)
        if df.columns == list(columns) and df.count() == rows:
            return df
    build().write.option("compression", "zstd").mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _seal(df: DataFrame) -> dict:
    """Rows and a digest of a table that doesn't depend on the order of rows: the sum of 48 bits of each row's SHA-256."""
    whole = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    r = df.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(whole, 1, 12), 16, 10).cast("decimal(38,0)")).alias("s")).first()
    return {"rows": r["n"], "sum": str(r["s"] or 0), "schema": hashlib.sha256(df.schema.json().encode()).hexdigest()}


def write_sealed_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines at path/rows, which must not be there yet, and a manifest at path/manifest that seals them."""
    df.write.mode("errorifexists").json(f"{path}/rows")
    told = _seal(df.sparkSession.read.schema(df.schema).json(f"{path}/rows"))
    df.sparkSession.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def read_sealed_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of write_sealed_jsonl(); an error if they aren't those that were sealed."""
    df = spark.read.schema(schema).json(f"{path}/rows")
    if _seal(df) != json.loads(spark.read.text(f"{path}/manifest").first()[0]):
        raise ValueError("the rows aren't those that the manifest seals")
    return df
