"""Label logs as text: Zeek connection logs and Argus flows. Every line comes out, with an error where it can't be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .contracts import ARGUS, ZEEK


def exact_ns(seconds: Column) -> Column:
    """Decimal seconds as text to nanoseconds; null if they don't come out whole or aren't a number."""
    d = seconds.try_cast("decimal(28,12)")
    ns = d * F.lit(1_000_000_000)
    return F.when(ns == F.floor(ns), ns.try_cast("bigint"))


def zeek(spark: SparkSession, path: str) -> DataFrame:
    """Connections of labelled Zeek logs: file, line fields, and typed start_ns, end_ns (null if the log has no duration), counts
    (null unless all four are known), missed_bytes, label, error.

    Cells are parted by tabs; the last may hold the tunnel's parents, label and detailed label parted by three spaces. "-" is
    null. Lines of a file whose #fields don't name the columns expected (det_label may stand for detailed-label) get the error
    HEADER.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    named = F.regexp_replace(F.regexp_replace("value", "   ", "\t"), r"\bdet_label\b", "detailed-label")
    heads = lines.where(F.col("value").startswith("#fields\t")).groupBy("file").agg(F.min(F.substring(named, 9, 1 << 20)).alias("fields"))
    cells = F.split("value", "\t")
    last = F.split(F.element_at(cells, -1), "   ")
    full = F.when(F.size(cells) == 21, F.concat(F.slice(cells, 1, 20), last)).otherwise(cells)
    rows = lines.where(~F.col("value").startswith("#") & (F.length("value") > 0)).join(F.broadcast(heads), "file", "left")  # a row for each file
    rows = rows.withColumn("c", F.transform(full, lambda x: F.when(x != "-", x)))
    cell = lambda name: F.get("c", ZEEK.index(name))
    start, length = exact_ns(cell("ts")), exact_ns(cell("duration"))
    counts = F.array(*[cell(n).try_cast("bigint") for n in ("orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes")])
    port = lambda name: cell(name).try_cast("int")
    error = (
        F.when(~F.col("fields").eqNullSafe(F.lit("\t".join(ZEEK))), "HEADER")
        .when(F.size("c") != len(ZEEK), "CELLS")
        .when(start.isNull(), "START")
        .when(cell("duration").isNotNull() & length.isNull(), "DURATION")
        .when(~F.coalesce(port("id.orig_p").between(0, 65535) & port("id.resp_p").between(0, 65535), F.lit(False)), "PORT")
    )
    return rows.select(
        "file", cell("uid").alias("uid"), F.lower(cell("proto")).alias("transport"), cell("id.orig_h").alias("source_address"), port("id.orig_p").alias("source_port"),
        cell("id.resp_h").alias("destination_address"), port("id.resp_p").alias("destination_port"), start.alias("start_ns"), (start + length).alias("end_ns"),
        F.when(~F.exists(counts, lambda x: x.isNull()), counts).alias("counts"), cell("missed_bytes").try_cast("bigint").alias("missed_bytes"),
        cell("label").alias("label"), cell("detailed-label").alias("detailed"), error.alias("error"),
    )


# How labels of known origin begin.
BOTNET, NORMAL = "flow=From-Botnet-V48-", "flow=From-Normal-V48-"


def label_kind(label: Column, botnet: str = BOTNET, normal: str = NORMAL) -> Column:
    return F.when(label.startswith(botnet), "BOTNET").when(label.startswith(normal), "NORMAL").otherwise("UNKNOWN")


def argus(spark: SparkSession, path: str, offset_hours: int = 0) -> DataFrame:
    """Argus flows: transport, addresses, ports (decimal or 0x...), start_ns, end_ns, kind, label, error.

    StartTime is in the zone of the given offset. error: TRANSPORT (neither tcp nor udp), TIME, PORT, or null.
    """
    df = spark.read.option("header", True).csv(path)
    if missing := [c for c in ARGUS if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    number = lambda c: F.when(F.lower(c).startswith("0x"), F.conv(F.substring(c, 3, 16), 16, 10)).otherwise(c).try_cast("int")
    stamp = F.try_to_timestamp("StartTime", F.lit("yyyy/MM/dd HH:mm:ss.SSSSSS"))
    zone = F.timestamp_diff("SECOND", F.to_utc_timestamp(F.lit("2000-01-01 00:00:00").cast("timestamp"), F.current_timezone()), F.lit("2000-01-01 00:00:00").cast("timestamp"))
    start = (F.unix_micros(stamp) + (zone - offset_hours * 3600) * 1_000_000) * 1000
    length = exact_ns(F.col("Dur"))
    s, t = number(F.col("Sport")), number(F.col("Dport"))
    error = (
        F.when(~F.coalesce(F.lower("Proto").isin("tcp", "udp"), F.lit(False)), "TRANSPORT")
        .when(start.isNull() | length.isNull(), "TIME")
        .when(~F.coalesce(s.between(0, 65535) & t.between(0, 65535), F.lit(False)), "PORT")
    )
    return df.select(
        F.lower("Proto").alias("transport"), F.col("SrcAddr").alias("source_address"), s.alias("source_port"), F.col("DstAddr").alias("destination_address"),
        t.alias("destination_port"), F.trim("Dir").alias("direction"), start.alias("start_ns"), (start + length).alias("end_ns"), label_kind(F.col("Label")).alias("kind"),
        F.col("Label").alias("label"), error.alias("error"),
    )
