"""Packets to flows: sessions by idle, active and size limits, and the features of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packets import FIN, RST, SYN, has

SECOND = 1_000_000_000


def idle_sessions(df: DataFrame, key: str, time: str, order: str, idle: int) -> DataFrame:
    """Adds session, from 1 for each key: a new one begins where the gap to the packet before is idle or more."""
    w = Window.partitionBy(key).orderBy(time, order)
    new = F.coalesce((F.col(time) - F.lag(time).over(w) >= idle).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w).cast("long")).drop("_new")


def sessions(df: DataFrame, key: str, time: str, order: str, idle: int, active: int, size: int) -> DataFrame:
    """Adds session, from 1 for each key, and begun_by: the rule that ended the session before (null for the first):
    IDLE_TIMEOUT (a gap of idle or more), else PACKET_LIMIT (it has size packets), else ACTIVE_TIMEOUT (active or more since
    its first packet).

    Idle gaps are found by a window and cut a key into runs; the restart of the other two rules depends on where a segment
    began, so it is a left fold over each run alone, which neither an idle gap nor another key can lengthen. Every packet is
    returned: those without a key are one key's, and repeated ones count each.
    """
    run = idle_sessions(df, key, time, order, idle).withColumnRenamed("session", "_run")
    row = F.struct(F.col(time).alias("t"), F.col(order).alias("o"), F.struct(*df.columns).alias("row"))
    # by time, then order; rows that are alike in both keep any order among themselves, and all are kept
    packets = F.array_sort(F.collect_list(row), lambda x, y: F.when((x["t"] < y["t"]) | ((x["t"] == y["t"]) & (x["o"] < y["o"])), -1).when((x["t"] == y["t"]) & (x["o"] == y["o"]), 0).otherwise(1))
    seed = F.struct(F.lit(0).alias("s"), F.lit(None).cast("long").alias("first"), F.lit(0).alias("n"), F.array().cast("array<struct<s:int,why:string>>").alias("out"))

    def fold(a: Column, p: Column) -> Column:
        why = F.when(a["first"].isNull(), F.lit(None).cast("string")).when(a["n"] >= size, "PACKET_LIMIT").when(p["t"] - a["first"] >= active, "ACTIVE_TIMEOUT")
        new = a["first"].isNull() | why.isNotNull()
        s = a["s"] + new.cast("int")
        return F.struct(
            s.alias("s"), F.when(new, p["t"]).otherwise(a["first"]).alias("first"), F.when(new, 1).otherwise(a["n"] + 1).alias("n"),
            F.concat(a["out"], F.array(F.struct(s.alias("s"), why.alias("why")))).alias("out"),
        )

    runs = run.groupBy(key, "_run").agg(packets.alias("_packets")).withColumn("_f", F.aggregate("_packets", seed, fold))
    before = F.coalesce(F.sum("_f.s").over(Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = runs.withColumn("_before", before).select("_run", "_before", F.inline(F.arrays_zip(F.col("_packets.row").alias("row"), F.col("_f.out").alias("out"))))
    return placed.select(
        *[F.col(f"row.{c}") for c in df.columns], (F.col("_before") + F.col("out.s")).cast("long").alias("session"),
        F.coalesce("out.why", F.when((F.col("_run") > 1) & (F.col("out.s") == 1), F.lit("IDLE_TIMEOUT"))).alias("begun_by"),
    )


def with_closure(flows: DataFrame, key: str, complete: bool = True) -> DataFrame:
    """flows (key, session, begun_by of each segment's first packet, ...) -> adds closure: what ended it; the last of a key
    ends with the capture, complete or not."""
    nxt = F.lead("begun_by").over(Window.partitionBy(key).orderBy("session"))
    return flows.withColumn("closure", F.coalesce(nxt, F.lit("CAPTURE_END" if complete else "INCOMPLETE_CAPTURE")))


def flow_features(packets: DataFrame, keys: list[str], time: str = "timestamp_ns", order: str = "event_id") -> DataFrame:
    """packets (keys, time in ns, order, forward boolean, ip_length, tcp_flags) -> keys, first_ns, last_ns, packets and the 14
    features, as floats rounded from doubles. Deviations are of the population."""
    w = Window.partitionBy(*keys).orderBy(time, order)
    p = packets.withColumn("_gap", F.col(time) - F.lag(time).over(w))
    n = F.col("ip_length").cast("double")
    side = lambda f, x: F.coalesce(F.sum(F.when(F.col("forward") == f, x)), F.lit(0))
    as_float = lambda c: c.cast("float")
    flag = lambda bit: as_float(F.count_if(has(F.col("tcp_flags"), bit)))
    return p.groupBy(*keys).agg(
        F.min(time).alias("first_ns"), F.max(time).alias("last_ns"), F.count("*").alias("packets"),
        as_float((F.max(time) - F.min(time)) / 1e9).alias("duration_seconds"),
        as_float(side(True, F.lit(1))).alias("forward_packet_count"), as_float(side(False, F.lit(1))).alias("backward_packet_count"),
        as_float(side(True, F.col("ip_length"))).alias("forward_ip_bytes"), as_float(side(False, F.col("ip_length"))).alias("backward_ip_bytes"),
        as_float(F.min(n)).alias("ip_length_min"), as_float(F.max(n)).alias("ip_length_max"), as_float(F.avg(n)).alias("ip_length_mean"),
        as_float(F.stddev_pop(n)).alias("ip_length_population_std"),
        flag(SYN).alias("tcp_syn_packet_count"), flag(FIN).alias("tcp_fin_packet_count"), flag(RST).alias("tcp_rst_packet_count"),
        as_float(F.coalesce(F.avg("_gap") / 1e9, F.lit(0.0))).alias("iat_mean_seconds"), as_float(F.coalesce(F.max("_gap") / 1e9, F.lit(0.0))).alias("iat_max_seconds"),
    )


def with_direction(packets: DataFrame, keys: list[str], source: Column, time: str = "timestamp_ns", order: str = "event_id") -> DataFrame:
    """Adds forward: does a packet come from the endpoint that the first packet of its flow came from?"""
    first = F.first(source).over(Window.partitionBy(*keys).orderBy(time, order))
    return packets.withColumn("forward", source == first)


def arrival_faults(packets: DataFrame, capture: str, index: str, time: str, event: str) -> DataFrame:
    """Adds fault: LATE_PACKET (older than one before it in the capture), DUPLICATE_EVENT (its id occurred before), or null;
    and gap_epoch: how many faults came before. A capture is one stream, in the order of index."""
    w = Window.partitionBy(capture).orderBy(index)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    late = F.col(time) < F.max(time).over(before)
    again = F.row_number().over(Window.partitionBy(capture, event).orderBy(index)) > 1
    out = packets.withColumn("fault", F.when(late, "LATE_PACKET").when(again, "DUPLICATE_EVENT"))
    return out.withColumn("gap_epoch", F.coalesce(F.sum(F.col("fault").isNotNull().cast("long")).over(before), F.lit(0)))
