"""Recovery of flows that a connection log holds in several parts, by the evidence of an independent decode."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packets import SYN
from .binding import containing

#: Reasons of operators.binding with which a flow may be recovered: a connection starts with it, but is shorter or has no end.
OPEN = ("ANCHOR_ONLY", "NO_END")

# Reasons of a recovery, in the order in which they are looked for.
DUPLICATE_UID = "DUPLICATE_UID_IN_LABEL_SOURCE"
UNAVAILABLE = "INDEPENDENT_REFERENCE_UNAVAILABLE"
MISMATCH = "INDEPENDENT_PACKET_MISMATCH"
SEQUENCE = "CONNECTION_REUSE_SEQUENCE_CHANGE"
TIMES = "DUPLICATE_OR_NON_UNIQUE_PACKET_TIME"
REFERENCE = "DUPLICATE_CONNECTION_REFERENCE"
UNCOVERED = "NON_UNIQUE_OR_UNCOVERED_PACKET"
COUNTERS = "EXACT_PARTITION_COUNTER_MISMATCH"
BOUNDS = "EXACT_PARTITION_TIME_MISMATCH"
QUALITY = "PARTITION_QUALITY_OR_LABEL_UNVERIFIED"
LABELS = "CONFLICTING_PARTITION_LABELS"
RECOVERED = "EXACT_SYN_PACKET_PARTITION"


def packet_lookup(packets: DataFrame, wire: DataFrame, compare: Sequence[str]) -> DataFrame:
    """Packets with the columns of the independently decoded packet (wire_...) of the same session and packet_index, which wire
    has once, and evidence: UNAVAILABLE, MISMATCH in a column of compare, or null."""
    on = ["session", "packet_index"]
    w = wire.select(*on, *[F.col(c).alias(f"wire_{c}") for c in wire.columns if c not in on], F.lit(True).alias("_found"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"wire_{c}")) for c in compare], F.lit(True))
    out = packets.join(w, on, "left")
    return out.withColumn("evidence", F.when(F.col("_found").isNull(), UNAVAILABLE).when(~same, MISMATCH)).drop("_found")


def row_first(connections: DataFrame, packets: DataFrame, keys: Sequence[str], width: int | None = None) -> DataFrame:
    """Each connection (keys, uid, start_ns, end_ns) with the packets (keys, event_id, timestamp_ns) that its own interval holds: packets,
    and shared, those that another connection holds too. width is that of containing()."""
    held = containing(packets, connections, keys, "timestamp_ns", "timestamp_ns", "start_ns", "end_ns", width).select("uid", "event_id")
    times = held.groupBy("event_id").agg(F.count("*").alias("_n")).where("_n > 1")
    per = held.join(times, "event_id", "left").groupBy("uid").agg(F.count("*").alias("packets"), F.count("_n").alias("shared"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("packets", "shared")}
    return connections.join(per, "uid", "left").withColumns(zero)


def uncovered(connections: DataFrame, packets: DataFrame, keys: Sequence[str], width: int | None = None) -> DataFrame:
    """Packets that no connection holds."""
    held = containing(packets, connections, keys, "timestamp_ns", "timestamp_ns", "start_ns", "end_ns", width)
    return packets.join(held.select("event_id").distinct(), "event_id", "left_anti")


def recovered(flows: DataFrame, packets: DataFrame, wire: DataFrame, connections: DataFrame, compare: Sequence[str], known: Sequence[str] = ("Benign", "Malicious")) -> DataFrame:
    """Every flow with flow_id, status, reason, references, label and basis.

    flows: flow_id, key (the same for both directions), transport, status, reason, reference, label, incomplete, closure. packets:
    flow_id, session, packet_index, event_id, timestamp_ns, source, ip_length, columns of compare. wire: session, packet_index, source,
    flags, payload_length, sequence, acknowledgment, columns of compare. connections: key, session, uid, reference, originator,
    start_ns, end_ns or null, counts or null (packets and bytes of the originator, then of the other side), missed_bytes, label, detailed.

    An incomplete flow is EXCLUDED by its closure. A TCP flow with a reason of OPEN becomes VERIFIED_MATCH if all its packets are
    opening packets without payload from one side with one sequence number, by an independent decode, and the connections that touch
    it divide them without rest: one connection for each packet, exact counters, starts and ends, no missed bytes, one known label.
    What fails first gives the reason, by packet_index or by start and reference. Other flows, null reasons and flows without packets stay.
    """
    open_ = ~F.coalesce("incomplete", F.lit(False)) & (F.col("transport") == "tcp") & F.col("reason").isin(*OPEN) & F.col("status").isin("CANDIDATE_MATCH", "EXCLUDED")
    tried = flows.where(open_).select("flow_id", "key")
    by = Window.partitionBy("flow_id").orderBy("packet_index")
    seen = packet_lookup(packets.join(tried, "flow_id"), wire, compare)
    bare = (F.col("wire_flags") == SYN) & (F.col("wire_payload_length") == 0) & (F.col("wire_acknowledgment") == 0)
    bare = F.coalesce(bare & (F.col("wire_source") == F.first("source").over(by)), F.lit(False))
    seen = seen.withColumns({"_bare": bare, "_stuck": F.col("timestamp_ns") <= F.lag("timestamp_ns").over(by)})
    least = lambda when, *of: F.min(F.when(when, F.struct(*of)))[of[-1]]
    facts = seen.groupBy("flow_id", "key").agg(
        F.min_by("session", "packet_index").alias("_session"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"),
        least(F.col("evidence").isNotNull(), "packet_index", "evidence").alias("_evidence"), F.count_if(~F.col("_bare")).alias("_other"),
        (~F.min("wire_sequence").eqNullSafe(F.max("wire_sequence"))).alias("_sequences"),
        ((F.count_if("_stuck") > 0) | (F.count_distinct("event_id") < F.count("*"))).alias("_times"),
    )
    touching = facts.select("flow_id", "key", "first_ns", "last_ns").join(connections.withColumnsRenamed({"session": "_of"}), "key")
    touching = touching.where("start_ns <= last_ns AND (start_ns >= first_ns OR end_ns >= first_ns)").drop("first_ns", "last_ns", "key")
    inside = F.when(F.col("end_ns").isNull(), F.col("timestamp_ns") == F.col("start_ns")).otherwise(F.col("timestamp_ns").between(F.col("start_ns"), F.col("end_ns")))
    own = seen.select("flow_id", "packet_index", "session", "timestamp_ns", "source", "ip_length")
    dealt = own.join(touching.select("flow_id", "reference", "_of", "originator", "start_ns", "end_ns"), "flow_id").where((F.col("session") == F.col("_of")) & inside)
    times = dealt.groupBy("flow_id", "packet_index").agg(F.count("*").alias("_n"))
    cover = own.join(times, ["flow_id", "packet_index"], "left").withColumn("_n", F.coalesce("_n", F.lit(0))).groupBy("flow_id")
    cover = cover.agg(least(F.col("_n") != 1, "packet_index", "_n").alias("_cover"))
    side = lambda yes: (F.count_if(yes), F.coalesce(F.sum(F.when(yes, F.col("ip_length"))), F.lit(0)).cast("long"))
    from_origin = F.col("source") == F.col("originator")
    got = dealt.groupBy("flow_id", "reference").agg(
        F.count("*").alias("_n"), F.min("timestamp_ns").alias("_first"), F.max("timestamp_ns").alias("_last"), F.array(*side(from_origin), *side(~from_origin)).alias("_counts")
    )
    end = F.col("end_ns")
    parts = touching.join(got, ["flow_id", "reference"], "left").withColumn("_fault",
        F.when(~F.coalesce((F.col("_first") == F.col("start_ns")) & (F.col("_counts") == F.col("counts")), F.lit(False)), COUNTERS)
        .when((end.isNull() & (F.col("_n") != 1)) | (F.col("_last") != end), BOUNDS)
        .when(~F.col("missed_bytes").eqNullSafe(F.lit(0)) | ~F.coalesce(F.col("label").isin(*known), F.lit(False)), QUALITY)
    )
    detail = F.struct("label", "detailed")
    judged = parts.groupBy("flow_id").agg(
        (F.count("*") > F.least(F.count_distinct("uid"), F.count_distinct("reference"))).alias("_repeated"),
        least(F.col("_fault").isNotNull(), "start_ns", "reference", "_fault").alias("_fault"), (F.min(detail) != F.max(detail)).alias("_labels"),
        F.min("label").alias("_label"), F.array_sort(F.collect_list(F.struct("start_ns", "reference"))).alias("_parts"),
    )
    twice = connections.groupBy("session", "uid").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("session").alias("_session"), F.lit(True).alias("_twice")).distinct()
    told = facts.drop("key").join(twice, "_session", "left").join(judged, "flow_id", "left").join(cover, "flow_id", "left").drop("first_ns", "last_ns", "_session")
    out = flows.select("flow_id", "status", "reason", "reference", "label", "incomplete", "closure").join(told, "flow_id", "left")
    verdict = (
        F.when(F.col("_other").isNull(), None).when(F.col("_twice"), DUPLICATE_UID).when(F.col("_evidence").isNotNull(), F.col("_evidence"))
        .when(F.col("_other") > 0, None).when(F.col("_sequences"), SEQUENCE).when(F.col("_times"), TIMES).when(F.coalesce("_repeated", F.lit(True)), REFERENCE)
        .when(F.col("_cover").isNotNull(), UNCOVERED).when(F.col("_fault").isNotNull(), F.col("_fault")).when(F.col("_labels"), LABELS).otherwise(RECOVERED)
    )
    out = out.withColumn("_verdict", verdict)
    v, incomplete = F.col("_verdict"), F.coalesce("incomplete", F.lit(False))
    status = (
        F.when(incomplete, "EXCLUDED").when(v.isNull(), F.col("status")).when(v.isin(DUPLICATE_UID, REFERENCE, LABELS) | ((v == UNCOVERED) & (F.col("_cover") > 1)), "AMBIGUOUS")
        .when(v.isin(MISMATCH, TIMES, QUALITY), "EXCLUDED").when(v == RECOVERED, "VERIFIED_MATCH").otherwise(F.col("status"))
    )
    before = F.when(F.col("reference").isNotNull(), F.array("reference")).otherwise(F.expr("array()").cast("array<string>"))
    return out.select(
        "flow_id", status.alias("status"), F.when(incomplete, F.col("closure")).otherwise(F.coalesce(v, F.col("reason"))).alias("reason"),
        F.when(v == RECOVERED, F.expr("transform(_parts, x -> x.reference)")).otherwise(before).alias("references"),
        F.when(v == RECOVERED, F.col("_label")).when(v == LABELS, None).otherwise(F.col("label")).alias("label"),
        F.when(v.isNull() | incomplete, "BASELINE").when(v == RECOVERED, "RECOVERED").otherwise("UNVERIFIED").alias("basis"),
    )
