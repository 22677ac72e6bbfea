"""Binding of flows to interval labels, with an explicit status for every flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def containing(flows: DataFrame, labels: DataFrame, keys: Sequence[str], first: str, last: str, start: str, end: str, width: int | None = None) -> DataFrame:
    """Pairs of flows and labels of the same keys where start <= first and last <= end.

    With a width (about the usual length of a label's interval), intervals are cut into cells of that width and a flow meets
    only those in the cell of its first instant: the join is then on keys and cell, and a key with many labels or flows is
    spread over its cells. A label has a row for each cell it touches; each pair is found once.
    """
    a, b = flows, labels.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [a[k] == b[f"_{k}"] for k in keys]
    if width:
        a = a.withColumn("_cell", F.floor(F.col(first) / width))
        b = b.withColumn("_cells", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
        on = [a[k] == b[f"_{k}"] for k in keys] + [F.col("_cell") == F.col("_cells")]
    on += [F.col(start) <= F.col(first), F.col(last) <= F.col(end)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return a.join(b, cond).drop(*[f"_{k}" for k in keys], *(["_cell", "_cells"] if width else []))


def bound(flows: DataFrame, matches: DataFrame, flow_id: str, reference: str, label: str, known: Sequence[str]) -> DataFrame:
    """Every flow with status, matches and, where verified or candidate, the reference and label.

    No match: UNMATCHED; several: AMBIGUOUS; one whose label isn't known: EXCLUDED; else VERIFIED_MATCH, but CANDIDATE_MATCH
    if the same label verifies several flows.
    """
    per = matches.groupBy(F.col(flow_id).alias("_f")).agg(
        F.count("*").alias("_n"), F.min(reference).alias("_reference"), F.min(label).alias("_label")
    )
    out = flows.join(per, flows[flow_id] == per["_f"], "left").drop("_f")
    n = F.coalesce(F.col("_n"), F.lit(0))
    status = F.when(n == 0, "UNMATCHED").when(n > 1, "AMBIGUOUS").when(~F.coalesce(F.col("_label").isin(*known), F.lit(False)), "EXCLUDED")
    out = out.withColumn("status", status.otherwise("VERIFIED_MATCH")).withColumn("matches", n)
    return demoted(out.withColumnRenamed("_reference", "reference").withColumnRenamed("_label", "label").drop("_n"))


def demoted(rows: DataFrame) -> DataFrame:
    """A reference that verifies several flows only makes candidates of them; other statuses carry no label."""
    # flows without a verified label are spread over their own keys: they would all meet under null
    uses = F.when(F.col("status") == "VERIFIED_MATCH", F.col("reference"))
    per = rows.where(uses.isNotNull()).groupBy(uses.alias("_r")).agg(F.count("*").alias("_uses")).where("_uses > 1")
    out = rows.join(per, uses == per["_r"], "left")
    status = F.when(F.col("_uses").isNotNull(), "CANDIDATE_MATCH").otherwise(F.col("status"))
    out = out.withColumn("status", status).drop("_r", "_uses")
    held = F.col("status").isin("VERIFIED_MATCH", "CANDIDATE_MATCH")
    return out.withColumn("reference", F.when(held, F.col("reference"))).withColumn("label", F.when(held, F.col("label")))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("flows"))


def overlapping(flows: DataFrame, labels: DataFrame, keys: Sequence[str], first: str, last: str, start: str, end: str) -> DataFrame:
    """Pairs of the same keys whose intervals have an instant in common."""
    b = labels.withColumnsRenamed({k: f"_{k}" for k in keys})
    cond: Column = (F.col(start) <= F.col(last)) & (F.col(first) <= F.col(end))
    for k in keys:
        cond = cond & (flows[k] == b[f"_{k}"])
    return flows.join(b, cond).drop(*[f"_{k}" for k in keys])


def novel(rows: DataFrame, seen: DataFrame, digest: str) -> DataFrame:
    """Rows whose digest isn't among those seen."""
    return rows.join(seen.select(digest).distinct(), digest, "left_anti")


def shared_members(rows: DataFrame, split: str, members: str) -> DataFrame:
    """By pair of splits: how many distinct members of an array column both have."""
    per = rows.select(F.col(split).alias("s"), F.explode(members).alias("m")).groupBy("m").agg(F.array_sort(F.collect_set("s")).alias("ss"))
    pairs = F.expr("flatten(transform(ss, (x, i) -> transform(slice(ss, i + 2, size(ss)), y -> struct(x AS split_a, y AS split_b))))")
    return per.where(F.size("ss") > 1).select(F.inline(pairs)).groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))


def first_of(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def bound_connections(flows: DataFrame, connections: DataFrame, keys: Sequence[str], known: Sequence[str] = ("Benign", "Malicious")) -> DataFrame:
    """Flows against a connection log whose entries may lack an end or counts: every flow with status, reason, reference, label.

    flows: keys, flow_id, first_ns, last_ns, counts (packets and bytes of the first side, then of the other). connections: keys, uid,
    start_ns, end_ns or null, counts or null, missed_bytes, label. In this order of precedence: no connection contains the flow: by those that
    start with it, several AMBIGUOUS, one without an end EXCLUDED, one CANDIDATE_MATCH, none UNMATCHED; several contain it: AMBIGUOUS; one does: a
    label that isn't known, missed bytes or no counts EXCLUDED; other counts or another start CANDIDATE_MATCH; else VERIFIED_MATCH. A
    connection that verifies several flows makes candidates of them.
    """
    c = connections.select(*[F.col(k).alias(f"_{k}") for k in keys], "uid", "start_ns", "end_ns", F.col("counts").alias("_counts"), "missed_bytes", F.col("label").alias("_label"))
    same = F.lit(True)
    for k in keys:
        same = same & (flows[k] == c[f"_{k}"])
    inside = F.coalesce((F.col("start_ns") <= F.col("first_ns")) & (F.col("last_ns") <= F.col("end_ns")), F.lit(False))
    anchor = F.col("start_ns") == F.col("first_ns")
    pairs = flows.join(c, same & (inside | anchor)).withColumn("_inside", inside)
    one = F.struct("uid", "start_ns", "end_ns", "_counts", "missed_bytes", "_label")
    per = pairs.groupBy(F.col("flow_id").alias("_f")).agg(
        F.count_if("_inside").alias("_n"), F.count_if(~F.col("_inside")).alias("_anchors"),
        F.min(F.when(F.col("_inside"), one)).alias("_in"), F.min(F.when(~F.col("_inside"), one)).alias("_at"),
    )
    rows = flows.join(per, flows["flow_id"] == per["_f"], "left")
    n, anchors = F.coalesce("_n", F.lit(0)), F.coalesce("_anchors", F.lit(0))
    hit = F.col("_in")
    reason = (
        F.when((n == 0) & (anchors > 1), "SEVERAL_ANCHORS").when((n == 0) & (anchors == 1) & F.col("_at.end_ns").isNull(), "NO_END")
        .when((n == 0) & (anchors == 1), "ANCHOR_ONLY").when(n == 0, "NO_CONNECTION").when(n > 1, "SEVERAL_CONNECTIONS")
        .when(~F.coalesce(hit["_label"].isin(*known), F.lit(False)), "LABEL").when(~hit["missed_bytes"].eqNullSafe(F.lit(0)), "MISSED_BYTES")
        .when(hit["_counts"].isNull(), "NO_COUNTS").when((hit["_counts"] != F.col("counts")) | (hit["start_ns"] != F.col("first_ns")), "NOT_THE_SAME")
        .otherwise("SAME")
    )
    r = F.col("reason")
    status = (
        F.when(r.isin("SEVERAL_ANCHORS", "SEVERAL_CONNECTIONS"), "AMBIGUOUS").when(r.isin("NO_END", "LABEL", "MISSED_BYTES", "NO_COUNTS"), "EXCLUDED")
        .when(r.isin("ANCHOR_ONLY", "NOT_THE_SAME"), "CANDIDATE_MATCH").when(r == "NO_CONNECTION", "UNMATCHED").otherwise("VERIFIED_MATCH")
    )
    out = rows.withColumn("reason", reason).withColumn("status", status).withColumns(
        {"reference": F.coalesce(hit["uid"], F.col("_at.uid")), "label": F.coalesce(hit["_label"], F.col("_at._label"))}
    )
    return demoted(out.drop("_f", "_n", "_anchors", "_in", "_at"))


def partitioned(packets: DataFrame, connections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Packets (keys, event_id, timestamp_ns) with the one connection (keys, uid, start_ns, end_ns) whose interval holds their instant;
    uid is null and matches says how many there were if it isn't just one."""
    c = connections.select(*[F.col(k).alias(f"_{k}") for k in keys], "uid", "start_ns", "end_ns")
    same = F.col("timestamp_ns").between(F.col("start_ns"), F.col("end_ns"))
    for k in keys:
        same = same & (packets[k] == c[f"_{k}"])
    per = packets.join(c, same).groupBy(F.col("event_id").alias("_e")).agg(F.count("*").alias("_n"), F.min("uid").alias("_uid"))
    out = packets.join(per, packets["event_id"] == per["_e"], "left")
    return out.withColumns({"matches": F.coalesce("_n", F.lit(0)), "uid": F.when(F.col("_n") == 1, F.col("_uid"))}).drop("_e", "_n", "_uid")


def named_labels(names: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of names (fqdn, ...) with the labels (fqdn, reference, label) of the same canonical name."""
    from ..functions.domains import canonical

    a = names.withColumn("_name", canonical(F.col("fqdn")))
    b = labels.select(canonical(F.col("fqdn")).alias("_name"), "reference", "label")
    return a.join(b, "_name").drop("_name")
