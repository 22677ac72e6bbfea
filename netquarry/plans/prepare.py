"""Queries of dataset preparation: patterns, conflicts, weights, splits, samples, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, patterns
from .common import FEATURES, LABEL, PATTERN, SOURCE, table

_ALL = [*PATTERN, LABEL]


def _freq(spark, d):
    return patterns.frequencies(table(spark, d, "lineitem", *_ALL), PATTERN, LABEL)


def frequency_patterns(spark, d):
    return _freq(spark, d)


def unique_patterns(spark, d):
    rows = table(spark, d, "lineitem", *_ALL, "l_orderkey", "l_linenumber", SOURCE).withColumn("row_id", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return patterns.unique_patterns(rows, PATTERN, LABEL, [SOURCE], "row_id").drop("row_id")


def reaggregated_patterns(spark, d):
    return patterns.reaggregated(_freq(spark, d), ["l_quantity", "l_tax"], LABEL)


def conflict_details(spark, d):
    return patterns.conflict_details(_freq(spark, d), PATTERN, LABEL)


def conflict_summary(spark, d):
    return patterns.conflict_summary(conflict_details(spark, d))


def conflicting_patterns(spark, d):
    return patterns.conflicting_patterns(table(spark, d, "lineitem", *_ALL), PATTERN, LABEL)


def class_weights(spark, d):
    return patterns.class_weights(_freq(spark, d), LABEL)


def sample_weights(spark, d):
    w = patterns.weighted(_freq(spark, d), LABEL, {"R": 2.0})
    return w.groupBy(LABEL).agg(
        F.count("*").alias("patterns"), F.round(F.min("sample_weight"), 6).alias("least"), F.round(F.max("sample_weight"), 6).alias("most"),
        F.round(F.sum("sample_weight"), 3).alias("total"),
    )


def _split(spark, d):
    # both engines can compute this hash of the pattern
    b = F.pmod((F.col("l_quantity") * 31 + F.round(F.col("l_discount") * 100) * 17 + F.round(F.col("l_tax") * 100) * 7).cast("long"), F.lit(100))
    return table(spark, d, "lineitem", *_ALL, SOURCE).withColumn("split", patterns.split_name(b))


def split_counts(spark, d):
    return patterns.split_counts(_split(spark, d), LABEL)


def split_leakage(spark, d):
    return patterns.leakage(_split(spark, d), PATTERN)


def row_split_leakage(spark, d):
    rows = table(spark, d, "lineitem", *_ALL, "l_orderkey", "l_linenumber")
    return patterns.leakage(rows.withColumn("split", patterns.split_name(F.pmod(F.col("l_orderkey") * 31 + F.col("l_linenumber"), F.lit(100)))), PATTERN)


def hash_split_properties(spark, d):
    """The library's own hash: no pattern in two splits, shares near 70, 15 and 15 of a hundred."""
    return patterns.leakage(patterns.split_by_pattern(table(spark, d, "lineitem", *PATTERN), PATTERN), PATTERN).select(
        (F.col("train_validation") + F.col("train_test") + F.col("validation_test")).alias("leaking"), F.col("patterns")
    )


def stratified_sample(spark, d):
    """The first 200 of each class by a key's order, in the library's windowed form."""
    from pyspark.sql import Window

    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", LABEL)
    w = Window.partitionBy(LABEL).orderBy(F.pmod(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729, F.lit(1000003)), "l_orderkey", "l_linenumber")
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 200")


def seeded_sample_sizes(spark, d):
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", LABEL)
    return patterns.sampled(rows, LABEL, {"A": 500, "N": 300}, ["l_orderkey", "l_linenumber"]).groupBy(LABEL).agg(F.count("*").alias("n"))


def train_test_sizes(spark, d):
    rows = patterns.train_test(table(spark, d, "lineitem", "l_orderkey", "l_linenumber", LABEL), LABEL, ["l_orderkey", "l_linenumber"])
    return rows.groupBy(LABEL).agg(F.count("*").alias("n"), F.count_if("in_test").alias("n_test"))


def row_conservation(spark, d):
    rows = table(spark, d, "lineitem", *_ALL)
    return gates.conserved(patterns.frequencies(rows, PATTERN, LABEL), rows, LABEL)


def weight_gate(spark, d):
    return gates.weights_sane(patterns.weighted(_freq(spark, d), LABEL, {"R": 2.0}), "sample_weight")


def union_of_splits(spark, d):
    rows = _split(spark, d)
    parts = [rows.where(F.col("split") == s).select(F.lit(i).cast("tinyint").alias("split_id"), *PATTERN) for i, s in enumerate(("train", "validation", "test"))]
    out = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return out.groupBy("split_id").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def excluded_features(spark, d):
    rows = table(spark, d, "lineitem")
    names = patterns.feature_columns(rows, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", LABEL, SOURCE])
    return patterns.projected(rows, sorted(names, reverse=True), [LABEL]).groupBy(LABEL).agg(*[F.round(F.avg(c), 6).alias(c) for c in names])


def pattern_integrity(spark, d):
    f = F.col("frequency")
    return _freq(spark, d).agg(
        F.count("*").alias("patterns"), F.sum(f).alias("rows"), F.min(f).alias("least"), F.max(f).alias("most"), F.round(F.avg(f), 6).alias("mean"),
        F.countDistinct(LABEL).alias("labels"), F.count_if(f > 1).alias("repeated"),
    )


QUERIES = {f.__name__: f for f in (
    frequency_patterns, unique_patterns, reaggregated_patterns, conflict_details, conflict_summary, conflicting_patterns, class_weights, sample_weights,
    split_counts, split_leakage, row_split_leakage, hash_split_properties, stratified_sample, seeded_sample_sizes, train_test_sizes, row_conservation,
    weight_gate, union_of_splits, excluded_features, pattern_integrity,
)}

_P = ", ".join(PATTERN)
_F = f"(SELECT {_P}, {LABEL}, count(*) AS frequency FROM lineitem GROUP BY ALL)"
_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in PATTERN)
_DETAILS = f"""SELECT {", ".join(f"a.{c}" for c in PATTERN)}, a.{LABEL} AS label_a, b.{LABEL} AS label_b, a.frequency AS frequency_a, b.frequency AS frequency_b,
  CASE WHEN a.frequency > b.frequency THEN a.{LABEL} WHEN b.frequency > a.frequency THEN b.{LABEL} END AS majority
  FROM {_F} AS a JOIN {_F} AS b ON {_SAME} AND a.{LABEL} < b.{LABEL}"""
_B = "((l_quantity * 31 + round(l_discount * 100) * 17 + round(l_tax * 100) * 7)::BIGINT % 100)"
_NAME = "CASE WHEN {b} < 70 THEN 'train' WHEN {b} < 85 THEN 'validation' ELSE 'test' END"
_SPLIT = f"(SELECT *, {_NAME.format(b=_B)} AS split FROM lineitem)"
_LEAK = f"""SELECT count(*) AS patterns, count_if(t > 0 AND v > 0) AS train_validation, count_if(t > 0 AND s > 0) AS train_test,
  count_if(v > 0 AND s > 0) AS validation_test FROM (SELECT {_P}, count_if(split = 'train') AS t, count_if(split = 'validation') AS v,
  count_if(split = 'test') AS s FROM {{}} GROUP BY {_P})"""
_W = f"(SELECT *, sqrt(frequency) * CASE WHEN {LABEL} = 'R' THEN 2.0 ELSE 1.0 END AS w FROM {_F})"

ORACLE = {
    "frequency_patterns": f"SELECT {_P}, {LABEL}, count(*) AS frequency FROM lineitem GROUP BY ALL",
    "unique_patterns": f"SELECT {_P}, {LABEL}, arg_min({SOURCE}, l_orderkey * 100 + l_linenumber) AS {SOURCE}, count(*) AS frequency FROM lineitem GROUP BY {_P}, {LABEL}",
    "reaggregated_patterns": f"SELECT l_quantity, l_tax, {LABEL}, sum(frequency)::BIGINT AS frequency FROM {_F} GROUP BY ALL",
    "conflict_details": _DETAILS,
    "conflict_summary": f"""SELECT label_a, label_b, count(*) AS patterns, sum(frequency_a)::BIGINT AS rows_a, sum(frequency_b)::BIGINT AS rows_b,
      sum(frequency_a + frequency_b)::BIGINT AS total_rows, sum(least(frequency_a, frequency_b))::BIGINT AS minority_rows,
      max(frequency_a + frequency_b) AS largest, round(sum(least(frequency_a, frequency_b)) / sum(frequency_a + frequency_b), 6) AS ambiguity
      FROM ({_DETAILS}) GROUP BY label_a, label_b""",
    "conflicting_patterns": f"SELECT {_P}, count(DISTINCT {LABEL}) AS labels, count(*) AS rows FROM lineitem GROUP BY {_P} HAVING count(DISTINCT {LABEL}) > 1",
    "class_weights": f"""SELECT {LABEL}, count(*) AS patterns, sum(frequency)::BIGINT AS rows, min(frequency) AS least, max(frequency) AS most,
      round(sum(ln(1 + frequency)), 4) AS by_log, round(sum(sqrt(frequency)), 4) AS by_root, round(sum(frequency) / count(*), 6) AS compression,
      round(sum(frequency) / max(sum(frequency)) OVER (), 6) AS to_majority FROM {_F} GROUP BY {LABEL}""",
    "sample_weights": f"""SELECT {LABEL}, count(*) AS patterns, round(min(w), 6) AS least, round(max(w), 6) AS most, round(sum(w), 3) AS total
      FROM {_W} GROUP BY {LABEL}""",
    "split_counts": f"""SELECT {LABEL}, count_if(split = 'train') AS train, count_if(split = 'validation') AS validation, count_if(split = 'test') AS test,
      count(*) AS total, round(count_if(split = 'train') / count(*), 6) AS train_share, round(count_if(split = 'validation') / count(*), 6) AS validation_share,
      round(count_if(split = 'test') / count(*), 6) AS test_share,
      least(count_if(split = 'train'), count_if(split = 'validation'), count_if(split = 'test')) = 0 AS lacking FROM {_SPLIT} GROUP BY {LABEL}""",
    "split_leakage": _LEAK.format(_SPLIT),
    "row_split_leakage": _LEAK.format(f"(SELECT *, {_NAME.format(b='((l_orderkey * 31 + l_linenumber) % 100)')} AS split FROM lineitem)"),
    "hash_split_properties": f"SELECT 0::BIGINT AS leaking, count(*) AS patterns FROM (SELECT DISTINCT {_P} FROM lineitem)",
    "stratified_sample": f"""SELECT * FROM (SELECT l_orderkey, l_linenumber, {LABEL}, row_number() OVER (PARTITION BY {LABEL}
      ORDER BY (l_orderkey * 7919 + l_linenumber * 104729) % 1000003, l_orderkey, l_linenumber)::INT AS place FROM lineitem) WHERE place <= 200""",
    "seeded_sample_sizes": f"""SELECT {LABEL}, CASE {LABEL} WHEN 'A' THEN least(500, count(*)) WHEN 'N' THEN least(300, count(*)) ELSE count(*) END AS n
      FROM lineitem GROUP BY {LABEL}""",
    "train_test_sizes": f"SELECT {LABEL}, count(*) AS n, ceil(count(*) * 0.2)::BIGINT AS n_test FROM lineitem GROUP BY {LABEL}",
    "row_conservation": f"SELECT {LABEL}, count(*) AS rows, count(*) AS frequencies, true AS passed FROM lineitem GROUP BY {LABEL}",
    "weight_gate": f"""SELECT unnest(['no_null', 'positive', 'finite', 'some']) AS "check",
      unnest([count_if(w IS NULL) = 0, min(w) > 0, max(w) < 'inf'::DOUBLE, count(*) > 0]) AS passed FROM {_W}""",
    "union_of_splits": f"""SELECT CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END::TINYINT AS split_id, count(*) AS n,
      round(sum(l_quantity), 2) AS quantity FROM {_SPLIT} GROUP BY 1""",
    "excluded_features": f"SELECT {LABEL}, {', '.join(f'round(avg({c}), 6) AS {c}' for c in FEATURES)} FROM lineitem GROUP BY {LABEL}",
    "pattern_integrity": f"""SELECT count(*) AS patterns, sum(frequency)::BIGINT AS rows, min(frequency) AS least, max(frequency) AS most,
      round(avg(frequency), 6) AS mean, count(DISTINCT {LABEL}) AS labels, count_if(frequency > 1) AS repeated FROM {_F}""",
}
