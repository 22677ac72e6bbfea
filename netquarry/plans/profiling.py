"""Queries of table profiles, with values made missing or infinite by rule so that those paths count."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile
from .common import FEATURES, LABEL, SOURCE, table


def _rows(spark, d):
    """lineitem with nulls, NaNs and infinities in l_tax and l_discount."""
    r = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", *FEATURES, LABEL, SOURCE)
    k = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(50))
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return r.withColumn("l_tax", F.when(k == 0, None).when(k == 1, nan).when(k == 2, inf).when(k == 3, -inf).otherwise(F.col("l_tax"))).withColumn(
        "l_discount", F.when(k == 4, None).otherwise(F.col("l_discount"))
    )


def null_counts(spark, d):
    return profile.gaps(_rows(spark, d), FEATURES)


def column_moments(spark, d):
    return profile.moments(_rows(spark, d), FEATURES)


def column_quantiles(spark, d):
    return profile.quantiles(_rows(spark, d), FEATURES)


def iqr_outliers(spark, d):
    return profile.iqr_outliers(_rows(spark, d), FEATURES, 0.5)


def duplicate_rows(spark, d):
    return profile.duplicates(table(spark, d, "lineitem", "l_quantity", "l_discount", "l_tax", LABEL), ["l_quantity", "l_discount", "l_tax", LABEL])


def correlation_pairs(spark, d):
    return profile.correlations(_rows(spark, d), FEATURES)


def strong_correlations(spark, d):
    r = _rows(spark, d).withColumn("double_quantity", F.col("l_quantity") * 2 + 1)
    return profile.correlations(r, ["l_quantity", "double_quantity", "l_tax"], 0.9)


def source_crosstab(spark, d):
    return profile.crosstab(table(spark, d, "lineitem", LABEL, SOURCE), SOURCE, LABEL, ["A", "N", "R"])


def label_value_counts(spark, d):
    return profile.value_counts(table(spark, d, "lineitem", LABEL), LABEL)


def group_summary(spark, d):
    return profile.group_summary(_rows(spark, d), [LABEL], FEATURES)


def binary_group_medians(spark, d):
    r = _rows(spark, d)
    return profile.median_differences(r, profile.binary_label(F.when(F.col(LABEL) == "N", " Benign ").otherwise(F.col(LABEL))) == "Attack", FEATURES)


def trimmed_rows(spark, d):
    t = profile.trimmed(table(spark, d, "lineitem", "l_extendedprice", LABEL), "l_extendedprice")
    return t.groupBy(LABEL).agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))


def imputation_medians(spark, d):
    return profile.medians(_rows(spark, d), FEATURES)


def scaler_parameters(spark, d):
    return profile.scaler(_rows(spark, d), FEATURES)


QUERIES = {f.__name__: f for f in (
    null_counts, column_moments, column_quantiles, iqr_outliers, duplicate_rows, correlation_pairs, strong_correlations, source_crosstab,
    label_value_counts, group_summary, binary_group_medians, trimmed_rows, imputation_medians, scaler_parameters,
)}

_K = "((l_orderkey + l_linenumber) % 50)"
_R = f"""(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, CASE WHEN {_K} = 4 THEN NULL ELSE l_discount END AS l_discount,
  CASE {_K} WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE WHEN 3 THEN '-inf'::DOUBLE ELSE l_tax END AS l_tax, {LABEL}, {SOURCE} FROM lineitem)"""
_LONG = "(" + " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS raw, CASE WHEN isfinite({c}) THEN {c} END AS x, {LABEL} AS g FROM {_R}" for c in FEATURES) + ")"
_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM {_R} WHERE isfinite({a}) AND isfinite({b})" for a, b in _PAIRS)
_QS = ", ".join(f"round(quantile_cont(x, {q}), 6) AS p{round(q * 100):02d}" for q in profile.QUANTILES)

ORACLE = {
    "null_counts": f"""SELECT name, count(*) AS rows, count_if(raw IS NULL) AS nulls, count_if(coalesce(isnan(raw), false)) AS nans,
      count_if(coalesce(isinf(raw), false)) AS infinite FROM {_LONG} GROUP BY name""",
    "column_moments": f"""SELECT name, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS deviation, min(x) AS least, max(x) AS most, count(DISTINCT x) AS "distinct",
      count_if(coalesce(x = 0, false)) AS zeros, round(count_if(coalesce(x = 0, false)) / count(x), 6) AS zero_share FROM {_LONG} GROUP BY name""",
    "column_quantiles": f"SELECT name, {_QS} FROM {_LONG} GROUP BY name",
    "iqr_outliers": f"""WITH q AS (SELECT name, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM {_LONG} GROUP BY name)
      SELECT name, round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, round(any_value(q1 - 0.5 * (q3 - q1)), 6) AS low,
      round(any_value(q3 + 0.5 * (q3 - q1)), 6) AS high, count_if(coalesce(x < q1 - 0.5 * (q3 - q1), false)) AS below,
      count_if(coalesce(x > q3 + 0.5 * (q3 - q1), false)) AS above,
      round(count_if(coalesce(x < q1 - 0.5 * (q3 - q1) OR x > q3 + 0.5 * (q3 - q1), false)) / count(x), 6) AS share
      FROM {_LONG} JOIN q USING (name) GROUP BY name""",
    "duplicate_rows": f"""SELECT sum(n)::BIGINT AS rows, count(*) AS distinct_rows, (sum(n) - count(*))::BIGINT AS duplicate_rows
      FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax, {LABEL})""",
    "correlation_pairs": _CORR,
    "strong_correlations": f"SELECT 'l_quantity' AS a, 'double_quantity' AS b, round(corr(l_quantity, l_quantity * 2 + 1), 6) AS r FROM {_R}",
    "source_crosstab": f"""SELECT {SOURCE}, {", ".join(f"count_if({LABEL} = '{v}') AS n_{v}" for v in "ANR")}, count(*) AS total,
      {", ".join(f"round(count_if({LABEL} = '{v}') / count(*), 6) AS share_{v}" for v in "ANR")} FROM lineitem GROUP BY {SOURCE}""",
    "label_value_counts": f"""SELECT {LABEL} AS value, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share,
      round(count(*) / max(count(*)) OVER (), 6) AS to_majority FROM lineitem GROUP BY {LABEL}""",
    "group_summary": f"""SELECT g AS {LABEL}, name, count(x) AS "count", round(avg(x), 6) AS mean, round(median(x), 6) AS median,
      round(stddev_samp(x), 6) AS deviation FROM {_LONG} GROUP BY g, name""",
    "binary_group_medians": f"""SELECT name, round(n, 6) AS negative_median, round(p, 6) AS positive_median, round(p - n, 6) AS difference,
      round((p - n) / nullif(abs(n), 0), 6) AS relative FROM (SELECT name, median(CASE WHEN g = 'N' THEN x END) AS n, median(CASE WHEN g <> 'N' THEN x END) AS p
      FROM {_LONG} GROUP BY name)""",
    "trimmed_rows": f"""SELECT {LABEL}, count(*) AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem,
      (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)
      WHERE l_extendedprice BETWEEN lo AND hi GROUP BY {LABEL}""",
    "imputation_medians": f"SELECT name, round(median(x), 6) AS median FROM {_LONG} GROUP BY name",
    "scaler_parameters": f"SELECT name, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation FROM {_LONG} GROUP BY name",
}
