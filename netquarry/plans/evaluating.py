"""Queries of tests and evaluation. Two deterministic predictors over lineitem stand for classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import evaluation, statistics
from .common import FEATURES, LABEL, table

#: The classes in order.
CLASSES = ["A", "N", "R"]


def _predicted(spark, d):
    """truth, a, b (class numbers), y (class 1 or not), p and q (probabilities of 1 in thousandths)."""
    r = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", LABEL)
    truth = F.array_position(F.array(*map(F.lit, CLASSES)), F.col(LABEL)).cast("int") - 1
    k = F.col("l_orderkey") * 31 + F.col("l_linenumber")
    a = F.when(F.pmod(k, F.lit(10)) < 7, truth).otherwise(F.pmod(truth + 1, F.lit(3)))
    b = F.when(F.pmod(k, F.lit(7)) < 5, truth).otherwise(F.pmod(truth + 2, F.lit(3)))
    y = (truth == 1).cast("int")
    p = (F.pmod(F.col("l_partkey") * 17 + F.col("l_linenumber"), F.lit(600)) + 400 * y) / 1000.0
    q = (F.pmod(F.col("l_suppkey") * 13 + F.col("l_orderkey"), F.lit(800)) + 200 * y) / 1000.0
    return r.select("l_orderkey", "l_linenumber", truth.alias("truth"), a.alias("a"), b.alias("b"), y.alias("y"), p.alias("p"), q.alias("q"))


def confusion_matrix(spark, d):
    return evaluation.confusion(_predicted(spark, d), "truth", "a")


def misclassifications(spark, d):
    return evaluation.misclassified(confusion_matrix(spark, d))


def class_metrics(spark, d):
    return evaluation.per_class(confusion_matrix(spark, d))


def overall_metrics(spark, d):
    return evaluation.overall(class_metrics(spark, d))


def classification_report(spark, d):
    return evaluation.report(class_metrics(spark, d))


def binary_metrics(spark, d):
    return evaluation.binary(_predicted(spark, d), "y", "p", 0.5)


def ranking_metrics(spark, d):
    return evaluation.ranking(_predicted(spark, d), "y", "p")


def calibration_bins(spark, d):
    return evaluation.calibration(_predicted(spark, d), "y", "p")


def calibration_error(spark, d):
    return evaluation.calibration_error(_predicted(spark, d), "y", "p")


def threshold_grid(spark, d):
    return evaluation.threshold_grid(_predicted(spark, d), "y", "p", [i / 20 for i in range(1, 20)])


def best_threshold(spark, d):
    return evaluation.best_threshold(threshold_grid(spark, d)).select("threshold", "f1", "recall", "fpr")


def model_disagreement(spark, d):
    return evaluation.disagreement(_predicted(spark, d), "truth", "a", "b")


def soft_vote(spark, d):
    """Votes of two predictors with weights 80 and 20, and the class that wins."""
    r = _predicted(spark, d)
    both = numeric.soft_vote(F.array(1 - F.col("p"), F.col("p")), F.array(1 - F.col("q"), F.col("q")), 0.8)
    v = r.select("y", both.alias("v"))
    return v.groupBy(numeric.argmax(F.col("v")).alias("winner"), "y").agg(F.count("*").alias("n"), F.round(F.avg(F.col("v")[1]), 6).alias("mean"))


def evidence_rows(spark, d):
    r = _predicted(spark, d)
    one = evaluation.evidence(F.array(1 - F.col("p"), F.col("p")), ["Benign", "Attack"], "Benign")
    e = r.select("l_orderkey", "l_linenumber", one.alias("e"))
    return e.select("l_orderkey", "l_linenumber", "e.predicted_class", "e.class_id", F.round("e.confidence", 6).alias("confidence"), F.round("e.threat_score", 6).alias("threat_score"))


def softmax_scores(spark, d):
    r = table(spark, d, "embeddings", "vec_id", "embedding")
    s = numeric.softmax(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")))
    return r.select("vec_id", numeric.argmax(s).alias("winner"), F.round(F.array_max(s), 6).alias("top"))


def int8_codes(spark, d):
    r = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    q = numeric.quantised(F.col("l_quantity"), 0.25, -60)
    return r.groupBy(q.cast("int").alias("code")).agg(F.count("*").alias("n"), F.round(F.max(numeric.dequantised(q, 0.25, -60)), 6).alias("back"))


def standardised_features(spark, d):
    r = table(spark, d, "lineitem", "l_quantity", LABEL)
    return r.groupBy(LABEL).agg(F.round(F.sum(numeric.standardised(F.col("l_quantity"), 25.5, 14.43)), 3).alias("total"))


def mann_whitney(spark, d):
    m = statistics.mann_whitney(table(spark, d, "lineitem", *FEATURES, LABEL), FEATURES, LABEL, "N", "R")
    return m.select("name", "n1", "n2", F.round("u1", 1).alias("u1"), F.round("z", 6).alias("z"), F.round("effect", 6).alias("effect"), "size")


def kruskal_wallis(spark, d):
    k = statistics.kruskal_wallis(table(spark, d, "lineitem", *FEATURES, LABEL), FEATURES, LABEL)
    return k.select("name", "groups", "n", F.round("h", 5).alias("h"), F.round("epsilon_squared", 6).alias("epsilon_squared"), "size")


def rank_test_p_values(spark, d):
    """Both tests' p values, adjusted together: no SQL twin."""
    r = table(spark, d, "lineitem", *FEATURES, LABEL)
    a = statistics.mann_whitney(r, FEATURES, LABEL, "N", "R").select(F.concat(F.lit("mann_whitney:"), "name").alias("name"), "p")
    b = statistics.kruskal_wallis(r, FEATURES, LABEL).select(F.concat(F.lit("kruskal_wallis:"), "name").alias("name"), "p")
    return statistics.false_discovery(a.unionByName(b))


def false_discovery_rates(spark, d):
    """Benjamini-Hochberg over stand-in p values: each part brand's share of small sizes."""
    p = table(spark, d, "part", "p_brand", "p_size").groupBy(F.col("p_brand").alias("name"))
    p = p.agg((F.count_if(F.col("p_size") <= 5) / F.count("*")).alias("p"))
    return statistics.false_discovery(p, 0.2).select("name", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), "significant")


QUERIES = {f.__name__: f for f in (
    confusion_matrix, misclassifications, class_metrics, overall_metrics, classification_report, binary_metrics, ranking_metrics, calibration_bins,
    calibration_error, threshold_grid, best_threshold, model_disagreement, soft_vote, evidence_rows, softmax_scores, int8_codes, standardised_features,
    mann_whitney, kruskal_wallis, rank_test_p_values, false_discovery_rates,
)}

_K = "(l_orderkey * 31 + l_linenumber)"
_R = f"""(SELECT *, CASE WHEN {_K} % 10 < 7 THEN truth ELSE (truth + 1) % 3 END AS a, CASE WHEN {_K} % 7 < 5 THEN truth ELSE (truth + 2) % 3 END AS b,
  (truth = 1)::INT AS y, ((l_partkey * 17 + l_linenumber) % 600 + 400 * (truth = 1)::INT) / 1000.0::DOUBLE AS p,
  ((l_suppkey * 13 + l_orderkey) % 800 + 200 * (truth = 1)::INT) / 1000.0::DOUBLE AS q
  FROM (SELECT *, list_position(['A', 'N', 'R'], {LABEL}) - 1 AS truth FROM lineitem))"""
_CM = f"(SELECT truth, a AS predicted, count(*) AS n FROM {_R} GROUP BY ALL)"
_PC = f"""(SELECT label, tp, claimed - tp AS fp, support - tp AS fn, support, round(coalesce(tp / nullif(claimed, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(claimed + support, 0), 0), 6) AS f1 FROM (
  SELECT c AS label, sum(CASE WHEN truth = c AND predicted = c THEN n ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN truth = c THEN n ELSE 0 END)::BIGINT AS support,
  sum(CASE WHEN predicted = c THEN n ELSE 0 END)::BIGINT AS claimed FROM {_CM}, (SELECT unnest([0, 1, 2]) AS c) GROUP BY c))"""
_GRID = f"""(SELECT t AS threshold, tp, fp, fn, tn, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(tp / nullif(tp + fn, 0), 6) AS recall,
  round(fp / nullif(fp + tn, 0), 6) AS fpr FROM (SELECT t, count_if(y = 1 AND p >= t) AS tp, count_if(y = 0 AND p >= t) AS fp, count_if(y = 1 AND p < t) AS fn,
  count_if(y = 0 AND p < t) AS tn FROM {_R}, (SELECT unnest([{", ".join(f"{i / 20!r}::DOUBLE" for i in range(1, 20))}]) AS t) GROUP BY t))"""
_LONG = "(" + " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS x, {LABEL} AS g FROM lineitem" for c in FEATURES) + ")"
_RANKED = """(SELECT *, min_rank + (ties - 1) / 2 AS mid FROM (SELECT *, rank() OVER (PARTITION BY name ORDER BY x) AS min_rank,
  count(*) OVER (PARTITION BY name, x) AS ties FROM {}))"""
_MW = _RANKED.format(f"(SELECT * FROM {_LONG} WHERE g IN ('N', 'R'))")
_KW = _RANKED.format(_LONG)
_SIZE = "CASE WHEN abs({e}) >= {a} THEN 'large' WHEN abs({e}) >= {b} THEN 'medium' WHEN abs({e}) >= {c} THEN 'small' ELSE 'negligible' END"
_BINS = f"""(SELECT bin, bin / 10 AS lower, count(*) AS n, round(avg(p), 6) AS mean_probability, round(avg(y), 6) AS positive_share
  FROM (SELECT *, (CASE {" ".join(f"WHEN p >= {i / 10!r} THEN {i}" for i in range(9, 0, -1))} ELSE 0 END)::INT AS bin FROM {_R}) GROUP BY bin)"""

ORACLE = {
    "confusion_matrix": f"SELECT * FROM {_CM}",
    "misclassifications": f"""SELECT * FROM (SELECT truth, predicted, n, round(n / sum(n) OVER (PARTITION BY truth), 6) AS share FROM {_CM}) WHERE truth <> predicted""",
    "class_metrics": f"SELECT * FROM {_PC}",
    "overall_metrics": f"""SELECT sum(support)::BIGINT AS rows, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision,
      round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM {_PC}""",
    "classification_report": f"""SELECT label::VARCHAR AS label, precision, recall, f1, support FROM {_PC}
      UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM {_PC}
      UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
      round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM {_PC}""",
    "binary_metrics": f"""SELECT n, tn, fp, fn, tp, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
      round(fp / (fp + tn), 6) AS fpr, round(fn / (fn + tp), 6) AS fnr, brier FROM (SELECT count(*) AS n, count_if(y = 0 AND p < 0.5) AS tn,
      count_if(y = 0 AND p >= 0.5) AS fp, count_if(y = 1 AND p < 0.5) AS fn, count_if(y = 1 AND p >= 0.5) AS tp, round(avg((p - y) ** 2), 6) AS brier FROM {_R})""",
    "ranking_metrics": f"""WITH s AS (SELECT p, count(*) AS n, sum(y) AS pos FROM {_R} GROUP BY p),
      c AS (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS seen_pos FROM s WINDOW w AS (ORDER BY p DESC))
      SELECT round(sum(pos * seen_pos / seen) / sum(pos), 6) AS average_precision,
      round(1 - sum(pos * (seen - seen_pos - (n - pos) + (n - pos) / 2)) / (sum(pos) * sum(n - pos)), 6) AS roc_auc FROM c""",
    "calibration_bins": f"SELECT * FROM {_BINS}",
    "calibration_error": f"SELECT round(sum(n * abs(mean_probability - positive_share)) / sum(n), 6) AS ece FROM {_BINS}",
    "threshold_grid": f"SELECT * FROM {_GRID}",
    "best_threshold": f"SELECT threshold, f1, recall, fpr FROM {_GRID} ORDER BY f1 DESC, recall DESC, fpr, abs(threshold - 0.5) LIMIT 1",
    "model_disagreement": f"""SELECT truth, count(*) AS rows, count_if(a = truth AND b = truth) AS both_right, count_if(a = truth AND b <> truth) AS a_only,
      count_if(a <> truth AND b = truth) AS b_only, count_if(a <> truth AND b <> truth) AS neither, round(avg((a = b)::INT), 6) AS agreement FROM {_R} GROUP BY truth""",
    "soft_vote": f"""SELECT (v1 > v0)::INT AS winner, y, count(*) AS n, round(avg(v1), 6) AS mean FROM (SELECT y, p * 0.8::DOUBLE + q * (1 - 0.8::DOUBLE) AS v1,
      (1 - p) * 0.8::DOUBLE + (1 - q) * (1 - 0.8::DOUBLE) AS v0 FROM {_R}) GROUP BY ALL""",
    "evidence_rows": f"""SELECT l_orderkey, l_linenumber, CASE WHEN p > 1 - p THEN 'Attack' ELSE 'Benign' END AS predicted_class, (p > 1 - p)::INT AS class_id,
      round(greatest(p, 1 - p), 6) AS confidence, round(1 - (1 - p), 6) AS threat_score FROM {_R}""",
    "softmax_scores": """SELECT vec_id, (list_position(e, list_max(e)) - 1)::INT AS winner, round(1 / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))), 6) AS top
      FROM (SELECT vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS e FROM embeddings)""",
    "int8_codes": """SELECT code, count(*) AS n, round(max((code + 60) * 0.25::DOUBLE), 6) AS back FROM (SELECT greatest(-128, least(127,
      round_even(l_quantity / 0.25, 0) - 60))::INT AS code FROM lineitem) GROUP BY code""",
    "standardised_features": f"SELECT {LABEL}, round(sum((l_quantity - 25.5::DOUBLE) / 14.43::DOUBLE), 3) AS total FROM lineitem GROUP BY {LABEL}",
    "mann_whitney": f"""WITH r AS (SELECT * FROM {_MW}), s AS (SELECT name, count_if(g = 'N') AS n1, count_if(g = 'R') AS n2, sum(CASE WHEN g = 'N' THEN mid END) AS r1,
      sum(ties::DOUBLE * ties - 1) AS tie_sum FROM r GROUP BY name), u AS (SELECT *, (n1 + n2)::DOUBLE AS n, r1 - n1 * (n1 + 1) / 2 AS u1 FROM s)
      SELECT name, n1, n2, round(u1, 1) AS u1, round((greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - tie_sum / (n * (n - 1)))), 6) AS z,
      round(2 * u1 / (n1 * n2) - 1, 6) AS effect, {_SIZE.format(e="(2 * u1 / (n1 * n2) - 1)", a=0.5, b=0.3, c=0.1)} AS size FROM u""",
    "kruskal_wallis": f"""WITH r AS (SELECT * FROM {_KW}), g AS (SELECT name, g, count(*) AS n, sum(mid) AS r FROM r GROUP BY name, g),
      t AS (SELECT name, sum(ties::DOUBLE * ties - 1) AS tie_sum, count(*)::DOUBLE AS n FROM r GROUP BY name),
      s AS (SELECT name, count(*) AS groups, sum(r * r / n) AS s FROM g GROUP BY name),
      h AS (SELECT name, groups, n, greatest(0, (12 * s / (n * (n + 1)) - 3 * (n + 1)) / (1 - tie_sum / (n * n * n - n))) AS h FROM s JOIN t USING (name)),
      e AS (SELECT *, greatest(0, (h - groups + 1) / (n - groups)) AS e FROM h)
      SELECT name, groups, n::BIGINT AS n, round(h, 5) AS h, round(e, 6) AS epsilon_squared, {_SIZE.format(e="e", a=0.14, b=0.06, c=0.01)} AS size FROM e""",
    "false_discovery_rates": """WITH p AS (SELECT p_brand AS name, count_if(p_size <= 5) / count(*) AS p FROM part GROUP BY p_brand),
      s AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS s FROM p),
      q AS (SELECT *, least(1, min(s) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM s)
      SELECT name, round(p, 6) AS p, round(q, 6) AS q, q <= 0.2 AS significant FROM q""",
}
