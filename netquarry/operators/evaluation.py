"""Evaluation of classifiers: every measure from counts by distinct key, so scores of any number of rows never meet in
one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio_or_null, ratio_or_zero


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """truth, predicted, n: the cells that occur."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def misclassified(cells: DataFrame) -> DataFrame:
    """Off-diagonal cells with their share of the true class, the most frequent first."""
    support = F.sum("n").over(Window.partitionBy("truth"))
    out = cells.withColumn("share", F.round(F.col("n") / support, 6)).where("truth <> predicted")
    return out.orderBy(F.desc("n"), "truth", "predicted")


def per_class(cells: DataFrame) -> DataFrame:
    """label, tp, fp, fn, support, precision, recall, f1 (0 where undefined), of every class that is true or predicted."""
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed")),
    )
    hit = F.col("truth") == F.col("predicted")
    rows = cells.select(F.when(hit, F.col("n")).otherwise(0).alias("hit"), F.inline(sides))
    # a cell gives two rows, so each hit is counted twice
    out = rows.groupBy("label").agg((F.sum("hit") / 2).cast("long").alias("tp"), F.sum("support").alias("support"), F.sum("claimed").alias("claimed"))
    out = out.withColumns({"fp": F.col("claimed") - F.col("tp"), "fn": F.col("support") - F.col("tp")})
    p, r = ratio_or_zero(F.col("tp"), F.col("claimed")), ratio_or_zero(F.col("tp"), F.col("support"))
    f1 = ratio_or_zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return out.select("label", "tp", "fp", "fn", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def overall(classes: DataFrame) -> DataFrame:
    """rows, accuracy, macro precision, recall and f1, weighted f1: of per_class()."""
    s = F.sum("support")
    return classes.agg(
        s.alias("rows"),
        F.round(ratio_or_zero(F.sum("tp"), s), 6).alias("accuracy"),
        *[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        F.round(ratio_or_zero(F.sum(F.col("f1") * F.col("support")), s), 6).alias("weighted_f1"),
    )


def report(classes: DataFrame) -> DataFrame:
    """per_class() with rows for the macro and the weighted averages below."""
    avg = lambda c: F.round(F.avg(c), 6)
    mean = classes.agg(F.sum("support").alias("support"), avg("precision").alias("precision"), avg("recall").alias("recall"), avg("f1").alias("f1"))
    w = lambda c: F.round(ratio_or_zero(F.sum(F.col(c) * F.col("support")), F.sum("support")), 6).alias(c)
    by_size = classes.agg(F.sum("support").alias("support"), w("precision"), w("recall"), w("f1"))
    named = lambda d, n: d.select(F.lit(n).alias("label"), "precision", "recall", "f1", "support")
    rows = classes.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    return rows.unionByName(named(mean, "macro avg")).unionByName(named(by_size, "weighted avg"))


def binary(df: DataFrame, y: str, p: str, threshold: float) -> DataFrame:
    """One row: n, tn, fp, fn, tp, precision, recall, f1, fpr, fnr (null where undefined), brier, with p >= threshold as
    positive. Rows whose y isn't 0 or 1 or whose p isn't within 0 and 1 don't count."""
    good = df.where(F.col(y).isin(0, 1) & F.col(p).between(0, 1))
    hit = lambda a, b: F.count_if((F.col(y) == a) & ((F.col(p) >= threshold) == F.lit(b)))
    c = good.agg(
        F.count("*").alias("n"), hit(0, False).alias("tn"), hit(0, True).alias("fp"), hit(1, False).alias("fn"), hit(1, True).alias("tp"),
        F.round(F.avg((F.col(p) - F.col(y)) ** 2), 6).alias("brier"),
    )
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    r = lambda a, b, n: F.round(ratio_or_null(a, b), 6).alias(n)
    return c.select(
        "n", "tn", "fp", "fn", "tp", r(tp, tp + fp, "precision"), r(tp, tp + fn, "recall"), r(2 * tp, 2 * tp + fp + fn, "f1"),
        r(fp, fp + tn, "fpr"), r(fn, fn + tp, "fnr"), "brier",
    )


def _steps(df: DataFrame, y: str, p: str) -> DataFrame:
    """By distinct score, descending: rows, positives, and both so far. The window runs over distinct scores; scores are cut
    into RANGES ranges first, whose totals carry over, so that no task holds them all."""
    per = df.where(F.col(y).isin(0, 1) & F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("score"))
    per = per.agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("pos")).withColumn("range", F.floor(F.col("score") * RANGES))
    totals = per.groupBy("range").agg(F.sum("n").alias("tn"), F.sum("pos").alias("tpos"))
    before = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # over RANGES rows
    carried = totals.select("range", F.coalesce(F.sum("tn").over(before), F.lit(0)).alias("cn"), F.coalesce(F.sum("tpos").over(before), F.lit(0)).alias("cpos"))
    within = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = per.withColumns({"wn": F.sum("n").over(within), "wpos": F.sum("pos").over(within)}).join(carried, "range")
    return out.select("score", "n", "pos", (F.col("cn") + F.col("wn")).alias("seen"), (F.col("cpos") + F.col("wpos")).alias("seen_pos"))


RANGES = 1000


def ranking(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: average precision (a step for each distinct score) and the area under the ROC curve (by midranks); null
    unless both classes occur."""
    s = _steps(df, y, p)
    neg = F.col("n") - F.col("pos")
    above = F.col("seen") - F.col("seen_pos") - neg  # negatives of higher scores
    out = s.agg(
        F.sum("pos").alias("p"), F.sum(neg).alias("q"),
        F.sum(F.col("pos") * F.col("seen_pos") / F.col("seen")).alias("ap"), F.sum(F.col("pos") * (above + neg / 2)).alias("lost"),
    )
    both = (F.col("p") > 0) & (F.col("q") > 0)
    return out.select(
        F.when(both, F.round(F.try_divide(F.col("ap"), F.col("p")), 6)).alias("average_precision"),
        F.when(both, F.round(1 - F.try_divide(F.col("lost"), F.col("p") * F.col("q")), 6)).alias("roc_auc"),
    )


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """bin, lower, n, mean_probability, positive_share, of the bins that have rows; [i / bins, (i + 1) / bins), the last
    closed. The edges are compared as doubles, not multiplied out."""
    place = F.lit(0)
    for i in range(1, bins):
        place = F.when(F.col(p) >= i / bins, i).otherwise(place)
    good = df.where(F.col(y).isin(0, 1) & F.col(p).between(0, 1)).withColumn("bin", place)
    return good.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_probability"), F.avg(F.col(y).cast("double")).alias("positive_share")).select(
        "bin", (F.col("bin") / bins).alias("lower"), "n", F.round("mean_probability", 6).alias("mean_probability"), F.round("positive_share", 6).alias("positive_share")
    )


def calibration_error(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """One row: the expected calibration error."""
    c = calibration(df, y, p, bins)
    return c.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_probability") - F.col("positive_share"))) / F.sum("n"), 6).alias("ece"))


def threshold_grid(df: DataFrame, y: str, p: str, thresholds: Sequence[float]) -> DataFrame:
    """threshold, tp, fp, fn, tn, f1, recall, fpr of each, in one pass: a row counts once, below the thresholds it reaches."""
    ordered = sorted(thresholds)
    place = F.lit(0)
    for i, t in enumerate(ordered, 1):
        place = F.when(F.col(p) >= t, i).otherwise(place)
    per = df.where(F.col(y).isin(0, 1) & F.col(p).isNotNull()).groupBy(place.alias("reached")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg")
    )
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(ordered, 1)])
    rows = per.select("reached", "pos", "neg", F.inline(grid))
    hit = F.col("reached") >= F.col("i")
    out = rows.groupBy("threshold").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"), F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("tn"),
    )
    r = lambda a, b: F.round(ratio_or_null(a, b), 6)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"f1": r(2 * tp, 2 * tp + fp + fn), "recall": r(tp, tp + fn), "fpr": r(fp, fp + tn)})


def best_threshold(grid: DataFrame) -> DataFrame:
    """The row of highest f1; then highest recall, lowest fpr, nearest to one half."""
    key = F.struct("f1", "recall", -F.col("fpr"), -F.abs(F.col("threshold") - 0.5))
    return grid.agg(F.max_by(F.struct(*grid.columns), key).alias("b")).select("b.*")


def disagreement(df: DataFrame, truth: str, a: str, b: str) -> DataFrame:
    """By true class: rows, both_right, a_only, b_only, neither, and how often a and b say the same."""
    ra, rb = F.col(a) == F.col(truth), F.col(b) == F.col(truth)
    return df.groupBy(F.col(truth).alias("truth")).agg(
        F.count("*").alias("rows"), F.count_if(ra & rb).alias("both_right"), F.count_if(ra & ~rb).alias("a_only"),
        F.count_if(~ra & rb).alias("b_only"), F.count_if(~ra & ~rb).alias("neither"),
        F.round(F.avg((F.col(a) == F.col(b)).cast("double")), 6).alias("agreement"),
    )


def evidence(probabilities: Column, names: Sequence[str], benign: str) -> Column:
    """Struct of a prediction: predicted_class, class_id, confidence, threat_score (1 - P(benign)), class_probabilities;
    null unless the probabilities are as many as the names and sum to 1 within 1e-5."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda s, x: s + x)
    at = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    listed = F.array(*map(F.lit, names))
    out = F.struct(
        F.element_at(listed, at).alias("predicted_class"), (at - 1).alias("class_id"), F.array_max(probabilities).alias("confidence"),
        (1 - F.element_at(probabilities, list(names).index(benign) + 1)).alias("threat_score"),
        F.transform(F.arrays_zip(listed.alias("l"), probabilities.alias("p")), lambda z: F.struct(z["l"].alias("label"), z["p"].alias("probability"))).alias("class_probabilities"),
    )
    return F.when((F.size(probabilities) == len(names)) & (F.abs(total - 1) <= 1e-5), out)
