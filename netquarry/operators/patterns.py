"""Feature patterns of labelled flows: frequencies, conflicts between labels, weights, splits and samples.

Grouping treats nulls as equal to each other, as NaNs and zeros of either sign: a pattern is a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feature_columns(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    """All columns but the excluded ones, in order."""
    return [c for c in df.columns if c not in set(excluded)]


def projected(df: DataFrame, names: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """The named features in the given order, then others; names may hold spaces and signs."""
    if missing := [c for c in (*names, *also) if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*[df[f"`{c.replace('`', '``')}`"] for c in (*names, *also)])


def frequencies(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """features, label, frequency: how often each pattern occurs with each label."""
    return df.groupBy(*features, label).agg(F.count("*").alias("frequency"))


def unique_patterns(df: DataFrame, features: Sequence[str], label: str, metadata: Sequence[str], order: str) -> DataFrame:
    """One row for each pattern and label, with the metadata of its row that comes first by order."""
    first = F.min(F.struct(order, *metadata)).alias("_first")
    out = df.groupBy(*features, label).agg(first, F.count("*").alias("frequency"))
    return out.select(*features, label, *[F.col(f"_first.{c}").alias(c) for c in metadata], "frequency")


def reaggregated(patterns: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Patterns over fewer features; frequencies add up."""
    return patterns.groupBy(*features, label).agg(F.sum("frequency").alias("frequency"))


def conflict_details(patterns: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One row for each pattern and pair of labels that share it: label_a < label_b, frequency_a, frequency_b, majority
    (null on a tie).

    A single grouping gathers a pattern's labels, of which there are as many as classes at most; no self-join.
    """
    labels = F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col("frequency").alias("f")))).alias("_ls")
    grouped = patterns.where(F.col(label).isNotNull()).groupBy(*features).agg(labels).where(F.size("_ls") > 1)
    pairs = F.expr("flatten(transform(_ls, (x, i) -> transform(slice(_ls, i + 2, size(_ls)), y -> struct(x AS a, y AS b))))")
    out = grouped.select(*features, F.explode(pairs).alias("_p"))
    a, b = F.col("_p.a.f"), F.col("_p.b.f")
    return out.select(
        *features,
        F.col("_p.a.l").alias("label_a"),
        F.col("_p.b.l").alias("label_b"),
        a.alias("frequency_a"),
        b.alias("frequency_b"),
        F.when(a > b, F.col("_p.a.l")).when(b > a, F.col("_p.b.l")).alias("majority"),
    )


def conflict_summary(details: DataFrame) -> DataFrame:
    """By pair of labels: patterns, rows of each, total, the rows that a classifier of patterns must lose at least,
    the largest pattern, and ratios."""
    total = F.sum(F.col("frequency_a") + F.col("frequency_b"))
    lost = F.sum(F.least("frequency_a", "frequency_b"))
    return details.groupBy("label_a", "label_b").agg(
        F.count("*").alias("patterns"),
        F.sum("frequency_a").alias("rows_a"),
        F.sum("frequency_b").alias("rows_b"),
        total.alias("total_rows"),
        lost.alias("minority_rows"),
        F.max(F.col("frequency_a") + F.col("frequency_b")).alias("largest"),
        F.round(lost / total, 6).alias("ambiguity"),
    )


def conflicting_patterns(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Patterns with more than one label: features, labels, rows."""
    out = df.groupBy(*features).agg(F.countDistinct(label).alias("labels"), F.count("*").alias("rows"))
    return out.where("labels > 1")


def class_weights(patterns: DataFrame, label: str) -> DataFrame:
    """By label: patterns, rows, and the effective size of a class when a pattern weighs 1, ln(1 + f), sqrt(f) or f;
    its share of the largest class's rows and the compression from rows to patterns."""
    f = F.col("frequency")
    out = patterns.groupBy(label).agg(
        F.count("*").alias("patterns"), F.sum(f).alias("rows"), F.min(f).alias("least"), F.max(f).alias("most"),
        F.sum(F.log1p(f)).alias("by_log"), F.sum(F.sqrt(f.cast("double"))).alias("by_root"),
    )
    top = out.agg(F.max("rows").alias("top_rows"))
    return out.crossJoin(F.broadcast(top)).select(  # one row
        label, "patterns", "rows", "least", "most", F.round("by_log", 4).alias("by_log"), F.round("by_root", 4).alias("by_root"),
        F.round(F.col("rows") / F.col("patterns"), 6).alias("compression"), F.round(F.col("rows") / F.col("top_rows"), 6).alias("to_majority"),
    )


def weighted(patterns: DataFrame, label: str, boosts: dict, common=None, common_rows: int | None = None) -> DataFrame:
    """Adds sample_weight: the root of the frequency, times boosts[label]. If the class common has been cut to common_rows
    patterns, its weights are raised by the share that was cut (sampled() cuts)."""
    w = F.sqrt(F.col("frequency").cast("double"))
    for key, factor in boosts.items():
        w = w * F.when(F.col(label) == F.lit(key), F.lit(float(factor))).otherwise(1.0)
    if common is None:
        return patterns.withColumn("sample_weight", w)
    size = patterns.where(F.col(label) == F.lit(common)).agg(F.count("*").alias("_n"))
    kept = sampled(patterns, label, {common: common_rows}, [c for c in patterns.columns if c != "frequency"])
    raised = F.when(F.col(label) == F.lit(common), F.greatest(F.lit(1.0), F.col("_n") / F.lit(float(common_rows)))).otherwise(1.0)
    return kept.crossJoin(F.broadcast(size)).withColumn("sample_weight", w * raised).drop("_n")  # one row


def bucket(columns: Sequence[str], buckets: int = 100) -> Column:
    """Which of some buckets a row's values fall into, by a hash of the given columns only."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def split_name(bucket_: Column, train: int = 70, validation: int = 15) -> Column:
    return F.when(bucket_ < train, "train").when(bucket_ < train + validation, "validation").otherwise("test")


def split_by_pattern(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds split: by a hash of the features alone, so that equal patterns never part."""
    return df.withColumn("split", split_name(bucket(features)))


def split_counts(df: DataFrame, label: str) -> DataFrame:
    """By label: rows of each split, total, their shares, and whether a split has none."""
    names = ("train", "validation", "test")
    out = df.groupBy(label).agg(*[F.count_if(F.col("split") == n).alias(n) for n in names], F.count("*").alias("total"))
    shares = {f"{n}_share": F.round(F.col(n) / F.col("total"), 6) for n in names}
    return out.withColumns(shares).withColumn("lacking", F.least(*names) == 0)


def leakage(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Patterns and rows that are in more than one split, over all and by pair of splits, in one grouping."""
    sides = [F.count_if(F.col("split") == n).alias(n) for n in ("train", "validation", "test")]
    per = df.groupBy(*features).agg(*sides)
    both = lambda a, b: F.count_if((F.col(a) > 0) & (F.col(b) > 0))
    return per.agg(
        F.count("*").alias("patterns"),
        both("train", "validation").alias("train_validation"),
        both("train", "test").alias("train_test"),
        both("validation", "test").alias("validation_test"),
    )


def first_of_class(df: DataFrame, label: str, limit: Callable[[Column, Column], Column], order: Sequence[str], seed: int, mark: str) -> DataFrame:
    """Adds the boolean mark: whether a row is among the first limit(class, rows of the class) of its class, by a seeded hash
    of the columns order, then by these. A null limit marks no row.

    No class is sorted as a whole: rows are counted by the hash's upper 16 bits, which gives each class the one range that its
    limit falls into, about one of 65,536; only rows of that range are sorted. df is read three times, one row for each class is
    broadcast. Rows equal in all of order share a range, and which of them come first is open.
    """
    key = F.xxhash64(F.lit(seed), *order)
    range_ = F.shiftright(key, 48)
    per = df.groupBy(F.col(label).alias("_class"), range_.alias("_at")).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_class")
    per = per.withColumns({"_so_far": F.sum("_n").over(whole.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(whole)})
    before = F.col("_so_far") - F.col("_n")
    most = limit(F.col("_class"), F.col("_all"))
    per = per.withColumn("_limit", F.when(most > F.col("_all"), F.col("_all")).otherwise(most))
    edges = per.where((F.col("_limit") > before) & (F.col("_limit") <= F.col("_so_far"))).select("_class", "_at", (F.col("_limit") - before).alias("_rest"))
    rows = df.join(F.broadcast(edges), F.col(label).eqNullSafe(F.col("_class")), "left")
    sure = rows.where(F.coalesce(range_ != F.col("_at"), F.lit(True))).withColumn(mark, F.coalesce(range_ < F.col("_at"), F.lit(False)))
    place = F.row_number().over(Window.partitionBy(label).orderBy(key, *order))
    edge = rows.where(range_ == F.col("_at")).withColumn(mark, place <= F.col("_rest"))
    return sure.unionAll(edge).drop("_class", "_at", "_rest")


def sampled(df: DataFrame, label: str, sizes: dict, order: Sequence[str], seed: int = 42) -> DataFrame:
    """At most sizes[label] rows of each class, the first by a seeded hash of the columns order; classes that aren't
    named stay whole."""
    limits = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, n)])
    named = first_of_class(df.where(limits[F.col(label)].isNotNull()), label, lambda class_, n: limits[class_], order, seed, "_in")
    return df.where(limits[F.col(label)].isNull()).unionAll(named.where("_in").drop("_in"))


def fractional_sample(df: DataFrame, fraction: float, cap: int, seed: int = 42) -> DataFrame:
    """A seeded share of the rows, and no more than cap of them."""
    return df.sample(fraction=fraction, seed=seed).limit(cap)


def train_test(df: DataFrame, label: str, columns: Sequence[str], test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds in_test: the share test of each class, by a seeded order of its rows."""
    return first_of_class(df, label, lambda class_, n: F.ceil(n * F.lit(test)), columns, seed, "in_test")
