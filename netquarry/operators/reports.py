"""Report tables: merges with fill and suffixes, ranked gains, baselines, unions of limits, mappings, set differences, timings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest finite float32.
FLOAT32 = 3.4028234663852886e38


def _suffixed(frames: Mapping[str, DataFrame], on: Sequence[str]) -> list[DataFrame]:
    return [df.select(*on, *[F.col(c).alias(f"{c}_{name}") for c in df.columns if c not in on]) for name, df in frames.items()]


def outer_merge(frames: Mapping[str, DataFrame], on: Sequence[str], fill: float = 0) -> DataFrame:
    """Full outer merge of the frames by on; other columns get their frame's name, and fill where a frame lacks the key."""
    return reduce(lambda a, b: a.join(b, list(on), "full"), _suffixed(frames, on)).na.fill(fill)


def chained_merge(frames: Mapping[str, DataFrame], on: Sequence[str]) -> DataFrame:
    """Inner merge of all frames by on, columns with their frame's name."""
    return reduce(lambda a, b: a.join(b, list(on)), _suffixed(frames, on))


def left_merge(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """All rows of left with right's columns, null where it has none."""
    return left.join(right, list(on), "left")


def status_changes(old: DataFrame, new: DataFrame, key: str, status: str) -> DataFrame:
    """Rows of new by their status in old (null: not there) and their own: old_status, new_status, n."""
    before = old.select(key, F.col(status).alias("old_status"))
    return new.select(key, F.col(status).alias("new_status")).join(before, key, "left").groupBy("old_status", "new_status").agg(F.count("*").alias("n"))


def ranked_gains(gains: DataFrame, name: str, gain: str) -> DataFrame:
    """name, gain -> adds rank (from 1, ties by name), gain_ratio and cumulative_ratio. One row a feature: a small table."""
    by = Window.orderBy(F.desc(gain), name)
    whole = F.sum(gain).over(Window.partitionBy())
    ranked = gains.select(name, gain, F.row_number().over(by).alias("rank"), (F.col(gain) / whole).alias("gain_ratio"))
    return ranked.withColumn("cumulative_ratio", F.sum("gain_ratio").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))


def top_by(df: DataFrame, gain: str, name: str, k: int) -> DataFrame:
    """The k rows of the largest gain, ties by name."""
    return df.orderBy(F.desc(gain), name).limit(k)


def against_baseline(df: DataFrame, name: str, baseline: str, metrics: Sequence[str]) -> DataFrame:
    """Each metric's difference from the row of that name and its reduction in per cent."""
    base = df.where(F.col(name) == baseline).agg(*[F.first(m).alias(f"_{m}") for m in metrics])  # a single row
    return df.crossJoin(F.broadcast(base)).select(
        name, *metrics, *[(F.col(m) - F.col(f"_{m}")).alias(f"{m}_delta") for m in metrics],
        *[F.when(F.col(f"_{m}") != 0, 100 * (1 - F.col(m) / F.col(f"_{m}"))).alias(f"{m}_reduction") for m in metrics],
    )


def limited_union(df: DataFrame, label: str, limits: Mapping, order: Sequence[str | Column]) -> DataFrame:
    """Of each label its first rows by order: one literal filter and limit a label, so that each task passes on that many at most."""
    return reduce(DataFrame.union, [df.where(F.col(label) == k).orderBy(*order).limit(n) for k, n in limits.items()])


def mapping(df: DataFrame, key: str, value: str) -> DataFrame:
    """One value of each key, the least, whatever the order of rows."""
    return df.groupBy(key).agg(F.min(value).alias(value))


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b lacks; nulls are equal."""
    return a.subtract(b)


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both; nulls are equal."""
    return a.intersect(b)


def date_parts(df: DataFrame, time: str) -> DataFrame:
    """Adds hour (0 to 23) and day_of_week (0 Monday to 6 Sunday)."""
    return df.withColumns({"hour": F.hour(time), "day_of_week": F.weekday(time)})


def latencies(df: DataFrame, by: str, seconds: str) -> DataFrame:
    """By group of timing rows: n, median, p95 and throughput (rows a second of their sum)."""
    q = lambda p: F.percentile(seconds, F.lit(p))
    total = F.sum(seconds)
    return df.groupBy(by).agg(F.count(seconds).alias("n"), q(0.5).alias("median"), q(0.95).alias("p95"), F.when(total > 0, F.count(seconds) / total).alias("throughput"))


def overlapping(a: DataFrame, b: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, n: how many distinct values of each field both sides have; nulls don't count."""
    each = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))).where("value IS NOT NULL").distinct()
    found = each(a).join(each(b), ["field", "value"]).groupBy("field").agg(F.count("*").alias("n"))
    return a.sparkSession.createDataFrame([(f,) for f in fields], "field string").join(found, "field", "left").na.fill(0)


def required_apart(a: DataFrame, b: DataFrame, fields: Sequence[str]) -> None:
    """Raises ValueError with the fields of which both sides have a value."""
    if bad := {r["field"]: r["n"] for r in overlapping(a, b, fields).where("n > 0").collect()}:  # a row a field at most
        raise ValueError(f"values on both sides: {bad}")


def validated(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles, and invalid: the names of those that are null, no numbers, not finite or beyond float32.
    A table with other columns than these (but for those before with an underscore) raises ValueError."""
    own = [c for c in df.columns if not c.startswith("_")]
    if sorted(own) != sorted(features):
        raise ValueError(f"missing {sorted(set(features) - set(own))}, unexpected {sorted(set(own) - set(features))}")
    number = {f: F.col(f).try_cast("double") for f in features}
    bad = [F.when(number[f].isNull() | F.isnan(number[f]) | (F.abs(number[f]) > FLOAT32), F.lit(f)) for f in features]
    return df.select(*[c for c in df.columns if c.startswith("_")], *[number[f].alias(f) for f in features], F.array_compact(F.array(*bad)).alias("invalid"))
