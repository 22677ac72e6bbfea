"""Exact quantiles for which no task needs all values: their ranks are found by counting ever smaller ranges of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite

#: Ranges of the first turn to each doubling of size, and parts of one of these in the second turn.
OCTAVE, PARTS = 1024, 2**21
#: Ranges of as many groups are broadcast; of more they are joined by a shuffle.
FEW_GROUPS = 10_000


def quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float], keys: Sequence[str] = (), few: bool | None = None) -> DataFrame:
    """keys, name, q array<double>: of each column, within each group, the exact quantiles of the finite values, linearly
    interpolated as by percentile(). Without values q is null, and with keys the row is missing.

    Three turns over df count values by range: by size, then by part of those ranges that hold a wanted rank, then by value
    within such parts. A range holds 2^43 different doubles at most and a part some 2^22, so the counts that one task sorts are
    bounded, whatever the number of rows. few: whether there are FEW_GROUPS at most; counted if not told.
    """
    if few is None:
        few = not keys or df.select(*keys).distinct().limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    by = [*[f"_k{i}" for i in range(len(keys))], "_i"]
    # adding 0 leaves one zero of the two
    values = F.array(*[F.struct(F.lit(i).alias("_i"), (finite(F.col(c)) + F.lit(0.0)).alias("_x")) for i, c in enumerate(columns)])
    cells = df.select(*[F.col(k).alias(a) for k, a in zip(keys, by)], F.inline(values)).where("_x IS NOT NULL")

    x, low, high = F.col("_x"), F.col("_low"), F.col("_high")
    size = F.floor((F.log2(F.abs(x)) + 1100) * OCTAVE)  # the least double is 2^-1074
    part = F.when(high > low, F.floor((x - low) / (high - low) * PARTS)).otherwise(0)
    places = F.transform(F.array(*[F.lit(float(q)) for q in at]), lambda q: q * (F.col("_n") - 1))
    ranks = F.array_distinct(F.concat(F.transform(places, lambda p: F.floor(p)), F.transform(places, lambda p: F.ceil(p))))
    whole = _counted(cells, by, F.when(x > 0, size).when(x < 0, -size).otherwise(0)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    held = _holding(whole.withColumn("_ranks", F.transform(ranks, lambda r: F.struct(r.alias("rank"), r.alias("left")))), by)
    for of in (part, x):
        ranges = held.withColumnsRenamed({c: f"_r{c}" for c in by})
        same = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in by[:-1]] + [F.col("_i") == F.col("_r_i"), x.between(low, high)]
        inside = cells.join(F.broadcast(ranges) if few else ranges, same)
        held = _holding(_counted(inside, [*by, "_low", "_high", "_n", "_ranks"], of).drop("_low", "_high"), by)

    found = held.select(*by, "_n", low.alias("_v"), F.explode("_ranks.rank").alias("_rank"))
    told = found.groupBy(*by, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_of"))
    out = told.select(*[F.col(a).alias(k) for k, a in zip(keys, by)], "_i", F.transform(places, _interpolated).alias("q"))
    names = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, columns))).alias("_i", "name"))  # one row for each column
    joined = out.join(F.broadcast(names), "_i") if keys else names.join(out, "_i", "left")
    return joined.select(*keys, "name", "q")


def _counted(rows: DataFrame, by: Sequence[str], range_: Column) -> DataFrame:
    """by, _range, _c: its rows, _least and _most: its values, _before: rows of the lower ranges."""
    out = rows.groupBy(*by, range_.alias("_range")).agg(F.count("*").alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    lower = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("_before", F.coalesce(F.sum("_c").over(lower), F.lit(0)))


def _holding(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, _low, _high, _n, _ranks: the ranges that hold ranks, with these; left counts within the range."""
    inside = F.filter("_ranks", lambda r: (r["left"] >= F.col("_before")) & (r["left"] < F.col("_before") + F.col("_c")))
    ranks = F.transform(inside, lambda r: F.struct(r["rank"].alias("rank"), (r["left"] - F.col("_before")).alias("left")))
    out = counted.select(*by, F.col("_least").alias("_low"), F.col("_most").alias("_high"), "_n", ranks.alias("_ranks"))
    return out.where(F.size("_ranks") > 0)


def _interpolated(place: Column) -> Column:
    lower, upper = F.floor(place), F.ceil(place)
    a, b = F.col("_of")[lower], F.col("_of")[upper]
    return F.when(a == b, a).otherwise((upper - place) * a + (place - lower) * b)
