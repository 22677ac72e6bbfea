"""Rank tests over many features at once, in window functions and aggregates.

Midranks need no global order in one task: values are counted by distinct value first, and the
running counts of a feature's distinct values give each value's ranks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite, level


def melted(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """name, group, value: one row for each finite value."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), finite(F.col(c)).alias("value")) for c in columns])
    return df.select(F.col(group).alias("group"), F.inline(cells)).where("value IS NOT NULL AND group IS NOT NULL")


def _ranked(cells: DataFrame) -> DataFrame:
    """name, value, group, n, ties, midrank, of each distinct value of a feature in each group."""
    per = cells.groupBy("name", "value", "group").agg(F.count("*").alias("n"))
    values = per.groupBy("name", "value").agg(F.sum("n").alias("ties"))
    before = F.coalesce(F.sum("ties").over(Window.partitionBy("name").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = values.select("name", "value", "ties", (before + (F.col("ties") + 1) / 2).alias("midrank"))
    return per.join(ranks, ["name", "value"])


def _tie_sum(ranked: DataFrame) -> DataFrame:
    t = F.col("ties").cast("double")
    once = ranked.groupBy("name", "value").agg(F.first("ties").alias("ties"))
    return once.groupBy("name").agg(F.sum(t * t * t - t).alias("tie_sum"), F.count("*").alias("values"))


def mann_whitney(df: DataFrame, columns: Sequence[str], group: str, first, second) -> DataFrame:
    """name, n1, n2, u1, z, p, effect, size: two-sided, normal approximation with tie and continuity correction, of the
    groups first and second. effect is the rank-biserial 2 u1 / (n1 n2) - 1. All values equal: z 0 and p 1. A feature that
    one group lacks isn't returned."""
    ranked = _ranked(melted(df.where(F.col(group).isin(first, second)), columns, group))
    one = lambda x: F.sum(F.when(F.col("group") == first, x))
    sums = ranked.groupBy("name").agg(
        one(F.col("n")).alias("n1"), (F.sum("n") - one(F.col("n"))).alias("n2"), one(F.col("n") * F.col("midrank")).alias("r1")
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, u1 = n1 + n2, F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("tie_sum") / (n * (n - 1))))
    z = F.coalesce(F.try_divide(F.greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5, spread), F.lit(0.0))
    out = sums.join(_tie_sum(ranked), "name").where("n1 > 0 AND n2 > 0")
    out = out.select("name", "n1", "n2", u1.alias("u1"), z.alias("z"), (2 * u1 / (n1 * n2) - 1).alias("effect"))
    return _with_p(out, "z", lambda r: min(1.0, math.erfc(r["z"] / math.sqrt(2)))).withColumn("size", level(F.col("effect"), 0.5, 0.3, 0.1))


def kruskal_wallis(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """name, groups, n, h, p, epsilon_squared, size: tie-corrected, over all groups that have values. All values equal: h 0
    and p 1. Fewer than two groups: not returned."""
    ranked = _ranked(melted(df, columns, group))
    per = ranked.groupBy("name", "group").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("midrank")).alias("r"))
    sums = per.groupBy("name").agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"))
    n, k = F.col("n").cast("double"), F.col("groups")
    plain = F.try_divide(12 * F.col("s"), n * (n + 1)) - 3 * (n + 1)
    corrected = F.try_divide(plain, 1 - F.try_divide(F.col("tie_sum"), n * n * n - n))
    h = F.when(F.col("values") < 2, 0.0).otherwise(F.greatest(corrected, F.lit(0.0)))
    out = sums.join(_tie_sum(ranked), "name").where("groups > 1").withColumn("h", h)
    e = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("h") - k + 1, n - k), F.lit(0.0)))
    out = out.select("name", "groups", "n", "h", e.alias("epsilon_squared"))
    return _with_p(out, "h", lambda r: chi_square_tail(r["h"], int(r["groups"]) - 1)).withColumn("size", level(F.col("epsilon_squared"), 0.14, 0.06, 0.01))


def chi_square_tail(x: float, freedom: int) -> float:
    """P(X >= x) for a chi-square variable: the upper regularised gamma function, by its finite sums for whole and half
    shapes."""
    if x <= 0:
        return 1.0
    half, term = x / 2, 0.0
    if freedom % 2 == 0:
        total = log_term = 0.0
        for i in range(freedom // 2):
            log_term = i * math.log(half) - math.lgamma(i + 1) - half
            total += math.exp(log_term)
        return min(1.0, total)
    total = math.erfc(math.sqrt(half))
    for i in range(1, (freedom - 1) // 2 + 1):
        term = (i - 0.5) * math.log(half) - math.lgamma(i + 0.5) - half
        total += math.exp(term)
    return min(1.0, total)


def _with_p(df: DataFrame, after: str, p) -> DataFrame:
    """Adds p, a function of a row; one row for each feature."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(p=[p(r) for r in b.to_dict("records")])

    return df.mapInPandas(add, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", p double")


def false_discovery(df: DataFrame, alpha: float = 0.05, p: str = "p") -> DataFrame:
    """Adds q, the Benjamini-Hochberg adjusted p, and significant (q <= alpha). A null p stays null and doesn't count. One row
    for each feature: the window over all of them is small."""
    known = F.col(p).isNotNull()
    n = F.count(p).over(Window.partitionBy())
    rank = F.row_number().over(Window.partitionBy(known).orderBy(F.col(p)))
    scaled = df.withColumn("_s", F.when(known, F.col(p) * n / rank))
    q = F.min("_s").over(Window.partitionBy(known).orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    out = scaled.withColumn("q", F.when(known, F.least(F.lit(1.0), q))).drop("_s")
    return out.withColumn("significant", F.coalesce(F.col("q") <= alpha, F.lit(False)))
