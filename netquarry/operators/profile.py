"""Profiles of tables: each one pass over the rows, however many columns; exact quantiles take three."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite, ratio_or_null
from . import ranks


def _by_column(df: DataFrame, columns: Sequence[str], measures: dict, keys: Sequence[str] = ()) -> DataFrame:
    """One aggregation of all measures of all columns, then one row for each column: name, measures."""
    aggregates = [F.struct(F.lit(c).alias("name"), *[f(c).alias(k) for k, f in measures.items()]) for c in columns]
    return df.groupBy(*keys).agg(F.array(*aggregates).alias("_all")).select(*keys, F.inline("_all"))


def gaps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """name, rows, nulls, nans, infinite: of each numeric column."""
    d = lambda c: F.col(c).cast("double")
    return _by_column(
        df, columns,
        {"rows": lambda c: F.count("*"), "nulls": lambda c: F.count_if(F.col(c).isNull()), "nans": lambda c: F.count_if(F.isnan(d(c))),
         "infinite": lambda c: F.count_if(F.abs(d(c)) == float("inf"))},
    )


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """name, mean, deviation (sample), least, most, distinct, zeros, zero_share: over finite values."""
    x = lambda c: finite(F.col(c))
    r = lambda v: F.round(v, 6)
    return _by_column(
        df, columns,
        {"mean": lambda c: r(F.avg(x(c))), "deviation": lambda c: r(F.stddev_samp(x(c))), "least": lambda c: F.min(x(c)), "most": lambda c: F.max(x(c)),
         "distinct": lambda c: F.countDistinct(x(c)), "zeros": lambda c: F.count_if(x(c) == 0),
         "zero_share": lambda c: r(ratio_or_null(F.count_if(x(c) == 0), F.count(x(c))))},
    )


QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float] = QUANTILES, exact: bool = True) -> DataFrame:
    """name and p01, p05, ...: linearly interpolated over finite values; not exact, a mergeable sketch of bounded size."""
    sketch = lambda c: F.percentile_approx(finite(F.col(c)), list(at), 100_000)
    out = ranks.quantiles(df, columns, at) if exact else _by_column(df, columns, {"q": sketch})
    return out.select("name", *[F.round(F.col("q")[i], 6).alias(f"p{round(q * 100):02d}") for i, q in enumerate(at)])


def iqr_outliers(df: DataFrame, columns: Sequence[str], reach: float = 1.5) -> DataFrame:
    """name, q1, q3, low, high, below, above, share: values strictly beyond reach interquartile ranges.

    The quartiles come first; their one row is joined to the last pass, which counts.
    """
    quartiles = ranks.quantiles(df, columns, (0.25, 0.75))
    q = quartiles.agg(*[F.first(F.when(F.col("name") == c, F.col("q")), ignorenulls=True).alias(f"_q_{c}") for c in columns])
    low = lambda c: F.col(f"_q_{c}")[0] - reach * (F.col(f"_q_{c}")[1] - F.col(f"_q_{c}")[0])
    high = lambda c: F.col(f"_q_{c}")[1] + reach * (F.col(f"_q_{c}")[1] - F.col(f"_q_{c}")[0])
    x = lambda c: finite(F.col(c))
    r = lambda v: F.round(v, 6)
    out = _by_column(
        df.select(*columns).crossJoin(F.broadcast(q)), columns,  # one row
        {"q1": lambda c: r(F.first(F.col(f"_q_{c}")[0])), "q3": lambda c: r(F.first(F.col(f"_q_{c}")[1])), "low": lambda c: r(F.first(low(c))),
         "high": lambda c: r(F.first(high(c))), "below": lambda c: F.count_if(x(c) < low(c)), "above": lambda c: F.count_if(x(c) > high(c)),
         "known": lambda c: F.count(x(c))},
    )
    return out.withColumn("share", r(ratio_or_null(F.col("below") + F.col("above"), F.col("known")))).drop("known")


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows, distinct_rows, duplicate_rows over the given columns: by value, not by a hash of them."""
    per = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_rows"), (F.sum("n") - F.count("*")).alias("duplicate_rows"))


def correlations(df: DataFrame, columns: Sequence[str], at_least: float = 0.0) -> DataFrame:
    """a, b, r for each pair of columns (a before b), over the rows where both are finite; null if one is constant there.
    Sums are taken of deviations from each column's mean, in a second pass, so that large values don't cancel."""
    means = df.agg(*[F.avg(finite(F.col(c))).alias(f"_m_{c}") for c in columns])
    z = df.crossJoin(F.broadcast(means)).select(*[(finite(F.col(c)) - F.col(f"_m_{c}")).alias(c) for c in columns])  # one row
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]

    def r(a: str, b: str) -> Column:
        x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
        n, sx, sy = F.count(x), F.sum(x), F.sum(y)
        vx, vy = F.sum(x * x) - sx * sx / n, F.sum(y * y) - sy * sy / n
        return F.try_divide(F.sum(x * y) - sx * sy / n, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))

    all_ = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(r(a, b), 6).alias("r")) for a, b in pairs]
    out = z.agg(F.array(*all_).alias("_all")).select(F.inline("_all"))
    return out.where(F.abs("r") >= at_least) if at_least else out


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """By rows: counts of the given values of columns, total, and each value's share of the row."""
    out = df.groupBy(rows).agg(*[F.count_if(F.col(columns) == v).alias(f"n_{v}") for v in values], F.count("*").alias("total"))
    return out.withColumns({f"share_{v}": F.round(ratio_or_null(F.col(f"n_{v}"), F.col("total")), 6) for v in values})


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, rows, share of all rows and of the most frequent value's."""
    out = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
    all_ = out.agg(F.sum("rows").alias("_all"), F.max("rows").alias("_top"))
    share = lambda c: F.round(ratio_or_null(F.col("rows"), F.col(c)), 6)
    return out.crossJoin(F.broadcast(all_)).select("value", "rows", share("_all").alias("share"), share("_top").alias("to_majority"))  # one row


def group_summary(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, name, count, mean, median, deviation of each column within each group."""
    x = lambda c: finite(F.col(c))
    out = _by_column(
        df, columns,
        {"count": lambda c: F.count(x(c)), "mean": lambda c: F.round(F.avg(x(c)), 6), "deviation": lambda c: F.round(F.stddev_samp(x(c)), 6)}, keys,
    )
    middle = ranks.quantiles(df, columns, (0.5,), keys).select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(keys)], F.col("name").alias("_name"), "q")
    same = [F.col(k).eqNullSafe(F.col(f"_m{i}")) for i, k in enumerate(keys)] + [F.col("name") == F.col("_name")]
    return out.join(middle, same, "left").select(*keys, "name", "count", "mean", F.round(F.col("q")[0], 6).alias("median"), "deviation")


def median_differences(df: DataFrame, positive: Column, columns: Sequence[str]) -> DataFrame:
    """name, negative_median, positive_median, difference and its ratio to the negative median's size (null at 0)."""
    sides = [F.when(~positive if side == "n" else positive, finite(F.col(c))).alias(f"{side}{i}") for i, c in enumerate(columns) for side in "np"]
    q = ranks.quantiles(df.select(*sides), [f"{side}{i}" for i in range(len(columns)) for side in "np"], (0.5,))
    of = lambda k: F.first(F.when(F.col("name") == k, F.col("q")[0]), ignorenulls=True)
    out = q.agg(F.array(*[F.struct(F.lit(c).alias("name"), of(f"n{i}").alias("n"), of(f"p{i}").alias("p")) for i, c in enumerate(columns)]).alias("_all"))
    out = out.select(F.inline("_all"))
    d = F.col("p") - F.col("n")
    return out.select(
        "name", F.round("n", 6).alias("negative_median"), F.round("p", 6).alias("positive_median"), F.round(d, 6).alias("difference"),
        F.round(ratio_or_null(d, F.abs("n")), 6).alias("relative"),
    )


def trimmed(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows whose value lies between two quantiles, both included."""
    q = ranks.quantiles(df, [column], (low, high)).select(F.col("q").alias("_q"))
    return df.crossJoin(F.broadcast(q)).where(F.col(column).between(F.col("_q")[0], F.col("_q")[1])).drop("_q")  # one row


def binary_label(label: Column, benign: str = "benign") -> Column:
    return F.when(F.lower(F.trim(label)) == benign, "Benign").when(label.isNotNull(), "Attack")


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """name, median: for imputation."""
    return ranks.quantiles(df, columns, (0.5,)).select("name", F.round(F.col("q")[0], 6).alias("median"))


def scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """name, mean and population deviation of the finite values: a standard scaler's parameters."""
    x = lambda c: finite(F.col(c))
    return _by_column(df, columns, {"mean": lambda c: F.round(F.avg(x(c)), 6), "deviation": lambda c: F.round(F.stddev_pop(x(c)), 6)})
