"""Gates: small tables of named checks and whether they hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdicts(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, passed: each check is an aggregate over all rows that gives a boolean; null fails."""
    all_ = [F.struct(F.lit(k).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in checks.items()]
    return df.agg(F.array(*all_).alias("_all")).select(F.inline("_all"))


def conserved(patterns: DataFrame, original: DataFrame, label: str) -> DataFrame:
    """By label: rows of the table, sum of the frequencies, and whether they are equal."""
    a = original.groupBy(label).agg(F.count("*").alias("rows"))
    b = patterns.groupBy(label).agg(F.sum("frequency").alias("frequencies"))
    out = a.join(b.withColumnRenamed(label, "_l"), F.col(label).eqNullSafe(F.col("_l")), "full")
    same = F.col("rows").eqNullSafe(F.col("frequencies"))
    return out.select(F.coalesce(label, "_l").alias(label), "rows", "frequencies", same.alias("passed"))


def weights_sane(df: DataFrame, weight: str) -> DataFrame:
    return verdicts(df, {"no_null": F.count_if(F.col(weight).isNull()) == 0, "positive": F.min(weight) > 0, "finite": F.max(weight) < float("inf"), "some": F.count("*") > 0})


def split_gates(df: DataFrame, split: str, group: str, time: str, label: str, order: Sequence[str]) -> DataFrame:
    """Groups in one split only, splits in order of time without overlap, every class in every split."""
    crossing = df.groupBy(group).agg(F.countDistinct(split).alias("n")).agg(F.count_if(F.col("n") > 1).alias("crossing"))
    per = df.groupBy(split).agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.countDistinct(label).alias("classes"))
    at = {s: per.where(F.col(split) == s).agg(F.min("lo").alias(f"lo_{i}"), F.max("hi").alias(f"hi_{i}"), F.max("classes").alias(f"c_{i}")) for i, s in enumerate(order)}
    one = crossing.crossJoin(df.agg(F.countDistinct(label).alias("all_classes")))  # single rows
    for part in at.values():
        one = one.crossJoin(part)
    rising = F.lit(True)
    for i in range(1, len(order)):
        rising = rising & (F.col(f"hi_{i - 1}") < F.col(f"lo_{i}"))
    full = F.lit(True)
    for i in range(len(order)):
        full = full & (F.col(f"c_{i}") == F.col("all_classes"))
    checks = {"groups_apart": F.col("crossing") == 0, "times_apart": rising, "classes_complete": full}
    all_ = [F.struct(F.lit(k).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in checks.items()]
    return one.select(F.inline(F.array(*all_)))


def unique(df: DataFrame, column: str) -> DataFrame:
    """check, passed: a column without nulls and repeats."""
    return verdicts(df, {f"{column}_known": F.count_if(F.col(column).isNull()) == 0, f"{column}_unique": F.count("*") == F.countDistinct(column)})


def admitted(checks: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row: passed if every required check is there and passed."""
    good = F.count_distinct(F.when(F.col("passed") & F.col("check").isin(*required), F.col("check"))) == len(set(required))
    return checks.agg((good & (F.count_if(~F.col("passed")) == 0)).alias("passed"))


def declared(samples: DataFrame, identity: str, raw: str, split: str, label: str) -> DataFrame:
    """Identities and raw digests known and unique, both classes in every split."""
    one = verdicts(samples, {
        "identities_unique": (F.count(identity) == F.count("*")) & (F.countDistinct(identity) == F.count("*")),
        "raw_unique": (F.count(raw) == F.count("*")) & (F.countDistinct(raw) == F.count("*")),
    })
    per = samples.groupBy(split).agg(F.countDistinct(F.when(F.col(label).isin(0, 1), F.col(label))).alias("n"))
    return one.unionByName(verdicts(per, {"both_classes": F.min("n") == 2}))
