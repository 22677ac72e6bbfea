"""Lexical features of domain names, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names and order of the features.
FEATURES = (
    "fqdn_length", "label_count", "max_label_length", "mean_label_length", "digit_ratio", "special_ratio", "character_entropy"
)


def canonical(fqdn: Column) -> Column:
    """Lower case without one trailing dot; null unless it is a name of 1 to 253 ASCII characters whose labels have 1 to
    63 letters, digits, hyphens or underscores."""
    name = F.lower(F.regexp_replace(fqdn, r"\.\z", ""))
    label = "[a-z0-9_-]{1,63}"
    return F.when(F.length(name).between(1, 253) & name.rlike(rf"\A{label}(?:\.{label})*\z"), name)


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for one kind of character, null for none."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    shares = F.transform(
        F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda d: d == c)) / F.size(letters).cast("double")
    )
    return F.when(F.size(letters) > 0, F.abs(F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))))


def with_features(df: DataFrame, column: str) -> DataFrame:
    """Adds the canonical name and FEATURES; all null where the name is invalid."""
    out = df.withColumn("canonical", canonical(F.col(column)))
    name = F.col("canonical")
    labels, joined = F.split(name, r"\."), F.regexp_replace(name, r"\.", "")
    size = F.length(joined).cast("double")
    count = lambda keep: F.length(F.regexp_replace(joined, keep, ""))
    values = (
        F.length(name),
        F.when(name.isNotNull(), F.size(labels)),
        F.array_max(F.transform(labels, F.length)),
        size / F.size(labels),
        count("[^0-9]") / size,
        count("[^_-]") / size,
        entropy(joined),
    )
    return out.withColumns(dict(zip(FEATURES, values, strict=True)))
