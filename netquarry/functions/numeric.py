"""Arithmetic on columns with a stated result for every input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value as a double, null where it is NaN or infinite."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ratio_or_null(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either is null."""
    return F.coalesce(ratio_or_null(a, b), F.lit(0.0))


def level(effect: Column, large: float, medium: float, small: float) -> Column:
    """Name of an effect's size by its absolute value; null stays null."""
    e = F.abs(effect)
    return F.when(e >= large, "large").when(e >= medium, "medium").when(e >= small, "small").when(e.isNotNull(), "negligible")


def quantised(x: Column, scale: float, zero: int = 0) -> Column:
    """8-bit code of x: x / scale rounded half to even, plus zero, held within -128 and 127."""
    return F.greatest(F.lit(-128), F.least(F.lit(127), F.bround(x / F.lit(scale)) + F.lit(zero))).cast("tinyint")


def dequantised(q: Column, scale: float, zero: int = 0) -> Column:
    return (q.cast("double") - F.lit(zero)) * F.lit(scale)


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by the largest so that nothing overflows; null or empty stay."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def argmax(values: Column) -> Column:
    """Index from 0 of the largest element, the first among equals; null for an empty array."""
    return F.nullif(F.array_position(values, F.array_max(values)), F.lit(0)).cast("int") - 1


def soft_vote(a: Column, b: Column, weight: float) -> Column:
    """weight * a + (1 - weight) * b, element by element."""
    return F.zip_with(a, b, lambda x, y: x * weight + y * (1 - weight))


def standardised(x: Column, mean: float, deviation: float) -> Column:
    """(x - mean) / deviation; a missing or non-finite x counts as the mean, a zero deviation as 1."""
    return (F.coalesce(finite(x), F.lit(float(mean))) - F.lit(float(mean))) / F.lit(float(deviation) or 1.0)


def literal_length(text: Column) -> Column:
    """Length of a list written out as text; 0 if it can't be read as one."""
    return F.greatest(F.coalesce(F.size(F.from_json(text, "array<double>")), F.lit(0)), F.lit(0))
