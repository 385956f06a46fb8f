"""Arithmetic shared by evaluation and serving."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_of_present(*values: Column) -> Column:
    """Mean of the non-null values; null when all are null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    present = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])
    return F.when(present > 0, total / present)


def never_negative(value: Column) -> Column:
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def units_up(value: Column) -> Column:
    """Whole units, rounded up."""
    return F.ceil(value).cast("int")


def rescale(value: Column, low: float, high: float) -> Column:
    """Min-max scaling without clipping; a constant column maps its value to 0."""
    span = (high - low) or 1.0
    return (value.cast("double") - F.lit(float(low))) / F.lit(float(span))


def _md5_digits(digits: int, columns: tuple[Column, ...]) -> Column:
    """Leading hexadecimal digits of the md5 of the key, as a number. The same in any engine."""
    key = F.concat_ws("|", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(key), 1, digits), 16, 10).cast("bigint")


def hash60(*columns: Column) -> Column:
    return _md5_digits(15, columns)


def hash_below(num: Column | int, den: int, *columns: Column) -> Column:
    """True for about ``num/den`` of the distinct key values.

    Needs no shuffle, repeats exactly, and equal rows always agree.
    """
    return _md5_digits(8, columns) * den < F.lit(num) * F.lit(2**32)
