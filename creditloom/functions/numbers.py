"""Null-safe and finite-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")


def finite(col: Column) -> Column:
    """NaN and both infinities become null."""
    value = col.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(INFINITY)), F.lit(None).cast("double")).otherwise(value)


def safe_ratio(num: Column, den: Column, default: float) -> Column:
    """``num / den`` as a double; wherever that is undefined or not finite, ``default``."""
    return F.coalesce(finite(F.try_divide(num.cast("double"), den.cast("double"))), F.lit(float(default)))


def eps_ratio(num: Column, den: Column, eps: float = 1e-6) -> Column:
    """``num / (den + eps)``: stays defined for a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double") + F.lit(eps))


def sum_or_zero(col: Column) -> Column:
    """Sum that skips nulls and is zero for a group with nothing to add."""
    return F.coalesce(F.sum(col), F.lit(0))


def mean_of(cols: list[Column]) -> Column:
    """Mean across columns of one row."""
    return sum(cols[1:], cols[0]) / len(cols)


def sample_std_of(cols: list[Column]) -> Column:
    """Sample standard deviation (n - 1) across columns of one row, in two passes for accuracy."""
    mean = mean_of(cols)
    squares = [(c - mean) * (c - mean) for c in cols]
    return F.sqrt(sum(squares[1:], squares[0]) / (len(cols) - 1))


def mean_of_present(cols: list[Column]) -> Column:
    """Mean across the non-null columns of one row; null when all are null."""
    total = sum((F.coalesce(c, F.lit(0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0))).cast("double")
    present = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return F.try_divide(total, present)


def whole_units(df: DataFrame, column: str) -> tuple[Column, int]:
    """An exact decimal amount as a count of its smallest unit, and how many of those make one.

    Sums of longs are as exact as sums of decimals, and several times faster, as a wide decimal has no fixed-width
    arithmetic. That needs ANSI mode, in which an overflow raises instead of wrapping around; without it, and for other
    types, the amount is left alone, with a divisor of 1.
    """
    kind = df.schema[column].dataType
    ansi = df.sparkSession.conf.get("spark.sql.ansi.enabled") == "true"
    if ansi and isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (F.col(column) * F.lit(10**kind.scale)).cast("long"), 10**kind.scale
    return F.col(column), 1
