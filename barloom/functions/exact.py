"""The only place that rounds, divides or repairs numbers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def snap_round(value: Column | str, places: int) -> Column:
    """Round half up on the decimal value, not on its binary neighbour.

    A double such as 1.005 is first snapped to ``places + 4`` decimals, so the tie is decided
    on the number a reader sees.
    """
    snapped = as_column(value).cast(T.DecimalType(38, places + 4))
    return F.round(snapped, places).cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; a zero denominator gives NULL instead of an error."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def pct_change(start: Column | str, end: Column | str) -> Column:
    start, end = as_column(start), as_column(end)
    return ratio(end - start, start) * F.lit(100.0)


def pct_of(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * F.lit(100.0)


def nan_to_null(value: Column | str) -> Column:
    """NaN compares greater than every number in Spark, so it must not reach a filter."""
    value = as_column(value).cast("double")
    return F.when(~F.isnan(value), value)


def anchor(as_of: Column | date | str | None) -> Column:
    """The day a report counts back from; today unless the caller says otherwise."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of.cast("date")
    return F.lit(str(as_of)).cast("date")
