"""Trailing-row aggregates over one ordered series per key.

Series here are keyed by an entity and a calendar day, and the key is unique, so one group
never holds more rows than there are days: the group size is bounded by the calendar and does
not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window

WARMUPS = ("null", "partial")


def series(key: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy("trade_date")


def spread(frame: DataFrame, key: str) -> DataFrame:
    """Rows placed by key in as many tasks as the session shuffles to.

    Adaptive execution merges other exchanges into tasks of 64 MB, which aggregates and sorts by key
    unpack to twenty times that; a number that is given stays. Later steps by the same key reuse the
    placing.
    """
    tasks = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(tasks, key)


def trailing_sum(total: Column, before: Column, rows: int, over: WindowSpec, warmup: str) -> Column:
    """Sum of the last ``rows`` rows as a difference of two running sums.

    ``total`` is the running sum up to the row, ``before`` the same without the row itself. One
    lag replaces a frame of ``rows`` additions, so the cost per row does not depend on the frame.
    The sums are of whole numbers: no rounding error builds up along the series.
    """
    if warmup not in WARMUPS:
        raise ValueError(f"warmup must be one of {WARMUPS}, not {warmup!r}")
    start = F.lag(before, rows - 1).over(over)
    return total - (start if warmup == "null" else F.coalesce(start, F.lit(0)))


def with_running_sums(frame: DataFrame, key: str, values: Iterable[str]) -> DataFrame:
    """Add ``<value>_total`` and ``<value>_before`` for each whole-number column."""
    values = list(values)
    running = series(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = frame.withColumns({f"{v}_total": F.sum(v).over(running) for v in values})
    return totals.withColumns({f"{v}_before": F.col(f"{v}_total") - F.col(v) for v in values})
