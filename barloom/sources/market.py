"""The five tables a report reads, whichever way they were made."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import indicators, pairs

TABLES = ("stocks", "daily_prices", "momentum_indicators", "stock_pairs", "pair_metrics")


def newest_rows(rows: DataFrame, key: str) -> DataFrame:
    """Every key's own newest row."""
    values = [name for name in rows.columns if name not in (key, "trade_date")]
    return rows.groupBy(key).agg(
        F.max("trade_date").alias("trade_date"),
        *(F.max_by(name, "trade_date").alias(name) for name in values),
    )


class Market:
    """A set of lazy tables.

    The two derived tables are taken as given when the caller has them stored, and are otherwise
    defined from the prices when a report first asks for them. ``newest`` is a one-row frame with
    the newest trading day, ``between`` returns the rows of a table for a range of days and
    ``latest`` the newest row of every key; a source that can answer one of them from less than the
    whole table supplies its own. ``summaries`` has a row per stock and period, see the warehouse.
    """

    summaries: DataFrame | None = None

    def __init__(
        self,
        stocks: DataFrame,
        daily_prices: DataFrame,
        stock_pairs: DataFrame,
        momentum_indicators: DataFrame | None = None,
        pair_metrics: DataFrame | None = None,
        newest: DataFrame | None = None,
        between: Callable[[str, Column, Column], DataFrame] | None = None,
        latest: Callable[[str, str], DataFrame] | None = None,
        summaries: DataFrame | None = None,
    ) -> None:
        self.stocks = stocks
        self.daily_prices = daily_prices
        self.stock_pairs = stock_pairs
        if momentum_indicators is not None:
            self.momentum_indicators = momentum_indicators
        if pair_metrics is not None:
            self.pair_metrics = pair_metrics
        if newest is not None:
            self.newest = newest
        if between is not None:
            self.between = between
        if latest is not None:
            self.latest = latest
        if summaries is not None:
            self.summaries = summaries

    @cached_property
    def momentum_indicators(self) -> DataFrame:
        return indicators.momentum(self.daily_prices)

    @cached_property
    def pair_metrics(self) -> DataFrame:
        return pairs.pair_metrics(self.daily_prices, self.stock_pairs)

    @cached_property
    def newest(self) -> DataFrame:
        return self.daily_prices.agg(F.max("trade_date").alias("last_date"))

    def last_date(self) -> Column:
        """The newest trading day as a scalar subquery."""
        return self.newest.scalar()

    def between(self, name: str, first: Column, last: Column) -> DataFrame:
        """Rows of the days from ``first`` to ``last``, both included."""
        return getattr(self, name).where(F.col("trade_date").between(first, last))

    def latest(self, name: str, key: str) -> DataFrame:
        """The newest row of every key of a table."""
        rows = getattr(self, name)
        return newest_rows(rows, key)

    def create_views(self) -> None:
        """Register the tables under their names for ``spark.sql``."""
        for name in TABLES:
            getattr(self, name).createOrReplaceTempView(name)


def run_sql(spark: SparkSession, query: str, **parameters: object) -> DataFrame:
    """Run a query over the registered views; ``:name`` markers take the keyword values."""
    return spark.sql(query, args=parameters)
