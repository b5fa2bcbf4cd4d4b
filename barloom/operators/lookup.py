"""Lookups against the stock list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.joins import lookup_join


def active_universe(stocks: DataFrame) -> DataFrame:
    """The stocks a refresh asks for; reports keep showing inactive ones."""
    return stocks.where("is_active").select("stock_id", "symbol")


def one_per_symbol(stocks: DataFrame) -> DataFrame:
    """The id a symbol resolves to: the smallest, should a symbol be listed twice."""
    return stocks.groupBy("symbol").agg(F.min("stock_id").alias("stock_id"))


def stock_ids(
    frame: DataFrame,
    stocks: DataFrame,
    spread_by: Column | None = None,
    salted: bool = False,
) -> DataFrame:
    """Add ``stock_id`` by symbol; an unknown symbol gets NULL.

    If ``salted``, rows of one symbol are spread by the input split they come from unless the
    caller names a better column.
    """
    spread = F.spark_partition_id() if spread_by is None else spread_by
    return lookup_join(frame, one_per_symbol(stocks), "symbol", spread, "left", salted)
