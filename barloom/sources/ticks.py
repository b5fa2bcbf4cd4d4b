"""Daily bars from a table of order lines, read as a stream of price steps.

Every line of a supplier moves that supplier's price by a few cents. A day's bar opens at the
previous close and closes after all steps of the day; its extremes reach past the body by the
day's largest single step up and down. Every part is a plain sum, minimum or maximum, so lines
are aggregated before they are shuffled and the later running sum sees one row per supplier and
day, however many lines a supplier has.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import schema as S
from barloom.operators.rolling import spread, with_running_sums
from barloom.sources.market import Market

LINES = """
    l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double
"""
SUPPLIERS = "s_suppkey long, s_name string, s_acctbal double"

START_CENTS = 1_000_000
STEP_RANGE = 2001


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The order lines as ``(stock_id, trade_date, step, quantity)``, steps in cents."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return spark.read.schema(LINES).parquet(f"{folder}/lineitem.parquet").select(
        F.col("l_suppkey").alias("stock_id"),
        F.to_date("l_shipdate").alias("trade_date"),
        (cents % STEP_RANGE - STEP_RANGE // 2).alias("step"),
        F.col("l_quantity").alias("quantity"),
    )


def stocks(spark: SparkSession, folder: str) -> DataFrame:
    """One stock per supplier; suppliers in debt count as inactive."""
    return spark.read.schema(SUPPLIERS).parquet(f"{folder}/supplier.parquet").select(
        F.col("s_suppkey").alias("stock_id"),
        F.concat(F.lit("SYM"), F.col("s_suppkey").cast("string")).alias("symbol"),
        F.col("s_name").alias("company_name"),
        (F.col("s_acctbal") >= 0).alias("is_active"),
    )


def stock_pairs(listed: DataFrame) -> DataFrame:
    """Every stock is paired with the next one, so most stocks are in two pairs."""
    first = listed.select(
        F.col("stock_id").alias("stock_a_id"),
        (F.col("stock_id") + 1).alias("stock_b_id"),
        F.col("symbol").alias("symbol_a"),
    )
    second = listed.select(
        F.col("stock_id").alias("stock_b_id"), F.col("symbol").alias("symbol_b")
    )
    return first.join(second, "stock_b_id").select(
        F.col("stock_a_id").alias("pair_id"),
        F.concat_ws("-", "symbol_a", "symbol_b").alias("pair_name"),
        "stock_a_id",
        "stock_b_id",
    )


def daily_prices(spark: SparkSession, folder: str) -> DataFrame:
    days = (
        read_lines(spark, folder)
        .groupBy(*S.BAR_KEY)
        .agg(
            F.sum("step").alias("move"),
            F.max("step").alias("up"),
            F.min("step").alias("down"),
            F.sum("quantity").cast("long").alias("volume"),
        )
    )
    walk = with_running_sums(spread(days, "stock_id"), "stock_id", ["move"])
    first = F.lit(START_CENTS) + F.col("move_before")
    last = F.lit(START_CENTS) + F.col("move_total")
    zero = F.lit(0)

    def price(cents: Column) -> Column:
        return (cents * F.lit(Decimal("0.01"))).cast(S.PRICE)

    return walk.select(
        *S.BAR_KEY,
        price(first).alias("open_price"),
        price(F.greatest(first, last) + F.greatest(F.col("up"), zero)).alias("high_price"),
        price(F.least(first, last) + F.least(F.col("down"), zero)).alias("low_price"),
        price(last).alias("close_price"),
        price(last).alias("adj_close"),
        "volume",
    )


def newest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest trading day; every line makes a bar, so no bar has to be built for it."""
    return read_lines(spark, folder).agg(F.max("trade_date").alias("last_date"))


class TickMarket(Market):
    """The market of one folder; a table is defined when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    @cached_property
    def stocks(self) -> DataFrame:
        return stocks(self.spark, self.folder)

    @cached_property
    def daily_prices(self) -> DataFrame:
        return daily_prices(self.spark, self.folder)

    @cached_property
    def stock_pairs(self) -> DataFrame:
        return stock_pairs(self.stocks)

    @cached_property
    def newest(self) -> DataFrame:
        return newest(self.spark, self.folder)
