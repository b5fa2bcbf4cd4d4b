"""Pair metrics: price ratio of two stocks, its trailing mean and its z-score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import schema as S
from barloom.functions.exact import ratio
from barloom.operators.joins import lookup_join
from barloom.operators.rolling import series

DEVIATIONS = {"population": F.stddev_pop, "sample": F.stddev_samp}


def legs(pairs: DataFrame) -> DataFrame:
    """Two rows per pair, one for each side."""
    sides = F.array(
        F.struct(F.lit("a").alias("side"), F.col("stock_a_id").alias("stock_id")),
        F.struct(F.lit("b").alias("side"), F.col("stock_b_id").alias("stock_id")),
    )
    return pairs.select("pair_id", F.inline(sides))


def _leg_bars(bars: DataFrame, pairs: DataFrame, salted: bool) -> DataFrame:
    """Close of every leg on every date, from one pass over the bars.

    One stock may sit in a large share of all pairs; a salted join spreads each stock's bars by
    date.
    """
    closes = bars.select(*S.BAR_KEY, "close_price")
    return lookup_join(closes, legs(pairs), "stock_id", F.col("trade_date"), salted=salted)


def pair_closes(
    bars: DataFrame, pairs: DataFrame, salted: bool = False
) -> DataFrame:
    """Both closes on the dates where both legs traded.

    Rows are placed by ``pair_id`` (at most two per calendar day), which serves this grouping and
    every later window over the pair's series, so the join result is shuffled once.
    """

    def close_of(side: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col("close_price")))

    return (
        _leg_bars(bars, pairs, salted)
        .repartition("pair_id")
        .groupBy(*S.PAIR_KEY)
        .agg(close_of("a").alias("close_a"), close_of("b").alias("close_b"))
        .where(F.col("close_a").isNotNull() & F.col("close_b").isNotNull())
    )


def with_ratio(closes: DataFrame) -> DataFrame:
    return closes.withColumn("price_ratio", ratio(F.col("close_a"), F.col("close_b")))


def pair_ratios(
    bars: DataFrame, pairs: DataFrame, salted: bool = False
) -> DataFrame:
    closes = pair_closes(bars, pairs, salted)
    return with_ratio(closes).select(*S.PAIR_KEY, "price_ratio")


def with_ratio_bands(
    ratios: DataFrame, warmup: str = "null", deviation: str = "population"
) -> DataFrame:
    """Trailing mean and z-score over 20 rows of the pair's own series."""
    ordered = series("pair_id")
    frame = ordered.rowsBetween(1 - S.RATIO_ROWS, Window.currentRow)
    full = F.lit(True) if warmup == "partial" else F.row_number().over(ordered) >= S.RATIO_ROWS
    mean = F.avg("price_ratio").over(frame)
    spread = DEVIATIONS[deviation]("price_ratio").over(frame)
    return ratios.withColumns(
        {
            "ratio_sma_20": F.when(full, mean),
            "z_score": F.when(full, ratio(F.col("price_ratio") - mean, spread)),
        }
    )


def pair_metrics(
    bars: DataFrame,
    pairs: DataFrame,
    warmup: str = "null",
    deviation: str = "population",
    salted: bool = False,
) -> DataFrame:
    """The full pair table: one row per pair and joint trading day."""
    return with_ratio_bands(pair_ratios(bars, pairs, salted), warmup, deviation)
