"""Divergences of a pair from entry to exit, their profit, and the correlation of its legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import schema as S
from barloom.functions import signals
from barloom.functions.exact import pct_change
from barloom.operators.pairs import pair_closes, with_ratio, with_ratio_bands
from barloom.operators.rolling import series

# --- fixed values -----------------------------------------------------------
Z_EXIT = 0.5
LEG_AMOUNT = 100_000
MIN_CORRELATION = 0.7
# ----------------------------------------------------------------------------


def excursions(bars: DataFrame, stock_pairs: DataFrame) -> DataFrame:
    """One row per trade: entered when the z-score leaves the outer band, closed on the first
    later day it is back inside the inner band or beyond it on the other side, still open while
    it is not. A z-score that jumps from one outer band to the other closes a trade and enters
    the opposite one on the same day.

    A side is held if the last day that entered or left it entered it, so every step is a window
    over the pair's own series and the final grouping needs no further shuffle.
    """
    ordered = series("pair_id")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    z = F.col("z_score")
    high = F.when(z > S.Z_ENTRY, True).when(z <= Z_EXIT, False)
    low = F.when(z < -S.Z_ENTRY, True).when(z >= -Z_EXIT, False)

    def held(mark: Column) -> Column:
        return F.coalesce(F.last(mark, ignorenulls=True).over(so_far), F.lit(False)).cast("int")

    banded = with_ratio_bands(with_ratio(pair_closes(bars, stock_pairs)))
    turned = F.col("side") != F.col("was")
    states = (
        banded.withColumn("side", held(high) - held(low))
        .withColumn("was", F.lag("side", 1, 0).over(ordered))
        .withColumn("enters", turned & (F.col("side") != 0))
        .withColumn("leaves", turned & (F.col("was") != 0))
        .withColumn("entries", F.count_if("enters").over(so_far))
        .where(turned)
    )
    # A day that turns from one side to the other counts for both trades.
    ends = F.array_compact(
        F.array(
            F.when(F.col("enters"), F.struct(F.col("entries").alias("trade"), F.lit(True).alias("entry"))),
            F.when(
                F.col("leaves"),
                F.struct(
                    (F.col("entries") - F.col("enters").cast("int")).alias("trade"),
                    F.lit(False).alias("entry"),
                ),
            ),
        )
    )
    days = states.select("*", F.inline(ends))

    def at(entry: bool, name: str) -> Column:
        return F.max(F.when(F.col("entry") == entry, F.col(name)))

    return (
        days.groupBy("pair_id", "trade")
        .agg(
            at(True, "trade_date").alias("entry_date"),
            at(False, "trade_date").alias("exit_date"),
            at(True, "z_score").alias("entry_z"),
            *(at(True, f"close_{side}").alias(f"entry_{side}") for side in "ab"),
            *(at(False, f"close_{side}").alias(f"exit_{side}") for side in "ab"),
        )
        .withColumn("trade_signal", signals.pair_trade("entry_z"))
        .withColumn("holding_days", F.datediff("exit_date", "entry_date").cast("long"))
    )


def pair_profit(trades: DataFrame, amount: float = LEG_AMOUNT) -> DataFrame:
    """Profit of closed trades with the same amount in either leg."""
    gain_a = pct_change("entry_a", "exit_a")
    gain_b = pct_change("entry_b", "exit_b")
    short_a = F.col("trade_signal") == signals.SHORT_A
    spread = F.when(short_a, gain_b - gain_a).otherwise(gain_a - gain_b)
    return trades.where(F.col("exit_date").isNotNull()).withColumn(
        "profit", spread / 100.0 * F.lit(float(amount))
    )


def pair_correlation(bars: DataFrame, stock_pairs: DataFrame) -> DataFrame:
    """Correlation of both closes over the joint days, and whether it is high enough to trade."""
    closes = pair_closes(bars, stock_pairs)
    correlation = F.corr(F.col("close_a").cast("double"), F.col("close_b").cast("double"))
    return (
        closes.groupBy("pair_id")
        .agg(correlation.alias("correlation"), F.count("*").alias("days"))
        .withColumn("tradable", F.col("correlation") > MIN_CORRELATION)
    )
