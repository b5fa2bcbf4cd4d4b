"""Readings of the indicators over time: strength bands, crossings, recoveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import schema as S
from barloom.functions import signals
from barloom.functions.exact import as_column
from barloom.operators.rolling import series

# --- fixed values -----------------------------------------------------------
STRENGTH_MODERATE = 2
STRENGTH_STRONG = 5
RSI_EXTREME = 80
RSI_BOUNCED = 40
RSI_COOLED = 60
# ----------------------------------------------------------------------------


def strength_band(strength: Column | str) -> Column:
    """How far the averages are apart and which way; NULL if that is unknown."""
    size = F.abs(as_column(strength))
    band = (
        F.when(size >= STRENGTH_STRONG, "strong")
        .when(size >= STRENGTH_MODERATE, "moderate")
        .otherwise("weak")
    )
    way = F.when(as_column(strength) > 0, "up").otherwise("down")
    return F.when(size.isNotNull(), F.concat_ws(" ", band, way))


def rsi_band(rsi: Column | str) -> Column:
    return (
        F.when(as_column(rsi) > RSI_EXTREME, "very overbought")
        .when(signals.overbought(rsi), "overbought")
        .when(signals.oversold(rsi), "oversold")
        .otherwise("normal")
    )


def cross_events(indicators: DataFrame) -> DataFrame:
    """Days on which the 50-row average moved to the other side of the 200-row average."""
    ready = indicators.where(F.col("sma_200").isNotNull())
    label = signals.cross_label("sma_50", "sma_200")
    return (
        ready.select(*S.BAR_KEY, label.alias("trend_signal"))
        .withColumn("before", F.lag("trend_signal").over(series("stock_id")))
        .where(F.col("before") != F.col("trend_signal"))
        .drop("before")
    )


def rsi_recoveries(indicators: DataFrame) -> DataFrame:
    """Every RSI reading with its band, the signal last seen, and whether that has passed.

    An oversold signal has passed once the RSI is back above 40, an overbought one once it is
    back below 60.
    """
    rsi = F.col("rsi_14")
    so_far = series("stock_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    signal = F.when(signals.oversold(rsi), signals.BUY).when(signals.overbought(rsi), signals.SELL)
    bounced = (F.col("last_signal") == signals.BUY) & (rsi > RSI_BOUNCED)
    cooled = (F.col("last_signal") == signals.SELL) & (rsi < RSI_COOLED)
    return (
        indicators.where(rsi.isNotNull())
        .select(*S.BAR_KEY, "rsi_14", rsi_band(rsi).alias("band"))
        .withColumn("last_signal", F.last(signal, ignorenulls=True).over(so_far))
        .withColumn("passed", F.coalesce(bounced | cooled, F.lit(False)))
    )
