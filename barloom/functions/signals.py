"""Signal labels as column functions. A NULL input never matches and takes the last label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom import schema as S
from barloom.functions.exact import as_column, pct_change

# --- fixed values -----------------------------------------------------------
BUY = "BUY - Oversold"
SELL = "SELL - Overbought"
HOLD = "HOLD - Neutral"

BULLISH = "Bullish"
BEARISH = "Bearish"
GOLDEN_CROSS = "Golden Cross - Bullish"
DEATH_CROSS = "Death Cross - Bearish"

SHORT_A = "SHORT A / LONG B"
LONG_A = "LONG A / SHORT B"
WATCH = "WATCH"
NEUTRAL = "NEUTRAL"
NO_TRADE = "NO TRADE"
# ----------------------------------------------------------------------------


def oversold(rsi: Column | str) -> Column:
    return as_column(rsi) < S.RSI_OVERSOLD


def overbought(rsi: Column | str) -> Column:
    return as_column(rsi) > S.RSI_OVERBOUGHT


def rsi_action(rsi: Column | str) -> Column:
    return F.when(oversold(rsi), BUY).when(overbought(rsi), SELL).otherwise(HOLD)


def _rising(sma_50: Column | str, sma_200: Column | str) -> Column:
    return as_column(sma_50) > as_column(sma_200)


def trend(sma_50: Column | str, sma_200: Column | str) -> Column:
    return F.when(_rising(sma_50, sma_200), BULLISH).otherwise(BEARISH)


def cross_label(sma_50: Column | str, sma_200: Column | str) -> Column:
    """Which average lies on top today; a state, not the crossing itself."""
    return F.when(_rising(sma_50, sma_200), GOLDEN_CROSS).otherwise(DEATH_CROSS)


def trend_strength(sma_50: Column | str, sma_200: Column | str) -> Column:
    return pct_change(sma_200, sma_50)


def diverged_high(z: Column | str) -> Column:
    return as_column(z) > S.Z_ENTRY


def diverged_low(z: Column | str) -> Column:
    return as_column(z) < -S.Z_ENTRY


def pair_signal(z: Column | str) -> Column:
    """Four-way label, with a watch band between the two thresholds."""
    watch = F.abs(as_column(z)) > S.Z_WATCH
    return (
        F.when(diverged_high(z), SHORT_A)
        .when(diverged_low(z), LONG_A)
        .when(watch, WATCH)
        .otherwise(NEUTRAL)
    )


def pair_trade(z: Column | str) -> Column:
    """Three-way label without the watch band."""
    return F.when(diverged_high(z), SHORT_A).when(diverged_low(z), LONG_A).otherwise(NO_TRADE)
