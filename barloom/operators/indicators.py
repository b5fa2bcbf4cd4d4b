"""Momentum indicators per stock: moving averages and the relative strength index.

All steps share one partitioning and one order, so Spark plans a single exchange and a single
sort for the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import schema as S
from barloom.functions.exact import ratio
from barloom.operators.rolling import series, trailing_sum, with_running_sums

KEY = "stock_id"
SMOOTHINGS = ("simple", "wilder")
UNITS = 10**S.PRICE.scale
# Rows that recursive smoothing folds into one map.
BLOCK_ROWS = 64


def price_deltas(bars: DataFrame) -> DataFrame:
    """Change of the close against the stock's previous row; NULL on its first row."""
    previous = F.lag("close_price").over(series(KEY))
    return bars.withColumn("delta", F.col("close_price") - previous)


def _price_units(bars: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Closes as whole numbers of the smallest price step.

    Whole numbers make every sum and difference exact, and every quotient the double nearest to
    the true one, so a value that lies on a threshold is never pushed over it. A running total
    stays inside a long for any calendar-long series of prices up to hundreds of millions.
    """
    units = (F.col("close_price") * UNITS).cast("long")
    return bars.select(*S.BAR_KEY, units.alias("units"), *carried)


def _with_moves(units: DataFrame) -> DataFrame:
    """Gain and loss against the previous row; both NULL on the first row of a stock."""
    delta = F.col("units") - F.lag("units").over(series(KEY))
    zero = F.lit(0).cast("long")
    known = F.col("delta").isNotNull()
    return units.withColumn("delta", delta).withColumns(
        {
            "gain": F.when(known, F.greatest(F.col("delta"), zero)),
            "loss": F.when(known, F.greatest(-F.col("delta"), zero)),
        }
    )


def _trailing(value: str, rows: int, warmup: str) -> Column:
    return trailing_sum(
        F.col(f"{value}_total"), F.col(f"{value}_before"), rows, series(KEY), warmup
    )


def _sma(rows: int, warmup: str) -> Column:
    count = F.lit(rows)
    if warmup == "partial":
        count = F.least(F.row_number().over(series(KEY)), count)
    total = _trailing("units", rows, warmup)
    return (total.cast("double") / (count * UNITS).cast("double")).alias(f"sma_{rows}")


def _rsi(warmup: str) -> Column:
    gain = _trailing("gain", S.RSI_ROWS, warmup)
    loss = _trailing("loss", S.RSI_ROWS, warmup)
    return ratio(gain * 100, gain + loss).alias(f"rsi_{S.RSI_ROWS}")


def moving_averages(bars: DataFrame, warmup: str = "null") -> DataFrame:
    """Trailing means of the close over 20, 50 and 200 rows, NULL until the frame is full."""
    sums = with_running_sums(_price_units(bars), KEY, ["units"])
    return sums.select(*S.BAR_KEY, *(_sma(n, warmup) for n in S.SMA_ROWS))


def relative_strength(
    bars: DataFrame, warmup: str = "null", smoothing: str = "simple"
) -> DataFrame:
    """RSI over 14 changes; the first value is on row 15, a flat stretch gives NULL."""
    return momentum(bars, warmup, smoothing).select(*S.BAR_KEY, f"rsi_{S.RSI_ROWS}")


def momentum(
    bars: DataFrame, warmup: str = "null", smoothing: str = "simple", carried: Sequence[str] = ()
) -> DataFrame:
    """The full indicator table: one row per bar, with the columns of the bars that are ``carried``."""
    if smoothing not in SMOOTHINGS:
        raise ValueError(f"smoothing must be one of {SMOOTHINGS}, not {smoothing!r}")
    moves = _with_moves(_price_units(bars, carried))
    sums = with_running_sums(moves, KEY, ["units", "gain", "loss"])
    averages = [_sma(n, warmup) for n in S.SMA_ROWS]
    simple = sums.select(*S.BAR_KEY, *averages, _rsi(warmup), *carried)
    if smoothing == "simple":
        return simple
    smoothed = wilder_rsi(moves)
    return simple.drop(f"rsi_{S.RSI_ROWS}").join(smoothed, list(S.BAR_KEY))


def wilder_rsi(moves: DataFrame) -> DataFrame:
    """RSI with recursive smoothing, from the gain and loss of every row.

    Each mean is ``a * mean + b`` of the one before it. Such maps compose, so rows are folded in
    blocks: a block becomes one map, the maps of a stock are composed in order (both are bounded by
    the calendar), and the rows of every block are unrolled from the mean it begins with. The first
    mean is the plain one of 14 changes; before it, and on a flat stretch, the value is NULL.
    """
    rows = S.RSI_ROWS
    keep, sides = 1.0 - 1.0 / rows, ("gain", "loss")
    numbered = moves.select(*S.BAR_KEY, *sides, F.row_number().over(series(KEY)).alias("number"))
    first = F.col("number") <= rows + 1
    # Block 0 is the stretch of the first mean; all others hold BLOCK_ROWS rows.
    block = F.when(first, 0).otherwise(F.floor((F.col("number") - rows - 2) / BLOCK_ROWS) + 1)
    entry = F.struct("trade_date", *(F.col(side).cast("double").alias(side) for side in sides))
    blocks = (
        numbered.withColumn("block", block.cast("int"))
        .groupBy(KEY, "block")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    )

    def step(state: Column, entry: Column) -> Column:
        return F.struct(*((state[s] * keep + entry[s] / rows).alias(s) for s in sides))

    def folded(start: Column) -> Column:
        return F.aggregate("entries", start, step)

    nothing = F.struct(*(F.lit(0.0).alias(side) for side in sides))
    plain = F.aggregate(
        F.filter("entries", lambda entry: entry["gain"].isNotNull()),
        nothing,
        lambda state, entry: F.struct(*((state[s] + entry[s] / rows).alias(s) for s in sides)),
    )
    full = F.size("entries") == rows + 1
    moved = F.when(F.col("block") == 0, F.when(full, plain)).otherwise(folded(nothing))
    shrunk = F.when(F.col("block") == 0, F.lit(0.0)).otherwise(F.pow(F.lit(keep), F.size("entries")))
    maps = blocks.withColumn("map", F.struct(shrunk.alias("a"), moved.alias("b")))

    earlier = Window.partitionBy(KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.aggregate(
        F.collect_list("map").over(earlier),
        nothing,
        lambda state, its: F.struct(*((its["a"] * state[s] + its["b"][s]).alias(s) for s in sides)),
    )
    each = F.struct(F.lit(None).cast("date").alias("trade_date"), *(F.lit(0.0).alias(s) for s in sides))

    def append(done: Column, entry: Column) -> Column:
        state = step(F.element_at(done, -1), entry)
        return F.concat(done, F.array(F.struct(entry["trade_date"], *(state[s].alias(s) for s in sides))))

    start = F.struct(each["trade_date"].alias("trade_date"), *(F.col("begun")[s].alias(s) for s in sides))
    unrolled = F.slice(
        F.aggregate("entries", F.array(start), append), 2, BLOCK_ROWS
    )
    last = F.struct(F.element_at("entries", -1)["trade_date"].alias("trade_date"), *(F.col("map.b")[s].alias(s) for s in sides))
    before = F.transform(
        F.col("entries"),
        lambda entry: F.struct(entry["trade_date"].alias("trade_date"), *(F.lit(None).cast("double").alias(s) for s in sides)),
    )
    ready = F.concat(F.slice(before, 1, F.size("entries") - 1), F.array(last))
    means = F.when(F.col("block") > 0, unrolled).when(full, ready).otherwise(before)
    return (
        maps.withColumn("begun", begun)
        .select(KEY, F.inline(means))
        .select(*S.BAR_KEY, ratio(F.col("gain") * 100, F.col("gain") + F.col("loss")).alias(f"rsi_{rows}"))
    )
