"""Deliveries derived from the driver's bars: landed files, late changes, defects."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import schema as S
from barloom.operators import upsert, validate
from barloom.operators.lookup import active_universe
from barloom.sources.market import Market
from barloom.sources.shared import new_folder

# A row's defect follows from its stock and day; most rows have none.
DEFECTS = 11
ZERO_OPEN, CROSSED, NAN_OPEN, STRANGER, NO_VOLUME, NAN_VOLUME, LOWER_CASE = range(7)


def landed(market: Market) -> DataFrame:
    """All bars as they might land: one up, by symbol and stamp, a part of them defective."""
    bars = market.daily_prices.join(market.stocks.select("stock_id", "symbol"), "stock_id")
    defect = (F.col("stock_id") * 31 + F.dayofyear("trade_date")) % DEFECTS
    bars = bars.withColumn("defect", defect)

    def price(name: str) -> Column:
        return F.col(name).cast("double")

    def on(kind: int) -> Column:
        return F.col("defect") == kind

    nan = F.lit(float("nan"))
    stamp = F.col("trade_date").cast("timestamp_ntz") + F.expr("INTERVAL '15:30' HOUR TO MINUTE")
    return bars.select(
        F.when(on(STRANGER), F.concat(F.lit("UNK"), F.col("stock_id").cast("string")))
        .when(on(LOWER_CASE), F.lower("symbol"))
        .otherwise(F.col("symbol"))
        .alias("symbol"),
        stamp.alias("ts"),
        F.when(on(ZERO_OPEN), 0.0)
        .when(on(NAN_OPEN), nan)
        .otherwise(price("open_price"))
        .alias("open"),
        F.when(on(CROSSED), price("low_price") - 1).otherwise(price("high_price")).alias("high"),
        price("low_price").alias("low"),
        (price("close_price") + 1).alias("close"),
        F.when(on(NAN_VOLUME), nan)
        .when(~on(NO_VOLUME), F.col("volume").cast("double"))
        .alias("volume"),
    )


def kept(rows: DataFrame, name: str) -> DataFrame:
    """Rows written once to shared storage, for those who read them several times."""
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def with_bars_kept(market: Market) -> Market:
    """The market with its bars made once."""
    bars = kept(market.daily_prices, "bars")
    return Market(market.stocks, bars, market.stock_pairs, newest=market.newest)


def land_csv(market: Market, folder: str) -> None:
    """``landed`` as CSV files in three column orders, and files of rows too short and too long."""
    rows, names = kept(landed(market), "rows"), ["symbol", "ts", "open", "high", "low", "close", "volume"]
    third = F.pmod(F.hash("symbol", "ts"), F.lit(3))
    for turn in range(3):
        order = [*names[2 * turn :], *names[: 2 * turn]]
        part = rows.where(third == turn).select(*order).write.mode("append")
        part.option("header", True).csv(folder)
    bad = rows.where("symbol LIKE '%1'").select(F.concat_ws(",", "symbol", "ts").alias("value"))
    long = bad.select(F.concat("value", F.lit(",1,2,1,1,7,8,9")).alias("value"))
    # One column whose name is the whole header, so that every task's file begins with it.
    lines = bad.unionByName(long).select(F.col("value").alias(",".join(names)))
    lines.write.mode("append").option("header", True).option("sep", "\x01").csv(folder)


def day_before(market: Market, days: int) -> Column:
    return F.date_sub(market.last_date(), days)


def target(market: Market) -> DataFrame:
    """The bars stored so far: all but the last week."""
    return market.daily_prices.where(F.col("trade_date") < day_before(market, 7))


def raised(market: Market) -> DataFrame:
    """The bars of the last two weeks, closing one higher: half of them are stored already."""
    higher = (F.col("close_price") + F.lit(Decimal("1.00"))).cast(S.PRICE)
    recent = market.daily_prices.where(F.col("trade_date") >= day_before(market, 14))
    return recent.withColumns({"close_price": higher, "adj_close": higher})


def merged(market: Market) -> DataFrame:
    return upsert.merge(target(market), raised(market))


def updated(market: Market) -> Market:
    """The market after the late changes are stored."""
    return Market(market.stocks, merged(market), market.stock_pairs)


def checked(market: Market) -> DataFrame:
    return validate.check(landed(market), market.stocks)


def asked(market: Market) -> DataFrame:
    """The checked rows as a refresh of the last two weeks judges them."""
    active = active_universe(market.stocks)
    return validate.asked(checked(market), market.last_date(), 14, active)


def is_late() -> Column:
    """The bars of every third stock on days of two stretches some years apart."""
    early = F.col("trade_date").between("1995-03-01", "1995-03-20")
    later = F.col("trade_date").between("1999-11-01", "1999-11-10")
    return (F.col("stock_id") % 3 == 0) & (early | later)


def delivered(market: Market, bars: DataFrame) -> DataFrame:
    """Sound bars as they land."""
    known = bars.join(market.stocks.select("stock_id", "symbol"), "stock_id")
    landed_as = {"open": "open_price", "high": "high_price", "low": "low_price", "close": "close_price"}
    return known.select(
        "symbol",
        F.col("trade_date").cast("timestamp_ntz").alias("ts"),
        *(F.col(name).cast("double").alias(landed) for landed, name in landed_as.items()),
        F.col("volume").cast("double").alias("volume"),
    )


#: By how much each of three deliveries closes higher, and which stocks it has: every n-th.
STEPS = ((3, 1), (-1, 3), (2, 5))


def in_turn(market: Market) -> list[DataFrame]:
    """Three deliveries of the same days in the order they land, each correcting the one before."""
    return [
        delivered(market, market.daily_prices.where(F.col("stock_id") % every == 0)).withColumn(
            "close", F.col("close") + F.lit(float(step))
        )
        for step, every in STEPS
    ]


def repeated(market: Market) -> tuple[DataFrame, DataFrame]:
    """Two deliveries in the order they land.

    The first has every bar three times in a row, closing 3 higher, 1 higher and 2 higher; the
    second has the bars of every third stock again, closing 1 lower.
    """
    bars = market.daily_prices.join(market.stocks.select("stock_id", "symbol"), "stock_id")

    def closing(rows: DataFrame, step: Column) -> DataFrame:
        low, high = (F.col(f"{name}_price").cast("double") for name in ("low", "high"))
        close = F.col("close_price").cast("double") + step
        return rows.select(
            "symbol",
            F.col("trade_date").cast("timestamp_ntz").alias("ts"),
            F.col("open_price").cast("double").alias("open"),
            high.alias("high"),
            low.alias("low"),
            close.alias("close"),
            F.col("volume").cast("double").alias("volume"),
        )

    steps = F.posexplode(F.array(*(F.lit(float(step)) for step in (3, 1, 2)))).alias("nth", "step")
    first = bars.select("*", steps).repartition("stock_id").sortWithinPartitions(*S.BAR_KEY, "nth")
    second = bars.where(F.col("stock_id") % 3 == 0)
    return closing(first, F.col("step")), closing(second, F.lit(-1.0))
