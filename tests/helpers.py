from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

from barloom import schema as S
from barloom.sources.market import Market

START = date(2020, 1, 1)


def day(number: int) -> date:
    return START + timedelta(days=number)


def bar(stock_id, when, close, **values):
    price = Decimal(str(close))
    row = {name: price for name in S.PRICE_COLUMNS} | {"volume": 1} | values
    return (stock_id, when, *(row[name] for name in S.VALUE_COLUMNS))


def bars(spark, closes: dict[int, list], start: int = 0):
    """One bar per day and stock; a None close leaves the day out."""
    rows = [
        bar(stock_id, day(start + number), close)
        for stock_id, series in closes.items()
        for number, close in enumerate(series)
        if close is not None
    ]
    return spark.createDataFrame(rows, S.DAILY_PRICES)


def stocks(spark, *ids: int, inactive: tuple = ()):
    rows = [(i, f"SYM{i}", f"Company {i}", i not in inactive) for i in ids]
    return spark.createDataFrame(rows, S.STOCKS)


def stock_pairs(spark, *legs: tuple[int, int]):
    rows = [(n, f"SYM{a}-SYM{b}", a, b) for n, (a, b) in enumerate(legs, start=1)]
    return spark.createDataFrame(rows, S.STOCK_PAIRS)


def market(spark, closes, pairs=(), inactive=()):
    listed = stocks(spark, *closes, inactive=inactive)
    return Market(listed, bars(spark, closes), stock_pairs(spark, *pairs))


def raw(spark, *rows):
    """Landed rows ``(symbol, day, open, high, low, close, volume)``."""
    stamped = [(r[0], r[1] and datetime(r[1].year, r[1].month, r[1].day, 15, 30), *r[2:]) for r in rows]
    return spark.createDataFrame(stamped, S.RAW_BARS)


def column(frame, name, *order):
    return [row[name] for row in frame.orderBy(*order).collect()]


def same(left, right) -> bool:
    """Equal rows, in any order, with duplicates counted."""
    names = sorted(left.columns)
    assert names == sorted(right.columns)
    left, right = left.select(names), right.select(names)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def close_to(got, expected, tolerance: float = 1e-12) -> bool:
    """Equal lists up to a relative tolerance, with None matching only None."""
    assert len(got) == len(expected)
    return all(
        (a is None and b is None)
        or (a is not None and b is not None and abs(a - b) <= tolerance * max(1.0, abs(b)))
        for a, b in zip(got, expected)
    )
