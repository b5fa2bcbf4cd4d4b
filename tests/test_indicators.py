from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators, regimes
from tests.helpers import bars, close_to, column, day, same


def sma(frame, rows):
    return column(frame, f"sma_{rows}", "trade_date")


def rsi(frame):
    return column(frame, "rsi_14", "trade_date")


@pytest.fixture(scope="module")
def walks():
    rng = random.Random(7)

    def walk(length):
        price, out = Decimal("100.00"), []
        for _ in range(length):
            price += Decimal(rng.randint(-300, 300)) / 100
            out.append(price if rng.random() < 0.8 else None)
        return out

    return {1: walk(420), 2: walk(300), 3: walk(16), 4: walk(1)}


def test_moving_average_needs_a_full_frame(spark):
    frame = indicators.momentum(bars(spark, {1: list(range(1, 21))}))
    assert sma(frame, 20) == [None] * 19 + [10.5]
    assert sma(frame, 50) == [None] * 20


def test_partial_warmup(spark):
    frame = indicators.moving_averages(bars(spark, {1: [1, 2, 3]}), warmup="partial")
    assert sma(frame, 20) == [1.0, 1.5, 2.0]


def test_rsi(spark):
    closes = [10, 11] * 7 + [14]
    assert rsi(indicators.momentum(bars(spark, {1: closes}))) == [None] * 14 + [62.5]


def test_rsi_without_losses_and_flat(spark):
    assert rsi(indicators.momentum(bars(spark, {1: list(range(1, 16))}))) == [None] * 14 + [100.0]
    assert rsi(indicators.momentum(bars(spark, {1: [5] * 15}))) == [None] * 15


def test_rsi_on_a_threshold_is_exact(spark):
    """Gains of 12.6 against losses of 29.4 are 30 percent, whatever their binary value."""
    steps = ["12.6"] + ["0"] * 12 + ["-29.4"]
    closes = [Decimal("100")]
    for step in steps:
        closes.append(closes[-1] + Decimal(step))
    assert rsi(indicators.momentum(bars(spark, {1: closes})))[-1] == 30.0


def brute_force(series, rows):
    closes = [c for c in series if c is not None]
    averages, strength = [], []
    for i in range(len(closes)):
        frame = closes[i + 1 - rows : i + 1] if i + 1 >= rows else None
        averages.append(float(sum(frame) / rows) if frame else None)
        moves = [closes[j] - closes[j - 1] for j in range(i - 13, i + 1)] if i >= 14 else None
        if moves is None or not any(moves):
            strength.append(None)
        else:
            gains = sum(m for m in moves if m > 0)
            strength.append(float(100 * gains / sum(abs(m) for m in moves)))
    return averages, strength


@pytest.mark.parametrize("rows", [20, 50, 200])
def test_matches_brute_force(spark, walks, rows):
    frame = indicators.momentum(bars(spark, walks))
    for stock_id, series in walks.items():
        own = frame.where(F.col("stock_id") == stock_id)
        averages, strength = brute_force(series, rows)
        assert close_to(sma(own, rows), averages)
        assert close_to(rsi(own), strength)


def test_bounds(spark, walks):
    frame = indicators.momentum(bars(spark, walks)).where("rsi_14 IS NOT NULL")
    assert frame.where("rsi_14 < 0 OR rsi_14 > 100").isEmpty()


def test_partitioning_does_not_change_results(spark, walks):
    prices = bars(spark, walks)
    assert same(
        indicators.momentum(prices.repartition(1)),
        indicators.momentum(prices.repartition(7, "trade_date")),
    )


def test_wilder_smoothing(spark, walks):
    frame = indicators.momentum(bars(spark, walks), smoothing="wilder")
    closes = [float(c) for c in walks[1] if c is not None]
    moves = [b - a for a, b in zip(closes, closes[1:])]
    gain = sum(max(m, 0) for m in moves[:14]) / 14
    loss = sum(max(-m, 0) for m in moves[:14]) / 14
    expected = [100 * gain / (gain + loss)]
    for move in moves[14:]:
        gain = (gain * 13 + max(move, 0)) / 14
        loss = (loss * 13 + max(-move, 0)) / 14
        expected.append(100 * gain / (gain + loss))
    own = frame.where("stock_id = 1")
    assert close_to(rsi(own), [None] * 14 + expected, 1e-9)
    assert frame.where("stock_id = 4").count() == 1


def test_unknown_options_are_refused(spark):
    with pytest.raises(ValueError):
        indicators.momentum(bars(spark, {1: [1]}), smoothing="other")
    with pytest.raises(ValueError):
        indicators.momentum(bars(spark, {1: [1]}), warmup="other")


def test_cross_events(spark):
    rows = [(1, day(n), None, a, b, None) for n, (a, b) in enumerate(
        [(1.0, None), (1.0, 2.0), (3.0, 2.0), (2.0, 2.0), (2.5, 2.0), (2.6, 2.0)])]
    schema = "stock_id long, trade_date date, sma_20 double, sma_50 double, sma_200 double, rsi_14 double"
    events = regimes.cross_events(spark.createDataFrame(rows, schema))
    assert column(events, "trade_date", "trade_date") == [day(2), day(3), day(4)]
    assert [s.split()[0] for s in column(events, "trend_signal", "trade_date")] == ["Golden", "Death", "Golden"]


def test_rsi_recoveries(spark):
    readings = [50.0, 25.0, 35.0, 41.0, 75.0, 61.0, 59.0]
    rows = [(1, day(n), value) for n, value in enumerate(readings)]
    frame = regimes.rsi_recoveries(spark.createDataFrame(rows, "stock_id long, trade_date date, rsi_14 double"))
    assert column(frame, "passed", "trade_date") == [False, False, False, True, False, False, True]
