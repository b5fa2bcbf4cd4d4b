from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barloom.functions import signals
from barloom.functions.exact import nan_to_null, pct_change, snap_round
from barloom.operators import regimes


def values(spark, rows, schema, expression):
    frame = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [row[0] for row in frame.coalesce(1).select(expression).collect()]


def test_snap_round_decides_ties_on_the_decimal(spark):
    got = values(spark, [1.005, 2.675, -1.005, 0.125, None], "x double", snap_round("x", 2))
    assert got == [1.01, 2.68, -1.01, 0.13, None]
    assert values(spark, [1.00005, 1e15 + 0.5], "x double", snap_round("x", 4)) == [1.0001, 1e15 + 0.5]


def test_pct_change(spark):
    rows = [(100.0, 145.0), (100.0, 95.0), (0.0, 1.0), (None, 1.0)]
    got = values(spark, rows, "a double, b double", pct_change("a", "b"))
    assert got == [45.0, -5.0, None, None]


def test_nan_to_null(spark):
    assert values(spark, [float("nan"), 1.0, None], "x double", nan_to_null("x")) == [None, 1.0, None]


@pytest.mark.parametrize(
    ("label", "cases"),
    [
        (
            signals.rsi_action,
            {29.99: signals.BUY, 30.0: signals.HOLD, 70.0: signals.HOLD, 70.01: signals.SELL},
        ),
        (
            signals.pair_signal,
            {
                2.01: signals.SHORT_A,
                2.0: signals.WATCH,
                1.01: signals.WATCH,
                1.0: signals.NEUTRAL,
                -1.0: signals.NEUTRAL,
                -1.01: signals.WATCH,
                -2.0: signals.WATCH,
                -2.01: signals.LONG_A,
            },
        ),
        (
            signals.pair_trade,
            {
                2.01: signals.SHORT_A,
                2.0: signals.NO_TRADE,
                -2.0: signals.NO_TRADE,
                -2.01: signals.LONG_A,
            },
        ),
    ],
)
def test_labels_at_and_around_thresholds(spark, label, cases):
    assert values(spark, list(cases), "x double", label("x")) == list(cases.values())


def test_null_takes_the_last_label(spark):
    frame = spark.range(1).select(F.lit(None).cast("double").alias("x"))
    row = frame.select(
        signals.rsi_action("x"),
        signals.pair_signal("x"),
        signals.pair_trade("x"),
        signals.trend("x", "x"),
        signals.cross_label("x", "x"),
    ).first()
    assert list(row) == [
        signals.HOLD,
        signals.NEUTRAL,
        signals.NO_TRADE,
        signals.BEARISH,
        signals.DEATH_CROSS,
    ]


def test_trend(spark):
    rows = [(51.0, 50.0), (50.0, 50.0), (49.0, 50.0), (51.0, None)]
    got = values(spark, rows, "a double, b double", signals.trend("a", "b"))
    assert got == [signals.BULLISH, signals.BEARISH, signals.BEARISH, signals.BEARISH]
    got = values(spark, rows, "a double, b double", signals.cross_label("a", "b"))
    assert got == [signals.GOLDEN_CROSS, *[signals.DEATH_CROSS] * 3]


def test_trend_strength(spark):
    rows = [(105.0, 100.0), (95.0, 100.0), (1.0, 0.0)]
    strength = snap_round(signals.trend_strength("a", "b"), 2)
    assert values(spark, rows, "a double, b double", strength) == [5.0, -5.0, None]


def test_strength_bands(spark):
    cases = {0.5: "weak up", 2.0: "moderate up", 5.0: "strong up", -1.99: "weak down", -7.0: "strong down"}
    assert values(spark, list(cases), "x double", regimes.strength_band("x")) == list(cases.values())


def test_rsi_bands(spark):
    cases = {29.0: "oversold", 30.0: "normal", 70.0: "normal", 70.1: "overbought", 80.1: "very overbought"}
    assert values(spark, list(cases), "x double", regimes.rsi_band("x")) == list(cases.values())
