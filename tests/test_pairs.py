from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from barloom import schema as S
from barloom.functions import signals
from barloom.operators import excursions, pairs, tail
from tests.helpers import bars, column, day, same, stock_pairs


def ratios(spark, values):
    rows = [(1, day(n), float(v)) for n, v in enumerate(values)]
    return spark.createDataFrame(rows, "pair_id long, trade_date date, price_ratio double")


def test_z_score(spark):
    bands = pairs.with_ratio_bands(ratios(spark, [1] * 19 + [2]))
    last = bands.orderBy(F.desc("trade_date")).first()
    assert last.ratio_sma_20 == pytest.approx(1.05)
    assert last.z_score == pytest.approx(4.3589, abs=1e-4)
    assert bands.where("z_score IS NOT NULL OR ratio_sma_20 IS NOT NULL").count() == 1


def test_sample_deviation(spark):
    bands = pairs.with_ratio_bands(ratios(spark, [1] * 19 + [2]), deviation="sample")
    assert bands.orderBy(F.desc("trade_date")).first().z_score == pytest.approx(4.2485, abs=1e-4)


def test_zero_deviation_and_partial_warmup(spark):
    bands = pairs.with_ratio_bands(ratios(spark, [1] * 20))
    assert column(bands, "z_score", "trade_date") == [None] * 20
    bands = pairs.with_ratio_bands(ratios(spark, [1, 3]), warmup="partial")
    assert column(bands, "ratio_sma_20", "trade_date") == [1.0, 2.0]


def test_joins_days_on_which_both_traded(spark):
    prices = bars(spark, {1: [10, None, 30, 40], 2: [5, 6, None, 0], 3: [1, 1, 1, 1]})
    metrics = pairs.pair_ratios(prices, stock_pairs(spark, (1, 2)))
    assert column(metrics, "trade_date", "trade_date") == [day(0), day(3)]
    assert column(metrics, "price_ratio", "trade_date") == [2.0, None]


@pytest.fixture
def many(spark):
    closes = {i: [Decimal(100 + (i * n * 7) % 23) for n in range(60)] for i in range(1, 13)}
    legs = [(1, i) for i in range(2, 13)] + [(i, 1) for i in range(2, 6)] + [(1, 1)]
    return bars(spark, closes), stock_pairs(spark, *legs)


def test_long_pair_lists_give_the_same_rows(spark, many):
    prices, listed = many
    broadcast = pairs.pair_metrics(prices, listed)
    salted = pairs.pair_metrics(prices, listed, salted=True)
    assert "salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    assert broadcast.count() == 16 * 60
    assert same(broadcast, salted)


def test_z_score_ignores_the_scale_of_a_leg(spark, many):
    prices, listed = many
    scaled = prices.withColumn(
        "close_price",
        F.when(F.col("stock_id") == 1, F.col("close_price") * 4)
        .otherwise(F.col("close_price"))
        .cast("decimal(18,4)"),
    )
    pairs_of_one = listed.where("stock_a_id = 1 AND stock_b_id <> 1")
    left = pairs.pair_metrics(prices, pairs_of_one)
    right = pairs.pair_metrics(scaled, pairs_of_one).withColumnRenamed("z_score", "other")
    joined = left.join(right, ["pair_id", "trade_date"]).where("z_score IS NOT NULL")
    assert joined.count() > 0
    assert joined.where("abs(z_score - other) > 1e-9").isEmpty()


def test_excursion_from_entry_to_exit(spark):
    a = [100 + (n % 2) for n in range(20)] + [110, 106, 103, 101, 100, 90]
    b = [100] * len(a)
    trades = excursions.excursions(bars(spark, {1: a, 2: b}), stock_pairs(spark, (1, 2)))
    metrics = pairs.pair_metrics(bars(spark, {1: a, 2: b}), stock_pairs(spark, (1, 2)))
    z = {r.trade_date: r.z_score for r in metrics.collect()}
    first, second = trades.orderBy("entry_date").collect()
    assert first.entry_date == day(20) and z[day(20)] > 2
    assert all(abs(z[day(n)]) > 0.5 for n in range(20, (first.exit_date - day(0)).days))
    assert abs(z[first.exit_date]) <= 0.5
    assert first.trade_signal == signals.SHORT_A
    assert first.holding_days == (first.exit_date - first.entry_date).days
    assert second.entry_date == day(25) and second.exit_date is None
    assert second.trade_signal == signals.LONG_A


def test_a_flip_closes_a_trade_and_enters_the_opposite_one(spark):
    a = [100 + (n % 2) for n in range(20)] + [125, 60, 40]
    b = [100] * len(a)
    listed = stock_pairs(spark, (1, 2))
    z = [r.z_score for r in pairs.pair_metrics(bars(spark, {1: a, 2: b}), listed).orderBy("trade_date").collect()]
    assert z[20] > 2 and z[21] < -2
    first, second = excursions.excursions(bars(spark, {1: a, 2: b}), listed).orderBy("entry_date").collect()
    assert (first.entry_date, first.exit_date, first.trade_signal) == (day(20), day(21), signals.SHORT_A)
    assert (second.entry_date, second.exit_date, second.trade_signal) == (day(21), None, signals.LONG_A)


def test_profit_of_equal_legs(spark):
    schema = (
        "trade_signal string, exit_date date, entry_a double, exit_a double, entry_b double, exit_b double"
    )
    rows = [
        (signals.SHORT_A, day(1), 100.0, 98.0, 50.0, 50.5),
        (signals.LONG_A, day(1), 100.0, 102.0, 50.0, 50.5),
        (signals.LONG_A, None, 100.0, None, 50.0, None),
    ]
    profits = excursions.pair_profit(spark.createDataFrame(rows, schema))
    assert sorted(r.profit for r in profits.collect()) == pytest.approx([1000.0, 3000.0])


def test_correlation(spark):
    closes = {1: [1, 2, 3, 4], 2: [2, 4, 6, 8], 3: [4, 3, 2, 1]}
    rows = excursions.pair_correlation(bars(spark, closes), stock_pairs(spark, (1, 2), (1, 3)))
    first, second = rows.orderBy("pair_id").collect()
    assert (first.correlation, first.tradable) == (pytest.approx(1.0), True)
    assert (second.correlation, second.tradable) == (pytest.approx(-1.0), False)


def test_tasks_do_not_merge_under_aggregates(spark):
    """Small exchanges are merged by adaptive execution, but not those that hash maps are built on."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = F.lit(Decimal("1.0000")).cast(S.PRICE)
    days = spark.range(6).select(
        (F.col("id") % 2 + 1).alias("stock_id"),
        F.date_add(F.lit(date(2000, 1, 3)), F.floor(F.col("id") / 2).cast("int")).alias("trade_date"),
        *(one.alias(name) for name in S.PRICE_COLUMNS),
        F.lit(1).cast("long").alias("volume"),
    )
    changed = days.select(*S.BAR_KEY).limit(2)
    assert tail.momentum_tail(days, changed).rdd.getNumPartitions() == tasks
