from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest

from barloom import schema as S
from barloom.functions import signals
from barloom.plans import catalog, reports
from barloom.sources import seed
from barloom.sources.market import Market, run_sql
from tests.helpers import bar, column, day, market, stock_pairs, stocks

RISING = [100 + n for n in range(260)]
FALLING = [500 - n for n in range(260)]


def rows(frame):
    return [tuple(row) for row in frame.collect()]


def priced(spark, *prices):
    return spark.createDataFrame([bar(*p) for p in prices], S.DAILY_PRICES)


def test_overview_covers_stocks_of_the_newest_day_only(spark):
    m = market(spark, {1: RISING, 2: FALLING, 3: RISING[:100]}, inactive=(2,))
    overview = {row.symbol: row for row in reports.market_overview(m).collect()}
    assert set(overview) == {"SYM1", "SYM2"}
    assert overview["SYM1"].trend == signals.BULLISH
    assert overview["SYM1"].action == signals.SELL
    assert overview["SYM2"].action == signals.BUY
    assert overview["SYM1"].ma_20 == pytest.approx(sum(RISING[-20:]) / 20)


def test_overview_sorts_missing_rsi_first(spark):
    m = market(spark, {1: [None] * 250 + RISING[-10:], 2: FALLING, 3: RISING})
    report = reports.market_overview(m)
    assert [row.symbol for row in report.collect()] == ["SYM1", "SYM2", "SYM3"]
    assert report.first().action == signals.HOLD and report.first().trend == signals.BEARISH


def test_signal_reports_use_a_closed_window(spark):
    m = market(spark, {1: FALLING[:60]})
    days = [row.days_ago for row in reports.oversold(m, day(59), days=30, limit=100).collect()]
    assert days == list(range(31))
    assert reports.overbought(m, day(59)).isEmpty()
    past = reports.oversold(m, day(40), days=3).collect()
    assert [row.trade_date for row in past] == [day(40), day(39), day(38), day(37)]


def test_signal_reports_keep_the_best_rows_of_a_day(spark):
    m = market(spark, {i: RISING[:30] for i in range(1, 26)})
    report = reports.overbought(m, day(29))
    assert report.count() == S.SIGNAL_LIMIT
    assert column(report, "symbol", "symbol") == sorted(f"SYM{i}" for i in range(1, 26))[:20]


def test_window_defaults_to_today(spark):
    assert reports.oversold(market(spark, {1: FALLING[:60]})).isEmpty()


def test_long_term_trends(spark):
    m = market(spark, {1: RISING, 2: FALLING, 3: [None] * 100 + RISING[100:]})
    report = reports.long_term_trends(m).collect()
    assert [row.symbol for row in report] == ["SYM1", "SYM2", "SYM3"]
    assert [row.trend_signal for row in report] == [
        signals.GOLDEN_CROSS,
        signals.DEATH_CROSS,
        signals.DEATH_CROSS,
    ]
    assert report[2].strength_pct is None


def test_yearly_performance(spark):
    prices = priced(
        spark,
        (1, date(2020, 1, 2), 100),
        (1, date(2020, 6, 1), 300),
        (1, date(2020, 12, 30), 145),
        (1, date(2021, 3, 1), 50),
        (2, date(2010, 12, 31), 10),
        (2, date(2011, 1, 1), 0),
        (2, date(2011, 1, 2), 5),
    )
    m = Market(stocks(spark, 1, 2), prices, stock_pairs(spark, (1, 2)))
    assert rows(reports.yearly_performance(m)) == [
        ("SYM1", 2021, 50.0, 50.0, 0.0, 1),
        ("SYM1", 2020, 100.0, 145.0, 45.0, 3),
        ("SYM2", 2011, 0.0, 5.0, None, 2),
    ]
    assert reports.yearly_performance(m, limit=1).count() == 1


def test_rsi_patterns(spark):
    m = market(spark, {1: FALLING[:24], 2: RISING[:19], 3: RISING[:14]})
    assert rows(reports.rsi_patterns(m)) == [
        ("SYM1", 10, 10, 0, 100.0, 0.0, 0.0),
        ("SYM2", 5, 0, 5, 0.0, 100.0, 100.0),
    ]


def pair_market(spark):
    flat = [Decimal(100 + n % 2) for n in range(30)]
    spiked = [*flat[:29], Decimal(120)]
    early = [*flat[:25], *[None] * 5]
    return market(spark, {1: spiked, 2: [100] * 30, 3: early}, [(1, 2), (2, 1), (3, 2)])


def test_every_pair_shows_its_own_newest_row(spark):
    report = reports.all_pairs_status(pair_market(spark)).collect()
    assert {row.pair_name for row in report} == {"SYM1-SYM2", "SYM2-SYM1", "SYM3-SYM2"}
    assert [abs(row.z_score) for row in report] == sorted((abs(r.z_score) for r in report), reverse=True)
    status = {row.pair_name: row.trade_signal for row in report}
    assert status["SYM1-SYM2"] == signals.SHORT_A
    assert status["SYM2-SYM1"] == signals.LONG_A


def test_diverged_pairs(spark):
    m = pair_market(spark)
    assert [(r.pair_name, r.trade_date) for r in reports.pairs_high(m, day(29)).collect()] == [
        ("SYM1-SYM2", day(29))
    ]
    assert column(reports.pairs_low(m, day(29)), "pair_name", "pair_name") == ["SYM2-SYM1"]


def test_pair_history(spark):
    history = reports.pair_history(pair_market(spark), day(29), days=4, pair_name="SYM1-SYM2")
    assert [row.trade_date for row in history.collect()] == [day(n) for n in (29, 28, 27, 26, 25)]
    assert history.first().trade_signal == signals.SHORT_A


def test_statistics_and_load_summary(spark):
    prices = priced(spark, (1, day(0), 1), (1, day(2), 1), (2, day(2), 1), (9, day(7), 1))
    m = Market(stocks(spark, 1, 2, 3), prices, stock_pairs(spark, (1, 2)))
    assert rows(reports.database_stats(m)) == [(2, 2, day(0), day(2))]
    assert rows(reports.load_summary(m)) == [
        ("SYM1", 2, day(0), day(2)),
        ("SYM2", 1, day(2), day(2)),
        ("SYM3", 0, None, None),
    ]


def test_catalog_runs_every_report(spark):
    m = pair_market(spark)
    assert [len(group) for group in catalog.CATALOG.values()] == [6, 4]
    for title in catalog.titles():
        assert catalog.run(title, m).columns
    assert not catalog.run("Pair History (30 Days)", m, as_of=day(29), pair_name="SYM1-SYM2").isEmpty()
    with pytest.raises(KeyError):
        catalog.run("no such report", m)


def test_sql_over_views(spark):
    m = market(spark, {1: RISING[:5]})
    m.create_views()
    counted = run_sql(spark, "SELECT count(*) AS n FROM daily_prices WHERE close_price > :low", low=102)
    assert rows(counted) == [(2,)]


def test_seed_lists(spark):
    listed, paired = seed.stocks(spark), seed.stock_pairs(spark)
    assert (listed.count(), paired.count()) == (10, 5)
    names = reports._with_legs(paired.select("pair_id"), Market(listed, None, paired))
    assert ("HDFCBANK-SBIN", "HDFCBANK.NS", "SBIN.NS") in rows(
        names.select("pair_name", "stock_a", "stock_b")
    )
