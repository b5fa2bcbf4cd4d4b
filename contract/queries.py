"""Registered queries: each takes a session and a folder of driver tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import schema as S
from barloom.functions import signals
from barloom.functions.exact import snap_round
from barloom.operators import (
    excursions,
    indicators,
    lookup,
    pairs,
    refresh,
    regimes,
    tail,
    upsert,
    validate,
)
from barloom.plans import maintain, reports
from barloom.sinks.export import export_csv
from barloom.sinks.warehouse import Warehouse
from barloom.sources import ticks
from barloom.sources.landing import read_landed, read_landed_csv
from barloom.sources.market import Market, run_sql
from barloom.sources.shared import new_folder
from barloom.streaming.ingest import landed_stream, start_ingest
from contract import fixtures

Query = Callable[[SparkSession, str], DataFrame]

# The driver's bars cover 1995 to 2001.
FROM_YEAR = 1996
PAIR_NAME = "SYM0-SYM1"
YEARLY_LIMIT = 150


def doubles(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({name: F.col(name).cast("double") for name in names})


def rounded(frame: DataFrame, **places: int) -> DataFrame:
    return frame.withColumns({name: snap_round(name, n) for name, n in places.items()})


def _over_market(plan: Callable[[Market], DataFrame]) -> Query:
    return lambda spark, folder: plan(ticks.TickMarket(spark, folder))


def _symbols_in_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols as the lines name them, by supplier and (mostly unknown) by part."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")

    def named(key: str) -> DataFrame:
        return lines.select(F.concat(F.lit("SYM"), F.col(key).cast("string")).alias("symbol"))

    return named("l_suppkey").union(named("l_partkey")).distinct()


def symbol_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.stock_ids(_symbols_in_lines(spark, folder), ticks.stocks(spark, folder))


def load_summary_latest(market: Market) -> DataFrame:
    """The load summary over the newest day only, where many stocks count 0."""
    newest = market.daily_prices.where(F.col("trade_date") == market.last_date())
    return reports.load_summary(Market(market.stocks, newest, market.stock_pairs))


SMA = {f"sma_{n}": 2 for n in S.SMA_ROWS}

READS: dict[str, Query] = {
    "active_universe": lambda spark, folder: lookup.active_universe(ticks.stocks(spark, folder)),
    "symbol_lookup": symbol_lookup,
    "stock_pairs": lambda spark, folder: ticks.stock_pairs(ticks.stocks(spark, folder)),
    "daily_bars": lambda spark, folder: doubles(
        ticks.daily_prices(spark, folder), *S.PRICE_COLUMNS
    ),
    "latest_date_global": lambda spark, folder: ticks.newest(spark, folder),
    "latest_per_pair": _over_market(
        lambda m: rounded(reports.latest_per_pair(m), price_ratio=4, z_score=2)
    ),
    "sma": _over_market(lambda m: rounded(indicators.moving_averages(m.daily_prices), **SMA)),
    "price_delta": _over_market(
        lambda m: doubles(
            indicators.price_deltas(m.daily_prices).select(*S.BAR_KEY, "delta"), "delta"
        )
    ),
    "rsi": _over_market(lambda m: rounded(indicators.relative_strength(m.daily_prices), rsi_14=2)),
    "rsi_wilder": _over_market(
        lambda m: rounded(
            indicators.relative_strength(m.daily_prices, smoothing="wilder"), rsi_14=2
        )
    ),
    "momentum": _over_market(lambda m: rounded(m.momentum_indicators, **SMA, rsi_14=2)),
    "pair_ratio": _over_market(
        lambda m: rounded(pairs.pair_ratios(m.daily_prices, m.stock_pairs), price_ratio=4)
    ),
    "pair_zscore": _over_market(
        lambda m: rounded(m.pair_metrics, price_ratio=4, ratio_sma_20=4, z_score=2)
    ),
    "market_overview": _over_market(reports.market_overview),
    "oversold": _over_market(lambda m: reports.oversold(m, m.last_date())),
    "overbought": _over_market(lambda m: reports.overbought(m, m.last_date())),
    "long_term_trends": _over_market(reports.long_term_trends),
    "oversold_all": _over_market(lambda m: reports.oversold(m, m.last_date(), limit=None)),
    "overbought_all": _over_market(lambda m: reports.overbought(m, m.last_date(), limit=None)),
    "pairs_high_all": _over_market(lambda m: reports.pairs_high(m, m.last_date(), limit=None)),
    "pairs_low_all": _over_market(lambda m: reports.pairs_low(m, m.last_date(), limit=None)),
    "yearly_performance": _over_market(lambda m: reports.yearly_performance(m, FROM_YEAR)),
    "yearly_performance_first": _over_market(
        lambda m: reports.yearly_performance(m, FROM_YEAR, limit=YEARLY_LIMIT)
    ),
    "first_last_in_year": _over_market(
        lambda m: doubles(reports.first_last_in_year(m, FROM_YEAR), "first_close", "last_close")
    ),
    "rsi_patterns": _over_market(reports.rsi_patterns),
    "all_pairs_status": _over_market(reports.all_pairs_status),
    "pairs_high": _over_market(lambda m: reports.pairs_high(m, m.last_date())),
    "pairs_low": _over_market(lambda m: reports.pairs_low(m, m.last_date())),
    "pair_history": _over_market(
        lambda m: reports.pair_history(m, m.last_date(), days=365, pair_name=PAIR_NAME)
    ),
    "database_stats": _over_market(reports.database_stats),
    "load_summary": _over_market(reports.load_summary),
    "load_summary_latest": _over_market(load_summary_latest),
}


def _doubled_bars(bars: DataFrame) -> DataFrame:
    return doubles(bars.select(*S.BAR_KEY, *S.VALUE_COLUMNS), *S.PRICE_COLUMNS)


def _new_rows(mode: str) -> Query:
    return _over_market(
        lambda m: _doubled_bars(
            upsert.new_rows(fixtures.raised(m), fixtures.target(m), mode)
        )
    )


def _newest(bars: DataFrame) -> DataFrame:
    return bars.agg(F.max("trade_date").alias("last_date"))


def _judged(m: Market) -> DataFrame:
    return validate.newer(fixtures.asked(m), fixtures.target(m), "global")


def refresh_result(spark: SparkSession, folder: str) -> DataFrame:
    """The record of a refresh, observed while its judged rows are written."""
    m = ticks.TickMarket(spark, folder)
    store = Warehouse(spark, new_folder(spark, "judged"))
    metrics = (*refresh.written(F.col("reason").isNull()), *refresh.left_out())
    judged = validate.outcome(_judged(m))
    _, seen = store.stage_counted("judged", judged, new_folder(spark, "batch"), *metrics)
    already = refresh.gate(_newest(fixtures.target(m)), m.last_date()).first().already_updated
    return refresh.record(spark, seen, already)


def _refresh_skipped(m: Market) -> DataFrame:
    rejects = validate.rejected(_judged(m))
    return rejects.groupBy("reason").agg(F.count("*").alias("rows"))


def _day_change(m: Market) -> DataFrame:
    before = Market(m.stocks, fixtures.target(m), m.stock_pairs)
    return refresh.day_change(
        reports.database_stats(before), reports.database_stats(fixtures.updated(m))
    )


def _momentum_tail(m: Market) -> DataFrame:
    """Stored indicators with the tail of the late changes merged in."""
    changed = tail.changed_days(fixtures.raised(m))
    stored = indicators.momentum(fixtures.target(m))
    fresh = tail.momentum_tail(fixtures.merged(m), changed)
    return rounded(upsert.merge(stored, fresh), **SMA, rsi_14=2)


def _pair_tail(m: Market) -> DataFrame:
    changed = tail.changed_pairs(tail.changed_days(fixtures.raised(m)), m.stock_pairs)
    stored = pairs.pair_metrics(fixtures.target(m), m.stock_pairs)
    fresh = tail.pair_tail(fixtures.merged(m), m.stock_pairs, changed, stored)
    merged = upsert.merge(stored, fresh, S.PAIR_KEY)
    return rounded(merged, price_ratio=4, ratio_sma_20=4, z_score=2)


def _warehouse(spark: SparkSession, m: Market, prices: DataFrame, grain: str) -> Warehouse:
    warehouse = Warehouse(spark, new_folder(spark, "warehouse"), grain)
    warehouse.write_list("stocks", m.stocks)
    warehouse.write_list("stock_pairs", m.stock_pairs)
    warehouse.write("daily_prices", prices)
    maintain.rebuild_all(warehouse)
    return warehouse


_stores: dict[tuple[str, str], str] = {}


def _stored_market(spark: SparkSession, folder: str) -> Market:
    """The stored tables of all bars, by month; made once in a session."""
    name = (spark.sparkContext.applicationId, folder)
    if name not in _stores:
        m = ticks.TickMarket(spark, folder)
        _stores[name] = _warehouse(spark, m, m.daily_prices, "month").root
    return Warehouse(spark, _stores[name], "month").market()


def _over_stored(plan: Callable[[Market], DataFrame]) -> Query:
    return lambda spark, folder: plan(_stored_market(spark, folder))


def stored_overview(spark: SparkSession, folder: str) -> DataFrame:
    """The overview from stored tables, read from the newest period alone."""
    m = ticks.TickMarket(spark, folder)
    warehouse = _warehouse(spark, m, m.daily_prices, "month")
    return reports.market_overview(warehouse.market())


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Prices and indicators after the landed bars streamed into a table that lacks a week."""
    m = fixtures.with_bars_kept(ticks.TickMarket(spark, folder))
    warehouse = _warehouse(spark, m, fixtures.target(m), "year")
    landing = new_folder(spark, "landing")
    delivery = fixtures.landed(m).repartitionByRange(4, "ts")
    delivery.write.parquet(landing)
    stream = landed_stream(warehouse, landing, files_per_batch=2)
    start_ingest(warehouse, stream, new_folder(spark, "ingest")).awaitTermination()
    stored = warehouse.table("daily_prices").select(*S.BAR_KEY, "close_price", "volume")
    joined = stored.join(warehouse.table("momentum_indicators"), list(S.BAR_KEY), "left")
    return rounded(doubles(joined, "close_price"), **SMA, rsi_14=2)


def _stored(warehouse: Warehouse) -> DataFrame:
    """Prices with both derived tables' newest columns, one row per bar."""
    prices = warehouse.table("daily_prices").select(*S.BAR_KEY, "close_price", "volume")
    joined = prices.join(warehouse.table("momentum_indicators"), list(S.BAR_KEY), "left")
    pair = warehouse.table("pair_metrics").withColumnRenamed("pair_id", "stock_id")
    return rounded(
        doubles(joined.join(pair, list(S.BAR_KEY), "left"), "close_price"),
        **SMA,
        rsi_14=2,
        price_ratio=4,
        ratio_sma_20=4,
        z_score=2,
    )


def _week_behind(spark: SparkSession, folder: str) -> tuple[Warehouse, Market, date]:
    """Stored tables that lack the last week."""
    m = ticks.TickMarket(spark, folder)
    return _warehouse(spark, m, fixtures.target(m), "year"), m, m.newest.first().last_date


def refresh_stored(spark: SparkSession, folder: str) -> DataFrame:
    """All stored tables after a refresh, each row with the record the refresh returned."""
    warehouse, m, today = _week_behind(spark, folder)
    record, _ = maintain.refresh(warehouse, fixtures.landed(m), as_of=today, days=14)
    return _stored(warehouse).crossJoin(record)


def refresh_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """The stored tables after a refresh that broke off once the prices were stored, and a plain
    one after it."""
    warehouse, m, today = _week_behind(spark, folder)
    landed = fixtures.landed(m)
    checked = validate.asked(
        validate.check(landed, m.stocks), F.lit(today), 14, lookup.active_universe(m.stocks)
    )
    judged = validate.newer(checked, warehouse.table("daily_prices"), "global", warehouse.newest())
    batch = new_folder(spark, "refresh")
    rows = warehouse.stage("judged", validate.outcome(judged), batch)
    stored = warehouse.stage("accepted", upsert.one_per_key(validate.accepted(rows)), batch)
    warehouse.begin(batch)
    warehouse.upsert("daily_prices", stored, batch=batch)
    maintain.refresh(warehouse, landed, as_of=today, days=14)
    return _stored(warehouse)


def bulk_load_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The stored tables after all landed bars were loaded into empty ones."""
    m = ticks.TickMarket(spark, folder)
    warehouse = _warehouse(spark, m, m.daily_prices.limit(0), "year")
    today = m.newest.first().last_date
    maintain.bulk_load(warehouse, fixtures.landed(m), as_of=today)
    return _stored(warehouse)


def late_bar_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The stored tables after bars that were missing in the middle of the history landed late."""
    m = ticks.TickMarket(spark, folder)
    missing = fixtures.is_late()
    warehouse = _warehouse(spark, m, m.daily_prices.where(~missing), "month")
    today = m.newest.first().last_date
    maintain.bulk_load(warehouse, fixtures.delivered(m, m.daily_prices.where(missing)), as_of=today)
    return _stored(warehouse)


def late_file_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The stored tables after three deliveries of the same days, of which the last to land was
    loaded first, the first next and once more at the end: what landed last is stored."""
    m = fixtures.with_bars_kept(ticks.TickMarket(spark, folder))
    warehouse = _warehouse(spark, m, m.daily_prices.limit(0), "year")
    today = m.newest.first().last_date
    paths = []
    for delivery in fixtures.in_turn(m):
        paths.append(new_folder(spark, "landing"))
        delivery.write.parquet(paths[-1])
    for number in (2, 0, 1, 0):
        maintain.bulk_load(warehouse, read_landed(spark, paths[number]), as_of=today)
    return _stored(warehouse)


def landed_once(spark: SparkSession, folder: str) -> DataFrame:
    """The rejects after two refreshes over one landing folder, which takes each file in once."""
    warehouse, m, today = _week_behind(spark, folder)
    landing = new_folder(spark, "landing")
    fixtures.landed(m).repartitionByRange(4, "ts").write.parquet(landing)
    maintain.refresh_folder(warehouse, landing, as_of=today, days=14)
    maintain.refresh_folder(warehouse, landing, as_of=today + timedelta(days=1), days=14)
    rejects = spark.read.parquet(f"{warehouse.path('rejects')}/*")
    return rejects.groupBy("reason").agg(F.count("*").alias("rows"))


def duplicate_delivery(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of two deliveries that repeat keys within a file and across files."""
    m = ticks.TickMarket(spark, folder)
    landing = new_folder(spark, "landing")
    for delivery in fixtures.repeated(m):
        delivery.write.mode("append").parquet(landing)
    checked = validate.check(read_landed(spark, landing), m.stocks)
    return _doubled_bars(upsert.one_per_key(validate.accepted(checked)))


def bar_quality_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Bars checked after a round through CSV files in three column orders, with malformed rows
    between them; volumes have decimals, gaps and NaN."""
    m = ticks.TickMarket(spark, folder)
    landing = new_folder(spark, "landing-csv")
    fixtures.land_csv(m, landing)
    checked = validate.check(read_landed_csv(spark, landing), m.stocks)
    return _doubled_bars(validate.accepted(checked))


def csv_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of CSV files in three column orders are refused, and why."""
    m = ticks.TickMarket(spark, folder)
    landing = new_folder(spark, "landing-csv")
    fixtures.land_csv(m, landing)
    rejects = validate.rejected(validate.check(read_landed(spark, landing, "csv"), m.stocks))
    return rejects.groupBy("reason").agg(F.count("*").alias("rows"))


def csv_export(spark: SparkSession, folder: str) -> DataFrame:
    """A report written as CSV and read back."""
    m = ticks.TickMarket(spark, folder)
    report = reports.rsi_patterns(m)
    path = export_csv(report, new_folder(spark, "export"), "RSI Patterns Analysis")
    return spark.read.option("header", True).schema(report.schema).csv(path)


def _sql_view(spark: SparkSession, folder: str) -> DataFrame:
    """A hand-written query over the registered tables."""
    ticks.TickMarket(spark, folder).create_views()
    query = """
        SELECT s.symbol, count(*) AS bars, CAST(max(p.close_price) AS DOUBLE) AS top_price
        FROM daily_prices p JOIN stocks s ON s.stock_id = p.stock_id
        WHERE p.volume >= :volume
        GROUP BY s.symbol
    """
    return run_sql(spark, query, volume=40)


def _trend_strength(m: Market) -> DataFrame:
    strength = signals.trend_strength("sma_50", "sma_200")
    ready = m.momentum_indicators.where(F.col("sma_200").isNotNull())
    return ready.select(
        *S.BAR_KEY,
        snap_round(strength, 2).alias("strength_pct"),
        regimes.strength_band(strength).alias("band"),
    )


TRADE_COLUMNS = ("pair_id", "entry_date", "exit_date", "holding_days", "trade_signal")


def _excursions(m: Market) -> DataFrame:
    trades = excursions.excursions(m.daily_prices, m.stock_pairs)
    return trades.select(*TRADE_COLUMNS, snap_round("entry_z", 2).alias("entry_z"))


def _pair_profit(m: Market) -> DataFrame:
    trades = excursions.excursions(m.daily_prices, m.stock_pairs)
    return excursions.pair_profit(trades).select(
        *TRADE_COLUMNS, snap_round("profit", 2).alias("profit")
    )


WRITES: dict[str, Query] = {
    "bar_window": _over_market(
        lambda m: _doubled_bars(refresh.history(m.daily_prices, m.last_date(), days=1000))
    ),
    "recent_bars": _over_market(
        lambda m: _doubled_bars(refresh.recent(m.daily_prices, m.stocks, m.last_date()))
    ),
    "bar_quality": _over_market(
        lambda m: _doubled_bars(validate.accepted(fixtures.checked(m)))
    ),
    "bar_rejects": _over_market(lambda m: validate.rejected(fixtures.checked(m))),
    "load_counts": _over_market(
        lambda m: validate.load_counts(fixtures.checked(m), m.stocks)
    ),
    "refresh_gate": _over_market(
        lambda m: refresh.gate(_newest(fixtures.target(m)), m.last_date())
    ),
    "new_rows_global": _new_rows("global"),
    "new_rows_per_stock": _new_rows("per_stock"),
    "upsert_bars": _over_market(lambda m: _doubled_bars(fixtures.merged(m))),
    "refresh_result": refresh_result,
    "refresh_skipped": _over_market(_refresh_skipped),
    "refresh_stored": refresh_stored,
    "refresh_resumed": refresh_resumed,
    "bulk_load_stored": bulk_load_stored,
    "late_bar_stored": late_bar_stored,
    "late_file_stored": late_file_stored,
    "duplicate_delivery": duplicate_delivery,
    "bar_quality_csv": bar_quality_csv,
    "csv_rejects": csv_rejects,
    "landed_once": landed_once,
    "refresh_errors": _over_market(
        lambda m: refresh.errors(validate.rejected(fixtures.asked(m)))
    ),
    "day_count_change": _over_market(_day_change),
    "momentum_tail": _over_market(_momentum_tail),
    "pair_tail": _over_market(_pair_tail),
    "stored_overview": stored_overview,
    "stream_ingest": stream_ingest,
    "csv_export": csv_export,
    "sql_view": _sql_view,
}

RULES: dict[str, Query] = {
    "trend_strength_bands": _over_market(_trend_strength),
    "cross_events": _over_market(lambda m: regimes.cross_events(m.momentum_indicators)),
    "rsi_recoveries": _over_market(
        lambda m: rounded(regimes.rsi_recoveries(m.momentum_indicators), rsi_14=2)
    ),
    "pair_excursions": _over_market(_excursions),
    "pair_profit": _over_market(_pair_profit),
    "pair_correlation": _over_market(
        lambda m: rounded(
            excursions.pair_correlation(m.daily_prices, m.stock_pairs), correlation=4
        )
    ),
}

STORED: dict[str, Query] = {
    "stored_oversold": _over_stored(lambda m: reports.oversold(m, m.last_date())),
    "stored_overbought": _over_stored(lambda m: reports.overbought(m, m.last_date())),
    "stored_trends": _over_stored(reports.long_term_trends),
    "stored_performance": _over_stored(lambda m: reports.yearly_performance(m, FROM_YEAR)),
    "stored_rsi_patterns": _over_stored(reports.rsi_patterns),
    "stored_pairs_status": _over_stored(reports.all_pairs_status),
    "stored_pairs_high": _over_stored(lambda m: reports.pairs_high(m, m.last_date())),
    "stored_pairs_low": _over_stored(lambda m: reports.pairs_low(m, m.last_date())),
    "stored_pair_history": _over_stored(
        lambda m: reports.pair_history(m, m.last_date(), days=365, pair_name=PAIR_NAME)
    ),
    "stored_stats": _over_stored(reports.database_stats),
    "stored_summary": _over_stored(reports.load_summary),
}

ALL: dict[str, Query] = {**READS, **WRITES, **STORED, **RULES}
