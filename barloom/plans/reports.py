"""The named screening reports, each a lazy frame over a ``Market``.

Facts are filtered or aggregated before they meet a dimension. No join is hinted: Catalyst
broadcasts a dimension only while its size is under ``spark.sql.autoBroadcastJoinThreshold`` and
sorts and merges beyond it. Sort keys end in a unique column, so a limit always keeps the same
rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import schema as S
from barloom.functions import signals
from barloom.functions.exact import anchor, pct_change, pct_of, snap_round
from barloom.sources.market import Market

AsOf = Column | date | str | None


def _recent(market: Market, name: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``, both ends included."""
    return market.between(name, F.date_sub(as_of, days), as_of)


def _sorted(rows: DataFrame, *order: Column) -> DataFrame:
    """All rows in order.

    A range sort samples its input before it reads it, which would compute the last stage (often
    the windows) twice. The small report is passed through an exchange first, so only that is
    read twice.
    """
    return rows.hint("rebalance").orderBy(*order)


def _ranked(rows: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    """The first rows in order, or all of them."""
    return _sorted(rows, *order) if limit is None else rows.orderBy(*order).limit(limit)


def _named(facts: DataFrame, market: Market) -> DataFrame:
    return facts.join(market.stocks.select("stock_id", "symbol", "company_name"), "stock_id")


def _with_legs(facts: DataFrame, market: Market) -> DataFrame:
    """Pair facts with the pair's name and the symbols of both legs."""

    def leg(side: str) -> DataFrame:
        return market.stocks.select(
            F.col("stock_id").alias(f"stock_{side}_id"), F.col("symbol").alias(f"stock_{side}")
        )

    named = market.stock_pairs.join(leg("a"), "stock_a_id").join(leg("b"), "stock_b_id")
    return facts.join(named.select("pair_id", "pair_name", "stock_a", "stock_b"), "pair_id")


def latest_bars(market: Market) -> DataFrame:
    """Bars of the newest trading day of the whole market, with their indicators."""
    last_date = market.last_date()
    prices = market.between("daily_prices", last_date, last_date)
    averages = market.between("momentum_indicators", last_date, last_date)
    return prices.select(*S.BAR_KEY, "close_price").join(averages, list(S.BAR_KEY))


def market_overview(market: Market) -> DataFrame:
    rows = _named(latest_bars(market), market)
    return _sorted(rows, F.col("rsi_14").asc_nulls_first(), F.col("symbol")).select(
        "symbol",
        "company_name",
        snap_round("close_price", 2).alias("price"),
        snap_round("sma_20", 2).alias("ma_20"),
        snap_round("sma_50", 2).alias("ma_50"),
        snap_round("sma_200", 2).alias("ma_200"),
        snap_round("rsi_14", 2).alias("rsi"),
        signals.trend("sma_50", "sma_200").alias("trend"),
        signals.rsi_action("rsi_14").alias("action"),
    )


def _rsi_signals(
    market: Market, hit: Column, as_of: AsOf, days: int, limit: int | None, order: Column
) -> DataFrame:
    today = anchor(as_of)
    hits = _recent(market, "momentum_indicators", today, days).where(hit)
    prices = _recent(market, "daily_prices", today, days).select(*S.BAR_KEY, "close_price")
    named = _named(hits.select(*S.BAR_KEY, "rsi_14").join(prices, list(S.BAR_KEY)), market)
    return _ranked(named, limit, F.col("trade_date").desc(), order, F.col("symbol")).select(
        "symbol",
        "company_name",
        "trade_date",
        snap_round("close_price", 2).alias("price"),
        snap_round("rsi_14", 2).alias("rsi"),
        F.datediff(today, F.col("trade_date")).cast("long").alias("days_ago"),
    )


def oversold(
    market: Market, as_of: AsOf = None, days: int = S.REPORT_DAYS, limit: int | None = S.SIGNAL_LIMIT
) -> DataFrame:
    rsi = F.col("rsi_14")
    return _rsi_signals(market, signals.oversold(rsi), as_of, days, limit, rsi.asc())


def overbought(
    market: Market, as_of: AsOf = None, days: int = S.REPORT_DAYS, limit: int | None = S.SIGNAL_LIMIT
) -> DataFrame:
    rsi = F.col("rsi_14")
    return _rsi_signals(market, signals.overbought(rsi), as_of, days, limit, rsi.desc())


def long_term_trends(market: Market) -> DataFrame:
    rows = _named(latest_bars(market), market).select(
        "symbol",
        "company_name",
        snap_round("close_price", 2).alias("price"),
        snap_round("sma_50", 2).alias("ma_50"),
        snap_round("sma_200", 2).alias("ma_200"),
        snap_round(signals.trend_strength("sma_50", "sma_200"), 2).alias("strength_pct"),
        signals.cross_label("sma_50", "sma_200").alias("trend_signal"),
    )
    return _sorted(rows, F.col("strength_pct").desc_nulls_last(), F.col("symbol"))


def first_last_in_year(market: Market, from_year: int = S.YEARLY_FROM) -> DataFrame:
    """First and last traded close of every stock and year, in one partial aggregation."""
    day, close = F.col("trade_date"), F.col("close_price")
    return (
        market.daily_prices.where(day >= F.make_date(F.lit(from_year), F.lit(1), F.lit(1)))
        .groupBy("stock_id", F.year(day).cast("long").alias("year"))
        .agg(
            F.min_by(close, day).alias("first_close"),
            F.max_by(close, day).alias("last_close"),
            F.count("*").alias("days_traded"),
        )
    )


def yearly_performance(
    market: Market, from_year: int = S.YEARLY_FROM, limit: int | None = None
) -> DataFrame:
    """Every stock and year; ``limit`` keeps the first rows by symbol and newest year."""
    years = _named(first_last_in_year(market, from_year), market)
    return _ranked(years, limit, F.col("symbol"), F.col("year").desc()).select(
        "symbol",
        "year",
        snap_round("first_close", 2).alias("start_price"),
        snap_round("last_close", 2).alias("end_price"),
        snap_round(pct_change("first_close", "last_close"), 2).alias("annual_return"),
        "days_traded",
    )


def rsi_patterns(market: Market) -> DataFrame:
    rsi = F.col("rsi_14")
    counted = (
        market.momentum_indicators.where(rsi.isNotNull())
        .groupBy("stock_id")
        .agg(
            F.count("*").alias("total_days"),
            F.count_if(signals.oversold(rsi)).alias("oversold_count"),
            F.count_if(signals.overbought(rsi)).alias("overbought_count"),
            F.avg(rsi).alias("mean_rsi"),
        )
    )
    total = F.col("total_days")
    rows = _named(counted, market).select(
        "symbol",
        "total_days",
        "oversold_count",
        "overbought_count",
        snap_round(pct_of(F.col("oversold_count"), total), 2).alias("oversold_pct"),
        snap_round(pct_of(F.col("overbought_count"), total), 2).alias("overbought_pct"),
        snap_round("mean_rsi", 2).alias("avg_rsi"),
    )
    return _sorted(rows, F.col("oversold_pct").desc(), F.col("symbol"))


def latest_per_pair(market: Market) -> DataFrame:
    """Every pair's own newest row."""
    return market.latest("pair_metrics", "pair_id").select(*S.PAIR_KEY, "price_ratio", "z_score")


def all_pairs_status(market: Market) -> DataFrame:
    rows = _with_legs(latest_per_pair(market), market)
    return _sorted(rows, F.abs("z_score").desc_nulls_last(), F.col("pair_name")).select(
        "pair_name",
        "stock_a",
        "stock_b",
        snap_round("price_ratio", 4).alias("current_ratio"),
        snap_round("z_score", 2).alias("z_score"),
        signals.pair_signal("z_score").alias("trade_signal"),
    )


def _pair_signals(
    market: Market, hit: Column, as_of: AsOf, days: int, limit: int | None, order: Column
) -> DataFrame:
    hits = _recent(market, "pair_metrics", anchor(as_of), days).where(hit)
    named = _with_legs(hits, market)
    return _ranked(named, limit, F.col("trade_date").desc(), order, F.col("pair_name")).select(
        "pair_name",
        "stock_a",
        "stock_b",
        "trade_date",
        snap_round("price_ratio", 4).alias("current_ratio"),
        snap_round("ratio_sma_20", 4).alias("normal_ratio"),
        snap_round("z_score", 2).alias("z_score"),
    )


def pairs_high(
    market: Market, as_of: AsOf = None, days: int = S.REPORT_DAYS, limit: int | None = S.SIGNAL_LIMIT
) -> DataFrame:
    z = F.col("z_score")
    return _pair_signals(market, signals.diverged_high(z), as_of, days, limit, z.desc())


def pairs_low(
    market: Market, as_of: AsOf = None, days: int = S.REPORT_DAYS, limit: int | None = S.SIGNAL_LIMIT
) -> DataFrame:
    z = F.col("z_score")
    return _pair_signals(market, signals.diverged_low(z), as_of, days, limit, z.asc())


def pair_history(
    market: Market,
    as_of: AsOf = None,
    days: int = S.REPORT_DAYS,
    pair_name: str = S.HISTORY_PAIR,
) -> DataFrame:
    pair = market.stock_pairs.where(F.col("pair_name") == pair_name).select("pair_id", "pair_name")
    rows = _recent(market, "pair_metrics", anchor(as_of), days).join(pair, "pair_id")
    return _sorted(rows, F.col("trade_date").desc()).select(
        "pair_name",
        "trade_date",
        snap_round("price_ratio", 4).alias("ratio"),
        snap_round("z_score", 2).alias("z_score"),
        signals.pair_trade("z_score").alias("trade_signal"),
    )


def database_stats(market: Market) -> DataFrame:
    """Stocks, trading days and date range over the bars of listed stocks."""
    listed = market.stocks.select("stock_id")
    if market.summaries is not None:
        rows = market.summaries.join(listed, "stock_id", "left_semi")
        words = [f"days_{n}" for n in range(S.DAY_WORDS)]
        together = rows.groupBy("period").agg(*(F.bit_or(word).alias(word) for word in words))
        each = sum((F.bit_count(word) for word in words), F.lit(0))
        days = together.agg(F.coalesce(F.sum(each), F.lit(0)).cast("long")).scalar()
        return rows.agg(
            F.count_distinct("stock_id").alias("stocks"),
            F.first(days).alias("days"),
            F.min("first_date").alias("from_date"),
            F.max("last_date").alias("to_date"),
        )
    day = F.col("trade_date")
    return market.daily_prices.join(listed, "stock_id", "left_semi").agg(
        F.count_distinct("stock_id").alias("stocks"),
        F.count_distinct(day).alias("days"),
        F.min(day).alias("from_date"),
        F.max(day).alias("to_date"),
    )


def _counted(market: Market) -> DataFrame:
    """Bars per stock and the days of the first and the last, from the summaries if there are any."""
    if market.summaries is not None:
        return market.summaries.groupBy("stock_id").agg(
            F.sum("bars").alias("bars"),
            F.min("first_date").alias("from_date"),
            F.max("last_date").alias("to_date"),
        )
    day = F.col("trade_date")
    return market.daily_prices.groupBy("stock_id").agg(
        F.count("*").alias("bars"), F.min(day).alias("from_date"), F.max(day).alias("to_date")
    )


def load_summary(market: Market) -> DataFrame:
    """Bars per listed stock; a stock without bars counts 0."""
    rows = market.stocks.select("stock_id", "symbol").join(_counted(market), "stock_id", "left")
    records = F.coalesce("bars", F.lit(0).cast("long")).alias("records")
    return _sorted(rows.select("symbol", records, "from_date", "to_date"), F.col("symbol"))
