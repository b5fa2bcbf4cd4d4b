"""DuckDB SQL for every registered query, written from the raw driver tables.

Each statement starts from the same named subqueries: ``bars`` holds whole cents, the report
parts hold one row per output row. Nothing here is generated from the Spark code.
"""

from __future__ import annotations

STOCKS = """
stocks AS (
    SELECT s_suppkey AS stock_id,
           'SYM' || CAST(s_suppkey AS VARCHAR) AS symbol,
           s_name AS company_name,
           s_acctbal >= 0 AS is_active
    FROM supplier
)"""

PAIRS = """
stock_pairs AS (
    SELECT a.stock_id AS pair_id,
           a.symbol || '-' || b.symbol AS pair_name,
           a.stock_id AS stock_a_id,
           b.stock_id AS stock_b_id,
           a.symbol AS stock_a,
           b.symbol AS stock_b
    FROM stocks a JOIN stocks b ON b.stock_id = a.stock_id + 1
)"""

BARS = """
lines AS (
    SELECT l_suppkey AS stock_id,
           CAST(l_shipdate AS DATE) AS trade_date,
           CAST(round(l_extendedprice * 100) AS BIGINT) % 2001 - 1000 AS step,
           l_quantity AS quantity
    FROM lineitem
),
days AS (
    SELECT stock_id, trade_date,
           CAST(sum(step) AS BIGINT) AS move, max(step) AS up, min(step) AS down,
           CAST(sum(quantity) AS BIGINT) AS volume
    FROM lines GROUP BY stock_id, trade_date
),
walk AS (
    SELECT *, CAST(1000000 + sum(move) OVER (PARTITION BY stock_id ORDER BY trade_date
                                             ROWS UNBOUNDED PRECEDING) AS BIGINT) AS last_c
    FROM days
),
bars AS (
    SELECT stock_id, trade_date, volume,
           last_c - move AS open_c,
           greatest(last_c, last_c - move) + greatest(up, 0) AS high_c,
           least(last_c, last_c - move) + least(down, 0) AS low_c,
           last_c AS close_c,
           last_c / 100.0::DOUBLE AS close_price
    FROM walk
),
newest AS (SELECT max(trade_date) AS as_of FROM bars)"""


def _sma(n: int) -> str:
    return f"""CASE WHEN count(*) OVER w{n} = {n}
                THEN CAST(sum(close_c) OVER w{n} AS DOUBLE) / {n * 100} END AS sma_{n}"""


MOMENTUM = f"""
moves AS (
    SELECT *, close_c - lag(close_c) OVER (PARTITION BY stock_id ORDER BY trade_date) AS d
    FROM bars
),
frames AS (
    SELECT stock_id, trade_date, close_price,
           {_sma(20)},
           {_sma(50)},
           {_sma(200)},
           CASE WHEN count(d) OVER w14 = 14
                THEN CAST(sum(CASE WHEN d > 0 THEN d ELSE 0 END) OVER w14 AS DOUBLE) END AS gain,
           CASE WHEN count(d) OVER w14 = 14
                THEN CAST(sum(CASE WHEN d < 0 THEN -d ELSE 0 END) OVER w14 AS DOUBLE) END AS loss
    FROM moves
    WINDOW w14 AS (PARTITION BY stock_id ORDER BY trade_date ROWS 13 PRECEDING),
           w20 AS (PARTITION BY stock_id ORDER BY trade_date ROWS 19 PRECEDING),
           w50 AS (PARTITION BY stock_id ORDER BY trade_date ROWS 49 PRECEDING),
           w200 AS (PARTITION BY stock_id ORDER BY trade_date ROWS 199 PRECEDING)
),
momentum AS (
    SELECT stock_id, trade_date, close_price, sma_20, sma_50, sma_200,
           100 * gain / nullif(gain + loss, 0) AS rsi_14
    FROM frames
)"""

PAIR_METRICS = """
ratios AS (
    SELECT p.pair_id, a.trade_date,
           a.close_price AS close_a, b.close_price AS close_b,
           a.close_price / nullif(b.close_price, 0) AS price_ratio
    FROM stock_pairs p
    JOIN bars a ON a.stock_id = p.stock_a_id
    JOIN bars b ON b.stock_id = p.stock_b_id AND b.trade_date = a.trade_date
),
ratio_frames AS (
    SELECT *,
           count(*) OVER w AS n,
           avg(price_ratio) OVER w AS mean,
           stddev_pop(price_ratio) OVER w AS spread
    FROM ratios
    WINDOW w AS (PARTITION BY pair_id ORDER BY trade_date ROWS 19 PRECEDING)
),
pair_metrics AS (
    SELECT pair_id, trade_date, price_ratio, close_a, close_b,
           CASE WHEN n = 20 THEN mean END AS ratio_sma_20,
           CASE WHEN n = 20 THEN (price_ratio - mean) / nullif(spread, 0) END AS z_score
    FROM ratio_frames
)"""


def r2(value: str) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(38,6)), 2) AS DOUBLE)"


def r4(value: str) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(38,8)), 4) AS DOUBLE)"


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


PRICES = _with(STOCKS, BARS)
INDICATORS = _with(STOCKS, BARS, MOMENTUM)
PAIRED = _with(STOCKS, PAIRS, BARS, PAIR_METRICS)

TREND = "CASE WHEN sma_50 > sma_200 THEN 'Bullish' ELSE 'Bearish' END"
CROSS = """CASE WHEN sma_50 > sma_200 THEN 'Golden Cross - Bullish'
            ELSE 'Death Cross - Bearish' END"""
ACTION = """CASE WHEN rsi_14 < 30 THEN 'BUY - Oversold'
                 WHEN rsi_14 > 70 THEN 'SELL - Overbought'
                 ELSE 'HOLD - Neutral' END"""
SIGNAL_4 = """CASE WHEN z_score > 2 THEN 'SHORT A / LONG B'
                   WHEN z_score < -2 THEN 'LONG A / SHORT B'
                   WHEN abs(z_score) > 1 THEN 'WATCH'
                   ELSE 'NEUTRAL' END"""
SIGNAL_3 = """CASE WHEN z_score > 2 THEN 'SHORT A / LONG B'
                   WHEN z_score < -2 THEN 'LONG A / SHORT B'
                   ELSE 'NO TRADE' END"""
LATEST = "trade_date = (SELECT as_of FROM newest)"
RECENT = """trade_date >= (SELECT as_of FROM newest) - INTERVAL 30 DAY
            AND trade_date <= (SELECT as_of FROM newest)"""


def _rsi_list(hit: str, direction: str, limit: str = "LIMIT 20") -> str:
    return f"""{INDICATORS}
SELECT symbol, company_name, trade_date,
       {r2("close_price")} AS price, {r2("rsi_14")} AS rsi,
       CAST(date_diff('day', trade_date, (SELECT as_of FROM newest)) AS BIGINT) AS days_ago
FROM momentum JOIN stocks USING (stock_id)
WHERE rsi_14 {hit} AND {RECENT}
ORDER BY trade_date DESC, rsi_14 {direction}, symbol
{limit}"""


def _pair_list(hit: str, direction: str, limit: str = "LIMIT 20") -> str:
    return f"""{PAIRED}
SELECT pair_name, stock_a, stock_b, trade_date,
       {r4("price_ratio")} AS current_ratio, {r4("ratio_sma_20")} AS normal_ratio,
       {r2("z_score")} AS z_score
FROM pair_metrics JOIN stock_pairs USING (pair_id)
WHERE pair_metrics.z_score {hit} AND {RECENT}
ORDER BY trade_date DESC, pair_metrics.z_score {direction}, pair_name
{limit}"""


YEARS = """
years AS (
    SELECT stock_id, CAST(year(trade_date) AS BIGINT) AS year,
           min(trade_date) AS first_day, max(trade_date) AS last_day,
           count(*) AS days_traded
    FROM bars WHERE trade_date >= DATE '1996-01-01'
    GROUP BY ALL
),
year_ends AS (
    SELECT y.stock_id, y.year, y.days_traded,
           f.close_price AS first_close, l.close_price AS last_close
    FROM years y
    JOIN bars f ON f.stock_id = y.stock_id AND f.trade_date = y.first_day
    JOIN bars l ON l.stock_id = y.stock_id AND l.trade_date = y.last_day
)"""

READS = {
    "active_universe": f"{_with(STOCKS)} SELECT stock_id, symbol FROM stocks WHERE is_active",
    "symbol_lookup": f"""{_with(STOCKS)},
wanted AS (
    SELECT DISTINCT 'SYM' || CAST(l_suppkey AS VARCHAR) AS symbol FROM lineitem
    UNION SELECT DISTINCT 'SYM' || CAST(l_partkey AS VARCHAR) FROM lineitem
)
SELECT w.symbol, s.stock_id FROM wanted w LEFT JOIN stocks s USING (symbol)""",
    "stock_pairs": f"""{_with(STOCKS, PAIRS)}
SELECT pair_id, pair_name, stock_a_id, stock_b_id FROM stock_pairs""",
    "daily_bars": f"""{PRICES}
SELECT stock_id, trade_date, open_c / 100.0::DOUBLE AS open_price,
       high_c / 100.0::DOUBLE AS high_price, low_c / 100.0::DOUBLE AS low_price,
       close_price, close_price AS adj_close, volume
FROM bars""",
    "latest_date_global": f"{PRICES} SELECT as_of AS last_date FROM newest",
    "latest_per_pair": f"""{PAIRED}
SELECT pair_id, trade_date, {r4("price_ratio")} AS price_ratio, {r2("z_score")} AS z_score
FROM pair_metrics
QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY trade_date DESC) = 1""",
    "sma": f"""{INDICATORS}
SELECT stock_id, trade_date, {r2("sma_20")} AS sma_20, {r2("sma_50")} AS sma_50,
       {r2("sma_200")} AS sma_200
FROM momentum""",
    "price_delta": f"""{PRICES},
steps AS (
    SELECT stock_id, trade_date,
           close_c - lag(close_c) OVER (PARTITION BY stock_id ORDER BY trade_date) AS d
    FROM bars
)
SELECT stock_id, trade_date, d / 100.0::DOUBLE AS delta FROM steps""",
    "rsi": f"""{INDICATORS}
SELECT stock_id, trade_date, {r2("rsi_14")} AS rsi_14 FROM momentum""",
    "momentum": f"""{INDICATORS}
SELECT stock_id, trade_date, {r2("sma_20")} AS sma_20, {r2("sma_50")} AS sma_50,
       {r2("sma_200")} AS sma_200, {r2("rsi_14")} AS rsi_14
FROM momentum""",
    "pair_ratio": f"""{PRICES},{PAIRS},
leg_a AS MATERIALIZED (
    SELECT p.pair_id, p.stock_b_id AS stock_id, a.trade_date, a.close_price AS close_a
    FROM stock_pairs p JOIN bars a ON a.stock_id = p.stock_a_id
)
SELECT pair_id, trade_date, {r4("close_a / nullif(close_price, 0)")} AS price_ratio
FROM leg_a JOIN bars USING (stock_id, trade_date)""",
    "pair_zscore": f"""{PAIRED}
SELECT pair_id, trade_date, {r4("price_ratio")} AS price_ratio,
       {r4("ratio_sma_20")} AS ratio_sma_20, {r2("z_score")} AS z_score
FROM pair_metrics""",
    "market_overview": f"""{INDICATORS}
SELECT symbol, company_name, {r2("close_price")} AS price, {r2("sma_20")} AS ma_20,
       {r2("sma_50")} AS ma_50, {r2("sma_200")} AS ma_200, {r2("rsi_14")} AS rsi,
       {TREND} AS trend, {ACTION} AS action
FROM momentum JOIN stocks USING (stock_id)
WHERE {LATEST}""",
    "oversold": _rsi_list("< 30", "ASC"),
    "overbought": _rsi_list("> 70", "DESC"),
    "oversold_all": _rsi_list("< 30", "ASC", ""),
    "overbought_all": _rsi_list("> 70", "DESC", ""),
    "pairs_high_all": _pair_list("> 2", "DESC", ""),
    "pairs_low_all": _pair_list("< -2", "ASC", ""),
    "long_term_trends": f"""{INDICATORS}
SELECT symbol, company_name, {r2("close_price")} AS price, {r2("sma_50")} AS ma_50,
       {r2("sma_200")} AS ma_200,
       {r2("(sma_50 - sma_200) / nullif(sma_200, 0) * 100")} AS strength_pct,
       {CROSS} AS trend_signal
FROM momentum JOIN stocks USING (stock_id)
WHERE {LATEST}""",
    "yearly_performance": f"""{PRICES},{YEARS}
SELECT symbol, year, {r2("first_close")} AS start_price, {r2("last_close")} AS end_price,
       {r2("(last_close - first_close) / nullif(first_close, 0) * 100")} AS annual_return,
       days_traded
FROM year_ends JOIN stocks USING (stock_id)
ORDER BY symbol, year DESC""",
    "first_last_in_year": f"""{PRICES},{YEARS}
SELECT stock_id, year, first_close, last_close, days_traded FROM year_ends""",
    "rsi_patterns": f"""{INDICATORS},
counted AS (
    SELECT symbol, count(*) AS total_days,
           CAST(sum(CASE WHEN rsi_14 < 30 THEN 1 ELSE 0 END) AS BIGINT) AS oversold_count,
           CAST(sum(CASE WHEN rsi_14 > 70 THEN 1 ELSE 0 END) AS BIGINT) AS overbought_count,
           avg(rsi_14) AS mean_rsi
    FROM momentum JOIN stocks USING (stock_id)
    WHERE rsi_14 IS NOT NULL
    GROUP BY symbol
)
SELECT symbol, total_days, oversold_count, overbought_count,
       {r2("CAST(oversold_count AS DOUBLE) / total_days * 100")} AS oversold_pct,
       {r2("CAST(overbought_count AS DOUBLE) / total_days * 100")} AS overbought_pct,
       {r2("mean_rsi")} AS avg_rsi
FROM counted""",
    "all_pairs_status": f"""{PAIRED},
latest AS (
    SELECT * FROM pair_metrics m
    WHERE trade_date = (SELECT max(n.trade_date) FROM pair_metrics n WHERE n.pair_id = m.pair_id)
)
SELECT pair_name, stock_a, stock_b, {r4("price_ratio")} AS current_ratio,
       {r2("z_score")} AS z_score, {SIGNAL_4} AS trade_signal
FROM latest JOIN stock_pairs USING (pair_id)""",
    "pairs_high": _pair_list("> 2", "DESC"),
    "pairs_low": _pair_list("< -2", "ASC"),
    "pair_history": f"""{PAIRED}
SELECT pair_name, trade_date, {r4("price_ratio")} AS ratio, {r2("z_score")} AS z_score,
       {SIGNAL_3} AS trade_signal
FROM pair_metrics JOIN stock_pairs USING (pair_id)
WHERE pair_name = 'SYM0-SYM1'
  AND trade_date >= (SELECT as_of FROM newest) - INTERVAL 365 DAY
  AND trade_date <= (SELECT as_of FROM newest)""",
    "database_stats": f"""{PRICES}
SELECT count(DISTINCT stock_id) AS stocks, count(DISTINCT trade_date) AS days,
       min(trade_date) AS from_date, max(trade_date) AS to_date
FROM bars JOIN stocks USING (stock_id)""",
    "load_summary": f"""{PRICES}
SELECT symbol, count(b.stock_id) AS records,
       min(b.trade_date) AS from_date, max(b.trade_date) AS to_date
FROM stocks s LEFT JOIN bars b ON b.stock_id = s.stock_id
GROUP BY s.stock_id, symbol""",
    "load_summary_latest": f"""{PRICES}
SELECT symbol, count(b.stock_id) AS records,
       min(b.trade_date) AS from_date, max(b.trade_date) AS to_date
FROM stocks s LEFT JOIN (SELECT * FROM bars WHERE {LATEST}) b ON b.stock_id = s.stock_id
GROUP BY s.stock_id, symbol""",
}

BAR_VALUES = """stock_id, trade_date, open_c / 100.0::DOUBLE AS open_price,
       high_c / 100.0::DOUBLE AS high_price, low_c / 100.0::DOUBLE AS low_price,
       close_c / 100.0::DOUBLE AS close_price, close_c / 100.0::DOUBLE AS adj_close, volume"""

LATE = """
stored AS (
    SELECT * FROM bars WHERE trade_date < (SELECT as_of FROM newest) - INTERVAL 7 DAY
),
late AS (
    SELECT * REPLACE (close_c + 100 AS close_c, (close_c + 100) / 100.0::DOUBLE AS close_price)
    FROM bars WHERE trade_date >= (SELECT as_of FROM newest) - INTERVAL 14 DAY
),
after_load AS (
    SELECT * FROM late
    UNION ALL
    SELECT s.* FROM stored s
    WHERE NOT EXISTS (SELECT 1 FROM late l
                      WHERE l.stock_id = s.stock_id AND l.trade_date = s.trade_date)
)"""

# What becomes of each landed row, from the defect its stock and day give it.
CHECKED = """
landed AS (
    SELECT *, (stock_id * 31 + dayofyear(trade_date)) % 11 AS defect
    FROM bars JOIN stocks USING (stock_id)
),
checked AS (
    SELECT CASE WHEN defect = 3 THEN 'UNK' || CAST(stock_id AS VARCHAR) ELSE symbol END AS symbol,
           trade_date, stock_id, is_active, open_c, high_c, low_c,
           close_c + 100 AS close_c,
           CASE WHEN defect IN (4, 5) THEN 0 ELSE volume END AS volume,
           CASE defect WHEN 0 THEN 'open not positive'
                       WHEN 1 THEN 'high below low'
                       WHEN 2 THEN 'bad price'
                       WHEN 3 THEN 'unknown symbol' END AS reason
    FROM landed
),
asked AS (
    SELECT * REPLACE (
        CASE WHEN reason IS NOT NULL THEN reason
             WHEN trade_date < (SELECT as_of FROM newest) - INTERVAL 14 DAY THEN 'outside window'
             WHEN NOT is_active THEN 'inactive stock' END AS reason)
    FROM checked
)"""
ERRORS = "('open not positive', 'high below low', 'bad price', 'unknown symbol')"


def _after(text: str, table: str) -> str:
    """The same subqueries over another bar table."""
    return text.replace("FROM bars", f"FROM {table}").replace("JOIN bars", f"JOIN {table}")


MOMENTUM_AFTER = _after(MOMENTUM, "after_load")
PAIRS_AFTER = _after(PAIR_METRICS, "after_load")

TABLES = f"""
tables AS (
    SELECT m.stock_id, m.trade_date, m.close_price, l.volume,
           {r2("sma_20")} AS sma_20, {r2("sma_50")} AS sma_50, {r2("sma_200")} AS sma_200,
           {r2("rsi_14")} AS rsi_14, {r4("p.price_ratio")} AS price_ratio,
           {r4("p.ratio_sma_20")} AS ratio_sma_20, {r2("p.z_score")} AS z_score
    FROM momentum m
    JOIN loaded l ON l.stock_id = m.stock_id AND l.trade_date = m.trade_date
    LEFT JOIN pair_metrics p ON p.pair_id = m.stock_id AND p.trade_date = m.trade_date
)"""

# The tables after a refresh of the last two weeks into tables that lack a week.
REFRESHED = f"""{_with(STOCKS, PAIRS, BARS)},{LATE},{CHECKED},
fresh AS (
    SELECT * FROM asked
    WHERE reason IS NULL AND trade_date > (SELECT max(trade_date) FROM stored)
),
loaded AS (
    SELECT stock_id, trade_date, close_c, close_c / 100.0::DOUBLE AS close_price, volume FROM fresh
    UNION ALL
    SELECT stock_id, trade_date, close_c, close_price, volume FROM stored
),{_after(MOMENTUM, "loaded")},{_after(PAIR_METRICS, "loaded")},{TABLES}"""

WRITES = {
    "bar_window": f"""{PRICES}
SELECT {BAR_VALUES} FROM bars
WHERE trade_date >= (SELECT as_of FROM newest) - INTERVAL 1000 DAY""",
    "recent_bars": f"""{PRICES}
SELECT {BAR_VALUES} FROM bars JOIN stocks USING (stock_id)
WHERE is_active AND trade_date >= (SELECT as_of FROM newest) - INTERVAL 7 DAY""",
    "bar_quality": f"""{PRICES},{CHECKED}
SELECT {BAR_VALUES} FROM checked WHERE reason IS NULL""",
    "bar_rejects": f"""{PRICES},{CHECKED}
SELECT symbol, trade_date, reason FROM checked WHERE reason IS NOT NULL""",
    "load_counts": f"""{PRICES},{CHECKED}
SELECT s.symbol, count(*) FILTER (WHERE c.symbol IS NOT NULL AND c.reason IS NULL) AS accepted,
       count(c.reason) AS rejected
FROM stocks s LEFT JOIN checked c ON c.symbol = s.symbol
GROUP BY s.symbol""",
    "refresh_gate": f"""{PRICES},{LATE}
SELECT (SELECT max(trade_date) FROM stored) AS last_date, as_of,
       (SELECT max(trade_date) FROM stored) >= as_of AS already_updated
FROM newest""",
    "new_rows_global": f"""{PRICES},{LATE}
SELECT {BAR_VALUES} FROM late WHERE trade_date > (SELECT max(trade_date) FROM stored)""",
    "new_rows_per_stock": f"""{PRICES},{LATE}
SELECT {BAR_VALUES} FROM late l
WHERE trade_date > coalesce((SELECT max(s.trade_date) FROM stored s WHERE s.stock_id = l.stock_id),
                            DATE '0001-01-01')""",
    "upsert_bars": f"{PRICES},{LATE} SELECT {BAR_VALUES} FROM after_load",
    "refresh_result": f"""{PRICES},{LATE},{CHECKED},
fresh AS (
    SELECT * FROM asked
    WHERE reason IS NULL AND trade_date > (SELECT max(trade_date) FROM stored)
)
SELECT (SELECT count(*) FROM fresh) > 0 AS success,
       (SELECT count(*) FROM fresh) AS records_updated,
       (SELECT count(DISTINCT trade_date) FROM fresh) AS new_trading_days,
       (SELECT count(*) FROM asked WHERE reason IN {ERRORS}) AS errors,
       (SELECT count(*) FROM asked WHERE reason NOT IN {ERRORS})
       + (SELECT count(*) FROM asked WHERE reason IS NULL
                                       AND trade_date <= (SELECT max(trade_date) FROM stored))
           AS skipped,
       false AS already_updated""",
    "refresh_skipped": f"""{PRICES},{LATE},{CHECKED}
SELECT CASE WHEN reason IS NULL THEN 'not newer' ELSE reason END AS reason, count(*) AS rows
FROM asked
WHERE reason IS NOT NULL OR trade_date <= (SELECT max(trade_date) FROM stored)
GROUP BY 1""",
    "refresh_errors": f"""{PRICES},{CHECKED}
SELECT symbol, symbol || ': ' || reason AS message, count(*) AS rows
FROM asked WHERE reason IN {ERRORS}
GROUP BY symbol, reason""",
    "day_count_change": f"""{PRICES},{LATE}
SELECT count(DISTINCT s.trade_date) AS old_days,
       (SELECT count(DISTINCT trade_date) FROM after_load) AS new_days,
       (SELECT count(DISTINCT trade_date) FROM after_load) - count(DISTINCT s.trade_date)
           AS days_added
FROM stored s""",
    "momentum_tail": f"""{_with(STOCKS, BARS, LATE, MOMENTUM_AFTER)}
SELECT stock_id, trade_date, {r2("sma_20")} AS sma_20, {r2("sma_50")} AS sma_50,
       {r2("sma_200")} AS sma_200, {r2("rsi_14")} AS rsi_14
FROM momentum""",
    "pair_tail": f"""{_with(STOCKS, PAIRS, BARS, LATE, PAIRS_AFTER)}
SELECT pair_id, trade_date, {r4("price_ratio")} AS price_ratio,
       {r4("ratio_sma_20")} AS ratio_sma_20, {r2("z_score")} AS z_score
FROM pair_metrics""",
    "stored_overview": READS["market_overview"],
    "stream_ingest": f"""{PRICES},{LATE},{CHECKED},
loaded AS (
    SELECT stock_id, trade_date, close_c, close_c / 100.0::DOUBLE AS close_price, volume
    FROM checked WHERE reason IS NULL
    UNION ALL
    SELECT stock_id, trade_date, close_c, close_price, volume FROM stored s
    WHERE NOT EXISTS (SELECT 1 FROM checked c WHERE c.reason IS NULL
                      AND c.stock_id = s.stock_id AND c.trade_date = s.trade_date)
),{_after(MOMENTUM, "loaded")}
SELECT m.stock_id, m.trade_date, m.close_price, l.volume,
       {r2("sma_20")} AS sma_20, {r2("sma_50")} AS sma_50, {r2("sma_200")} AS sma_200,
       {r2("rsi_14")} AS rsi_14
FROM momentum m JOIN loaded l ON l.stock_id = m.stock_id AND l.trade_date = m.trade_date""",
    "refresh_stored": f"""{REFRESHED},
record AS (
    SELECT (SELECT count(*) FROM fresh) > 0 AS success,
           (SELECT count(*) FROM fresh) AS records_updated,
           (SELECT count(DISTINCT trade_date) FROM fresh) AS new_trading_days,
           (SELECT count(*) FROM asked WHERE reason IN {ERRORS}) AS errors,
           (SELECT count(*) FROM asked WHERE reason NOT IN {ERRORS})
           + (SELECT count(*) FROM asked WHERE reason IS NULL
                                           AND trade_date <= (SELECT max(trade_date) FROM stored))
               AS skipped,
           false AS already_updated
)
SELECT t.*, record.* FROM tables t, record""",
    "refresh_resumed": f"{REFRESHED} SELECT * FROM tables",
    "bulk_load_stored": f"""{_with(STOCKS, PAIRS, BARS)},{CHECKED},
loaded AS (
    SELECT stock_id, trade_date, close_c, close_c / 100.0::DOUBLE AS close_price, volume
    FROM checked
    WHERE reason IS NULL
),{_after(MOMENTUM, "loaded")},{_after(PAIR_METRICS, "loaded")},{TABLES}
SELECT * FROM tables""",
    "late_bar_stored": f"""{_with(STOCKS, PAIRS, BARS)},
loaded AS (SELECT * FROM bars),{_after(MOMENTUM, "loaded")},{_after(PAIR_METRICS, "loaded")},{TABLES}
SELECT * FROM tables""",
    "late_file_stored": f"""{_with(STOCKS, PAIRS, BARS)},
loaded AS (
    SELECT stock_id, trade_date, close_c + step AS close_c,
           (close_c + step) / 100.0::DOUBLE AS close_price, volume
    FROM (SELECT *, CASE WHEN stock_id % 5 = 0 THEN 200 WHEN stock_id % 3 = 0 THEN -100
                    ELSE 300 END AS step FROM bars)
),{_after(MOMENTUM, "loaded")},{_after(PAIR_METRICS, "loaded")},{TABLES}
SELECT * FROM tables""",
    "duplicate_delivery": f"""{PRICES}
SELECT stock_id, trade_date, open_c / 100.0::DOUBLE AS open_price,
       high_c / 100.0::DOUBLE AS high_price, low_c / 100.0::DOUBLE AS low_price,
       CASE WHEN stock_id % 3 = 0 THEN (close_c - 100) / 100.0::DOUBLE
            ELSE (close_c + 200) / 100.0::DOUBLE END AS close_price,
       CASE WHEN stock_id % 3 = 0 THEN (close_c - 100) / 100.0::DOUBLE
            ELSE (close_c + 200) / 100.0::DOUBLE END AS adj_close,
       volume
FROM bars""",
    "csv_export": READS["rsi_patterns"],
    "sql_view": f"""{PRICES}
SELECT symbol, count(*) AS bars, max(close_price) AS top_price
FROM bars JOIN stocks USING (stock_id) WHERE volume >= 40
GROUP BY symbol""",
}

STRENGTH = "(sma_50 - sma_200) / nullif(sma_200, 0) * 100"

TRADES = """
marks AS (
    SELECT *,
           CASE WHEN z_score > 2 THEN 1 WHEN z_score <= 0.5 THEN 0 END AS high,
           CASE WHEN z_score < -2 THEN 1 WHEN z_score >= -0.5 THEN 0 END AS low
    FROM pair_metrics
),
states AS (
    SELECT *, coalesce(last_value(high IGNORE NULLS) OVER w, 0)
              - coalesce(last_value(low IGNORE NULLS) OVER w, 0) AS side
    FROM marks
    WINDOW w AS (PARTITION BY pair_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING)
),
turns AS (
    SELECT *, lag(side, 1, 0) OVER (PARTITION BY pair_id ORDER BY trade_date) AS was
    FROM states
),
entries AS (SELECT * FROM turns WHERE side <> 0 AND side <> was),
exits AS (SELECT * FROM turns WHERE was <> 0 AND side <> was),
trades AS (
    SELECT n.pair_id, n.trade_date AS entry_date, x.trade_date AS exit_date,
           CAST(date_diff('day', n.trade_date, x.trade_date) AS BIGINT) AS holding_days,
           CASE WHEN n.z_score > 2 THEN 'SHORT A / LONG B' ELSE 'LONG A / SHORT B' END
               AS trade_signal,
           n.z_score AS entry_z, n.close_a AS entry_a, n.close_b AS entry_b,
           x.close_a AS exit_a, x.close_b AS exit_b
    FROM entries n LEFT JOIN exits x
      ON x.pair_id = n.pair_id
     AND x.trade_date = (SELECT min(y.trade_date) FROM exits y
                         WHERE y.pair_id = n.pair_id AND y.trade_date > n.trade_date)
)"""
TRADE_COLUMNS = "pair_id, entry_date, exit_date, holding_days, trade_signal"
GAIN_A = "(exit_a - entry_a) / entry_a * 100"
GAIN_B = "(exit_b - entry_b) / entry_b * 100"

RULES = {
    "trend_strength_bands": f"""{INDICATORS}
SELECT stock_id, trade_date, {r2(STRENGTH)} AS strength_pct,
       CASE WHEN abs({STRENGTH}) >= 5 THEN 'strong'
            WHEN abs({STRENGTH}) >= 2 THEN 'moderate'
            ELSE 'weak' END
       || CASE WHEN {STRENGTH} > 0 THEN ' up' ELSE ' down' END AS band
FROM momentum WHERE sma_200 IS NOT NULL""",
    "cross_events": f"""{INDICATORS},
states AS (
    SELECT stock_id, trade_date, {CROSS} AS trend_signal FROM momentum
    WHERE sma_200 IS NOT NULL
)
SELECT stock_id, trade_date, trend_signal FROM states
QUALIFY lag(trend_signal) OVER (PARTITION BY stock_id ORDER BY trade_date) <> trend_signal""",
    "rsi_recoveries": f"""{INDICATORS},
readings AS (
    SELECT stock_id, trade_date, rsi_14,
           CASE WHEN rsi_14 > 80 THEN 'very overbought' WHEN rsi_14 > 70 THEN 'overbought'
                WHEN rsi_14 < 30 THEN 'oversold' ELSE 'normal' END AS band,
           last_value(CASE WHEN rsi_14 < 30 THEN 'BUY - Oversold'
                           WHEN rsi_14 > 70 THEN 'SELL - Overbought' END IGNORE NULLS)
               OVER (PARTITION BY stock_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING)
               AS last_signal
    FROM momentum WHERE rsi_14 IS NOT NULL
)
SELECT stock_id, trade_date, {r2("rsi_14")} AS rsi_14, band, last_signal,
       coalesce((last_signal = 'BUY - Oversold' AND rsi_14 > 40)
                OR (last_signal = 'SELL - Overbought' AND rsi_14 < 60), false) AS passed
FROM readings""",
    "pair_excursions": f"""{PAIRED},{TRADES}
SELECT {TRADE_COLUMNS}, {r2("entry_z")} AS entry_z FROM trades""",
    "pair_profit": f"""{PAIRED},{TRADES}
SELECT {TRADE_COLUMNS},
       {r2(f"CASE WHEN trade_signal = 'SHORT A / LONG B' THEN {GAIN_B} - {GAIN_A} "
           f"ELSE {GAIN_A} - {GAIN_B} END / 100 * 100000")} AS profit
FROM trades WHERE exit_date IS NOT NULL""",
    "pair_correlation": f"""{PAIRED}
SELECT pair_id, {r4("corr(close_a, close_b)")} AS correlation, count(*) AS days,
       corr(close_a, close_b) > 0.7 AS tradable
FROM ratios GROUP BY pair_id""",
}

WRITES["bar_quality_csv"] = WRITES["bar_quality"]
WRITES["landed_once"] = WRITES["refresh_skipped"]
WRITES["csv_rejects"] = f"""{PRICES},{CHECKED}
SELECT reason, count(*) AS rows FROM checked WHERE reason IS NOT NULL GROUP BY reason
UNION ALL
SELECT 'bad row', 2 * count(*) FROM checked WHERE symbol LIKE '%1'"""

# The reports give the same from stored tables.
STORED = {
    "stored_oversold": READS["oversold"],
    "stored_overbought": READS["overbought"],
    "stored_trends": READS["long_term_trends"],
    "stored_performance": READS["yearly_performance"],
    "stored_rsi_patterns": READS["rsi_patterns"],
    "stored_pairs_status": READS["all_pairs_status"],
    "stored_pairs_high": READS["pairs_high"],
    "stored_pairs_low": READS["pairs_low"],
    "stored_pair_history": READS["pair_history"],
    "stored_stats": READS["database_stats"],
    "stored_summary": READS["load_summary"],
}
READS["yearly_performance_first"] = READS["yearly_performance"] + " LIMIT 150"
READS["rsi_wilder"] = f"""{PRICES.replace("WITH ", "WITH RECURSIVE ", 1)},
moves AS MATERIALIZED (
    SELECT stock_id, trade_date, row_number() OVER w AS n, close_c - lag(close_c) OVER w AS d
    FROM bars WINDOW w AS (PARTITION BY stock_id ORDER BY trade_date)
),
smoothed AS (
    SELECT stock_id, 15::BIGINT AS n, sum(greatest(d, 0))::DOUBLE / 14 AS gain,
           sum(greatest(-d, 0))::DOUBLE / 14 AS loss
    FROM moves WHERE n BETWEEN 2 AND 15 GROUP BY stock_id HAVING count(*) = 14
    UNION ALL
    SELECT m.stock_id, m.n, (s.gain * 13 + greatest(m.d, 0)) / 14, (s.loss * 13 + greatest(-m.d, 0)) / 14
    FROM smoothed s JOIN moves m ON m.stock_id = s.stock_id AND m.n = s.n + 1
)
SELECT m.stock_id, m.trade_date, {r2("100 * gain / nullif(gain + loss, 0)")} AS rsi_14
FROM moves m LEFT JOIN smoothed s ON s.stock_id = m.stock_id AND s.n = m.n"""

ALL = {**READS, **WRITES, **STORED, **RULES}
