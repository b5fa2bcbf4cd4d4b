"""Table schemas and the fixed values every other module shares."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
SEED_SYMBOLS = (
    "RELIANCE.NS",
    "TCS.NS",
    "HDFCBANK.NS",
    "INFY.NS",
    "ICICIBANK.NS",
    "HINDUNILVR.NS",
    "ITC.NS",
    "SBIN.NS",
    "BHARTIARTL.NS",
    "KOTAKBANK.NS",
)
SEED_PAIRS = (
    "HDFCBANK-ICICIBANK",
    "ICICIBANK-KOTAKBANK",
    "TCS-INFY",
    "HINDUNILVR-ITC",
    "HDFCBANK-SBIN",
)
SEED_SUFFIX = ".NS"

RSI_OVERSOLD = 30
RSI_OVERBOUGHT = 70
Z_ENTRY = 2
Z_WATCH = 1

SMA_ROWS = (20, 50, 200)
RSI_ROWS = 14
RATIO_ROWS = 20

REPORT_DAYS = 30
REFRESH_DAYS = 7
HISTORY_DAYS = 15 * 365
SIGNAL_LIMIT = 20
YEARLY_FROM = 2011
HISTORY_PAIR = "HDFCBANK-ICICIBANK"
# ----------------------------------------------------------------------------

PRICE = T.DecimalType(18, 4)
PRICE_COLUMNS = ("open_price", "high_price", "low_price", "close_price", "adj_close")
VALUE_COLUMNS = (*PRICE_COLUMNS, "volume")
BAR_KEY = ("stock_id", "trade_date")
PAIR_KEY = ("pair_id", "trade_date")

STOCKS = T.StructType(
    [
        T.StructField("stock_id", T.LongType(), False),
        T.StructField("symbol", T.StringType(), False),
        T.StructField("company_name", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
    ]
)

DAILY_PRICES = T.StructType(
    [
        T.StructField("stock_id", T.LongType(), False),
        T.StructField("trade_date", T.DateType(), False),
        *(T.StructField(name, PRICE) for name in PRICE_COLUMNS),
        T.StructField("volume", T.LongType()),
    ]
)

VERSION = T.DecimalType(38, 0)
# As stored: with the number that tells when the row landed, null if it did not come from a file.
STORED_PRICES = T.StructType([*DAILY_PRICES, T.StructField("version", VERSION)])

MOMENTUM = T.StructType(
    [
        T.StructField("stock_id", T.LongType(), False),
        T.StructField("trade_date", T.DateType(), False),
        *(T.StructField(f"sma_{n}", T.DoubleType()) for n in SMA_ROWS),
        T.StructField(f"rsi_{RSI_ROWS}", T.DoubleType()),
    ]
)

STOCK_PAIRS = T.StructType(
    [
        T.StructField("pair_id", T.LongType(), False),
        T.StructField("pair_name", T.StringType(), False),
        T.StructField("stock_a_id", T.LongType(), False),
        T.StructField("stock_b_id", T.LongType(), False),
    ]
)

PAIR_METRICS = T.StructType(
    [
        T.StructField("pair_id", T.LongType(), False),
        T.StructField("trade_date", T.DateType(), False),
        T.StructField("price_ratio", T.DoubleType()),
        T.StructField("ratio_sma_20", T.DoubleType()),
        T.StructField("z_score", T.DoubleType()),
    ]
)

# One row per stock and period: bars, their first and last day, and a bit for each day of the year.
DAY_WORDS = 6
SUMMARIES = T.StructType(
    [
        T.StructField("stock_id", T.LongType(), False),
        T.StructField("bars", T.LongType()),
        T.StructField("first_date", T.DateType()),
        T.StructField("last_date", T.DateType()),
        *(T.StructField(f"days_{n}", T.LongType()) for n in range(DAY_WORDS)),
        T.StructField("period", T.DateType()),
    ]
)

# Landed files that were taken in.
LANDED_FILES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("modificationTime", T.TimestampType(), False),
        T.StructField("length", T.LongType(), False),
    ]
)

# Bars as they land, before any check: every field may be missing or malformed.
RAW_BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)
