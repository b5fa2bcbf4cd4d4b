"""Checks on landed bars: every row is either accepted or kept with the reason it was not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom import schema as S
from barloom.functions.exact import nan_to_null
from barloom.operators import lookup

LANDED = {"open_price": "open", "high_price": "high", "low_price": "low", "close_price": "close"}

BAD_ROW = "bad row"
BAD_DATE = "bad date"
BAD_PRICE = "bad price"
BAD_OPEN = "open not positive"
BAD_RANGE = "high below low"
BAD_VOLUME = "bad volume"
UNKNOWN_SYMBOL = "unknown symbol"

# Sound rows that a load was not asked for or that are too old for it.
OUTSIDE_WINDOW = "outside window"
INACTIVE = "inactive stock"
NOT_NEWER = "not newer"
SKIPPED = (OUTSIDE_WINDOW, INACTIVE, NOT_NEWER)

MODES = ("upsert", "global", "per_stock")

REJECT_COLUMNS = ("symbol", "trade_date", "reason")


def trading_day(raw: DataFrame, column: str, zone: str | None = None) -> Column:
    """The calendar day of a bar at its exchange.

    Days and local stamps are taken as they are. An instant is shown in the exchange's zone
    first, whatever the session's zone is.
    """
    stamp = F.col(column)
    if zone is not None and isinstance(raw.schema[column].dataType, T.TimestampType):
        local = stamp.cast("timestamp_ntz")
        stamp = F.convert_timezone(F.current_timezone(), F.lit(zone), local)
    if isinstance(raw.schema[column].dataType, T.StringType):
        return stamp.try_cast("date")
    return F.to_date(stamp)


def _number(raw: DataFrame, column: str) -> Column:
    """The value, with NaN read as missing; text is left for the cast to judge."""
    if isinstance(raw.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return nan_to_null(column)
    return F.col(column)


def _volume(raw: DataFrame) -> Column:
    """The volume, 0 where it is missing, blank or NaN, NULL where it is no number.

    A column of numbers with gaps is written to text with decimals, so text is read as a double
    unless it is a whole number.
    """
    volume = _number(raw, "volume")
    if isinstance(raw.schema["volume"].dataType, T.StringType):
        text = F.trim("volume")
        double = text.try_cast("double")
        missing = volume.isNull() | (text == "") | F.isnan(double)
        whole = F.coalesce(text.try_cast("long"), double.try_cast("long"))
        return F.when(missing, 0).otherwise(whole).cast("long")
    return F.when(volume.isNull(), 0).otherwise(volume.try_cast("long")).cast("long")


def _with_values(raw: DataFrame, zone: str | None) -> DataFrame:
    prices = {
        name: _number(raw, landed).try_cast(S.PRICE) for name, landed in LANDED.items()
    }
    kept = [F.col(name) for name in raw.columns if name not in (*LANDED.values(), "volume")]
    return raw.select(
        *kept,
        trading_day(raw, "ts", zone).alias("trade_date"),
        *(value.alias(name) for name, value in prices.items()),
        prices["close_price"].alias("adj_close"),
        _volume(raw).alias("volume"),
    ).withColumn("symbol", F.upper(F.trim("symbol")))


def _reason(malformed: Column) -> Column:
    missing = F.col("open_price").isNull()
    for name in ("high_price", "low_price", "close_price"):
        missing = missing | F.col(name).isNull()
    return (
        F.when(malformed, BAD_ROW)
        .when(F.col("trade_date").isNull(), BAD_DATE)
        .when(missing, BAD_PRICE)
        .when(F.col("open_price") <= 0, BAD_OPEN)
        .when(F.col("high_price") < F.col("low_price"), BAD_RANGE)
        .when(F.col("volume").isNull(), BAD_VOLUME)
        .when(F.col("stock_id").isNull(), UNKNOWN_SYMBOL)
    )


def check(raw: DataFrame, stocks: DataFrame, zone: str | None = None) -> DataFrame:
    """Landed rows as table rows, with ``reason`` set on those that must not be stored.

    Rows that a reader could not make out come with their text in ``bad_row``.
    """
    resolved = lookup.stock_ids(_with_values(raw, zone), stocks)
    malformed = F.col("bad_row").isNotNull() if "bad_row" in raw.columns else F.lit(False)
    return resolved.withColumn("reason", _reason(malformed))


def _skip(checked: DataFrame, unwanted: Column, reason: str) -> DataFrame:
    """Give sound rows a reason not to be stored; rows that have one keep it."""
    sound = F.col("reason").isNull()
    return checked.withColumn("reason", F.when(sound & unwanted, reason).otherwise(F.col("reason")))


def asked(
    checked: DataFrame, as_of: Column, days: int, active: DataFrame | None = None
) -> DataFrame:
    """Checked rows, skipping those outside the last ``days`` days and of stocks not ``active``."""
    rows = _skip(checked, ~in_window(days, as_of), OUTSIDE_WINDOW)
    if active is None:
        return rows
    listed = active.select("stock_id", F.lit(True).alias("is_wanted"))
    known = rows.join(listed, "stock_id", "left")
    return _skip(known, F.col("is_wanted").isNull(), INACTIVE).drop("is_wanted")


def newer(
    checked: DataFrame, target: DataFrame, mode: str, newest: DataFrame | None = None
) -> DataFrame:
    """Checked rows, skipping those that a load in ``mode`` leaves out as not newer.

    ``newest`` is a one-row frame with the target's newest day, if that is known without reading
    the whole target.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if mode == "upsert":
        return checked
    if mode == "global":
        last = target.agg(F.max("trade_date")) if newest is None else newest
        unwanted = F.coalesce(F.col("trade_date") <= last.scalar(), F.lit(False))
        return _skip(checked, unwanted, NOT_NEWER)
    last = target.groupBy("stock_id").agg(F.max("trade_date").alias("last_date"))
    known = checked.join(last, "stock_id", "left")
    unwanted = F.coalesce(F.col("trade_date") <= F.col("last_date"), F.lit(False))
    return _skip(known, unwanted, NOT_NEWER).drop("last_date")


def in_window(days_back: int, as_of: Column, day: str = "trade_date") -> Column:
    """Days from ``days_back`` before ``as_of`` up to ``as_of``."""
    return F.col(day).between(F.date_sub(as_of, days_back), as_of)


def accepted(checked: DataFrame) -> DataFrame:
    version = [name for name in ("version",) if name in checked.columns]
    return checked.where(F.col("reason").isNull()).select(
        *S.BAR_KEY, *S.VALUE_COLUMNS, *version
    )


def rejected(checked: DataFrame) -> DataFrame:
    """Every row that was not stored and why, skipped ones included."""
    return checked.where(F.col("reason").isNotNull()).select(*REJECT_COLUMNS)


def outcome(judged: DataFrame) -> DataFrame:
    """Judged rows with what storing and rejecting them needs."""
    version = [name for name in ("version",) if name in judged.columns]
    return judged.select("symbol", *S.BAR_KEY, *S.VALUE_COLUMNS, *version, "reason")


def refused(rejects: DataFrame) -> DataFrame:
    """The rejects that are wrong, not merely skipped."""
    return rejects.where(~F.col("reason").isin(*SKIPPED))


def load_counts(checked: DataFrame, stocks: DataFrame) -> DataFrame:
    """Rows stored and refused per listed symbol; a symbol without any rows counts 0."""
    counted = checked.groupBy("symbol").agg(
        F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected"),
    )
    zero = F.lit(0).cast("long")
    return (
        stocks.select("symbol")
        .join(counted, "symbol", "left")
        .select(
            "symbol",
            F.coalesce("accepted", zero).alias("accepted"),
            F.coalesce("rejected", zero).alias("rejected"),
        )
    )
