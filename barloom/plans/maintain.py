"""Loading bars into a warehouse and keeping its derived tables in step."""

from __future__ import annotations

from datetime import date
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom import schema as S
from barloom.operators import refresh as R
from barloom.operators import tail, upsert, validate
from barloom.operators.indicators import momentum
from barloom.operators.lookup import active_universe
from barloom.operators.pairs import pair_metrics
from barloom.plans import reports
from barloom.sinks.warehouse import Warehouse
from barloom.sources.landing import landed_files, read_landed
from barloom.sources.shared import discard, exists, new_folder, shared_root


def rebuild_all(warehouse: Warehouse) -> None:
    """Derive both indicator tables from all stored prices."""
    bars = warehouse.table("daily_prices")
    warehouse.write("momentum_indicators", momentum(bars))
    warehouse.write("pair_metrics", pair_metrics(bars, warehouse.table("stock_pairs")))


def rebuild_touched(warehouse: Warehouse, loaded: DataFrame, batch: str | None = None) -> None:
    """Derive the indicator rows that the ``loaded`` bars changed, and merge them in.

    The derived tables must have been in step with the prices before the load. A changed bar
    reaches a bounded number of later rows, so that only the stretches around the changed days are
    read and only the periods of the rows they reach are rewritten, however old the days are.
    """
    folder = batch or new_folder(warehouse.spark, "touched")
    changed = tail.changed_days(loaded)
    spans = ((period, warehouse.period_end(period)) for period in warehouse.periods_of(loaded))
    for number, (first, last) in enumerate(tail.clusters(spans)):
        its = changed.where(F.col("trade_date").between(first, last))
        _rebuild_near(warehouse, its, first, last, f"{folder}/{number}")
    if batch is None:
        discard(warehouse.spark, folder)


def _rebuild_near(warehouse: Warehouse, changed: DataFrame, first: date, last: date, folder: str) -> None:
    def around(name: str, days: DataFrame, key: str, reach: int) -> DataFrame:
        """The rows of a table that the changed series need and reach."""

        def stored(start: date | None, end: date | None) -> DataFrame:
            return warehouse.between(name, start, end).select(key, "trade_date")

        newest = max(warehouse.periods(name), default=None)
        start = tail.context_start(stored, days, key, reach, first, warehouse.oldest(name))
        end = tail.reach_end(stored, days, key, reach, last, newest)
        return warehouse.between(name, start, end)

    def merge_in(name: str, fresh: DataFrame) -> None:
        rows = warehouse.stage(f"fresh-{name}", fresh, folder)
        warehouse.upsert(name, rows, batch=folder)

    bars = around("daily_prices", changed, "stock_id", tail.MOMENTUM_REACH)
    merge_in("momentum_indicators", tail.momentum_tail(bars, changed))

    stock_pairs = warehouse.table("stock_pairs")
    pairs_changed = tail.changed_pairs(changed, stock_pairs)
    ids = warehouse.stage("changed-pairs", tail.changed_ids(pairs_changed), folder)
    stored = around("pair_metrics", pairs_changed, "pair_id", tail.PAIR_REACH)
    bars = warehouse.between("daily_prices", first, last)
    merge_in("pair_metrics", tail.pair_tail(bars, stock_pairs, pairs_changed, stored, ids))


def store(
    warehouse: Warehouse, judged: DataFrame, batch: str, own: bool = False
) -> tuple[DataFrame, DataFrame, dict[str, object]]:
    """Store the accepted rows of a delivery; returns what was stored, what was not, and metrics.

    The delivery is judged once: its rows are written to the batch folder with their reasons, the
    accepted ones then with one row per key, and both writes observe what the record counts. The
    folder is entered as pending before any table changes. A run that broke off is finished from
    there by the next load, whoever starts it; repeating a batch changes nothing. A folder that is
    the load's ``own`` is removed then. Bars that landed before the stored ones they meet count as
    accepted and change nothing.
    """
    rows, left = warehouse.stage_counted("judged", validate.outcome(judged), batch, *R.left_out())
    kept = upsert.one_per_key(validate.accepted(rows), versioned=True)
    stored, written = warehouse.stage_counted("accepted", kept, batch, *R.written())
    if written["rows"]:
        warehouse.begin(batch, own)
        _apply(warehouse, stored, batch)
        warehouse.finish(batch)
    return stored, validate.rejected(rows), {**left, **written}


def _apply(warehouse: Warehouse, stored: DataFrame, batch: str) -> None:
    """Merge bars into the prices, and rebuild the indicator rows that those of them reach that altered one."""
    warehouse.upsert("daily_prices", stored, batch=batch)
    rebuild_touched(warehouse, warehouse.altered(batch), batch=batch)


def resume(warehouse: Warehouse) -> None:
    """Finish loads that broke off after they began to change the tables."""
    spark = warehouse.spark
    for batch, own in warehouse.pending():
        stored = spark.read.schema(S.STORED_PRICES).parquet(f"{batch}/accepted")
        _apply(warehouse, stored, batch)
        judged = spark.read.parquet(f"{batch}/judged")
        warehouse.keep_rejects(validate.rejected(judged), batch)
        if exists(spark, f"{batch}/files/_SUCCESS"):
            warehouse.take(spark.read.schema(S.LANDED_FILES).parquet(f"{batch}/files"), batch)
        warehouse.finish(batch)
        if own:
            discard(spark, batch)


def bulk_load(
    warehouse: Warehouse,
    landed: DataFrame,
    as_of: date | None = None,
    days: int = S.HISTORY_DAYS,
    zone: str | None = None,
    batch: str | None = None,
) -> DataFrame:
    """Load landed bars of the last ``days`` days; returns the load summary per stock.

    Rows that were not stored are kept with their reasons in the table of rejects.
    """
    resume(warehouse)
    checked = validate.check(landed, warehouse.table("stocks"), zone)
    judged = validate.asked(checked, F.lit(as_of or date.today()), days)
    folder = batch or new_folder(warehouse.spark, "load")
    _, rejects, _ = store(warehouse, judged, folder, batch is None)
    warehouse.keep_rejects(rejects, folder)
    if batch is None:
        discard(warehouse.spark, folder)
    return reports.load_summary(warehouse.market())


def refresh(
    warehouse: Warehouse,
    landed: DataFrame,
    as_of: date | None = None,
    days: int = S.REFRESH_DAYS,
    mode: str = "global",
    zone: str | None = None,
    batch: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Bring the tables up to date from landed bars of the last days of active stocks.

    Returns the one-row result record and the messages for refused rows. Rows that were not
    stored, the skipped ones included, are kept with their reasons in the table of rejects.
    """
    spark = warehouse.spark
    resume(warehouse)
    today = F.lit(as_of or date.today())
    stocks = warehouse.table("stocks")
    repeated = batch is not None and exists(spark, f"{batch}/accepted/_SUCCESS")
    if R.gate(warehouse.newest(), today).first().already_updated and not repeated:
        return R.nothing_to_do(spark)

    checked = validate.check(landed, stocks, zone)
    asked = validate.asked(checked, today, days, active_universe(stocks))
    judged = validate.newer(asked, warehouse.table("daily_prices"), mode, warehouse.newest())
    folder = batch or new_folder(spark, "refresh")
    _, rejects, metrics = store(warehouse, judged, folder, batch is None)
    kept = warehouse.keep_rejects(rejects, folder)
    if batch is None:
        discard(spark, folder)
    return R.record(spark, metrics), R.errors(kept)


def untaken(warehouse: Warehouse, folder: str) -> tuple[list[str], str] | None:
    """The files of a landing folder that were not taken in yet, and the batch folder they make.

    A file counts by path, time and length, so one that was written anew is taken in again. The
    batch is named by its files: repeated after a break it is the same batch.
    """
    spark = warehouse.spark
    known = ["path", "modificationTime", "length"]
    files = landed_files(spark, folder).join(warehouse.taken(), known, "left_anti")
    rows = sorted(files.collect())  # the names that the reader is given anyway
    if not rows:
        return None
    name = sha256("\n".join("|".join(map(str, row)) for row in rows).encode()).hexdigest()[:32]
    batch = f"{shared_root(spark)}/intake-{name}"
    warehouse.stage("files", spark.createDataFrame(rows, S.LANDED_FILES), batch)
    return [row.path for row in rows], batch


def _taken_in(warehouse: Warehouse, batch: str) -> None:
    warehouse.take(warehouse.spark.read.schema(S.LANDED_FILES).parquet(f"{batch}/files"), batch)
    discard(warehouse.spark, batch)


def refresh_folder(
    warehouse: Warehouse, folder: str, fmt: str = "parquet", **how: object
) -> tuple[DataFrame, DataFrame]:
    """``refresh`` from the files of a landing folder that no load has taken in yet.

    Every file is read by one load, and its rows are rejected at most once. Files that land while
    the tables are up to date wait for the next load.
    """
    resume(warehouse)
    found = untaken(warehouse, folder)
    if found is None:
        return R.nothing_to_do(warehouse.spark)
    paths, batch = found
    landed = read_landed(warehouse.spark, paths, fmt)
    record, messages = refresh(warehouse, landed, batch=batch, **how)
    if not record.first().already_updated:
        _taken_in(warehouse, batch)
    return record, messages


def bulk_load_folder(warehouse: Warehouse, folder: str, fmt: str = "parquet", **how: object) -> DataFrame:
    """``bulk_load`` from the files of a landing folder that no load has taken in yet."""
    resume(warehouse)
    found = untaken(warehouse, folder)
    if found is not None:
        paths, batch = found
        bulk_load(warehouse, read_landed(warehouse.spark, paths, fmt), batch=batch, **how)
        _taken_in(warehouse, batch)
    return reports.load_summary(warehouse.market())
