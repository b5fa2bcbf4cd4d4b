from __future__ import annotations

import re
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators, pairs, refresh, tail, validate
from barloom.plans import maintain, reports
from barloom.sinks.export import export_csv, export_name
from barloom.sinks.warehouse import Warehouse
from barloom.sources.landing import read_landed, read_landed_csv
from barloom.sources.market import Market, newest_rows
from barloom.sources.shared import new_folder, shared_root
from barloom.streaming.ingest import landed_stream, rejects_path, start_ingest
from tests.helpers import bars, day, raw, same, stock_pairs, stocks

LENGTH = 300


def walk(seed: int, length: int = LENGTH) -> list:
    return [100 + (n * seed * 37 + n * n) % 29 for n in range(length)]


@pytest.fixture
def warehouse(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "tables"))
    store.write_list("stocks", stocks(spark, 1, 2, 3, 4, inactive=(4,)))
    store.write_list("stock_pairs", stock_pairs(spark, (1, 2), (1, 3)))
    return store


def landed(spark, stock_id, closes, start=0):
    return [
        (f"SYM{stock_id}", day(start + n), float(c), float(c), float(c), float(c), 1.0)
        for n, c in enumerate(closes)
        if c is not None
    ]


def filled(spark, warehouse, sparse=False):
    third = [c if n % 50 == 0 else None for n, c in enumerate(walk(3))] if sparse else walk(3)
    warehouse.write("daily_prices", bars(spark, {1: walk(1), 2: walk(2), 3: third}))
    maintain.rebuild_all(warehouse)
    return warehouse


def consistent(warehouse):
    """The stored derived tables equal a full derivation from the stored prices."""
    prices, listed = warehouse.table("daily_prices"), warehouse.table("stock_pairs")
    assert same(warehouse.table("momentum_indicators"), indicators.momentum(prices))
    assert same(warehouse.table("pair_metrics"), pairs.pair_metrics(prices, listed))


def test_bulk_load_and_refresh(spark, warehouse):
    first = raw(spark, *landed(spark, 1, walk(1, 30)), *landed(spark, 2, walk(2, 25)))
    summary = maintain.bulk_load(warehouse, first, as_of=day(29))
    assert [r.records for r in summary.collect()] == [30, 25, 0, 0]
    consistent(warehouse)

    more = raw(
        spark,
        *landed(spark, 1, [7, 8, 9], start=29),
        *landed(spark, 2, [5, 6, 7], start=28),
        *landed(spark, 3, [1], start=20),
        *landed(spark, 4, [1], start=30),
        ("SYM1", day(31), 0.0, 1.0, 1.0, 1.0, 1.0),
        ("ELSE", day(31), 1.0, 1.0, 1.0, 1.0, 1.0),
    )
    record, messages = maintain.refresh(warehouse, more, as_of=day(31))
    assert record.first().asDict() == {
        "success": True,
        "records_updated": 3,
        "new_trading_days": 2,
        "errors": 2,
        "skipped": 5,
        "already_updated": False,
    }
    assert {r.message for r in messages.collect()} == {
        "SYM1: open not positive",
        "ELSE: unknown symbol",
    }
    kept = warehouse.table("daily_prices").where("stock_id = 2 AND trade_date >= '2020-01-29'")
    assert {(r.trade_date, int(r.close_price)) for r in kept.collect()} == {(day(30), 7)}
    consistent(warehouse)

    record, messages = maintain.refresh(warehouse, more, as_of=day(31))
    assert record.first().already_updated and messages.first().message == refresh.UP_TO_DATE


def test_refresh_without_new_rows(spark, warehouse):
    filled(spark, warehouse)
    record, _ = maintain.refresh(warehouse, raw(spark), as_of=day(LENGTH + 5))
    assert not record.first().success and not record.first().already_updated


def test_lagging_stock_is_filled_per_stock(spark, warehouse):
    filled(spark, warehouse)
    warehouse.write_list("stocks", stocks(spark, 1, 2, 3, 4))
    late = raw(spark, *landed(spark, 4, [3, 4], start=LENGTH - 3), *landed(spark, 1, [3], start=LENGTH - 3))
    record, _ = maintain.refresh(warehouse, late, as_of=day(LENGTH + 1), mode="per_stock")
    assert record.first().records_updated == 2
    consistent(warehouse)


@pytest.mark.parametrize("grain", ["year", "month", "day"])
def test_grains_give_the_same_table(spark, tmp_path, grain):
    store = Warehouse(spark, str(tmp_path / grain), grain)
    target = bars(spark, {1: walk(1, 40), 2: walk(2, 40)})
    store.write("daily_prices", target)
    assert same(store.table("daily_prices"), target)
    store.upsert("daily_prices", bars(spark, {1: [1, 2, 3]}, start=38))
    assert store.table("daily_prices").count() == 81
    assert store.newest().first()[0] == day(40)
    window = store.between("daily_prices", F.lit(day(30)), F.lit(day(39)))
    assert window.count() == 20


def test_unknown_grain(spark, tmp_path):
    with pytest.raises(ValueError):
        Warehouse(spark, str(tmp_path), "week")


def test_windows_prune_periods(spark, warehouse):
    filled(spark, warehouse)
    plan = (
        warehouse.between("daily_prices", F.lit(day(LENGTH - 5)), F.lit(day(LENGTH)))
        .select("close_price")
        ._jdf.queryExecution()
        .executedPlan()
        .toString()
    )
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(period" in scan
    assert "open_price" not in scan.split("ReadSchema")[1]


def test_newest_day_reads_one_period(spark, warehouse):
    assert warehouse.newest().first()[0] is None and warehouse.oldest("daily_prices") is None
    filled(spark, warehouse)
    assert warehouse.newest().first()[0] == day(LENGTH - 1)
    plan = warehouse.newest()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(period" in plan


@pytest.mark.parametrize(("sparse", "at"), [(True, LENGTH - 10), (True, 100), (False, 100), (False, -5)])
def test_rebuild_near_changes_equals_full_rebuild(spark, warehouse, sparse, at, monkeypatch):
    """Also when a rarely traded stock has its context rows and those it reaches far away."""
    monkeypatch.setattr(tail, "SPAN_DAYS", 25)
    filled(spark, warehouse, sparse)
    changes = bars(spark, {1: [1, 2, None, 3], 3: [4]}, start=at)
    warehouse.upsert("daily_prices", changes)
    maintain.rebuild_touched(warehouse, changes)
    consistent(warehouse)


def test_changes_far_apart(spark, warehouse, monkeypatch):
    monkeypatch.setattr(tail, "SPAN_DAYS", 25)
    long = {n: walk(n, 900) for n in (1, 2, 3)}
    warehouse.write("daily_prices", bars(spark, long))
    maintain.rebuild_all(warehouse)
    before = {name: stored_files(warehouse, name) for name in ("momentum_indicators", "pair_metrics")}
    changes = bars(spark, {1: [1]}, start=40).union(bars(spark, {2: [5]}, start=600))
    warehouse.upsert("daily_prices", changes)
    maintain.rebuild_touched(warehouse, changes)
    consistent(warehouse)

    def rewritten(name):
        after = stored_files(warehouse, name)
        return {period for period in after if after[period] != before[name].get(period)}

    # Day 40 reaches 199 rows, to day 239, and day 600 to day 799; pairs 19 rows.
    months = {day(n).replace(day=1).isoformat() for n in (*range(40, 240), *range(600, 800))}
    assert rewritten("momentum_indicators") == {f"period={month}" for month in months}
    months = {day(n).replace(day=1).isoformat() for n in (*range(40, 60), *range(600, 620))}
    assert rewritten("pair_metrics") == {f"period={month}" for month in months}


def stored_files(warehouse, name):
    root = Path(warehouse.path(name))
    return {folder.name: sorted(f.name for f in folder.glob("*.parquet")) for folder in root.glob("period=*")}


def test_clusters():
    spans = [(day(0), day(30)), (day(31), day(58)), (day(2000), day(2030)), (day(5000), day(5030))]
    assert tail.clusters(reversed(spans)) == [(day(0), day(58)), *spans[2:]]
    assert tail.clusters([]) == []


def test_recent_context_is_enough_for_dense_series(spark, warehouse):
    filled(spark, warehouse)
    changed = tail.changed_days(bars(spark, {1: [1]}, start=LENGTH - 1))

    def series(first, last):
        return warehouse.between("daily_prices", first, last)

    start = tail.context_start(series, changed, "stock_id", 19, day(LENGTH - 1), day(-1000))
    assert start is not None and start <= day(LENGTH - 20)
    early = tail.changed_days(bars(spark, {1: [1]}, start=5))
    assert tail.reach_end(series, early, "stock_id", 19, day(5), day(3000)) == day(5 + tail.SPAN_DAYS)
    assert tail.reach_end(series, early, "stock_id", 19, day(5), day(LENGTH)) is None


def test_newest_rows_are_found_from_the_newest_period_back(spark, warehouse, monkeypatch):
    warehouse.write_list("stock_pairs", stock_pairs(spark, (1, 2), (1, 3), (2, 4)))
    prices = {1: walk(1), 2: walk(2), 3: walk(3, 100)}
    warehouse.write("daily_prices", bars(spark, prices))
    maintain.rebuild_all(warehouse)
    read, of_periods = [], Warehouse.of_periods
    monkeypatch.setattr(
        Warehouse, "of_periods", lambda self, name, periods: read.append(len(periods)) or of_periods(self, name, periods)
    )
    stored = warehouse.table("pair_metrics")
    every = warehouse.latest("pair_metrics", warehouse.table("stock_pairs"))
    assert same(every, newest_rows(stored, "pair_id"))
    assert {(r.pair_id, r.trade_date) for r in every.collect()} == {(1, day(LENGTH - 1)), (2, day(99))}
    assert read == [1, 2, 4, 3]  # pair 3 never traded, so all ten months are read, once
    read.clear()
    found = warehouse.latest("pair_metrics", warehouse.table("stock_pairs").where("pair_id = 1"))
    assert found.count() == 1 and read == [1]
    assert warehouse.latest("pair_metrics", warehouse.table("stock_pairs").where("pair_id = 9")).count() == 0


@pytest.mark.parametrize("grain", ["year", "month", "day"])
def test_summaries_follow_the_prices(spark, tmp_path, grain):
    store = Warehouse(spark, str(tmp_path / grain), grain)
    store.write_list("stocks", stocks(spark, 1, 2, 4))
    store.write_list("stock_pairs", stock_pairs(spark, (1, 2)))
    assert store.market().summaries is None
    store.write("daily_prices", bars(spark, {1: walk(1, 40), 2: walk(2, 10), 3: walk(3, 90)}))
    store.upsert("daily_prices", bars(spark, {1: [1, None, 3], 2: [5, 6, 7]}, start=39))
    plain = Market(store.table("stocks"), store.table("daily_prices"), store.table("stock_pairs"))
    for report in (reports.database_stats, reports.load_summary):
        assert same(report(store.market()), report(plain))
        plan = report(store.market())._jdf.queryExecution().executedPlan().toString()
        assert "summaries" in plan and "daily_prices" not in plan


def land_bars(spark, folder, *rows):
    raw(spark, *rows).coalesce(1).write.mode("append").parquet(str(folder))


def rejects(spark, warehouse):
    return spark.read.parquet(f"{warehouse.path('rejects')}/*").count()


def test_landed_files_are_taken_in_once(spark, warehouse, tmp_path):
    folder = tmp_path / "landing"
    land_bars(spark, folder, *landed(spark, 1, [1, 2, 3]), ("ELSE", day(1), 1.0, 1.0, 1.0, 1.0, 1.0))
    record, _ = maintain.refresh_folder(warehouse, str(folder), as_of=day(2), days=30)
    assert record.first().records_updated == 3 and rejects(spark, warehouse) == 1
    record, _ = maintain.refresh_folder(warehouse, str(folder), as_of=day(9), days=30)
    assert record.first().already_updated and rejects(spark, warehouse) == 1
    land_bars(spark, folder, *landed(spark, 1, [4], start=3), *landed(spark, 1, [9], start=0))
    record, _ = maintain.refresh_folder(warehouse, str(folder), as_of=day(9), days=30)
    assert (record.first().records_updated, record.first().skipped) == (1, 1)
    assert rejects(spark, warehouse) == 2 and warehouse.taken().count() == 2
    consistent(warehouse)
    summary = maintain.bulk_load_folder(warehouse, str(folder), as_of=day(9))
    assert summary.first().records == 4 and warehouse.taken().count() == 2


@pytest.mark.parametrize("step", [0, 3])
def test_a_broken_off_intake_heals(spark, warehouse, tmp_path, monkeypatch, step):
    folder = tmp_path / "landing"
    land_bars(spark, folder, *landed(spark, 1, [1, 2, 3]), ("ELSE", day(1), 1.0, 1.0, 1.0, 1.0, 1.0))
    write, count = Warehouse._write, iter(range(100))

    def dies(self, rows, path, overwrite):
        if next(count) == step:
            raise RuntimeError("lost driver")
        write(self, rows, path, overwrite)

    monkeypatch.setattr(Warehouse, "_write", dies)
    with pytest.raises(RuntimeError):
        maintain.refresh_folder(warehouse, str(folder), as_of=day(2), days=30)
    monkeypatch.setattr(Warehouse, "_write", write)
    land_bars(spark, folder, *landed(spark, 1, [4], start=3))
    maintain.refresh_folder(warehouse, str(folder), as_of=day(3), days=30)
    assert warehouse.table("daily_prices").count() == 4 and rejects(spark, warehouse) == 1
    assert warehouse.taken().count() == 2
    consistent(warehouse)


def test_broken_off_upsert_is_finished_from_its_copy(spark, warehouse, monkeypatch):
    filled(spark, warehouse)
    batch = new_folder(spark, "batch")
    changes = bars(spark, {1: [1, 2, 3]}, start=LENGTH - 1)
    write = Warehouse._write

    def fails_at_the_table(self, rows, path, overwrite):
        if overwrite == "dynamic":
            raise RuntimeError("lost driver")
        write(self, rows, path, overwrite)

    monkeypatch.setattr(Warehouse, "_write", fails_at_the_table)
    with pytest.raises(RuntimeError):
        warehouse.upsert("daily_prices", changes, batch=batch)
    assert warehouse.table("daily_prices").count() == 3 * LENGTH
    monkeypatch.setattr(Warehouse, "_write", write)
    warehouse.upsert("daily_prices", changes.limit(0), batch=batch)
    assert warehouse.table("daily_prices").count() == 3 * LENGTH + 2


def test_broken_off_refresh_is_finished(spark, warehouse, monkeypatch):
    """Prices were stored but not yet the indicators; the gate would see a table up to date."""
    filled(spark, warehouse)
    batch = new_folder(spark, "batch")
    fresh = raw(spark, *landed(spark, 1, [5, 6], start=LENGTH), *landed(spark, 2, [5, 6], start=LENGTH))
    monkeypatch.setattr(maintain, "rebuild_touched", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        maintain.refresh(warehouse, fresh, as_of=day(LENGTH + 1), batch=batch)
    monkeypatch.undo()
    record, _ = maintain.refresh(warehouse, fresh, as_of=day(LENGTH + 1), batch=batch)
    assert record.first().records_updated == 4
    consistent(warehouse)


@pytest.mark.parametrize("step", [0, 1, 3, 5])
def test_any_break_heals_with_the_next_load(spark, warehouse, monkeypatch, step):
    """A refresh that dies at any write, and a plain one of the next day after it."""
    filled(spark, warehouse)
    first = raw(spark, *landed(spark, 1, [5, 6], start=LENGTH), *landed(spark, 2, [5, 6], start=LENGTH))
    write, count = Warehouse._write, iter(range(100))

    def dies(self, rows, path, overwrite):
        if next(count) == step:
            raise RuntimeError("lost driver")
        write(self, rows, path, overwrite)

    monkeypatch.setattr(Warehouse, "_write", dies)
    try:
        maintain.refresh(warehouse, first, as_of=day(LENGTH + 1))
        raise AssertionError("nothing broke")
    except RuntimeError:
        pass
    monkeypatch.setattr(Warehouse, "_write", write)
    maintain.refresh(warehouse, raw(spark, *landed(spark, 1, [7], start=LENGTH + 2)), as_of=day(LENGTH + 2))
    assert warehouse.table("daily_prices").count() == 3 * LENGTH + 5
    assert warehouse.pending() == []
    consistent(warehouse)


def test_rejects_are_kept(spark, warehouse):
    late = raw(spark, *landed(spark, 1, [3], start=0), *landed(spark, 1, [3], start=400))
    maintain.bulk_load(warehouse, late, as_of=day(400), days=30)
    kept = spark.read.parquet(f"{warehouse.path('rejects')}/*")
    assert [(r.symbol, r.reason) for r in kept.collect()] == [("SYM1", "outside window")]


def test_reports_read_stored_tables(spark, warehouse):
    filled(spark, warehouse)
    stored = warehouse.market()
    prices = bars(spark, {1: walk(1), 2: walk(2), 3: walk(3)})
    derived = type(stored)(warehouse.table("stocks"), prices, warehouse.table("stock_pairs"))
    for report in (reports.market_overview, reports.rsi_patterns, reports.all_pairs_status):
        assert same(report(stored), report(derived))
    for report in (reports.oversold, reports.overbought, reports.pairs_high, reports.pairs_low):
        assert same(report(stored, stored.last_date()), report(derived, derived.last_date()))


def test_export(spark, warehouse, tmp_path):
    assert export_name("All Pairs Status", date(2024, 3, 9)) == "All_Pairs_Status_20240309.csv"
    summary = reports.load_summary(filled(spark, warehouse).market())
    path = export_csv(summary, str(tmp_path), "Load Summary", date(2024, 3, 9))
    assert path.endswith("Load_Summary_20240309.csv")
    back = spark.read.option("header", True).schema(summary.schema).csv(path)
    assert same(back, summary)


def test_text_bars_load(spark, warehouse, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "a.csv").write_text(
        "symbol,ts,open,high,low,close,volume\nSYM1,2020-01-01,1,2,1,1.5,7\nSYM2,2020-01-02,1,2,1,1.5,\n"
    )
    summary = maintain.bulk_load(warehouse, read_landed_csv(spark, str(folder)), as_of=day(3))
    assert [r.records for r in summary.collect()] == [1, 1, 0, 0]


def test_text_bars_go_by_the_names_of_each_header(spark, warehouse, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "a.csv").write_text(
        "\ufeffSymbol, TS ,volume,open,high,low,close,note\r\n"
        'SYM1,2020-01-01,500,10,12,9,11,"a, ""b"""\r\n\r\n'
        "SYM1,2020-01-02,abc,10,12,9,11,\r\n"
        "SYM1,2020-01-03,500,10,12,9\r\n"
    )
    (folder / "b.csv").write_text(
        "close,open,ts,symbol,low,high,volume\n11,10,2020-01-04,SYM2,9,12,5\n11,10,2020-01-05,SYM2,9,12,5,6,7\n"
    )
    (folder / "c.csv").write_text("symbol,ts,open,high,low\nSYM3,2020-01-06,1,2,1\n")
    checked = validate.check(read_landed(spark, str(folder), "csv"), warehouse.table("stocks")).collect()
    good = {(r.symbol, str(r.trade_date), int(r.open_price), int(r.high_price), int(r.low_price), int(r.close_price), r.volume)
            for r in checked if r.reason is None}
    assert good == {("SYM1", "2020-01-01", 10, 12, 9, 11, 500), ("SYM2", "2020-01-04", 10, 12, 9, 11, 5)}
    assert sorted(r.reason for r in checked if r.reason) == ["bad price", "bad row", "bad row", "bad volume"]
    assert sorted(r.bad_row for r in checked if r.bad_row)[0].startswith("11,10,2020-01-05")


def test_text_bars_stream(spark, warehouse, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "a.csv").write_text("ts,symbol,open,high,low,close,volume\n2020-01-01,SYM1,1,2,1,1.5,x\n2020-01-02,SYM1,1,2,1,1.5,3\n")
    (folder / "b.csv").write_text("symbol,ts,close,open,high,low,volume\nSYM2,2020-01-01,1.5,1,2,1,4\nSYM2,2020\n")
    stream = landed_stream(warehouse, str(folder), files_per_batch=1, fmt="csv")
    start_ingest(warehouse, stream, str(tmp_path / "checkpoint")).awaitTermination()
    stored = warehouse.table("daily_prices").collect()
    assert {(r.stock_id, str(r.close_price), r.volume) for r in stored} == {(1, "1.5000", 3), (2, "1.5000", 4)}
    kept = spark.read.parquet(rejects_path(str(tmp_path / "checkpoint")))
    assert sorted(r.reason for r in kept.collect()) == ["bad row", "bad volume"]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_a_file_loaded_again_rebuilds_nothing(spark, warehouse, tmp_path):
    """Bars that alter no stored price leave the indicators as they are; one that does is carried on."""
    for name, rows in (("old", landed(spark, 1, walk(2))), ("new", [*landed(spark, 1, walk(1)), *landed(spark, 2, walk(2))])):
        land_bars(spark, tmp_path / name, *rows)
    maintain.bulk_load(warehouse, read_landed(spark, str(tmp_path / "new")), as_of=day(LENGTH))
    derived = ("momentum_indicators", "pair_metrics")
    before = [stored_files(warehouse, name) for name in derived]
    for name in ("old", "new"):
        maintain.bulk_load(warehouse, read_landed(spark, str(tmp_path / name)), as_of=day(LENGTH))
    assert [stored_files(warehouse, name) for name in derived] == before
    land_bars(spark, tmp_path / "last", *landed(spark, 2, [7], start=100))
    maintain.bulk_load(warehouse, read_landed(spark, str(tmp_path / "last")), as_of=day(LENGTH))
    assert [stored_files(warehouse, name) for name in derived] != before
    consistent(warehouse)


def test_tails_sort_every_series_once(spark, warehouse):
    filled(spark, warehouse)
    changed = tail.changed_days(bars(spark, {1: [1]}, start=LENGTH - 5))
    listed, prices = warehouse.table("stock_pairs"), warehouse.table("daily_prices")
    pair_days = tail.changed_pairs(changed, listed)
    momentum = tail.momentum_tail(prices, changed)
    ratios = tail.pair_tail(prices, listed, pair_days, warehouse.table("pair_metrics"))
    for rows, key in ((momentum, "stock_id"), (ratios, "pair_id")):
        text = rows._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(rf"Sort \[{key}#\w+ \w+ NULLS \w+, trade_date#", text)) == 1
        assert "SortAggregate" not in text
