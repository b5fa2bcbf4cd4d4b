from __future__ import annotations

import random
import time
from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from barloom import schema as S
from barloom.operators import lookup, refresh, upsert, validate
from barloom.sources.landing import _cells, read_landed, read_landed_csv
from barloom.sources.market import Market
from contract import fixtures
from tests.helpers import bar, bars, column, day, raw, same, stocks

NAN = float("nan")


def reasons(spark, *landed):
    checked = validate.check(raw(spark, *landed), stocks(spark, 1, 2))
    return [row.reason for row in checked.orderBy("ts").collect()]


def test_quality_filter(spark):
    ranges = [(1, 2, 1), (0, 2, 1), (1, 1, 2), (None, 2, 1), (NAN, 2, 1), (1, 1, 1)]
    landed = [
        ("SYM1", day(n), *(None if v is None else float(v) for v in r), 1.0, 1.0)
        for n, r in enumerate(ranges)
    ]
    assert reasons(spark, *landed) == [
        None,
        validate.BAD_OPEN,
        validate.BAD_RANGE,
        validate.BAD_PRICE,
        validate.BAD_PRICE,
        None,
    ]


def test_other_rejects(spark):
    infinite = float("inf")
    assert reasons(
        spark,
        ("SYM1", None, 1.0, 2.0, 1.0, 1.0, 1.0),
        ("SYM1", day(1), 1.0, 2.0, 1.0, NAN, 1.0),
        ("SYM1", day(2), 1.0, infinite, 1.0, 1.0, 1.0),
        ("SYM1", day(3), 1.0, 2.0, 1.0, 1.0, infinite),
        ("SYM9", day(4), 1.0, 2.0, 1.0, 1.0, 1.0),
        (None, day(5), 1.0, 2.0, 1.0, 1.0, 1.0),
    ) == [
        validate.BAD_DATE,
        validate.BAD_PRICE,
        validate.BAD_PRICE,
        validate.BAD_VOLUME,
        validate.UNKNOWN_SYMBOL,
        validate.UNKNOWN_SYMBOL,
    ]


def test_accepted_rows(spark):
    landed = raw(
        spark,
        ("sym1 ", day(0), 1.0, 2.0, 1.0, 1.5, None),
        ("SYM1", day(1), 1.0, 2.0, 1.0, 1.5, NAN),
        ("SYM2", day(2), 1.0, 2.0, 1.0, 1.5, 7.0),
    )
    rows = validate.accepted(validate.check(landed, stocks(spark, 1, 2))).orderBy("trade_date")
    assert column(rows, "volume", "trade_date") == [0, 0, 7]
    assert column(rows, "stock_id", "trade_date") == [1, 1, 2]
    assert rows.first().adj_close == rows.first().close_price == Decimal("1.5000")
    assert rows.schema.fieldNames() == S.DAILY_PRICES.fieldNames()


def test_volumes_as_text(spark):
    volumes = ["7", "7.0", "NaN", "", None, " 12 ", "1e3", "9007199254740993", "many", "7.5x"]
    rows = [("SYM1", str(day(n)), "1", "2", "1", "1.5", v) for n, v in enumerate(volumes)]
    landed = spark.createDataFrame(
        rows, "symbol string, ts string, open string, high string, low string, close string, volume string"
    )
    checked = validate.check(landed, stocks(spark, 1)).orderBy("trade_date").collect()
    assert [r.volume for r in checked] == [7, 7, 0, 0, 0, 12, 1000, 9007199254740993, None, None]
    assert [r.reason for r in checked[-2:]] == [validate.BAD_VOLUME] * 2


def test_skipped_rows_keep_a_reason(spark):
    landed = raw(
        spark,
        *((f"SYM{s}", day(n), 1.0, 2.0, 1.0, 1.5, 1.0) for s, n in ((1, 1), (1, 8), (1, 9), (2, 9))),
        ("SYM1", day(2), 0.0, 2.0, 1.0, 1.5, 1.0),
    )
    checked = validate.check(landed, stocks(spark, 1, 2))
    judged = validate.asked(checked, F.lit(day(10)), 5, stocks(spark, 1))
    judged = validate.newer(judged, bars(spark, {1: [1] * 9}), "global")
    got = {(r.stock_id, r.trade_date, r.reason) for r in judged.collect()}
    assert got == {
        (1, day(1), validate.OUTSIDE_WINDOW),
        (1, day(2), validate.BAD_OPEN),
        (1, day(8), validate.NOT_NEWER),
        (1, day(9), None),
        (2, day(9), validate.INACTIVE),
    }
    assert validate.refused(validate.rejected(judged)).count() == 1


def test_load_counts(spark):
    landed = raw(
        spark,
        ("SYM1", day(0), 1.0, 2.0, 1.0, 1.5, None),
        ("SYM1", day(1), 0.0, 2.0, 1.0, 1.5, None),
    )
    listed = stocks(spark, 1, 2)
    counts = validate.load_counts(validate.check(landed, listed), listed)
    assert [tuple(r) for r in counts.orderBy("symbol").collect()] == [("SYM1", 1, 1), ("SYM2", 0, 0)]


def test_text_files(spark, tmp_path):
    (tmp_path / "bars.csv").write_text(
        "symbol,ts,open,high,low,close,volume\n"
        "SYM1,2020-01-01,1.25,2,1,1.5,7\n"
        "SYM1,2020-01-02,x,2,1,1.5,7\n"
        "SYM1,someday,1,2,1,1.5,7\n"
        "SYM1,2020-01-04,1,2,1,1.5,many\n"
        "SYM1,2020-01-05,NaN,2,1,1.5,\n"
    )
    checked = validate.check(read_landed_csv(spark, str(tmp_path)), stocks(spark, 1))
    got = {(str(r.trade_date), r.reason) for r in checked.collect()}
    assert got == {
        ("2020-01-01", None),
        ("2020-01-02", validate.BAD_PRICE),
        ("None", validate.BAD_DATE),
        ("2020-01-04", validate.BAD_VOLUME),
        ("2020-01-05", validate.BAD_PRICE),
    }


def test_columnar_files_round_trip(spark, tmp_path):
    landed = raw(spark, ("SYM1", day(0), 1.0, 2.0, 1.0, 1.5, 7.0))
    for fmt in ("parquet", "orc", "json"):
        landed.write.format(fmt).save(str(tmp_path / fmt))
        back = read_landed(spark, str(tmp_path / fmt), fmt)
        assert same(back.drop("version"), landed)


def test_instants_take_the_day_of_the_exchange(spark):
    late = datetime(2020, 1, 1, 20, 0, tzinfo=timezone.utc)
    frame = spark.createDataFrame([(late,)], "ts timestamp")
    local = validate.trading_day(frame, "ts", "Asia/Kolkata")
    assert frame.select(local).first()[0] == date(2020, 1, 2)
    assert frame.select(validate.trading_day(frame, "ts")).first()[0] == date(2020, 1, 1)


def test_symbol_lookup_spreads_long_lists(spark):
    listed = stocks(spark, *range(1, 40)).union(stocks(spark, 50).withColumn("symbol", F.lit("SYM3")))
    wanted = spark.createDataFrame([(f"SYM{i % 45}", i) for i in range(300)], "symbol string, n int")
    plain = lookup.stock_ids(wanted, listed)
    spread = lookup.stock_ids(wanted, listed, salted=True)
    by_column = lookup.stock_ids(wanted, listed, F.col("n"), salted=True)
    assert plain.count() == 300
    assert same(plain, spread) and same(plain, by_column)
    assert plain.where("symbol = 'SYM3'").select("stock_id").distinct().first()[0] == 3


def test_last_write_wins(spark):
    rows = [(*bar(1, day(0), 5), 1), (*bar(1, day(0), 4), 2), (*bar(1, day(1), 3), 1)]
    frame = spark.createDataFrame(rows, [*S.DAILY_PRICES.fieldNames(), "version"])
    kept = upsert.one_per_key(frame)
    assert "SortAggregate" not in kept._jdf.queryExecution().executedPlan().toString()
    assert column(kept, "close_price", "trade_date") == [4, 3]
    assert "version" not in kept.columns
    unversioned = upsert.one_per_key(frame.drop("version"))
    assert column(unversioned, "close_price", "trade_date") == [5, 3]


def test_merge_is_idempotent(spark):
    target = bars(spark, {1: [1, 2, 3], 2: [9]})
    updates = bars(spark, {1: [8, 8], 3: [7]}, start=2)
    once = upsert.merge(target, updates)
    assert once.count() == 6
    assert column(once.where("stock_id = 1"), "close_price", "trade_date") == [1, 2, 8, 8]
    assert same(once, upsert.merge(once, updates))
    assert same(once.select("stock_id", "trade_date").distinct(), once.select("stock_id", "trade_date"))


def versioned(spark, rows):
    schema = "stock_id long, trade_date date, x int, version decimal(38,0)"
    exact = [(*row[:3], None if row[3] is None else Decimal(row[3])) for row in rows]
    return spark.createDataFrame(exact, schema)


@pytest.mark.parametrize(
    "stored, update, kept",
    [
        ((5, 7), (6, 8), (6, 8)),
        ((5, 8), (6, 7), (5, 8)),
        ((5, 8), (6, 8), (6, 8)),
        ((5, None), (6, 1), (6, 1)),
        ((5, 8), (6, None), (6, 8)),
        ((5, None), (None, None), (None, None)),
        ((5, 10**37), (None, 3 * 10**37), (None, 3 * 10**37)),
        ((None, 3 * 10**37), (6, 10**37), (None, 3 * 10**37)),
    ],
)
def test_merge_goes_by_arrival(spark, stored, update, kept):
    target, updates = (versioned(spark, [(1, day(0), *row)]) for row in (stored, update))
    merged = upsert.merge(target, updates)
    assert "SortAggregate" not in merged._jdf.queryExecution().executedPlan().toString()
    row = merged.select("x", "version").first()
    assert (row.x, None if row.version is None else int(row.version)) == kept


@pytest.mark.parametrize("seed", range(3))
def test_any_order_of_deliveries_merges_to_one_table(spark, seed):
    """By brute force: the row with the greatest version of each key."""
    rng = random.Random(seed)
    rows = [(rng.randrange(4), day(rng.randrange(3)), n, n) for n in range(1, 25)]
    rng.shuffle(rows)
    want = {}
    for key, on, value, version in rows:
        want[key, on] = max(want.get((key, on), 0), value)
    table = versioned(spark, [])
    for at in range(0, len(rows), 8):
        delivery = upsert.one_per_key(versioned(spark, rows[at : at + 8]), versioned=True)
        table = upsert.merge(table, delivery)
    assert {(r.stock_id, r.trade_date): r.x for r in table.collect()} == want


def test_merge_may_write_null(spark):
    target = spark.createDataFrame([(1, day(0), 5)], "stock_id long, trade_date date, x int")
    updates = spark.createDataFrame([(1, day(0), None)], target.schema)
    assert upsert.merge(target, updates).first().x is None


@pytest.mark.parametrize(
    ("mode", "expected"),
    [("upsert", [3, 4, 5, 3, 4, 5]), ("global", [5, 5]), ("per_stock", [5, 3, 4, 5])],
)
def test_new_rows(spark, mode, expected):
    target = bars(spark, {1: [1] * 5, 2: [1] * 3})
    updates = bars(spark, {1: [2] * 3, 2: [2] * 3}, start=3)
    fresh = upsert.new_rows(updates, target, mode).orderBy("stock_id", "trade_date").collect()
    assert [(r.trade_date - day(0)).days for r in fresh] == expected


@pytest.mark.parametrize("mode", validate.MODES)
def test_everything_is_new_to_an_empty_table(spark, mode):
    updates = bars(spark, {1: [1, 2]})
    assert upsert.new_rows(updates, updates.limit(0), mode).count() == 2


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        upsert.new_rows(bars(spark, {1: [1]}), bars(spark, {1: [1]}), "other")


def test_gate(spark):
    prices = bars(spark, {1: [1, 2]})
    newest = prices.agg(F.max("trade_date").alias("last_date"))
    nothing = prices.limit(0).agg(F.max("trade_date").alias("last_date"))
    assert refresh.gate(newest, F.lit(day(1))).first().already_updated
    assert not refresh.gate(newest, F.lit(day(2))).first().already_updated
    assert not refresh.gate(nothing, F.lit(day(2))).first().already_updated


def test_windows(spark):
    prices = bars(spark, {1: [1] * 20, 2: [1] * 20})
    listed = stocks(spark, 1, 2, inactive=(2,))
    recent = refresh.recent(prices, listed, F.lit(day(15)))
    assert column(recent, "trade_date", "trade_date") == [day(n) for n in range(8, 16)]
    assert refresh.history(prices, F.lit(day(15)), days=3).count() == 8


def test_malformed_rows_are_landed_by_all_tasks(spark, tmp_path):
    """Every file of malformed rows has its own header: none has to be written by one task."""
    stocks = spark.createDataFrame([(n, f"SYM{n}", "x", True) for n in (1, 11, 21)], S.STOCKS)
    days = spark.range(40).select(F.date_add(F.lit(date(2000, 1, 3)), F.col("id").cast("int")).alias("trade_date"))
    price = [F.lit(Decimal("5.0000")).cast(S.PRICE).alias(name) for name in S.PRICE_COLUMNS]
    bars = days.crossJoin(stocks.select("stock_id")).select(*S.BAR_KEY, *price, F.lit(7).cast("long").alias("volume"))
    folder = str(tmp_path / "landing")
    fixtures.land_csv(Market(stocks, bars.repartition(6), stocks.limit(0)), folder)
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_path").alias("file"))
    bad = lines.where("value RLIKE '^[A-Za-z0-9]+,[^,]+(,1,2,1,1,7,8,9)?$'")
    assert bad.select("file").distinct().count() > 1
    assert bad.count() == 2 * bars.count()
    checked = validate.check(read_landed_csv(spark, folder), stocks)
    assert checked.where(F.col("reason") == validate.BAD_ROW).count() == bad.count()
    assert checked.count() == bars.count() + bad.count()


def test_headers_are_found_without_sorting_lines(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("symbol,ts,close\nSYM1,2000-01-03,5\n")
    (tmp_path / "b.csv").write_text("close,symbol,ts\n6,SYM2,2000-01-04\n")
    rows = read_landed_csv(spark, str(tmp_path))
    assert {(r.symbol, r.close) for r in rows.collect()} == {("SYM1", "5"), ("SYM2", "6")}
    rows.explain()
    plan = capsys.readouterr().out
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan


def test_cells_of_any_line(spark):
    """Against one pattern for a comma outside quotes, on lines of all signs that matter."""
    rng = random.Random(7)
    lines = ["".join(rng.choices('ab,," \r\0\ufeff', k=rng.randrange(24))) for _ in range(2000)]
    lines += ["", ",", "a,b", '"a,b",c', ' "a" ,"b""c"', "\ufeffa,b\r", 'a"b,c']

    outside_quotes = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
    cells = F.split(F.regexp_replace("value", "^\ufeff|\r$", ""), outside_quotes, -1)
    bare = F.transform(cells, lambda cell: F.regexp_replace(cell, r'^\s*"|"\s*$', ""))
    want = F.transform(bare, lambda cell: F.regexp_replace(cell, '""', '"'))
    frame = spark.createDataFrame([(line,) for line in lines], "value string")
    both = frame.select("value", _cells(F.col("value")).alias("got"), want.alias("want"))
    assert both.where("got <> want OR got IS NULL").collect() == []


@pytest.mark.parametrize("cell", ["1", '"1"'])
def test_a_line_is_cut_in_time_that_grows_with_its_length(spark, tmp_path, cell):
    wide = ",".join([cell] * 60_000)
    (tmp_path / "bars.csv").write_text(f"symbol,ts,close\n{wide}\nSYM1,2000-01-03,5\n")
    began = time.monotonic()
    rows = read_landed_csv(spark, str(tmp_path)).collect()
    assert time.monotonic() - began < 8
    assert sorted((r.symbol, r.bad_row == wide) for r in rows if r.bad_row) == [(None, True)]
    assert [r.symbol for r in rows if not r.bad_row] == ["SYM1"]


def test_csv_files_are_landed_from_bars_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def count(volume):
        made.add(1)
        return volume

    listed = stocks(spark, 1, 11)
    prices = bars(spark, {1: [5] * 20, 11: [6] * 20}).withColumn("volume", count("volume"))
    fixtures.land_csv(Market(listed, prices, listed.limit(0)), str(tmp_path / "landing"))
    assert made.value == 40


def test_merge_marks_what_it_alters(spark):
    rows = [(1, day(0), 5, 8), (1, day(1), 5, 8), (1, day(2), 5, 8), (1, day(3), None, 8), (1, day(4), 5, None)]
    new = [(1, day(0), 6, 7), (1, day(1), 5, 9), (1, day(2), 6, 9), (1, day(3), None, None), (1, day(5), None, None)]
    merged = upsert.merge(versioned(spark, rows), versioned(spark, new), marked=True).orderBy("trade_date")
    assert [(r.x, r.altered) for r in merged.collect()] == [
        (5, False), (5, False), (6, True), (None, False), (5, False), (None, True)
    ]
    assert [r.version for r in merged.collect()] == [8, 9, 9, 8, None, None]
