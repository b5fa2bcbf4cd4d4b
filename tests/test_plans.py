"""The shape of physical plans: what is shuffled, broadcast, pruned or left to Python."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as contract
from barloom.operators import indicators, pairs, upsert
from barloom.plans import reports
from barloom.sources import ticks
from contract import queries as registered
from tests.helpers import bars

FOLDER = "/root/testdata/sf0.001"
WRITING = {"stored_overview", "stream_ingest", "csv_export", "refresh_result", "refresh_stored", "refresh_resumed", "bulk_load_stored", "duplicate_delivery", "bar_quality_csv"}
LAZY = sorted(set(registered.ALL) - WRITING)


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def shuffles(text: str) -> list[str]:
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|SinglePartition|rangepart\w*)", text)


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_global_window(name, spark):
    text = plan(contract.queries()[name](spark, FOLDER))
    assert "Python" not in text and "InPandas" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    for window in re.findall(r"windowspecdefinition\((\w+)#", text):
        assert window in {"stock_id", "pair_id"}


def test_lines_are_aggregated_before_the_shuffle(spark):
    text = plan(ticks.daily_prices(spark, FOLDER))
    assert "partial_sum(step" in text and "SortAggregate" not in text
    assert len(shuffles(text)) == 2


def test_scan_reads_needed_columns_only(spark):
    text = plan(indicators.momentum(ticks.daily_prices(spark, FOLDER)))
    assert "l_extendedprice" in text and "l_quantity" not in text


def test_indicators_shuffle_and_sort_once(spark, tmp_path):
    bars(spark, {1: [1, 2]}).write.parquet(str(tmp_path / "bars"))
    stored = spark.read.parquet(str(tmp_path / "bars"))
    text = plan(indicators.momentum(stored))
    assert len(shuffles(text)) == 1 and text.count("Sort [") == 1


def test_pairs_read_the_bars_once(spark):
    market = ticks.TickMarket(spark, FOLDER)
    text = plan(pairs.pair_metrics(market.daily_prices, market.stock_pairs))
    assert text.count("l_extendedprice") == plan(market.daily_prices).count("l_extendedprice")
    assert text.count("REPARTITION_BY_COL") == 1


def test_first_and_last_need_one_shuffle(spark, tmp_path):
    bars(spark, {1: [1, 2]}).write.parquet(str(tmp_path / "bars"))
    stored = spark.read.parquet(str(tmp_path / "bars"))
    market = ticks.TickMarket(spark, FOLDER)
    text = plan(reports.first_last_in_year(type(market).__base__(market.stocks, stored, None)))
    assert len(shuffles(text)) == 1 and "partial_min_by" in text and "SortAggregate" not in text
    assert "PushedFilters: [IsNotNull(trade_date), GreaterThanOrEqual(trade_date" in text


def test_merge_is_a_hash_aggregate(spark):
    text = plan(upsert.merge(bars(spark, {1: [1]}), bars(spark, {1: [2]})))
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_top_k_is_not_a_full_sort(spark):
    market = ticks.TickMarket(spark, FOLDER)
    assert "TakeOrderedAndProject" in plan(reports.oversold(market, market.last_date()))


def test_nothing_is_broadcast_past_the_threshold(spark):
    """Dimension joins fall back to sort-merge when the list is too large."""
    market = ticks.TickMarket(spark, FOLDER)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(reports.load_summary(market)) + plan(reports.market_overview(market))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
