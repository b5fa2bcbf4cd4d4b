"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from contract.queries import ALL  # noqa: E402

HEADLINE = (
    "daily_bars",
    "momentum",
    "pair_zscore",
    "market_overview",
    "oversold",
    "overbought",
    "long_term_trends",
    "yearly_performance",
    "rsi_patterns",
    "all_pairs_status",
    "pairs_high",
    "pairs_low",
    "pair_history",
    "database_stats",
    "load_summary",
    "bar_quality",
    "upsert_bars",
    "refresh_result",
    "momentum_tail",
    "pair_tail",
    "cross_events",
    "pair_excursions",
)


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def timed(spark: SparkSession, name: str, folder: str) -> float:
    """Seconds to plan a query and compute every row and column of it."""
    started = time.perf_counter()
    ALL[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    for name in names:
        timed(spark, name, folder)
    seconds = {name: round(timed(spark, name, folder), 3) for name in names}
    spark.stop()
    report = {
        "metric": "total seconds of the headline queries, second run",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
