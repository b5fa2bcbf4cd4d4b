"""The stored tables: Parquet, partitioned by calendar period.

A period is the first day of its month by default (year and day are the other grains), so that
reports over the last days read one or two partitions and an update rewrites only the periods
it touches.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom import schema as S
from barloom.functions.exact import anchor
from barloom.operators.upsert import merge
from barloom.sources.market import Market, newest_rows
from barloom.sources.shared import (
    discard,
    exists,
    new_folder,
    read_texts,
    subfolders,
    write_text,
)

GRAINS = ("year", "month", "day")
DATED = {
    "daily_prices": (S.STORED_PRICES, S.BAR_KEY),
    "momentum_indicators": (S.MOMENTUM, S.BAR_KEY),
    "pair_metrics": (S.PAIR_METRICS, S.PAIR_KEY),
}
#: What dated tables carry beside their declared columns.
HIDDEN = ("period", "version")
LISTS = {"stocks": S.STOCKS, "stock_pairs": S.STOCK_PAIRS}


def _entry(batch: str) -> str:
    return sha256(batch.encode()).hexdigest()[:32]


def _complete(name: str, rows: DataFrame, *more: str) -> DataFrame:
    """Rows with all stored columns of a dated table; those that have no version get a null."""
    columns = DATED[name][0].names
    if "version" in columns and "version" not in rows.columns:
        rows = rows.withColumn("version", F.lit(None).cast(S.VERSION))
    return rows.select(*columns, *more)


class Warehouse:
    """A folder with one Parquet table per name."""

    def __init__(self, spark: SparkSession, root: str, grain: str = "month") -> None:
        if grain not in GRAINS:
            raise ValueError(f"grain must be one of {GRAINS}, not {grain!r}")
        self.spark = spark
        self.root = root.rstrip("/")
        self.grain = grain

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def period(self, day: Column) -> Column:
        return day.cast("date") if self.grain == "day" else F.trunc(day, self.grain)

    def read(self, name: str) -> DataFrame:
        """A table in its declared schema, empty if nothing was stored yet.

        Dated tables carry their partition column ``period`` behind the declared columns, prices
        the ``version`` of each row, too: when it landed.
        """
        schema = self._schema(name)
        if not exists(self.spark, self.path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def table(self, name: str) -> DataFrame:
        return self.read(name).drop(*HIDDEN)

    def of_periods(self, name: str, periods: Iterable[date]) -> DataFrame:
        """The rows of some periods of a dated table; no other folder is listed."""
        known = set(self.periods(name)).intersection(periods)
        if not known:
            return self.spark.createDataFrame([], self._schema(name))
        paths = [f"{self.path(name)}/period={period.isoformat()}" for period in sorted(known)]
        reader = self.spark.read.schema(self._schema(name)).option("basePath", self.path(name))
        return reader.parquet(*paths)

    def between(
        self, name: str, first: Column | date | None, last: Column | date | None
    ) -> DataFrame:
        """Rows of the days from ``first`` to ``last``, reading only their periods.

        Between plain dates the periods are named, so that no other folder of the table is listed.
        """
        if all(day is None or isinstance(day, date) for day in (first, last)):
            rows = self.of_periods(name, self._spanned(name, first, last))
        else:
            rows = self.read(name)
        if first is not None:
            first = anchor(first)
            rows = rows.where(F.col("period") >= self.period(first))
            rows = rows.where(F.col("trade_date") >= first)
        if last is not None:
            last = anchor(last)
            rows = rows.where(F.col("period") <= self.period(last))
            rows = rows.where(F.col("trade_date") <= last)
        return rows.drop(*HIDDEN)

    def _spanned(self, name: str, first: date | None, last: date | None) -> list[date]:
        """The periods of a table that hold days from ``first`` to ``last``."""
        return [
            period
            for period in self.periods(name)
            if (first is None or self.period_end(period) >= first) and (last is None or period <= last)
        ]

    def oldest(self, name: str) -> date | None:
        """The first day of the oldest period that holds rows."""
        return min(self.periods(name), default=None)

    def periods(self, name: str) -> list[date]:
        """The periods of a dated table, from its folders alone."""
        found = subfolders(self.spark, self.path(name))
        return [date.fromisoformat(f.removeprefix("period=")) for f in found if f.startswith("period=")]

    def newest(self) -> DataFrame:
        """The newest stored day, read from the newest period alone, which the folders tell."""
        prices = self.read("daily_prices")
        last_period = F.lit(max(self.periods("daily_prices"), default=None)).cast("date")
        return prices.where(F.col("period") == last_period).agg(
            F.max("trade_date").alias("last_date")
        )

    def market(self) -> Market:
        return Market(
            stocks=self.table("stocks"),
            daily_prices=self.table("daily_prices"),
            stock_pairs=self.table("stock_pairs"),
            momentum_indicators=self.table("momentum_indicators"),
            pair_metrics=self.table("pair_metrics"),
            newest=self.newest(),
            between=self.between,
            latest=lambda name, key: self.latest(name, self.table("stock_pairs").select(key)),
            summaries=self.summaries(),
        )

    def latest(self, name: str, keys: DataFrame) -> DataFrame:
        """The newest row of every key that has one, read from the newest period backwards.

        Every step reads twice as many periods as the one before, of the keys not found yet only;
        the walk ends when none is missing. What a step finds is written to shared storage, a row
        per key. A key without rows makes the walk go on to the oldest period, once.
        """
        key = DATED[name][1][0]
        missing, found = keys.select(key).distinct(), self.table(name).where(F.lit(False))
        periods, folder = sorted(self.periods(name), reverse=True), new_folder(self.spark, "latest")
        step = 1
        while periods:
            rows = self.of_periods(name, periods[:step]).drop("period").join(missing, key, "left_semi")
            part = self.stage(str(step), newest_rows(rows, key), folder)
            found = found.unionByName(part)
            missing = missing.join(part, key, "left_anti")
            if missing.isEmpty():
                break
            periods, step = periods[step:], 2 * step
        return found

    def summaries(self) -> DataFrame | None:
        """The table of summaries, if the prices have one."""
        if not exists(self.spark, self.path("summaries")):
            return None
        return self.spark.read.schema(S.SUMMARIES).parquet(self.path("summaries"))

    def _summarise(self, prices: DataFrame, overwrite: str) -> None:
        """Replace the summaries of the periods of some stored prices, which are all of them."""
        day = F.dayofyear("trade_date") - 1
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), day % 64)

        def word(n: int) -> Column:
            return F.bit_or(F.when(F.floor(day / 64) == n, bit).otherwise(F.lit(0).cast("long")))

        summed = prices.groupBy("stock_id", "period").agg(
            F.count("*").alias("bars"),
            F.min("trade_date").alias("first_date"),
            F.max("trade_date").alias("last_date"),
            *(word(n).alias(f"days_{n}") for n in range(S.DAY_WORDS)),
        )
        rows = summed.select(S.SUMMARIES.names).hint("rebalance", "period")
        self._write(rows, self.path("summaries"), overwrite)

    def write_list(self, name: str, rows: DataFrame) -> None:
        rows.select(LISTS[name].names).write.mode("overwrite").parquet(self.path(name))

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace a whole dated table, which must not be an input of ``rows``."""
        self._write(self._placed(name, rows), self.path(name), "static")
        if name == "daily_prices":
            self._summarise(self.read(name), "static")

    def upsert(
        self,
        name: str,
        updates: DataFrame,
        batch: str | None = None,
    ) -> None:
        """Merge updates (one row per key) into a dated table, period by period.

        Only the periods of the updates are read and rewritten. Prices that landed before the
        ones they meet change nothing. The merged periods are first
        written beside the table and only then replace the old ones, so the table is never read
        and overwritten at once. With a ``batch`` folder, a run that broke off in between is
        finished from its complete copy when it is run again.
        """
        key = DATED[name][1]
        staged = f"{batch}/{name}" if batch else new_folder(self.spark, f"staged-{name}")
        if not exists(self.spark, f"{staged}/_SUCCESS"):
            current = self.of_periods(name, self.periods_of(updates)).drop("period")
            marked = ["altered"] if name == "daily_prices" else []
            merged = merge(current, _complete(name, updates), key, bool(marked))
            self._write(self._placed(name, merged, *marked), staged, "static")
        rows = self.spark.read.schema(self._schema(name)).parquet(staged)
        self._write(rows.sortWithinPartitions("period", *key), self.path(name), "dynamic")
        if name == "daily_prices":
            self._summarise(rows, "dynamic")
        if not batch:
            discard(self.spark, staged)

    def altered(self, batch: str) -> DataFrame:
        """The stocks and days of which a batch's upsert altered the prices, told by its complete copy.

        A bar that landed before the stored one, or is stored with the same values, is none of them.
        """
        schema = self._schema("daily_prices").add("altered", T.BooleanType())
        rows = self.spark.read.schema(schema).parquet(f"{batch}/daily_prices")
        return rows.where(F.coalesce("altered", F.lit(True))).select(*S.BAR_KEY)

    def stage(self, name: str, rows: DataFrame, batch: str) -> DataFrame:
        """Rows written once to shared storage and read back: later steps neither compute them
        again nor depend on the executors that made them."""
        path = f"{batch}/{name}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def stage_counted(
        self, name: str, rows: DataFrame, batch: str, *metrics: Column
    ) -> tuple[DataFrame, dict[str, object]]:
        """Staged rows and metrics of them, which the write observes as the rows pass by.

        Only rows that were staged by an earlier run are read once more for it.
        """
        if exists(self.spark, f"{batch}/{name}/_SUCCESS"):
            staged = self.stage(name, rows, batch)
            return staged, staged.agg(*metrics).first().asDict()
        seen = Observation()
        return self.stage(name, rows.observe(seen, *metrics), batch), seen.get

    def keep_rejects(self, rejects: DataFrame, batch: str) -> DataFrame:
        """Rejects of a batch moved to the table of rejects, which keeps them by batch."""
        path = f"{self.path('rejects')}/{batch.rstrip('/').rsplit('/', 1)[-1]}"
        rejects.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rejects.schema).parquet(path)

    def taken(self) -> DataFrame:
        """The landed files that were taken in."""
        if not exists(self.spark, self.path("landed_files")):
            return self.spark.createDataFrame([], S.LANDED_FILES)
        return self.spark.read.schema(S.LANDED_FILES).parquet(f"{self.path('landed_files')}/*")

    def take(self, files: DataFrame, batch: str) -> None:
        """Enter the files of a batch as taken in; to enter them again changes nothing."""
        files.write.mode("overwrite").parquet(f"{self.path('landed_files')}/{_entry(batch)}")

    def begin(self, batch: str, own: bool = False) -> None:
        """Enter a batch as pending: from here on its changes must be finished."""
        entry = f"{self.path('_pending')}/{_entry(batch)}"
        write_text(self.spark, entry, f"{'own' if own else 'named'} {batch}")

    def finish(self, batch: str) -> None:
        discard(self.spark, f"{self.path('_pending')}/{_entry(batch)}")

    def pending(self) -> list[tuple[str, bool]]:
        """Batches that began and were not finished, and whether they are the load's own."""
        found = (text.split(" ", 1) for text in read_texts(self.spark, self.path("_pending")))
        return [(batch, kind == "own") for kind, batch in found]

    def _schema(self, name: str) -> T.StructType:
        if name in LISTS:
            return LISTS[name]
        return T.StructType([*DATED[name][0], T.StructField("period", T.DateType())])

    def period_end(self, period: date) -> date:
        """The last day of a period, given by its first."""
        if self.grain == "day":
            return period
        if self.grain == "year":
            return period.replace(month=12, day=31)
        return (period.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)

    def periods_of(self, rows: DataFrame) -> list[date]:
        """The periods of some rows: no more than their calendar span holds."""
        periods = rows.select(self.period(F.col("trade_date")).alias("period")).distinct()
        return [row.period for row in periods.collect()]

    def _placed(self, name: str, rows: DataFrame, *more: str) -> DataFrame:
        """Rows gathered by period into files of even size, however full a period is."""
        key = DATED[name][1]
        dated = _complete(name, rows, *more).withColumn("period", self.period(F.col("trade_date")))
        return dated.hint("rebalance", "period").sortWithinPartitions("period", *key)

    def _write(self, rows: DataFrame, path: str, overwrite: str) -> None:
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", overwrite)
            .partitionBy("period")
            .parquet(path)
        )
