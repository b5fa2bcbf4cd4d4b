"""What the text operators share: reading tables, staging and the words of a text."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import barloom
from barloom.sources.shared import new_folder

#: The six characters that separate words, and the class of all others.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that Python works on at once.
CHUNK = 4 << 20
#: Rows with texts that Python is sent at once.
TEXTS = 1_000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_shipped: set[str] = set()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(rows: DataFrame, purpose: str, at_once: int | None = None) -> DataFrame:
    """Rows written once to shared storage and read back.

    Later steps neither compute them again nor depend on the executors that made them. With
    ``at_once`` Python gets no more than so many rows in a batch, as both sides hold it whole.
    """
    spark = rows.sparkSession
    path = new_folder(spark, purpose)
    usual = spark.conf.get(BATCH_ROWS)
    if at_once is not None and not 0 < int(usual) <= at_once:
        spark.conf.set(BATCH_ROWS, str(at_once))
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, usual)
    return spark.read.schema(rows.schema).parquet(path)


def placed(rows: DataFrame) -> DataFrame:
    """Rows with ``(part, file, row)``, the place where each one is written.

    Places are those of the Parquet files that are read, and so they grow in the order in which
    the files were written. Rows that do not come from files are staged and numbered.
    """
    try:
        found = rows.select("*", "_metadata.file_name", "_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        numbered = staged(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        return numbered.select("*", F.lit(0).cast("long").alias("part"), F.lit("").alias("file"))
    part = F.regexp_extract("file_name", r"^part-(\d+)", 1).try_cast("long")
    renamed = found.withColumnsRenamed({"file_path": "file", "row_index": "row"})
    return renamed.withColumn("part", part).drop("file_name")


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(barloom.__file__).resolve().parent
    bundle = os.path.join(tempfile.mkdtemp(prefix="bundle-"), "barloom_package.zip")
    with zipfile.ZipFile(bundle, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(bundle)
    _shipped.add(context.applicationId)


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in turn, some ``CHUNK`` bytes of a text column at a time."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy().astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = int(ends[start - 1]) if start else 0
        stop = max(int(np.searchsorted(ends, done + CHUNK, "right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task for the operator that it works for.

    Workers serve all steps of an application one after another, so what one operator kept goes
    when another asks, or releases it.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Drop what the worker kept for another operator, and give back what Arrow holds unused."""
    _kept.clear()
    pa.default_memory_pool().release_unused()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text, none if it is null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda word: word != "")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
