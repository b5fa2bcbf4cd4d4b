"""From raw documents to token files: five stages, each written and read again by the next.

Every stage gets all its predecessor kept and, but for the last, returns the columns of
``documents``. Rows without text or key pass through all stages; an empty table stays empty. What
a stage returns must be written before the next one is called, which discards its scratch folders.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import binary, decontam, mix, neardup, toxicity
from barloom.llm.common import count_words, placed, staged, table
from barloom.sources.shared import discard, recorded_folders

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose sentences are harmless by the classifier trained on ``labels``."""
    return toxicity.harmless(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, similarity 0.8.

    Rows are compared one by one, whatever their keys: texts that share a key are near copies only
    if they are alike, and rows without a key can be copies, too. The row with the smallest key
    stays, and one of the rows without a key, as those pass through all stages. Rows without words
    are near nothing; of those with a key one row per key and text stays.
    """
    rows = staged(docs.withColumn("row_id", F.monotonically_increasing_id()), "rows")
    found = neardup.near_duplicates(rows, width=5, percent=80, key="row_id").select(
        F.col("doc_id").alias("row_id"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component")
    )
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    others = [name for name in COLUMNS if name not in ("doc_id", "text")]
    placed = rows.select("row_id", "doc_id", text_hash, *others).join(found, "row_id")
    wordless = F.col("component").isNull()
    chosen = placed.groupBy(
        "component",
        F.col("doc_id").isNull().alias("keyless"),
        F.when(wordless, F.col("doc_id")).alias("its_key"),
        F.when(wordless, F.col("text_hash")).alias("its_text"),
        F.when(wordless & F.col("doc_id").isNull(), F.col("row_id")).alias("its_row"),
    ).agg(F.min(F.struct("doc_id", "text_hash", *others, "row_id")).alias("first"))
    return rows.join(chosen.select("first.row_id"), "row_id", "left_semi").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    found = decontam.contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), into="leaked_items")
    return found.where(F.size("leaked_items") == 0).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of whole documents as the mix takes them, in training order.

    The mix sees the number of words of each row and where it lies; the texts join its copies, once,
    and are range-sorted by position. The order of the rows written is the order of training.
    """
    rows = placed(docs)
    place = ["file", "row"]
    sizes = staged(rows.select("doc_id", "source", count_words(F.col("text")).alias("size"), *place), "sizes")
    copies = mix.mix(sizes, whole=True, size="size", carried=place).select(
        *(F.col(name).alias(f"its_{name}") for name in place), F.explode("copies.position").alias("position")
    )
    its = (F.col("file") == F.col("its_file")) & (F.col("row") == F.col("its_row"))
    order = ["position", "doc_id", *place]
    taken = rows.select(*COLUMNS, *place).join(staged(copies, "copies"), its)
    return taken.repartitionByRange(*order).sortWithinPartitions(*order).select(*COLUMNS)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of all copies, in the order in which their rows were written, read back: one
    row per copy."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return binary.round_trip(spark, placed(docs), vocabulary, order=["part", "file", "row"])


_scratch: dict[str, list[str]] = {}


def tidy(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that first discards what the one before it staged: its output has been written since."""

    @wraps(stage)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = _scratch.setdefault(spark.sparkContext.applicationId, [])
        while names:
            discard(spark, names.pop())
        with recorded_folders(names):
            return stage(spark, docs, sf_dir)

    return tidied


STAGES = [
    ("toxicity", tidy(drop_toxic)),
    ("near-duplicates", tidy(drop_near_copies)),
    ("decontamination", tidy(drop_leaks)),
    ("mixing", tidy(mix_sources)),
    ("token files", tidy(write_token_files)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
