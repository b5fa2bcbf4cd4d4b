"""Line dedup: which lines go, as bitmaps per document.

Hashes of all lines are range-partitioned together with their document and sorted by document
and position, so that a line that a third of all documents share is spread over many tasks and a
document's first occurrence of a line is simply the row after another document or line. Counting
first occurrences gives the documents of a line; the lines of the frequent ones become bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import SPACES, let, staged

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BITS = 64
SALTS = 64
DOCUMENT = ("doc_id", "text_hash")


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, UPPER.lower())


def _named(docs: DataFrame, text: str, key: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("body")
    )


def dropped_lines(
    docs: DataFrame,
    min_chars: int = 1,
    min_docs: int = 10,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """One row per document that loses lines: ``(doc_id, text_hash, n_dropped, dropped)``.

    ``dropped`` is a sparse bitmap, sorted ``(word, bits)`` with only the words that are not
    zero; bit b of word w stands for line ``64 w + b``. A line's key of at least ``min_chars``
    code points that is found in at least ``min_docs`` documents loses all its lines. A document
    is a key and a text: repeated rows count once, null keys with different texts are different
    documents. Null and empty texts are one empty line, which is never dropped.
    """
    hashes = (
        _named(docs, text, key)
        .select(*DOCUMENT, F.posexplode(F.split("body", "\n")).alias("at", "line"))
        .select(*DOCUMENT, "at", line_key(F.col("line")).alias("line_key"))
        .where(F.char_length("line_key") >= max(min_chars, 1))
        .select(
            F.xxhash64("line_key").alias("h1"),
            F.xxhash64(F.lit(1), "line_key").alias("h2"),
            *DOCUMENT,
            "at",
        )
    )
    # Texts are split and hashed once; sampling, counting and marking read the hashes.
    lines = (
        staged(hashes, "lines")
        .repartitionByRange("h1", *DOCUMENT)
        .sortWithinPartitions("h1", "h2", *DOCUMENT, "at")
    )
    occurrence = Window.partitionBy("h1", "h2", *DOCUMENT).orderBy("at")
    frequent = (
        lines.withColumn("nth", F.row_number().over(occurrence))
        .where(F.col("nth") == 1)
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("documents"))
        .where(F.col("documents") >= min_docs)
    )
    # A line that a third of all documents share is marked by several tasks.
    spread = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.col("text_hash"), F.lit(SALTS)).cast("int")
    word = (F.col("at") / BITS).cast("int")
    return (
        lines.withColumn("salt", salt)
        .join(spread, ["h1", "h2", "salt"], "left_semi")
        .withColumn("word", word)
        .withColumn("bit", F.expr(f"shiftleft(1L, at % {BITS})"))
        .groupBy(*DOCUMENT, "word")
        .agg(F.bit_or("bit").alias("bits"))
        .groupBy(*DOCUMENT)
        .agg(
            F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
            F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"),
        )
    )


def without_dropped(body: Column, dropped: Column) -> Column:
    """A text without the lines of a bitmap, null if the bitmap is."""

    def dense(lines: Column) -> Column:
        def bits(word: Column) -> Column:
            same = F.filter(dropped, lambda entry: entry["word"] == word)
            return F.coalesce(F.get(F.transform(same, lambda e: e["bits"]), F.lit(0)), F.lit(0))

        return F.transform(F.sequence(F.lit(0), ((F.size(lines) - 1) / BITS).cast("int")), bits)

    def stays(bits: Column, at: Column) -> Column:
        word = F.get(bits, (at / BITS).cast("int"))
        shifted = F.call_function("shiftrightunsigned", word, at % BITS)
        return shifted.bitwiseAND(F.lit(1)) == 0

    def kept(lines: Column) -> Column:
        return let(
            dense(lines), lambda bits: F.filter(lines, lambda line, at: stays(bits, at))
        )

    return F.array_join(let(F.split(body, "\n"), kept), "\n")


def dedup_lines(
    docs: DataFrame,
    min_chars: int = 1,
    min_docs: int = 10,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """One row per row of ``docs``: its lines, the bitmap of those dropped, and the text left.

    ``dropped`` is null where nothing is dropped. Null and empty texts have one empty line and
    give the empty text; other columns of ``docs`` are not read.
    """
    bitmaps = dropped_lines(docs, min_chars, min_docs, text, key)
    its = bitmaps.select(
        F.col("doc_id").alias("its_id"), F.col("text_hash").alias("its_hash"), "n_dropped", "dropped"
    )
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_hash") == F.col("its_hash"))
    kept = F.when(F.col("dropped").isNull(), F.col("body")).otherwise(
        without_dropped(F.col("body"), F.col("dropped"))
    )
    return (
        _named(docs, text, key)
        .join(its, same, "left")
        .select(
            "doc_id",
            (F.regexp_count("body", F.lit("\n")) + 1).cast("long").alias("n_lines"),
            F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
            "dropped",
            kept.alias("kept_text"),
        )
    )
