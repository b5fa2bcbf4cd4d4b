"""Token counts of whole texts by a compiled transducer.

Texts up to a chunk's length are counted in one piece. Longer ones are cut in one pass into chunks
that are dealt to all tasks; the chunks' state maps are composed in two rounds, within runs of
chunks and then within texts, so that a very long text is not one task's work. Should a chunk have
begun in a state that was not foreseen, its text is counted in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.bpe import Chunk, counter, packed, unpacked
from barloom.llm.common import ship

CHUNK = "digest string, at int, body string, from_inside boolean, to_inside boolean, before string"
MAP = "digest string, at int, map string"
#: Chunks that leave the task that cuts them at once.
BATCH = 64


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    chunk_chars: int = 1 << 15,
    run: int = 64,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """One row ``(doc_id, n_bytes, n_tokens)`` per row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE file that all machines have. Null and empty
    texts have no tokens, repeated rows stay, the key may be null, other columns are not read.
    """
    ship(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), body.alias("body"))
    long = F.char_length("body") > chunk_chars
    n_bytes = F.octet_length("body").cast("long").alias("n_bytes")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in batches:
            found = [tokens.count(value.as_py()) for value in batch.column("body")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    short = (
        rows.where(~long)
        .select("doc_id", n_bytes, "body")
        .mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    )

    cut_shape = pa.schema(
        [
            ("digest", pa.string()),
            ("at", pa.int32()),
            ("body", pa.string()),
            ("from_inside", pa.bool_()),
            ("to_inside", pa.bool_()),
            ("before", pa.string()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in batches:
            for digest, body in zip(batch.column("digest"), batch.column("body")):
                digest, chunks = digest.as_py(), enumerate(tokens.cut(body.as_py(), chunk_chars))
                while some := [(digest, at, *chunk) for at, chunk in islice(chunks, BATCH)]:
                    columns = [pa.array(its, field.type) for its, field in zip(zip(*some), cut_shape)]
                    yield pa.RecordBatch.from_arrays(columns, schema=cut_shape)

    def map_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in batches:
            ends = (batch.column(name).to_pylist() for name in Chunk._fields)
            maps = [packed(tokens.chunk_map(Chunk(*one))) for one in zip(*ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("at"), pa.array(maps, pa.string())],
                names=["digest", "at", "map"],
            )

    def compose(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        whole = counter(vocabulary).scan([unpacked(value) for value in group.column("map").to_pylist()])
        first = group.slice(0, 1)
        return first.set_column(2, "map", pa.array([packed(whole)], pa.string()))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in batches:
            found = [tokens.total(unpacked(value)) for value in batch.column("map").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(found, pa.int64())], names=["digest", "n_tokens"]
            )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in batches:
            found = [
                tokens.count(body.as_py()) if known is None else known
                for known, body in zip(batch.column("n_tokens").to_pylist(), batch.column("unforeseen"))
            ]
            yield batch.select(["doc_id", "n_bytes"]).append_column("n_tokens", pa.array(found, pa.int64()))

    named = rows.where(long).withColumn("digest", F.sha2(F.col("body").cast("binary"), 256))
    chunks = (
        named.dropDuplicates(["digest"])
        .select("digest", "body")
        .mapInArrow(cut, CHUNK)
        .repartition("digest", "at")
        .mapInArrow(map_chunks, MAP)
    )
    runs = chunks.groupBy("digest", F.floor(F.col("at") / run).alias("run"))
    composed = (
        runs.applyInArrow(lambda _, group: compose(group), MAP)
        .groupBy("digest")
        .applyInArrow(compose, MAP)
        .select("digest", "map")
        .mapInArrow(total, "digest string, n_tokens long")
    )
    unforeseen = F.when(F.col("n_tokens").isNull(), F.col("body")).alias("unforeseen")
    counted = (
        named.withColumn("n_bytes", n_bytes)
        .join(composed, "digest")
        .select("doc_id", "n_bytes", "n_tokens", unforeseen)
        .mapInArrow(finish, f"doc_id {kind}, n_bytes long, n_tokens long")
    )
    return short.unionByName(counted)
