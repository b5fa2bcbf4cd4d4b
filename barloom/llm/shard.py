"""Sharding: contiguous shards of near equal bytes that never split a group of equal texts.

The groups are put in the order of their text's hash. Binary search finds the smallest capacity
for which a greedy pass fits them into the shards. The pass works on the byte totals of ranges of
the hash; only the ranges that a cut may fall into are read again at a finer grain, so the driver
holds some ten thousand totals whatever the number of groups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barloom.llm.common import staged

LOWEST = -(2**63)
FIRST_SHIFT, STEP = 48, 8


@dataclass(frozen=True)
class Cells:
    """Ranges of the group order: the first hash, its width in bits, bytes and groups of each.

    Groups larger than a shard's even share come first, each as a range of its own.
    """

    first: np.ndarray
    shift: np.ndarray
    size: np.ndarray
    groups: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        """Byte positions of all range borders, from 0 to the total."""
        return np.concatenate([[0], np.cumsum(self.size)])

    def replaced(self, gone: np.ndarray, new: Cells) -> Cells:
        keep = ~gone
        parts = [
            np.concatenate([a[keep], b])
            for a, b in (
                (self.first, new.first),
                (self.shift, new.shift),
                (self.size, new.size),
                (self.groups, new.groups),
            )
        ]
        order = np.lexsort((parts[0], parts[1] >= 0))
        return Cells(*(part[order] for part in parts))


def _cells(rows: list, shift: int) -> Cells:
    first = np.array([(r.cell % 2**64 << shift) + LOWEST for r in rows], dtype=np.int64)
    return Cells(
        first,
        np.full(len(rows), shift, dtype=np.int64),
        np.array([r.size for r in rows], dtype=np.int64),
        np.array([r.groups for r in rows], dtype=np.int64),
    )


def _walk(cells: Cells, ends: np.ndarray, capacity: int, shards: int, hopeful: bool) -> list[int]:
    """Greedy cuts: each as far as the capacity reaches.

    A cut inside a range of several groups falls on its border, or, if ``hopeful``, just where
    the capacity ends; the true cut lies between the two.
    """
    cuts, at, total = [], 0, int(ends[-1])
    for _ in range(shards):
        reach = min(at + capacity, total)
        cell = int(np.searchsorted(ends, reach, side="right")) - 1
        at = int(ends[cell])
        if hopeful and cell < len(cells.size) and cells.groups[cell] > 1:
            at = reach
        cuts.append(at)
    return cuts


def _smallest(cells: Cells, ends: np.ndarray, shards: int, low: int, hopeful: bool) -> int:
    high = int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if _walk(cells, ends, middle, shards, hopeful)[-1] >= ends[-1]:
            high = middle
        else:
            low = middle + 1
    return low


def _even_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Cuts that keep the capacity and leave what remains as even as can be."""
    latest = [len(ends) - 1]  # for each cut, from the last: the earliest border that still fits
    for _ in range(shards - 1):
        latest.append(int(np.searchsorted(ends, ends[latest[-1]] - capacity, side="left")))
    earliest = latest[::-1]
    cuts, at = [], 0
    for shard in range(shards - 1):
        fair = ends[at] + (ends[-1] - ends[at]) / (shards - shard)
        most = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
        near = int(np.searchsorted(ends, fair))
        if near > 0 and (near == len(ends) or fair - ends[near - 1] <= ends[near] - fair):
            near -= 1
        near = max(near, at + 1)  # no empty shard while groups are left
        at = max(earliest[shard], at, min(near, most))
        cuts.append(at)
    return cuts


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, dict[int, int], list[int]]:
    """The smallest capacity, the shard of each large group, and the first hash of each cut.

    ``groups`` has one row ``(grp, size)`` per group.
    """
    totals = groups.agg(F.sum("size").alias("total"), F.max("size").alias("most")).first()
    total, most = totals.total or 0, totals.most or 0
    large = F.col("size") * shards > total
    heavy = groups.where(large).orderBy("grp").collect()  # fewer than ``shards`` rows
    others = groups.where(~large).select(
        (F.col("grp").bitwiseXOR(F.lit(LOWEST))).alias("place"), "size"
    )

    def summed(rows: DataFrame, shift: int) -> Cells:
        cell = F.shiftrightunsigned("place", shift) if shift else F.col("place")
        found = rows.groupBy(cell.alias("cell")).agg(
            F.sum("size").alias("size"), F.count("*").alias("groups")
        )
        return _cells(found.collect(), shift)

    cells = Cells(
        np.array([r.grp for r in heavy], dtype=np.int64),
        np.full(len(heavy), -1, dtype=np.int64),
        np.array([r["size"] for r in heavy], dtype=np.int64),
        np.ones(len(heavy), dtype=np.int64),
    )
    cells = cells.replaced(np.zeros(len(heavy), dtype=bool), summed(others, FIRST_SHIFT))
    least = max(most, -(-total // shards))
    while True:
        ends = cells.ends
        low = _smallest(cells, ends, shards, least, hopeful=True)
        high = _smallest(cells, ends, shards, least, hopeful=False)
        near = _walk(cells, ends, low, shards, hopeful=False)
        far = _walk(cells, ends, high, shards, hopeful=True)
        unclear = np.zeros(len(cells.size), dtype=bool)
        for a, b in zip(near, far):
            unclear |= (ends[:-1] <= b) & (ends[1:] > a)
        unclear &= cells.groups > 1
        if low == high or not unclear.any():
            break
        shift = int(cells.shift[unclear].max())
        unclear &= cells.shift == shift
        keys = [(int(first) - LOWEST) >> shift for first in cells.first[unclear]]
        inside = others.where(F.shiftrightunsigned("place", shift).isin(keys))
        cells = cells.replaced(unclear, summed(inside, shift - STEP))
    cuts = _even_cuts(ends, high, shards)
    of_heavy = {
        int(cells.first[i]): sum(cut <= i for cut in cuts) for i in range(len(heavy))
    }
    behind = [cut for cut in cuts if cut < len(cells.first)]  # the others leave nothing behind
    firsts = [LOWEST if cut < len(heavy) else int(cells.first[cut]) for cut in behind]
    return high, of_heavy, firsts


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 8,
    text: str = "text",
    key: str = "doc_id",
    rows_per_bucket: int = 50_000,
) -> DataFrame:
    """One row per row of ``docs``: the shard and the place in it.

    A row weighs its text's UTF-8 bytes plus 1. Null and empty texts weigh 1 and count as equal.
    Rows of equal texts share a shard, whatever their number; the largest shard is as small as
    contiguous cuts allow. Slots count from 0 without gaps and follow a hash of the key. Repeated
    rows get slots of their own, a null key is a key like others, an empty table gives no row,
    and other columns of ``docs`` are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = staged(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("grp"),
        ),
        "shard-rows",
    )
    groups = staged(rows.groupBy("grp").agg(F.sum("size").alias("size")), "shard-groups")
    capacity, of_heavy, firsts = minimax_cuts(groups, shards)

    shard: Column = sum(
        (F.when(F.col("grp") >= F.lit(first), 1).otherwise(0) for first in firsts),
        F.lit(0),
    )
    for grp, its in of_heavy.items():
        shard = F.when(F.col("grp") == F.lit(grp), its).otherwise(shard)
    buckets = rows.count() // rows_per_bucket + 1
    placed = rows.withColumns(
        {
            "shard": shard.cast("int"),
            "bucket": F.pmod(F.xxhash64("doc_id", "grp"), F.lit(buckets)),
        }
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket")
    starts = counts.select(
        "shard", "bucket", (F.sum("n").over(before) - F.col("n")).alias("start")
    )
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "grp")
    return placed.join(starts, ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.row_number().over(within) - 1).cast(T.LongType()).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.lit(capacity).cast("long").alias("capacity"),
    )
