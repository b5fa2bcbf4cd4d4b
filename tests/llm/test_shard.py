from __future__ import annotations

import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from barloom.llm import shard
from tests.llm.helpers import documents, frame, odd_rows, row


def brute_capacity(sizes, shards):
    """The smallest largest part of all contiguous cuts."""
    edges = range(len(sizes) + 1)
    best = None
    for cuts in combinations(edges, min(shards - 1, len(sizes))):
        parts = [sum(sizes[a:b]) for a, b in zip((0, *cuts), (*cuts, len(sizes)))]
        best = max(parts) if best is None else min(best, max(parts))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_capacity_is_the_smallest(spark, seed):
    rng = random.Random(seed)
    shards = rng.randint(2, 4)
    groups = [(rng.randint(-(2**63), 2**63 - 1), rng.choice([1, 5, 9, 40])) for _ in range(9)]
    groups += [(groups[0][0] + n + 1, rng.randint(1, 9)) for n in range(3)]  # share their cell
    total = sum(size for _, size in groups)
    heavy = sorted(g for g in groups if g[1] * shards > total)
    light = sorted(g for g in groups if g[1] * shards <= total)
    capacity, of_heavy, firsts = shard.minimax_cuts(
        spark.createDataFrame(groups, "grp long, size long"), shards
    )
    assert capacity == brute_capacity([size for _, size in heavy + light], shards)
    filled = np.zeros(shards, dtype=int)
    for grp, size in groups:
        filled[of_heavy.get(grp, sum(grp >= first for first in firsts))] += size
    assert filled.max() <= capacity


def check(rows, shards):
    slots = {n: sorted(r.slot for r in rows if r.shard == n) for n in range(shards)}
    assert all(found == list(range(len(found))) for found in slots.values())
    homes = {}
    for r in rows:
        assert homes.setdefault(r.text_crc32, r.shard) == r.shard


def test_odd_rows(spark):
    rows = odd_rows()
    found = shard.shard_by_bytes(frame(spark, rows), shards=3).collect()
    assert len(found) == len(rows)
    check(found, 3)
    sizes = sorted(len((r[1] or "").encode()) + 1 for r in rows)
    assert sorted(r["size"] for r in found) == sizes
    assert {r.text_crc32 for r in found} == {zlib.crc32((r[1] or "").encode()) for r in rows}
    assert max(sum(r["size"] for r in found if r.shard == n) for n in range(3)) <= found[0].capacity


def test_a_third_in_one_group_leaves_the_others_even(spark):
    rng = random.Random(1)
    rows = [row(n, f"{rng.random():.12f}" * 5) for n in range(600)]
    rows += [row(1000 + n, "the same text over and over again" * 2) for n in range(280)]
    found = shard.shard_by_bytes(frame(spark, rows), shards=8, rows_per_bucket=50).collect()
    check(found, 8)
    sizes = [sum(r["size"] for r in found if r.shard == n) for n in range(8)]
    heavy = sizes.index(max(sizes))
    others = [size for n, size in enumerate(sizes) if n != heavy]
    assert min(others) > 0.95 * max(others)


def test_reruns_agree_and_sizes_are_near(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    first = shard.shard_by_bytes(docs).collect()
    again = shard.shard_by_bytes(docs.repartition(5)).collect()
    assert sorted(map(tuple, first)) [:5] == sorted(map(tuple, again))[:5]
    assert {(r.doc_id, r.shard, r.slot) for r in first} == {(r.doc_id, r.shard, r.slot) for r in again}
    sizes = [sum(r["size"] for r in first if r.shard == n) for n in range(8)]
    assert min(sizes) > 0.9 * max(sizes)


def test_empty(spark):
    found = shard.shard_by_bytes(frame(spark, []))
    assert found.collect() == []
