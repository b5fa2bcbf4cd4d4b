from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from barloom.llm import binary, neardup
from barloom.llm.common import BATCH_ROWS, staged
from barloom.llm.components import components
from barloom.sources.shared import exists, new_folder, recorded_folders
from tests.llm.helpers import documents, frame, lower, odd_rows, prose, row, words_of


def shingles(text, width):
    words = words_of(lower(text or ""))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[at : at + width]) for at in range(len(words) - width + 1))


def brute(rows, width, percent):
    """``(shingles, component)`` by comparing every two rows that have a key."""
    sets = [(key, shingles(text, width)) for key, text in rows]
    root = {key: key for key, _ in sets if key is not None}

    def find(key):
        while root[key] != key:
            key = root[key]
        return key

    for at, (a, left) in enumerate(sets):
        for b, right in sets[at + 1 :]:
            if a is None or b is None or not left or not right:
                continue
            both = len(left & right)
            if 100 * both >= percent * (len(left) + len(right) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(
        ((key, len(its), None if key is None else find(key)) for key, its in sets), key=str
    )


def check(spark, rows, width, percent):
    found = neardup.near_duplicates(frame(spark, rows), width, percent).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)
    assert got == brute([(r[0], r[1]) for r in rows], width, percent)
    assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in found)


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_families_chains_and_shared_passages(spark, width, percent):
    rng = random.Random(7)
    rows, passage = [], prose(rng, 120)
    for family in range(4):
        text = prose(rng, rng.choice([8, 60, 300]))
        for _ in range(rng.choice([2, 12, 30])):
            rows.append(edited(rng, text, rng.randrange(0, 5)))
            text = rows[-1] if family % 2 else text
    rows += [passage + " " + prose(rng, rng.choice([10, 60, 100])) for _ in range(40)]
    rows += [rows[0]] * 20 + ["tiny", "tiny text", "TINY text", ""]
    rng.shuffle(rows)
    check(spark, [row(n, text) for n, text in enumerate(rows)], width, percent)


def test_odd_rows(spark):
    check(spark, odd_rows(), 3, 85)
    assert neardup.near_duplicates(frame(spark, [])).collect() == []


def test_documents(spark):
    rows = [row(r.doc_id, r.text) for r in documents(spark, "/root/testdata/sf0.01").collect()]
    check(spark, rows, 5, 80)


def test_sketches_of_similar_sets_share_enough():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        size = int(rng.integers(40, 1500))
        union = rng.choice(2**62, size, replace=False)
        cut = int(0.15 * size)
        split = int(rng.integers(0, cut + 1))
        a, b = np.sort(union[split:]), np.sort(np.concatenate([union[:split], union[cut:]]))
        sent = neardup.SENT
        least = min(neardup.shared_at_least(len(its), 85, sent) for its in (a, b))
        assert neardup.may_be_similar(a[:sent], b[:sent], least)
        shared = len(np.intersect1d(a[: neardup.KEEP], b[: neardup.KEEP]))
        assert shared >= max(neardup.shared_at_least(len(its), 85) for its in (a, b))


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    links = [(n, n + 1) for n in range(100, 160)] + [(5, n) for n in range(200, 260)]
    links += [(300, 301), (301, 302), (302, 300), (7, 7)]
    rng.shuffle(links)
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {n: 100 for n in range(100, 161)} | {n: 5 for n in [5, *range(200, 260)]}
    assert found == want | {300: 300, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sketching_leaves_a_worker_little_to_hold(monkeypatch):
    """What another operator kept in the worker goes, and long batches are sketched in parts."""

    class Rows:
        sparkSession, function = None, None

        def mapInArrow(self, function, schema):
            self.function = function
            return self

    rows = Rows()
    monkeypatch.setattr(neardup, "ship", lambda spark: None)
    monkeypatch.setattr(neardup, "staged", lambda found, *how: found)
    monkeypatch.setattr(neardup, "_named", lambda *named: rows)
    sketch = neardup.sketches(rows, 3, 85, "text", "doc_id").function
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = binary.encoder(path)
    assert binary.encoder(path) is encoder
    texts = [f"{n} " + "some words and more " * 60_000 for n in range(4)]
    columns = [pa.array(range(4), pa.int64()), pa.array(range(4), pa.int64()), pa.array(texts)]
    found = list(sketch(iter([pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "body"])])))
    assert len(found) > 1
    assert [key for batch in found for key in batch.column("doc_id").to_pylist()] == [0, 1, 2, 3]
    assert binary.encoder(path) is not encoder


def test_texts_go_to_python_in_small_batches(spark):
    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    usual = spark.conf.get(BATCH_ROWS)
    rows = spark.range(0, 5_000, 1, 1).mapInArrow(count, "n long")
    assert [r.n for r in staged(rows, "counts", 2_000).collect()] == [2_000, 2_000, 1_000]
    assert spark.conf.get(BATCH_ROWS) == usual


def test_sketch_values_are_shuffled_once(spark):
    rows = [(1, 3, 1, [10, 20, 30]), (2, 2, 1, [20, 40]), (3, 3, 2, [20, 30, 50])]
    classes = spark.createDataFrame(rows, "id long, n long, needed int, sketch array<long>")
    found = neardup.shared_values(classes)
    planned = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in planned and planned.count("Exchange hashpartitioning") == 1
    got = sorted((r.v, r.id, r.n, r.needed, r.m) for r in found.collect())
    assert got == [(20, 1, 3, 1, 3), (20, 2, 2, 1, 3), (20, 3, 3, 2, 3), (30, 1, 3, 1, 2), (30, 3, 3, 2, 2)]


def test_folders_are_recorded_by_lists_that_are_equal(spark):
    outer, inner = [], []
    with recorded_folders(outer):
        with recorded_folders(inner):
            first = new_folder(spark, "first")
        second = new_folder(spark, "second")
    assert (outer, inner) == ([first, second], [first])


def test_scratch_that_nothing_reads_again_is_discarded(spark):
    rng = random.Random(5)
    text = prose(rng, 120)
    rows = [row(n, edited(rng, text, 1)) for n in range(12)] + [row(20, prose(rng, 120)), row(21, text)]
    made = []
    with recorded_folders(made):
        found = neardup.near_duplicates(frame(spark, rows), 3, 85)
    for purpose in ("sketches-", "hopeful-", "candidates-"):
        its = [path for path in made if path.rsplit("/", 1)[1].startswith(purpose)]
        assert its and not any(exists(spark, path) for path in its)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in rows], 3, 85)
