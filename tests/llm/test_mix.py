from __future__ import annotations

from fractions import Fraction

import pytest

from barloom.llm import mix
from tests.llm.helpers import documents, frame, odd_rows, row, words_of


def water(sizes, weights, budget, most):
    """Reshare the excess by weight until no target is above its limit."""
    targets = {s: Fraction(0) for s in sizes}
    open_ = {s for s in sizes}
    rest = Fraction(budget) * sum(sizes.values())
    while open_ and rest:
        whole = sum(weights[s] for s in open_)
        shares = {s: rest * weights[s] / whole for s in open_}
        full = {s for s in open_ if targets[s] + shares[s] >= most * sizes[s]}
        if not full:
            for s in open_:
                targets[s] += shares[s]
            break
        for s in full:
            rest -= most * sizes[s] - targets[s]
            targets[s] = Fraction(most * sizes[s])
        open_ -= full
    return targets


@pytest.mark.parametrize("sizes", [[10, 1000, 5], [1, 1, 1, 500], [0, 7, 0, 9], [3], [900, 2, 2, 2, 2]])
def test_targets_fill_the_budget(spark, sizes):
    named = {f"s{n}": size for n, size in enumerate(sizes)}
    rows = spark.createDataFrame(list(named.items()), "source string, source_size long")
    weights = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sorted(named))}
    expected = water(named, weights, Fraction(3, 2), 2)
    for r in mix.targets(rows, (5, 2, 1), 1.5, 2).collect():
        assert r.target == pytest.approx(float(expected[r.source]))


def brute_time(share, schedule, steps=200_000):
    whole = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(schedule, schedule[1:]))
    area, at = 0.0, 0.0
    for n in range(steps):
        at = (n + 0.5) / steps
        for (t0, a), (t1, b) in zip(schedule, schedule[1:]):
            if t0 <= at <= t1:
                area += (a + (b - a) * (at - t0) / (t1 - t0)) / steps
                break
        if area >= share * whole:
            return at
    return at


@pytest.mark.parametrize("schedule", mix.SCHEDULES)
def test_due_inverts_the_demand(spark, schedule):
    from pyspark.sql import functions as F

    shares = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    rows = spark.createDataFrame([(s,) for s in shares], "share double")
    got = [r[0] for r in rows.select(mix.due(F.col("share"), schedule)).collect()]
    for share, at in zip(shares, got):
        assert at == pytest.approx(brute_time(share, schedule), abs=1e-3)


def test_odd_rows(spark):
    rows = odd_rows()
    found = mix.mix(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    sizes = sorted(len(words_of(r[1])) for r in rows)
    assert sorted(r["size"] for r in found) == sizes
    for source in ("a", "b", None):
        its = [r for r in found if r.source == source]
        assert sum(r.taken for r in its) == pytest.approx(its[0].target, abs=1)
        assert all(0 <= r.taken <= 2 * r["size"] for r in its)
        assert all((r.position is None) == (r.taken == 0) for r in its)
    assert mix.mix(frame(spark, [])).collect() == []


def test_reruns_agree_and_positions_sort(spark):
    docs = documents(spark)
    first = mix.mix(docs).drop("copies").collect()
    again = mix.mix(docs.repartition(7)).drop("copies").collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    order = mix.training_order(mix.mix(docs)).collect()
    places = [r.position for r in order]
    assert places == sorted(places) and min(places) >= 0 and max(places) <= 1
    assert sum(r.words for r in order) == sum(r.taken for r in first)


def test_whole_copies_keep_their_words(spark):
    rows = [row(n, "w " * (n % 7 + 1), source="ab"[n % 2]) for n in range(200)]
    found = mix.mix(frame(spark, rows), whole=True).collect()
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in found)
    for source in "ab":
        its = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in its) - its[0].target) <= 4
