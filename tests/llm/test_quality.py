from __future__ import annotations

from collections import Counter

from barloom.llm import quality
from tests.llm.helpers import documents, frame, odd_rows, words_of


def measured(text):
    body = text or ""
    words = words_of(body)
    windows = [tuple(words[at : at + 3]) for at in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {at + d for at, w in enumerate(windows) if counts[w] > 1 for d in range(3)}
    lines = [line for line in body.split("\n") if words_of(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in quality.SYMBOLS for c in body),
        len(lines) - len(set(lines)),
        len(covered),
        len(lines),
        sum("A" <= c <= "Z" for c in body),
    )


def check(rows, texts):
    got = sorted(tuple(r[name] for name in quality.MEASURES) for r in rows)
    assert got == sorted(map(measured, texts))


def test_odd_rows(spark):
    rows = odd_rows()
    found = quality.ledger(frame(spark, rows)).collect()
    check(found, [r[1] for r in rows])
    assert quality.ledger(frame(spark, [])).collect() == []


def test_documents(spark):
    docs = documents(spark)
    found = quality.judged(quality.ledger(docs), "2").collect()
    check(found, [r.text for r in docs.collect()])
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_ablation_counts_by_rule(spark):
    rows = quality.ledger(documents(spark))
    masks = [r.failed for r in rows.collect()]
    for r in quality.ablation(rows, "2").collect():
        bit = quality.mask((r.rule,))
        assert r.failing == sum(1 for m in masks if m & bit)
        assert r.only_by_it == sum(1 for m in masks if m == bit)


def test_no_python_in_the_plan(spark):
    plan = quality.ledger(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
