from __future__ import annotations

import math
import random
import re
import zlib

from barloom.llm import toxicity
from barloom.llm.units import Memo
from tests.llm.helpers import frame, odd_rows, prose, row

LABELS = "doc_id long, toxic int, quality int"


def corpus(seed, size):
    """Clean prose; every third text has one sentence with a bad word."""
    rng = random.Random(seed)
    texts, labels = [], []
    for n in range(size):
        parts = [prose(rng, rng.randint(3, 9)) for _ in range(rng.randint(1, 30))]
        if n % 3 == 0:
            bad = rng.choice(["fiend", "fiendish", "brute", "knave"])
            parts.insert(rng.randrange(len(parts) + 1), f"you are a {bad} and")
        texts.append(". ".join(parts))
        labels.append(int(n % 3 == 0))
    return texts, labels


def test_finds_documents_and_their_sentences():
    model = toxicity.train(*corpus(1, 400))
    known = Memo(model.of_word)
    texts, labels = corpus(2, 200)
    right = 0
    for text, label in zip(texts, labels):
        score, offending = model.judge(text, known)
        right += (score >= 0.5) == bool(label)
        for number in offending:
            assert "you are a" in toxicity.sentences(text.lower())[number]
        assert bool(offending) <= bool(label)
    assert right >= 196


def plainly(model, text):
    """The leaky noisy-or by its definition."""
    def chance(value):
        return 1 / (1 + math.exp(-value))

    clean = 1 - chance(model.bias)
    for sentence in re.split(r"[.!?\n]", text.lower()):
        weights = [
            [model.weights[name] for name in toxicity.features(word) if name in model.weights]
            for word in set(re.findall("[a-z]+", sentence))
        ]
        if any(weights):
            clean *= 1 - chance(model.bias + sum(map(sum, weights)))
    return 1 - clean


def test_scores_are_the_noisy_or_that_was_fitted():
    texts, labels = corpus(1, 300)
    labels = [1 - label if n % 11 == 0 else label for n, label in enumerate(labels)]  # not separable
    model = toxicity.train(texts, labels)

    def loss(its):
        scores = [min(max(plainly(its, text), 1e-9), 1 - 1e-9) for text in texts]
        return -sum(math.log(s if label else 1 - s) for s, label in zip(scores, labels))

    known = Memo(model.of_word)
    for text in texts:
        assert abs(model.judge(text, known)[0] - plainly(model, text)) < 1e-9
    for step in (-0.7, 0.7):
        assert loss(toxicity.Model(model.bias + step, model.weights)) > loss(model)


def test_a_long_clean_text_stays_clean():
    model = toxicity.train(*corpus(1, 400))
    assert model.judge(prose(random.Random(8), 60_000), Memo(model.of_word))[0] < 0.5


def test_one_label_or_none():
    assert toxicity.train([], []).judge("any", Memo(lambda word: 0.0))[0] < 0.01
    assert toxicity.train(["a", "b"], [0, 0]).judge("a", Memo(lambda word: 0.0))[0] < 0.01
    assert toxicity.train(["a"], [1]).judge("", Memo(lambda word: 0.0))[0] > 0.5
    assert toxicity.train(["", "!"], [0, 1]) is not None


def test_frames(spark):
    texts, labels = corpus(3, 150)
    rows = [row(1000 + n, text) for n, text in enumerate(texts)] + odd_rows()
    known = [(1000 + n, label, 1) for n, label in enumerate(labels)]
    known += [(None, 1, 0), (1001, None, 1), (5, 1, 1), (1000, 1, 0)]
    marks = spark.createDataFrame(known, LABELS)
    found = toxicity.score(frame(spark, rows), marks).collect()
    assert len(found) == len(rows)
    for r in found:
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.held_out == held and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.5)
    by_key = {r.doc_id: r.predicted for r in found}
    right = sum(by_key[1000 + n] == label for n, label in enumerate(labels))
    assert right >= 0.95 * len(labels)
    kept = toxicity.harmless(frame(spark, rows), marks)
    assert kept.columns == frame(spark, rows).columns
    assert kept.count() == sum(r.predicted == 0 for r in found)


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    """Long texts are not learned from, and no more texts than the bytes allow; all are scored."""
    monkeypatch.setattr(toxicity, "LONGEST", 60)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 150)
    rows = frame(spark, [row(n, "w" * (100 if n % 4 == 0 else 40)) for n in range(80)])
    marks = spark.createDataFrame([(n, n % 2, 1) for n in range(80)], LABELS)
    chosen = toxicity.training_rows(rows, marks, "text", "doc_id").collect()
    assert sorted(r.toxic for r in chosen) == [0, 0, 0, 1, 1, 1]
    assert all(len(r.body) == 40 for r in chosen)
    assert toxicity.score(rows, marks).count() == 80


def test_held_out_labels_teach_nothing(spark):
    texts, labels = corpus(4, 60)
    rows = frame(spark, [row(n, text) for n, text in enumerate(texts)])
    marks = [(n, label, 1) for n, label in enumerate(labels)]
    turned = [(n, 1 - t if zlib.crc32(str(n).encode()) % 5 == 0 else t, q) for n, t, q in marks]
    scores = [
        sorted((r.doc_id, r.score) for r in toxicity.score(rows, spark.createDataFrame(m, LABELS)).collect())
        for m in (marks, turned)
    ]
    assert scores[0] == scores[1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert toxicity.score(frame(spark, []), none).collect() == []
    assert {r.predicted for r in toxicity.score(frame(spark, odd_rows()), none).collect()} == {0}


def test_held_out_documents(spark):
    """Held-out accuracy on the labelled documents."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    found = toxicity.score(docs, marks).join(marks, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in found) >= 0.98 * len(found)
