from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from barloom.llm import phrases
from tests.llm.helpers import documents, frame, lower, odd_rows, row


def brute(rows, longest, least, percent, top):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            its = counts.setdefault(lang or "und", Counter())
            sizes[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                its.update(tuple(words[at : at + n]) for at in range(len(words) - n + 1))
    result = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            longer = [
                b for q, b in candidates.items()
                if len(q) > len(p) and any(q[at : at + len(p)] == p for at in range(len(q)))
            ]
            if any(100 * b >= percent * a for b in longer):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(result)


def check(spark, rows, longest=3, least=10, percent=50, top=2_000):
    found = phrases.collocations(frame(spark, rows), longest, least, percent, top).collect()
    assert sorted(map(tuple, found)) == brute([(r[2], r[1]) for r in rows], longest, least, percent, top)


def spoken(rng, words, vocabulary, lang):
    text = "".join(rng.choice(vocabulary) + rng.choice((" ", " ", " ", "\t ", ", ", "\n")) for _ in range(words))
    return (rng.randint(0, 50), text, lang, "a", 3, *row(0, "")[5:])


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_random_words(spark, longest):
    rng = random.Random(longest)
    vocabulary = ["A", "a", "bé", "CÉ", "dd", "日本", "x\xa0y", "it's", "the"]
    rows = [spoken(rng, 300, vocabulary, lang) for lang in ("en", "en", None, "und", "日")]
    check(spark, rows, longest, least=3)
    check(spark, rows, longest, least=5, percent=80, top=7)


def test_odd_rows(spark):
    check(spark, odd_rows(), least=2)
    check(spark, [], least=2)
    check(spark, [row(1, None), row(2, "")], least=1)
    check(spark, [row(1, "again and again " * 300)] * 2)


def test_documents(spark):
    rows = [(r.doc_id, r.text, r.lang, *row(0, "")[3:]) for r in documents(spark).collect()[:60]]
    check(spark, rows, least=4)


def test_one_prefix_before_a_third_of_all_words(spark):
    rng = random.Random(9)
    words = [f"w{n}" for n in range(400)]
    rows = [spoken(rng, 600, ["hot"] * 200 + words, "en") for _ in range(12)]
    check(spark, rows, least=3)
