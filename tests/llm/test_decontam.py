from __future__ import annotations

import random

import pytest

from barloom.llm import decontam
from tests.llm.helpers import documents, frame, lower, odd_rows, prose, row


def distance_in(window: bytes, text: bytes) -> int:
    """The fewest edits that make the window a part of the text, over all cells."""
    above = [0] * (len(text) + 1)
    for at, letter in enumerate(window, start=1):
        here = [at]
        for n, other in enumerate(text, start=1):
            here.append(min(above[n - 1] + (letter != other), above[n] + 1, here[-1] + 1))
        above = here
    return min(above)


def windows(text: str) -> list[bytes]:
    data = decontam.normal(text)
    if len(data) < decontam.SHORTEST:
        return []
    last = max(len(data) - decontam.WINDOW, 0)
    starts = sorted({*range(0, last, decontam.STRIDE), last})
    return [data[at : at + decontam.WINDOW] for at in starts]


def brute(text: str, items: list[str]) -> list[int]:
    data = decontam.normal(text)
    return [
        n
        for n, item in enumerate(items)
        if any(distance_in(w, data) <= decontam.edits(w) for w in windows(item))
    ]


def damaged(rng, data: bytes, edits: int) -> bytes:
    letters = bytearray(data)
    for _ in range(edits):
        at = rng.randrange(len(letters))
        kind = rng.randrange(3)
        if kind == 0:
            letters[at] = rng.choice(b"qxyw")
        elif kind == 1:
            del letters[at]
        else:
            letters.insert(at, rng.choice(b"qxyw"))
    return bytes(letters)


@pytest.mark.parametrize("seed", range(3))
def test_same_as_brute_force(seed):
    rng = random.Random(seed)
    items = [prose(rng, n) for n in (6, 9, 20, 60)] + ["short", ""]
    index = decontam.Index.of(items)
    texts = []
    for edits in (0, 2, 4, 5, 6, 7, 9):
        its = rng.choice(windows(rng.choice(items[:4])))
        before, after = prose(rng, rng.randrange(20)), prose(rng, rng.randrange(20))
        texts.append(before + " " + damaged(rng, its, edits).decode() + " " + after)
    texts += ["", prose(rng, 100), items[3][40:300].upper(), items[0]]
    found = index.search([decontam.normal(text) for text in texts])
    assert [sorted(its) for its in found] == [brute(text, items) for text in texts]


def test_quotes_that_begin_at_any_byte():
    """By plain search for every 96 bytes in a row."""
    rng = random.Random(11)
    item = prose(rng, 60)[:240]
    data = decontam.normal(item)
    every = [data[at : at + 96] for at in range(len(data) - 95)]
    index = decontam.Index.of(["a" * 40, item, prose(rng, 40)])
    texts = [b"zz " * 20 + data[at : at + size] + b" yy" * 20 for size in (96, 100, 104) for at in range(len(data) - size)]
    assert all(any(window in text for window in every) for text in texts)
    assert index.search(texts) == [[1]] * len(texts)


def reworded(data: bytes, every: int) -> bytes:
    """With one word of six to twelve bytes replaced in each so many bytes."""
    out, last = [], 20
    for word in data.split(b" "):
        last += len(word) + 1
        if last >= every and 6 <= len(word) <= 12:
            word, last = b"q" * len(word), 0
        out.append(word)
    return b" ".join(out)


def test_partial_and_reworded_passages():
    rng = random.Random(12)
    items = [prose(rng, 60) for _ in range(4)]
    datas = [decontam.normal(item) for item in items]
    index = decontam.Index.of(items)
    for n, data in enumerate(datas):
        before, after = (decontam.normal(prose(rng, 30)) for _ in range(2))
        quotes = [data[at : at + size] for size in (48, 60, 90) for at in range(0, len(data) - size, 5)]
        quotes += [reworded(data, every) for every in (60, 75, 90)]
        assert all(quote not in data for quote in quotes[-3:])
        texts = [before + b" " + quote + b" " + after for quote in quotes]
        assert index.search(texts) == [[n]] * len(texts)
    others = [decontam.normal(prose(rng, 200)) for _ in range(20)]
    assert index.search(others) == [[]] * len(others)


def test_bounded_hits_give_the_same(monkeypatch):
    rng = random.Random(13)
    items = [prose(rng, 50) for _ in range(5)] + ["a" * 400]
    texts = [decontam.normal(prose(rng, 150) + " " + item[30:90] + " " + prose(rng, 150)) for item in items]
    texts += [b"a" * 3000, b""]
    whole = decontam.Index.of(items).search(texts)
    monkeypatch.setattr(decontam, "TOGETHER_HITS", 100)
    assert decontam.Index.of(items).search(texts) == whole == [[0], [1], [2], [3], [4], [5], [5], []]


BENCHMARK = "item_id long, text string, lang string"


def bench(spark, items):
    rows = [(n, text, "x") for n, text in enumerate(items)]
    return spark.createDataFrame([*rows, (None, "no id " * 30, "x"), (77, None, "x")], BENCHMARK)


@pytest.mark.parametrize("block", [decontam.BLOCK, 200])
def test_frames_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK", block)
    rng = random.Random(9)
    items = [prose(rng, 50) for _ in range(5)]
    rows = odd_rows()
    rows += [row(100 + n, prose(rng, 30) + "\n" + text.upper() + "\n" + prose(rng, 30)) for n, text in enumerate(items)]
    rows += [row(200, items[1] + " and " + items[3]), row(None, items[2])]
    found = decontam.contaminated(frame(spark, rows), bench(spark, items)).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: r["items"] for r in found if r.doc_id is not None and r["items"]}
    assert got == {**{100 + n: [n] for n in range(5)}, 200: [1, 3]}
    assert [r["items"] for r in found if r.doc_id is None and r["items"]] == [[2]]


SHORT_ITEMS = ["Capital of  France is\nParis", "42", "Ünïcode", "a.b", "  ", "", "capital of france is paris", "x" * 31, "首都是巴黎"]


def by_words(text: str, item: str) -> bool:
    """By hand: the item stands in the text, and no word goes on at either end."""
    text, item = (" ".join(lower(t).split()) for t in (text, item))
    places = [at for at in range(len(text)) if item and text.startswith(item, at)]

    def joined(at):
        return 0 < at < len(text) and all(c.isalnum() and c < "\u2e80" for c in text[at - 1 : at + 1])

    return any(not joined(at) and not joined(at + len(item)) for at in places)


SHORT_TEXTS = [
    "They say the capital of france is PARIS.",
    "capital of france is parish",
    "the subcapital of france is paris",
    "(42) and 420",
    "420 142",
    "42",
    "an ünïcode text",
    "an ünïcode text, “Ünïcode”—42",
    "an Ünïcoded text; a.b",
    "法国的首都是巴黎。",
    "aa.b a.bb",
    "x" * 31,
    "x" * 32,
    "x" * 30 + " " + "42-42" * 40,
    "",
]


def test_short_items_are_found_as_whole_words():
    short = decontam.Short(decontam.Short.of(SHORT_ITEMS))
    for text in SHORT_TEXTS:
        want = {n for n, item in enumerate(SHORT_ITEMS) if by_words(text, item)}
        assert short.search(decontam.normal(text)) == want, text
    assert short.search(decontam.normal(SHORT_TEXTS[0])) == {0, 6}


@pytest.mark.parametrize("block", [decontam.BLOCK, 40])
def test_short_and_long_items_together(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK", block)
    long = prose(random.Random(3), 30)
    texts = [*SHORT_TEXTS, long, f"42 {long} a.b", None]
    items = [*SHORT_ITEMS, long]
    found = decontam.contaminated(frame(spark, [row(n, text) for n, text in enumerate(texts)]), bench(spark, items))
    assert found.columns[-1] == "items" and found.columns[:-1] == frame(spark, []).columns
    for r in found.collect():
        text = r.text or ""
        want = [n for n, item in enumerate(SHORT_ITEMS) if by_words(text, item)]
        assert r["items"] == want + [len(SHORT_ITEMS)] * (long in text)


def test_a_clash_of_the_new_column_is_refused(spark):
    docs = frame(spark, [row(1, "text")])
    with pytest.raises(ValueError, match="size"):
        decontam.contaminated(docs, bench(spark, []), into="size")
    assert decontam.contaminated(docs, bench(spark, []), into="found").first().size == 7


def test_long_texts_are_searched_in_parts(monkeypatch):
    monkeypatch.setattr(decontam, "TOGETHER", 500)
    rng = random.Random(4)
    item = prose(rng, 40)
    index = decontam.Index.of([item])
    for words in range(0, 200, 7):
        text = prose(rng, words) + " " + item + " " + prose(rng, 200)
        assert any(any(index.search(parts)) for _, parts in decontam.together([text]))


def test_empty_tables(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], BENCHMARK)
    assert decontam.contaminated(docs, none).where("size(items) > 0").count() == 0
    assert decontam.contaminated(docs.limit(0), bench(spark, ["a" * 99])).collect() == []


def test_documents_that_hold_an_item(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    texts = {r.item_id: decontam.normal(r.text) for r in items.collect()}
    exact = {
        r.doc_id: [key for key, text in sorted(texts.items()) if text in decontam.normal(r.text or "")]
        for r in docs.collect()
    }
    for r in decontam.contaminated(docs, items).collect():
        assert set(exact[r.doc_id]) <= set(r["items"])
