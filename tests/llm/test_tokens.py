from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barloom.llm import binary, tokens
from barloom.llm.bpe import TokenCounter, packed, unpacked
from barloom.llm.units import units
from tests.llm.helpers import documents, frame, odd_rows, odd_texts, prose, row

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)

HARD = [
    "'''s it's 'reading I'LL don'T",
    "  <|endoftext|> a<|endoftext|><|endoftext|>  b <|endoftext",
    "\xa0  foo \x1c \x85bar   　 x",
    "a" * 5000,
    "=" * 777 + "-" * 333,
    "1234567890" * 50,
    "\r\n\r\n\t x \n\n\n",
    "日本語テキスト😀😀 ẞ",
    "  ",
]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(PATH)


@pytest.mark.parametrize("text", [*HARD, *odd_texts()[1:]])
def test_transducer_counts_like_the_library(counter, text):
    assert counter.count(text) == len(ids(text))
    assert "".join(units(text)) == text


#: Long runs of one kind, which are cut within a piece, and special strings among them.
RUNS = [
    "x" * 400,
    "ab" * 300 + "'" * 90 + "ll" + "7" * 200,
    "=" * 300 + "<|endoftext|>" + "|" * 50 + "<|endoftext|>" * 9 + "<" * 40,
    " " * 100 + "<|endoftext|>" + " " * 100 + "y" + "\n" * 90 + "'re" + "\t" * 80,
    "語" * 200 + "、" + "日本語テキスト" * 60,
    "\xa0" * 60 + " " * 60 + "\x85" * 9 + "q",
]


@pytest.mark.parametrize("size", [1, 5, 64])
def test_chunk_maps_compose(counter, size):
    for text in [*HARD, *RUNS, prose(random.Random(3), 300)]:
        chunks = list(counter.cut(text, size))
        assert "".join(chunk.body for chunk in chunks) == text
        maps = [unpacked(packed(counter.chunk_map(chunk))) for chunk in chunks]
        assert counter.total(counter.scan(maps)) == len(ids(text))
        left = maps[0]
        for chunk in maps[1:]:
            left = counter.compose(left, chunk)
        assert counter.total(left) == len(ids(text))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abst'é語7 \n\xa0=<|>", max_size=80), st.integers(1, 12), st.integers(1, 30))
def test_chunk_maps_of_any_text(counter, text, size, times):
    text = text + text[:1] * times + "<|endoftext|>" + text[-1:] * times
    maps = [counter.chunk_map(chunk) for chunk in counter.cut(text, size)]
    assert counter.total(counter.scan(maps)) == len(ids(text))


def test_long_runs_are_cut(counter):
    for text in ["x" * 5000, "語" * 5000, "=" * 5000, " " * 5000, "aGVsbG8" * 700]:
        assert max(len(chunk.body) for chunk in counter.cut(text, 500)) <= 1000


def test_unforeseen_states_give_no_total(monkeypatch):
    monkeypatch.setattr(TokenCounter, "states_behind", lambda self, before: set())
    chunks = list(TokenCounter(PATH).cut("x" * 400, 50))
    lost = TokenCounter(PATH)
    assert lost.total(lost.scan([lost.chunk_map(chunk) for chunk in chunks])) is None


def test_small_memory_counts_the_same():
    small = TokenCounter(PATH)
    small.machine.limit, small.known.limit, small.machine.known.limit = 50, 5, 5
    for text in HARD:
        assert small.count(text) == len(ids(text))


@pytest.mark.parametrize("chunk", [1 << 15, 50])
def test_counts(spark, chunk):
    rows = odd_rows() + [row(99, text) for text in HARD + RUNS]
    found = tokens.count_tokens(frame(spark, rows), PATH, chunk_chars=chunk, run=4).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in found)
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(ids(r[1]))) for r in rows)
    assert got == want
    assert tokens.count_tokens(frame(spark, []), PATH).collect() == []


def test_counts_of_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    found = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, PATH).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert found == {key: len(ids(text)) for key, text in texts.items()}


def sums(rows):
    """What the files must hold, from the library alone."""
    coded = sorted(((key is not None, key or 0, key, ids(text) + [binary.END]) for key, text in rows), key=lambda r: r[:2])
    start, result = 0, []
    for _, _, key, its in coded:
        data = np.array(its, dtype="<u4").tobytes()
        result.append((key, start, len(its), zlib.crc32(data)))
        start += len(its)
    return result


def test_files_of_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    found = binary.round_trip(spark, docs, PATH).collect()
    want = sums([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, found)) == want


def test_files_of_odd_rows(spark):
    rows = odd_rows() + [row(200 + n, text) for n, text in enumerate(HARD)]
    found = binary.round_trip(spark, frame(spark, rows), PATH).orderBy("start").collect()
    want = sums([(r[0], r[1]) for r in rows])
    keys = [r.doc_id for r in found]
    assert keys == [w[0] for w in want]
    starts = [r.start for r in found]
    assert starts == list(np.cumsum([0, *(r.n_tokens for r in found)])[:-1])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sorted(
        (str(w[0]), w[2], w[3]) for w in want
    )
    assert binary.round_trip(spark, frame(spark, []), PATH).collect() == []


def test_plain_words_go_to_the_model_once(monkeypatch):
    """Words of Latin letters are not sent through the pre-tokenizer, nor twice to the model."""
    encoder, sent, modelled = binary.Encoder(PATH), [], []
    plain, model = encoder._ids, encoder.tokenize
    monkeypatch.setattr(encoder, "_ids", lambda texts: sent.extend(texts) or plain(texts))
    monkeypatch.setattr(encoder, "tokenize", lambda word: modelled.append(word) or model(word))
    texts = ["Größe straße Größe", "a größe straße ñandú"] * 3
    assert encoder.encode(texts) == [np.array(ids(text), "<u2").tobytes() for text in texts]
    assert not any(any(map(str.isalpha, text)) for text in sent)
    assert len(modelled) == len(set(modelled)) == 6


def test_marks_behind_words_make_no_new_words(monkeypatch):
    """A word is one word to the encoder whatever sign of ASCII stands behind it."""
    encoder, modelled = binary.Encoder(PATH), []
    model = encoder.tokenize
    monkeypatch.setattr(encoder, "tokenize", lambda word: modelled.append(word) or model(word))
    texts = ["", "so beta, beta. beta\nbeta\nso beta's (beta)beta7", "beta.<|endoftext|>beta,so", "é, beta! b\x00eta"]
    assert encoder.encode(texts[:2]) == [np.array(ids(text), "<u2").tobytes() for text in texts[:2]]
    assert sorted(modelled) == sorted(["so", "\u0120beta", "beta"])
    assert encoder.encode(texts) == [np.array(ids(text), "<u2").tobytes() for text in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abÉ'語7 \n\t\0\xa0=<.", max_size=30), max_size=6))
def test_encoder_gives_the_library_ids(texts):
    found = binary.encoder(PATH).encode(texts)
    assert found == [np.array(ids(text), "<u2").tobytes() for text in texts]
