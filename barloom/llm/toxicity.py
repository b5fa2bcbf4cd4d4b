"""Toxicity by multiple-instance learning: documents have labels, sentences get the scores.

A sentence's score is the logistic of the summed weights of its different words; a document is toxic unless
all its sentences are harmless (noisy-or). Training raises, in toxic documents, the sentences that
explain the label and lowers every sentence of the others. A word's weight is the sum over itself
and its beginnings, so that a compound of a known stem is recognised. The noisy-or has a leak:
sentences without a weighted word say nothing by themselves, and the bias alone stands once for
whatever they hide, in the last fit as in the score, so that they do not add up in a long text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, expm1, fsum, log1p

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import release, ship
from barloom.llm.units import Memo

#: At most so many labelled documents of either label are used for training.
SAMPLE = 3_000
#: Longer texts, in bytes, are not used for training; they are scored like all others.
LONGEST = 1 << 20
#: At most so many bytes of texts of either label are used for training.
SAMPLE_BYTES = 1 << 26
BEGINNINGS = (3, 4, 5, 6)

sentences = re.compile(r"[^.!?\n]+").findall
words = re.compile(r"[^\W\d_]+").findall


def features(word: str) -> list[str]:
    """The word and its beginnings; a mark keeps the two apart."""
    return [word, *(f"^{word[:n]}" for n in BEGINNINGS if n < len(word))]


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    def of_word(self, word: str) -> float | None:
        """A word's weight, none if none of its features has one."""
        found = [self.weights[name] for name in features(word) if name in self.weights]
        return fsum(found) if found else None

    def judge(self, text: str, known: Memo) -> tuple[float, list[int]]:
        """A text's score and the numbers of its sentences that are toxic by themselves.

        A text is harmless if its leak and each sentence with a weighted word are.
        """
        harmless, offending = -_softplus(self.bias), []
        for number, sentence in enumerate(sentences(text.lower())):
            found = [w for w in map(known.__getitem__, set(words(sentence))) if w is not None]
            if found:
                value = self.bias + fsum(found)
                harmless -= _softplus(value)
                if value >= 0:
                    offending.append(number)
        return -expm1(harmless), offending


def _softplus(value: float) -> float:
    return value if value > 40 else log1p(exp(value))


def _logistic(value: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(value, -40, 40)))


def train(
    texts: list[str],
    labels: list[int],
    rounds: int = 120,
    polish: int = 80,
    rate: float = 0.1,
    penalty: float = 4e-4,
    least: int = 5,
) -> Model:
    """Fit the weights by full-gradient steps on the mean log loss of the documents.

    ``penalty`` shrinks weights towards 0, so that words that merely happen to stand in toxic
    documents end at 0. Meanwhile all sentences count, as any word might get a weight. ``polish``
    more rounds then fit the weights that are left without a penalty, in the noisy-or that scores:
    sentences with a weighted word, and the leak. Features found in fewer than ``least`` documents
    get no weight. Without documents of both labels the model is a constant that says what the
    labels say.
    """
    truth = np.array(labels, dtype=np.float64)
    if not len(truth) or truth.min() == truth.max():
        return Model(4.0 if len(truth) and truth[0] else -12.0, {})

    number: dict[str, int] = {}
    of_word: list[int] = []
    sentence_sizes: list[int] = []
    doc_sizes: list[int] = []
    seen: Counter[str] = Counter()
    for text in texts:
        count, found = 0, set()
        for sentence in sentences(text.lower()):
            its = sorted(set(words(sentence)))
            if its:
                count += 1
                sentence_sizes.append(len(its))
                of_word.extend(number.setdefault(word, len(number)) for word in its)
                found.update(its)
        doc_sizes.append(count)
        seen.update({name for word in found for name in features(word)})
    names = [name for name, n in seen.items() if n >= least]
    place = {name: at for at, name in enumerate(names)}
    width = len(BEGINNINGS) + 1
    matrix = np.full((len(number), width), len(names), dtype=np.int32)  # the last has weight 0
    for word, row in number.items():
        for at, name in enumerate(features(word)):
            matrix[row, at] = place.get(name, len(names))

    full = np.array(doc_sizes) > 0
    truth, docs = truth[full], np.array([n for n in doc_sizes if n], dtype=np.int64)
    sizes = np.array(sentence_sizes, dtype=np.int64)
    tokens = np.array(of_word, dtype=np.int32)
    sentence_at = np.cumsum(sizes) - sizes
    doc_at = np.cumsum(docs) - docs
    weights, bias = np.zeros(len(names) + 1), -5.0
    fast, fast_bias = np.zeros_like(weights), 0.0
    mean, mean_bias = np.zeros_like(weights), 0.0
    speaks, leak = np.ones(len(sizes)), 0.0
    for step in range(1, rounds + polish + 1):
        if step == rounds + 1:
            chosen = weights != 0
            weighted = chosen[matrix].any(axis=1)
            speaks, leak = np.logical_or.reduceat(weighted[tokens], sentence_at).astype(np.float64), 1.0
        word_weight = weights[matrix].sum(axis=1)
        scores = bias + np.add.reduceat(word_weight[tokens], sentence_at)
        chance = _logistic(scores)
        # The log of none being toxic.
        harmless = np.add.reduceat(-np.logaddexp(0, scores) * speaks, doc_at) - leak * np.logaddexp(0, bias)
        toxic = -np.expm1(harmless)
        # d loss / d score: the chance itself, minus chance / toxic where the label is 1.
        pull = 1.0 - truth / np.maximum(toxic, 1e-12)
        slope = speaks * chance * np.repeat(pull, docs) / len(docs)
        by_word = np.bincount(tokens, np.repeat(slope, sizes), minlength=len(number))
        grad = np.bincount(
            matrix.ravel(), np.repeat(by_word, width), minlength=len(weights)
        )
        grad[-1] = 0.0
        grad_bias = slope.sum() + leak * _logistic(bias) * pull.sum() / max(len(docs), 1)
        mean = 0.9 * mean + 0.1 * grad
        fast = 0.99 * fast + 0.01 * grad * grad
        mean_bias = 0.9 * mean_bias + 0.1 * grad_bias
        fast_bias = 0.99 * fast_bias + 0.01 * grad_bias * grad_bias
        a, b = 1 - 0.9**step, 1 - 0.99**step
        scale = rate / (np.sqrt(fast / b) + 1e-6)
        weights -= scale * mean / a
        if step > rounds:
            weights *= chosen
        else:
            weights = np.sign(weights) * np.maximum(np.abs(weights) - scale * penalty, 0.0)
        bias -= rate * (mean_bias / a) / (np.sqrt(fast_bias / b) + 1e-6)
    return Model(float(bias), {names[at]: float(weights[at]) for at in np.flatnonzero(chosen[:-1])})


def training_rows(docs: DataFrame, labels: DataFrame, text: str, key: str) -> DataFrame:
    """A bounded sample of labelled documents of either label: the first by a hash of their key.

    At most ``SAMPLE`` of them, none longer than ``LONGEST`` and together at most ``SAMPLE_BYTES``,
    whole texts always. Held-out keys are left out. A key with several labels counts as toxic if one
    of them says so, one with several texts has the smallest of them and the size of the longest.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
        .where(~held_out(F.col("doc_id")))
    )
    texts = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    sizes = texts.groupBy("doc_id").agg(F.max(F.octet_length("body").cast("long")).alias("n_bytes"))
    there = known.join(sizes.where(F.col("n_bytes") <= LONGEST), "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    either = [there.where(F.col("toxic") == label).orderBy(*order).limit(SAMPLE) for label in (0, 1)]
    first = either[0].unionByName(either[1])  # at most 2 * SAMPLE rows, so a window may take them
    upto = F.sum("n_bytes").over(Window.partitionBy("toxic").orderBy(*order))
    chosen = first.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("doc_id", "toxic")
    return (
        texts.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("body").alias("body"))
    )


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    rows = training_rows(docs, labels, text, key).collect()
    rows.sort(key=lambda row: row.doc_id)
    return train([row.body for row in rows], [row.toxic for row in rows])


def judged(spark: SparkSession, model: Model, text: Column) -> Column:
    """``(score, offending)`` of a text; null counts as empty."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, offending array<int>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        its = shared.value
        known = Memo(its.of_word)
        for batch in batches:
            found = [its.judge(body or "", known) for body in batch]
            yield pd.DataFrame(found, columns=["score", "offending"])

    return judge(F.coalesce(text, F.lit("")))


def score(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """One row per row of ``docs``: the score, and the numbers of the offending sentences.

    Null and empty texts get the score of a text without any known word. Repeated rows stay, the
    key may be null (then it is not held out), labels of unknown documents are not used, and
    other columns are not read.
    """
    model = fit(docs, labels, text, key)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("body"))
    verdict = rows.select(
        "doc_id", judged(docs.sparkSession, model, F.col("body")).alias("verdict")
    )
    return verdict.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("verdict.score").alias("score"),
        (F.col("verdict.score") >= 0.5).cast("int").alias("predicted"),
        F.col("verdict.offending").alias("offending"),
    )


def harmless(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """The rows of ``docs`` that score below one half, with all their columns."""
    model = fit(docs, labels, text, key)
    return docs.where(judged(docs.sparkSession, model, F.col(text))["score"] < 0.5)
