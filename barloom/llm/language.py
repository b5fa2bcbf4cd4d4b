"""Which language a text is in, by interpolated Kneser-Ney models of its letters.

A text is read as a stream of lower-case letters, with one mark for whatever stands between words.
Four letters of 16 bits make one number, so that a gram's beginning and end are shifts and masks of
it. All grams of all learned documents are counted; the lower orders count how many different
letters stand before a gram. What the models say of a gram is kept in sorted arrays of hashes.
The language whose model needs the fewest bits per letter is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import ship, staged

ORDER = 4
LETTER_BITS = 16
#: Grams are told apart by so many bits, so that an array has at most 2**22 entries.
HASH_BITS = 22
#: Letters are read in stretches of so many, however long a text is.
STRETCH = 1 << 18
#: A task sends its counts on, or forgets what it knows of grams, when it holds so many.
HELD = 1 << 21
#: How sharply a difference of bits may tell languages apart; the certainty is set by the best.
SHARPNESSES = tuple(2.0**k for k in range(-1, 6))
#: A loss is summed in whole numbers of this fraction.
LOSS_UNITS = 1 << 20
#: A text that needs more bits per letter than this share of the learned ones is marked as strange.
USUAL = 0.995
#: Bits per letter are told apart to this fraction of a bit.
BINS = 1 << 14
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """The 16-bit number of every code point that is a letter, 0 for the others."""
    table = np.zeros(0x110000, dtype=np.uint64)
    points = np.fromiter((p for p in range(0x110000) if chr(p).isalpha()), dtype=np.uint64)
    folded = (points ^ (points >> np.uint64(LETTER_BITS)) * np.uint64(0x9E37)) & np.uint64(0xFFFF)
    table[points] = np.maximum(folded, 1)
    return table


_table: list[np.ndarray] = []


def grams(text: str) -> Iterator[np.ndarray]:
    """The grams of a text in stretches: each letter, and each end of a word, behind three before.

    A text without letters has none.
    """
    if not _table:
        _table.append(_letters())
    tail = np.zeros(ORDER - 1, dtype=np.uint64)
    for start in range(0, len(text), STRETCH):
        part = text[start : start + STRETCH].lower()
        codes = _table[0][np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        if start + STRETCH >= len(text):
            codes = np.append(codes, np.uint64(0))
        before = np.concatenate([tail[-1:], codes[:-1]])
        codes = codes[(codes != 0) | (before != 0)]
        stream = np.concatenate([tail, codes])
        if len(codes):
            found = stream[ORDER - 1 :].copy()
            for back in range(1, ORDER):
                found |= stream[ORDER - 1 - back : -back] << np.uint64(LETTER_BITS * back)
            yield found
        tail = stream[len(stream) - ORDER + 1 :]


def hashed(codes: np.ndarray, order: int) -> np.ndarray:
    """Numbers of ``HASH_BITS`` bits for grams of an order."""
    mixed = (codes + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - HASH_BITS)).astype(np.uint32)


def learned(key: Column) -> Column:
    """Whether a document may be learned from: it is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 != 0, F.lit(True))


def count_grams(docs: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over ``(lang, body)``: all grams of whole texts."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def settle(lang: str) -> None:
            new, n = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
            sizes[lang] = 0
            if lang in held:
                old, before = held[lang]
                every, place = np.unique(np.concatenate([old, new]), return_inverse=True)
                total = np.zeros(len(every), dtype=np.int64)
                np.add.at(total, place, np.concatenate([before, n]))
                new, n = every, total
            held[lang] = new, n

        def sent(lang: str) -> pa.RecordBatch:
            codes, n = held.pop(lang)
            columns = [pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(n)]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

        for batch in batches:
            for lang, body in zip(batch.column("lang").to_pylist(), batch.column("body").to_pylist()):
                for part in grams(body):
                    waiting.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part)
                    if sizes[lang] >= HELD:
                        settle(lang)
                        if len(held[lang][0]) >= HELD:
                            yield sent(lang)
        for lang in list(waiting):
            settle(lang)
        for lang in list(held):
            yield sent(lang)

    rows = docs.mapInArrow(count, "lang string, gram bigint, n bigint")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> DataFrame:
    """The absolute discount of each language and order from how many grams were counted once, twice."""
    once, twice = (F.count_if(F.col("n") == k).cast("double") for k in (1, 2))
    share = once / (once + 2 * twice)
    return counts.groupBy("lang", "size").agg(
        F.coalesce(F.when(once > 0, share), F.lit(0.5)).alias("discount")
    )


def estimates(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kneser-Ney terms of all orders from the counts of whole grams.

    The first frame has ``(lang, size, gram, term)``: what is left of a gram's count after the
    discount, by its context's sum. The second ``(lang, size, gram, rest)``: the share that a
    context leaves to the next lower order.
    """
    orders = [counts.select("lang", F.lit(ORDER).alias("size"), "gram", "n")]
    for size in range(ORDER - 1, 0, -1):
        mask = (1 << LETTER_BITS * size) - 1
        # Each longer gram is one row, so counting rows counts the letters that stand before.
        orders.append(
            orders[-1]
            .groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram"))
            .agg(F.count("*").alias("n"))
            .select("lang", F.lit(size).alias("size"), "gram", "n")
        )
    every = orders[0]
    for rows in orders[1:]:
        every = every.unionByName(rows)
    every = staged(every, "grams")
    context = F.call_function("shiftrightunsigned", F.col("gram"), F.lit(LETTER_BITS))
    contexts = (
        every.groupBy("lang", "size", context.alias("context"))
        .agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        .join(F.broadcast(_discounts(every)), ["lang", "size"])  # a row per language and order
    )
    terms = (
        every.withColumn("context", context)
        .join(contexts, ["lang", "size", "context"])
        .select("lang", "size", "gram", ((F.col("n") - F.col("discount")) / F.col("total")).alias("term"))
    )
    rests = contexts.select(
        "lang", "size", F.col("context").alias("gram"),
        (F.col("discount") * F.col("kinds") / F.col("total")).alias("rest"),
    )
    return terms, rests


@dataclass
class Models:
    """The models of all languages, in the order of their names.

    ``terms`` and ``rests`` hold, by order and language, a sorted array of hashes and what is said
    of them; ``limits`` are the bits per letter that are still usual, ``sharpness`` turns a
    difference of bits into odds.
    """

    langs: list[str]
    terms: dict[int, list[tuple[np.ndarray, np.ndarray]]]
    rests: dict[int, list[tuple[np.ndarray, np.ndarray]]]
    sharpness: float = 8.0
    limits: tuple[float, ...] = ()

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Bits that each gram's last letter costs, a column per language."""
        found = np.empty((len(codes), len(self.langs)), dtype=np.float64)
        for at in range(len(self.langs)):
            chance = np.full(len(codes), 2.0**-LETTER_BITS)
            for size in range(1, ORDER + 1):
                part = codes & np.uint64((1 << LETTER_BITS * size) - 1)
                term = _looked_up(self.terms[size][at], hashed(part, size), 0.0)
                rest = _looked_up(self.rests[size][at], hashed(part >> np.uint64(LETTER_BITS), size), 1.0)
                chance = term + rest * chance
            found[:, at] = -np.log2(np.minimum(chance, 1.0))
        return found


def _looked_up(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, missing: float) -> np.ndarray:
    hashes, values = table
    if not len(hashes):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return np.where(hashes[at] == wanted, values[at], missing)


class Reader:
    """Bits per letter of texts; what the models say of a gram is remembered."""

    def __init__(self, models: Models) -> None:
        self.models = models
        self.codes = np.empty(0, dtype=np.uint64)
        self.costs = np.empty((0, len(models.langs)))

    def per_letter(self, texts: list[str | None]) -> list[list[float] | None]:
        """Bits per letter of each text in each language, none without a letter."""
        totals = np.zeros((len(texts), len(self.models.langs)))
        sizes = np.zeros(len(texts), dtype=np.int64)
        held: list[np.ndarray] = []
        owners: list[int] = []

        def settle() -> None:
            lengths = [len(codes) for codes in held]
            begins = np.cumsum([0, *lengths[:-1]])
            sums = np.add.reduceat(self._known(np.concatenate(held)), begins, axis=0)
            np.add.at(totals, owners, sums)
            np.add.at(sizes, owners, lengths)
            held.clear()
            owners.clear()

        waiting = 0
        for at, text in enumerate(texts):
            for codes in grams(text or ""):
                held.append(codes)
                owners.append(at)
                waiting += len(codes)
                if waiting >= STRETCH:
                    settle()
                    waiting = 0
        if held:
            settle()
        return [(total / n).tolist() if n else None for total, n in zip(totals, sizes)]

    def _known(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, codes)
        near = np.minimum(at, max(len(self.codes) - 1, 0))
        new = codes if not len(self.codes) else codes[self.codes[near] != codes]
        if not len(new):
            return self.costs[near]
        new = np.unique(new)
        if len(self.codes) + len(new) > HELD:
            self.codes, self.costs, new = self.codes[:0], self.costs[:0], np.unique(codes)
        place = np.searchsorted(self.codes, new)
        self.codes = np.insert(self.codes, place, new)
        self.costs = np.insert(self.costs, place, self.models.bits(new), axis=0)
        return self.costs[np.searchsorted(self.codes, codes)]


def _arrays(rows: DataFrame, value: str, langs: list[str]) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Sorted hash arrays by order and language; grams of one hash keep the greatest value.

    An array has at most ``2 ** HASH_BITS`` entries, whatever was counted.
    """

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("gram").to_numpy().view(np.uint64)
            sizes = batch.column("size").to_numpy()
            hashes = np.zeros(len(codes), dtype=np.int32)
            for size in np.unique(sizes):
                hashes[sizes == size] = hashed(codes[sizes == size], int(size))
            columns = [batch.column("lang"), batch.column("size"), pa.array(hashes), batch.column(value)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "size", "hash", "value"])

    ship(rows.sparkSession)
    table = (
        rows.mapInArrow(folded, "lang string, size int, hash int, value double")
        .groupBy("lang", "size", "hash")
        .agg(F.max("value").cast("float").alias("value"))
        .toArrow()
    )
    places = np.array([langs.index(lang) for lang in table.column("lang").to_pylist()], dtype=np.int64)
    sizes, hashes, values = (table.column(name).to_numpy() for name in ("size", "hash", "value"))
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for size in range(1, ORDER + 1):
        found[size] = []
        for at in range(len(langs)):
            mine = (places == at) & (sizes == size)
            order = np.argsort(hashes[mine])
            found[size].append((hashes[mine][order].astype(np.uint32), values[mine][order]))
    return found


def _learnable() -> Column:
    """Whether a row with a text may be learned from."""
    return learned(F.col("doc_id")) & F.col("lang").isNotNull()


def fit(docs: DataFrame) -> Models:
    """Models of every language of ``(doc_id, lang, body)``, over all rows that may be learned from."""
    known = docs.where(_learnable() & F.col("body").isNotNull())
    counts = staged(count_grams(known.select("lang", "body")), "gram-counts")
    langs = sorted(row.lang for row in counts.select("lang").distinct().collect())
    if not langs:
        return Models([], {}, {})
    terms, rests = estimates(counts)
    return Models(langs, _arrays(terms, "term", langs), _arrays(rests, "rest", langs))


def calibrate(models: Models, costs: DataFrame) -> None:
    """Set the sharpness and the usual bits by ``(lang, costs)`` of all learned texts with letters.

    The sharpness is that of the least loss over all of them. The usual bits of a language are the
    quantile ``USUAL`` of its texts' bits, told apart to a fraction of a bit, so that tasks send
    bounded counts and no text is left out.
    """
    names = F.array(*map(F.lit, models.langs))
    own = F.get("costs", F.array_position(names, F.col("lang")).cast("int") - 1)
    least = F.array_min("costs")

    def loss(sharpness: float) -> Column:
        odds = F.aggregate(
            "costs", F.lit(0.0), lambda total, cost: total + F.exp(F.lit(-sharpness) * (cost - least))
        )
        # Whole numbers, whose sum does not depend on the order in which it is taken.
        return F.sum(F.round((F.lit(sharpness) * (own - least) + F.log(odds)) * LOSS_UNITS).cast("long"))

    losses = costs.agg(*(loss(s).alias(str(at)) for at, s in enumerate(SHARPNESSES))).first()
    if losses[0] is not None:
        models.sharpness = SHARPNESSES[min(range(len(SHARPNESSES)), key=lambda at: losses[at])]
    binned = (F.ceil(own * BINS) / BINS).alias("bits")  # so few values that a map holds their counts
    limits = dict(costs.select("lang", binned).groupBy("lang").agg(F.percentile("bits", F.lit(USUAL))).collect())
    models.limits = tuple(limits.get(lang, float("inf")) for lang in models.langs)


def _read(spark: SparkSession, models: Models):
    ship(spark)
    shared = spark.sparkContext.broadcast(models)

    @F.arrow_udf("array<double>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(shared.value)
        for batch in batches:
            yield pa.array(reader.per_letter(batch.to_pylist()), pa.list_(pa.float64()))

    return read


def identify(
    docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang"
) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, held_out, lang_pred, score, bits, strange)``.

    Models are learned from the rows with a text and a language whose key is not held out. The
    score is the calibrated certainty of the language chosen; ``strange`` marks texts that need
    more bits per letter than nearly all learned ones of that language. Null texts and texts
    without a letter, and all texts if nothing was learned, are ``und`` with score 0. Repeated
    rows stay, null keys are not held out, and other columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("body"))
    models = fit(rows)
    costs = F.lit(None).cast("array<double>")
    if models.langs:
        costs = _read(docs.sparkSession, models)(F.col("body"))
    read = rows.select("doc_id", "lang", costs.alias("costs"))
    if models.langs:
        # Texts are read once: what they cost serves the calibration and the result.
        read = staged(read, "bits")
        # A null text has no costs.
        calibrate(models, read.where(_learnable() & F.col("costs").isNotNull()))
    names = F.array(*map(F.lit, models.langs)) if models.langs else F.array().cast("array<string>")
    limits = F.array(*map(F.lit, models.limits or [float("inf")] * len(models.langs)))
    least = F.array_min("costs")
    place = F.array_position("costs", least).cast("int") - 1
    odds = F.aggregate(
        "costs", F.lit(0.0), lambda total, cost: total + F.exp(F.lit(-models.sharpness) * (cost - least))
    )
    return read.select(
        "doc_id",
        (~learned(F.col("doc_id"))).alias("held_out"),
        F.coalesce(F.get(names, place), F.lit(UNKNOWN)).alias("lang_pred"),
        F.coalesce(F.lit(1.0) / odds, F.lit(0.0)).alias("score"),
        least.alias("bits"),
        F.coalesce(least > F.get(limits.cast("array<double>"), place), F.lit(True)).alias("strange"),
    )
