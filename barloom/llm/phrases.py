"""Phrases whose words keep company: contiguous words found together more often than apart.

Counts are kept as stripes: every prefix of no, one, two, ... words has an associative counter of
the words that follow it. Tasks fill stripes from whole texts, equal prefixes are merged
elementwise, and one merged structure answers everything asked of it: an entry is the count of the
extended phrase, and that is the total of the prefix it makes; the greatest entry of a stripe is
what covers its prefix from the right, and turned around the same entries cover it from the left.

Nearly all phrases are rare, and no stripe needs them. So phrases are counted first by a hash, in
a table of bounded size: what falls into a slot that was met too rarely is rare itself. Tasks ask
the table before they fill a stripe; it may say yes wrongly but never no, and the stripes' own
counts are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import ship, staged

#: Letters A-Z become small, what ends a piece becomes a byte that no text holds, a tab a space.
_UPPER = bytes(range(65, 91))
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
END = b"\xff"
FOLD = bytes.maketrans(_UPPER + _ENDS + b"\t", _UPPER.lower() + END * len(_ENDS) + b" ")

#: The hash table has a slot for every four bytes of text, between these powers of two: its bits
#: take 128 MB at most, and are sent to every task.
LEAST_BITS, MOST_BITS = 16, 30
BLOCK_BITS = 16
#: A stripe is merged in so many parts, by its next word, so that no task has all of a hot prefix.
PARTS = 16
#: Stripes travel in bundles, one for so many bytes of text, and at most so many.
BUNDLE, MOST_BUNDLES = 1 << 21, 1 << 20
#: Words a task gathers before it counts them, and bytes of a text it cuts into words at once.
HELD, SLICE = 1 << 21, 1 << 20
#: The first phrases of a language are chosen in so many shares, then in fewer.
SHARES = (64, 8)

STRIPES = "lang string, size int, prefix string, stripe map<string, bigint>"


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, ``END`` between its pieces and behind the last."""
    text = text.translate(FOLD)
    start = 0
    while start < len(text):
        end = text.find(END, start + SLICE)
        end = len(text) if end < 0 else end
        yield text[start:end].replace(END, b" \xff ").split() + [END]
        start = end + 1


class Vocabulary(dict):
    """Numbers of the words a task has met, and their hashes; 0 stands for the end of a piece."""

    def __init__(self) -> None:
        super().__init__({END: 0})
        self.hashes = [0]

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return number

    def texts(self) -> pa.Array:
        """The words by number, as text; that of 0 is empty."""
        return pa.array([b"", *list(self)[1:]], pa.binary()).cast(pa.string())


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def phrase_slots(
    words: np.ndarray, hashes: np.ndarray, lang: str, longest: int, bits: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For phrases of 1, 2, ... words at every place: their slots, and whether they lie in a piece."""
    its, inside = hashes[words], words != 0
    value = _mixed(its ^ np.uint64(xxhash.xxh64_intdigest(lang)))
    whole = inside
    for size in range(1, longest + 1):
        if size > 1:
            value = _mixed(value[:-1] + its[size - 1 :])
            whole = whole[:-1] & inside[size - 1 :]
        yield value >> np.uint64(64 - bits), whole


class Gathered:
    """Words of texts by language, as numbers, until there are enough to count them."""

    def __init__(self) -> None:
        self.vocabulary = Vocabulary()
        self.held: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str, text: bytes) -> Iterator[None]:
        """Take a text; yields whenever the words should be counted and dropped."""
        for words in slices(text):
            numbers = np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words))
            self.held.setdefault(lang, []).append(numbers)
            self.size += len(words)
            if self.size >= HELD:
                yield

    def taken(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        hashes = np.array(self.vocabulary.hashes, dtype=np.uint64)
        for lang, parts in self.held.items():
            yield lang, np.concatenate(parts), hashes
        self.held, self.size = {}, 0
        if len(self.vocabulary) >= HELD // 4:
            self.vocabulary = Vocabulary()


def _gather(batches: Iterator[pa.RecordBatch], count) -> Iterator[pa.RecordBatch]:
    """What ``count`` makes of all words of the texts, some of them at a time."""
    gathered = Gathered()
    for batch in batches:
        for lang, body in zip(batch.column("lang").to_pylist(), batch.column("body")):
            for _ in gathered.add(lang, body.as_py()):
                yield from count(gathered)
    if gathered.held:
        yield from count(gathered)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return chain.from_iterable(zip(*(c.to_pylist() for c in batch.columns)) for batch in batches)


def frequent_slots(texts: DataFrame, longest: int, least: int, bits: int) -> bytes:
    """A bit for every slot whose phrases were met ``least`` times together.

    Tasks send the slots they met by blocks, as packed steps and small counts; a block is added up
    by one task, and its bits are gathered: at most ``2 ** MOST_BITS``.
    """
    ship(texts.sparkSession)
    kind = np.dtype("u1" if least < 256 else "<u4")

    def count(gathered: Gathered) -> Iterator[pa.RecordBatch]:
        met = [
            slots[whole].astype(np.uint32)
            for lang, words, hashes in gathered.taken()
            for slots, whole in phrase_slots(words, hashes, lang, longest, bits)
        ]
        slots, n = np.unique(np.concatenate(met), return_counts=True)
        if not len(slots):
            return
        blocks = slots >> np.uint32(BLOCK_BITS)
        starts = np.flatnonzero(np.diff(blocks, prepend=np.int64(-1)))
        ends = np.append(starts[1:], len(slots))
        steps = np.diff(slots, prepend=np.uint32(0))
        steps[starts] = slots[starts]
        bytes_of = steps.astype("<u2").view("u1")
        counts = np.minimum(n, np.iinfo(kind).max).astype(kind)
        packed = [
            pa.compress(
                bytes_of[2 * a : 2 * b : 2].tobytes() + bytes_of[2 * a + 1 : 2 * b : 2].tobytes() + counts[a:b].tobytes(),
                "zstd", asbytes=True,
            )
            for a, b in zip(starts.tolist(), ends.tolist())
        ]
        columns = [pa.array(blocks[starts].astype(np.int64)), pa.array(ends - starts), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "n", "packed"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, same in groupby(_rows(batches), itemgetter(0)):
            total = np.zeros(1 << BLOCK_BITS, dtype=np.int64)
            for _, n, packed in same:
                data = pa.decompress(packed, n * (2 + kind.itemsize), "zstd", asbytes=True)
                low, high = (np.frombuffer(data, "u1", n, at).astype(np.int64) for at in (0, n))
                total[np.cumsum(low + (high << 8))] += np.frombuffer(data, kind, n, 2 * n)
            found = np.packbits(total >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([found])], names=["block", "bits"])

    met = texts.mapInArrow(lambda batches: _gather(batches, count), "block bigint, n bigint, packed binary")
    dealt = met.repartition("block").sortWithinPartitions("block")
    gathered = dealt.mapInArrow(added, "block bigint, bits binary").toArrow()
    step = 1 << BLOCK_BITS - 3
    table = bytearray(1 << bits - 3)
    for block, found in zip(*(gathered.column(name).to_pylist() for name in ("block", "bits"))):
        table[block * step : (block + 1) * step] = found
    return bytes(table)


def _numbered(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """One number for each row of some columns of numbers, in the order of the columns."""
    code, used = columns[0], bits
    for column in columns[1:]:
        if used + bits > 63:
            known, code = np.unique(code, return_inverse=True)
            used = len(known).bit_length()
        code, used = code << bits | column, used + bits
    return code


def _counted(
    prefix: list[np.ndarray], word: np.ndarray, hashes: np.ndarray, texts: pa.Array
) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Prefixes with the words behind them: each phrase once with a line break, its count and place.

    The place, a number of 64 bits, is that of the prefix and the part of its stripe.
    """
    bits = len(hashes).bit_length()
    code, first, n = np.unique(_numbered([*prefix, word], bits), return_index=True, return_counts=True)
    columns = [column[first] for column in (*prefix, word)]
    place = hashes[columns[-1]] % np.uint64(PARTS)
    for column in columns[:-1]:
        place = _mixed(place + hashes[column])
    names = [texts.take(pa.array(column)) for column in columns]
    joined = pc.binary_join_element_wise(*names, " ") if len(names) > 1 else names[0]
    return pc.binary_join_element_wise(joined, "", "\n"), n, _mixed(place)


def _bundles(
    lang: str, counted: list[tuple[pa.Array, np.ndarray, np.ndarray]], bundle_bits: int
) -> Iterator[pa.RecordBatch]:
    """Counted phrases by bundle; those of one stripe stand together."""
    phrases = pa.concat_arrays([phrase for phrase, _, _ in counted])
    n = np.concatenate([n for _, n, _ in counted])
    place = np.concatenate([place for _, _, place in counted])
    order = np.argsort(place, kind="stable")
    bundle = (place[order] >> np.uint64(64 - bundle_bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(bundle, prepend=-1))
    ends = np.append(starts[1:], len(bundle))
    phrases, n = phrases.take(pa.array(order)), n[order].astype("<i8")
    _, offsets, data = phrases.buffers()
    offsets, data = np.frombuffer(offsets, "<i4")[: len(n) + 1].tolist(), memoryview(data)
    raw = [n[a:b].tobytes() + bytes(data[offsets[a] : offsets[b]]) for a, b in zip(starts.tolist(), ends.tolist())]
    columns = [
        pa.array([lang] * len(raw), pa.string()),
        pa.array(bundle[starts]),
        pa.array(ends - starts),
        pa.array([len(part) for part in raw], pa.int64()),
        pa.array([pa.compress(part, "zstd", asbytes=True) for part in raw], pa.binary()),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=["lang", "bundle", "n", "length", "packed"])


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The stripes of a bundle added up; the total of the language is a stripe of size -1."""
    for (lang, _), same in groupby(_rows(batches), itemgetter(0, 1)):
        stripes: dict[bytes, Counter] = {}
        for _, _, n, length, packed in same:
            data = pa.decompress(packed, length, "zstd", asbytes=True)
            counts = np.frombuffer(data, "<i8", n).tolist()
            for phrase, count in zip(data[8 * n :].split(b"\n"), counts):
                prefix, _, word = phrase.rpartition(b" ")
                stripes.setdefault(prefix, Counter())[word] += count
        rows = []
        for prefix, stripe in stripes.items():
            if b"" in stripe:
                rows.append((-1, b"", [(b"", stripe.pop(b""))]))
            frequent = [(word, count) for word, count in stripe.items() if count >= least]
            if frequent:
                rows.append((prefix.count(b" ") + 1 if prefix else 0, prefix, frequent))
        for start in range(0, len(rows), 5_000):
            sizes, prefixes, entries = zip(*rows[start : start + 5_000])
            flat = [entry for stripe in entries for entry in stripe]
            offsets = np.cumsum([0, *map(len, entries)], dtype=np.int32)
            words = pa.array([word for word, _ in flat], pa.binary()).cast(pa.string())
            columns = [
                pa.array([lang] * len(sizes), pa.string()),
                pa.array(sizes, pa.int32()),
                pa.array(prefixes, pa.binary()).cast(pa.string()),
                pa.MapArray.from_arrays(pa.array(offsets), words, pa.array([n for _, n in flat], pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "size", "prefix", "stripe"])


def stripes_of(texts: DataFrame, longest: int, least: int, bits: int) -> DataFrame:
    """The frequent entries of the stripes of all prefixes shorter than ``longest``.

    ``(lang, size, prefix, stripe)``, a prefix in up to ``PARTS`` rows; one row of size -1 for each
    language counts its words.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(frequent_slots(texts, longest, least, bits))
    size = texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bundle_bits = (min(size // BUNDLE, MOST_BUNDLES) + 1).bit_length()

    def count(gathered: Gathered) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, dtype=np.uint8)
        texts = gathered.vocabulary.texts()
        for lang, words, hashes in gathered.taken():
            total = np.array([np.count_nonzero(words)])
            found = [(pa.array(["\n"]), total, np.zeros(1, dtype=np.uint64))]
            slots_of = phrase_slots(words, hashes, lang, longest, bits)
            for length, (slots, whole) in enumerate(slots_of):
                met = known[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8) & 1
                at = np.flatnonzero(whole & met.astype(bool))
                if len(at):
                    prefix = [words[at + k] for k in range(length)]
                    found.append(_counted(prefix, words[at + length], hashes, texts))
            yield from _bundles(lang, found, bundle_bits)

    rows = texts.mapInArrow(
        lambda batches: _gather(batches, count), "lang string, bundle bigint, n bigint, length bigint, packed binary"
    )
    keys = ("lang", "bundle")
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lambda batches: _merged(batches, least), STRIPES)


def table_bits(texts: DataFrame) -> int:
    """Enough bits for the slots of all phrases, as far as the bound allows."""
    size = texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    return min(max((size // 4).bit_length(), LEAST_BITS), MOST_BITS)


def _entries(stripes: DataFrame) -> DataFrame:
    return stripes.select("lang", "prefix", F.explode("stripe").alias("word", "n"))


def _joined_words(prefix: str, word: str) -> Column:
    return F.when(F.col(prefix) == "", F.col(word)).otherwise(F.concat(F.col(prefix), F.lit(" "), F.col(word)))


def _first_words(phrase: Column, n: int) -> Column:
    return F.substring_index(phrase, " ", n)


def collocations(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    covered_percent: int = 50,
    top: int = 2_000,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """The first phrases of every language: ``(lang, rank, phrase, a, l, r, n, score)``.

    Phrases of 2 to ``longest`` words found ``least`` times (a) are scored by their loosest cut,
    a * a / (l * r) in millionths, rounded down, where l and r count the two parts; the first cut wins a tie. A phrase
    inside a longer one with ``covered_percent`` of its count is left out. ``n`` counts the words
    of the language. Ranks follow score, a and the phrase in byte order. Null texts are empty, a
    null language is ``und``, repeated rows count again, other columns are not read, and without
    words there is no row. Counts are exact up to 10**15.
    """
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    texts = docs.select(
        F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("body")
    ).where("body IS NOT NULL")
    stripes = staged(stripes_of(texts, longest, least, table_bits(texts)), "stripes")
    sizes = stripes.where("size = -1").select("lang", F.element_at("stripe", "").alias("n"))
    entries = [_entries(stripes.where(F.col("size") == size)) for size in range(longest)]
    totals = [
        rows.select("lang", _joined_words("prefix", "word").alias("phrase"), F.col("n").alias("f"))
        for rows in entries[:-1]
    ]
    found = []
    for length in range(2, longest + 1):
        phrases = _scored(entries[length - 1], totals, length)
        if length < longest:
            phrases = phrases.join(_covering(entries[length], length), ["lang", "phrase"], "left")
            free = F.col("covering").isNull() | (100 * F.col("covering") < covered_percent * F.col("a"))
            phrases = phrases.where(free).drop("covering")
        found.append(phrases)
    return _first(reduce(DataFrame.unionByName, found), top).join(sizes, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def _scored(entries: DataFrame, counted: list[DataFrame], length: int) -> DataFrame:
    """Phrases of a length with their loosest cut; both parts' counts are prefix totals."""
    phrases = entries.select("lang", _joined_words("prefix", "word").alias("phrase"), F.col("n").alias("a"))
    phrase = F.col("phrase")
    for at in range(1, length):
        left = counted[at - 1].select(F.col("lang").alias("l_lang"), F.col("phrase").alias("l_part"), F.col("f").alias(f"l{at}"))
        right = counted[length - at - 1].select(F.col("lang").alias("r_lang"), F.col("phrase").alias("r_part"), F.col("f").alias(f"r{at}"))
        phrases = phrases.join(
            left, (F.col("lang") == F.col("l_lang")) & (_first_words(phrase, at) == F.col("l_part"))
        ).drop("l_lang", "l_part")
        phrases = phrases.join(
            right, (F.col("lang") == F.col("r_lang")) & (_first_words(phrase, at - length) == F.col("r_part"))
        ).drop("r_lang", "r_part")

    def wide(name: str) -> Column:
        return F.col(name).cast("decimal(38,0)")

    def cut(at: int) -> Column:
        score = F.call_function(
            "div", wide("a") * wide("a") * F.lit(1_000_000), wide(f"l{at}") * wide(f"r{at}")
        )
        return F.struct(score.alias("score"), F.lit(at).alias("at"), F.col(f"l{at}").alias("l"), F.col(f"r{at}").alias("r"))

    loosest = F.array_min(F.array(*(cut(at) for at in range(1, length))))
    return phrases.withColumn("cut", loosest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _covering(longer: DataFrame, length: int) -> DataFrame:
    """For phrases of ``length`` words inside those with one more, the greatest count of these.

    Longer ones need no look: what is between them and the phrase is at least as frequent.
    """
    phrase = _joined_words("prefix", "word")
    behind = longer.select("lang", F.col("prefix").alias("phrase"), "n")
    ahead = longer.select("lang", F.substring_index(phrase, " ", -length).alias("phrase"), "n")
    return behind.unionByName(ahead).groupBy("lang", "phrase").agg(F.max("n").alias("covering"))


def _first(phrases: DataFrame, top: int) -> DataFrame:
    """The first phrases of every language, chosen in shares, in fewer shares, and among these."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for shares in SHARES:
        share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
        nth = F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))
        phrases = phrases.withColumn("nth", nth).where(F.col("nth") <= top)
    whole = Window.partitionBy("lang").orderBy(*order)
    ranked = phrases.withColumn("rank", F.row_number().over(whole).cast("long"))
    return ranked.where(F.col("rank") <= top).drop("nth")
