"""Benchmark decontamination by the q-gram lemma.

A window begins at every byte of a benchmark item. A window found in a text with at most k edits
shares at least ``length - q + 1 - k q`` of its q-grams with it, and those lie on diagonals at
most k apart. Hits are sorted by band of diagonals, overlapping by k, and place in the item; where
so many places lie within a window, the windows that hold them are verified by an alignment.

Items too short for the lemma are looked for as they are, as whole words, by one automaton.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import placed, ship, staged

Q = 6
#: At most 57, so that a window lies in eight bytes of bits from any bit of the first on.
WINDOW = 48
#: A window begins at every byte.
STRIDE = 1
#: Edits allowed for each hundred bytes of a window.
EDITS = 13
#: Items with fewer bytes must be found without any edit, as whole words.
SHORTEST = 32
#: Benchmarks are searched in blocks of about so many bytes.
BLOCK = 1 << 19
#: Texts are searched together up to so many bytes.
TOGETHER = 1 << 20
#: So many hits are met at once, or those of four windows.
TOGETHER_HITS = 1 << 17
SLOTS = 1 << 17
#: Keeps the slots of two items apart.
APART = 8 * 40503
BAND_BITS = 3
BAND = 1 << BAND_BITS
#: Windows that begin so close together are first looked for by what they share.
GROUP = 16
#: So many windows are aligned together.
STEP = 1 << 13
FILTER_BITS = 20
#: Wider than all that a window may reach beyond its text.
GAP = b"\n" * (2 * WINDOW)


def normal(text: str) -> bytes:
    """A-Z in lower case, white space as single blanks."""
    return b" ".join(text.encode().lower().split())


def grams(data: bytes) -> np.ndarray:
    """A 64-bit code for the q-gram at every byte."""
    count = len(data) - Q + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    code = np.ndarray((count,), "<u2", data, 4, (1,)).astype(np.uint64) << np.uint64(32)
    code |= np.ndarray((count,), "<u4", data, 0, (1,))
    return code * np.uint64(0xD6E8FEB86659FD93)


def allowed(size):
    """Edits allowed in windows of a size, a number or an array."""
    return size * EDITS // 100


def edits(window: bytes) -> int:
    return allowed(len(window))


@dataclass(frozen=True)
class Index:
    """A block of items, laid behind each other, and the places of their q-grams, sorted by code.

    A window begins at every byte of an item. Items are a window apart, so that places of two
    items never lie in one window.
    """

    data: bytes
    item: np.ndarray
    first: np.ndarray
    length: np.ndarray
    codes: np.ndarray
    low: np.ndarray
    bucket: np.ndarray
    seen: np.ndarray
    place_at: np.ndarray
    turn_at: np.ndarray
    letter: np.ndarray
    letters: np.ndarray

    @property
    def bits(self) -> np.ndarray:
        return np.ndarray((len(self.letters) - 7,), "<u8", self.letters, 0, (1,))

    @staticmethod
    def of(texts: list[str]) -> Index:
        kept = [(n, data) for n, data in enumerate(map(normal, texts)) if len(data) >= SHORTEST]
        length = np.array([len(data) for _, data in kept], dtype=np.int64)
        first = np.cumsum(length + WINDOW) - length - WINDOW
        codes = [grams(data) for _, data in kept]
        places = [start + np.arange(len(its)) for start, its in zip(first, codes)]
        every = np.concatenate([np.zeros(0, dtype=np.uint64), *codes])
        order = np.argsort(every, kind="stable")
        distinct, low = np.unique(every[order], return_index=True)
        buckets = (distinct >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        bucket = np.searchsorted(buckets, np.arange((1 << FILTER_BITS) + 1))
        place = np.concatenate([np.zeros(0, dtype=np.int64), *places])[order]
        number = np.searchsorted(first, place, "right") - 1
        data = b"".join(data + bytes(WINDOW) for _, data in kept)
        return Index(
            data,
            np.array([n for n, _ in kept], dtype=np.int64),
            first,
            length,
            distinct,
            np.append(low, len(every)).astype(np.int32),
            bucket.astype(np.int32),
            np.diff(bucket) > 0,
            place.astype(np.int32),
            (place + number * APART % (SLOTS * BAND)).astype(np.int32),
            *letters_of(data),
        )

    def search(self, texts: list[bytes]) -> list[list[int]]:
        """For each normalised text the numbers of the items found in it."""
        found: list[set[int]] = [set() for _ in texts]
        sizes = np.array([len(text) + len(GAP) for text in texts], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes + len(GAP)
        data = GAP + GAP.join([*texts, b""])
        codes = grams(data)
        bucket = (codes >> np.uint64(64 - FILTER_BITS)).astype(np.int32)
        at = np.flatnonzero(self.seen[bucket])
        codes, bucket = codes[at], bucket[at]
        # Codes are sorted, so those of a bucket follow each other.
        name, end = self.bucket[bucket], self.bucket[bucket + 1]
        other = np.flatnonzero(self.codes[name] != codes)
        while len(other):
            name[other] += 1
            other = other[name[other] < end[other]]
            other = other[self.codes[name[other]] != codes[other]]
        known = name < end
        at, name = at[known].astype(np.int32), name[known]
        low, many = self.low[name], self.low[name + 1] - self.low[name]
        upto = np.cumsum(many, dtype=np.int64)
        begin, met = 0, []
        while begin < len(at):
            # Hits are met in bounded numbers; the parts overlap by more than a window and its edits.
            stop = np.searchsorted(upto, upto[begin] - many[begin] + TOGETHER_HITS, "right")
            stop = max(int(stop), int(np.searchsorted(at, at[begin] + 4 * WINDOW)))
            part = slice(begin, stop)
            met.append(self.met(at[part], low[part], many[part]))
            if stop >= len(at):
                break
            begin = int(np.searchsorted(at, at[stop] - 2 * WINDOW))
        if not met:
            return [[] for _ in texts]
        nearest, place, item, from_, to = map(np.concatenate, zip(*met))
        sure = self.confirmed(data, nearest, item, from_, to)
        # A place that is known but for its band still lies behind the gap's first half.
        text = np.searchsorted(starts - WINDOW, (nearest + place)[sure], "right") - 1
        for t, n in zip(text.tolist(), self.item[item[sure]].tolist()):
            found[t].add(n)
        return [sorted(its) for its in found]

    def met(
        self, at: np.ndarray, low: np.ndarray, many: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows with enough q-grams in a band.

        A row has the band's first diagonal, a place that was met, its item, and the places of the
        item where the first and the last such window begin.
        """
        hit = np.repeat(low - np.cumsum(many, dtype=np.int32) + many, many) + np.arange(int(many.sum()), dtype=np.int32)
        where = np.repeat(at, many)
        # Most hits are alone: those of an item and two bands are counted, in slots that may be shared.
        slot = ((where - self.turn_at[hit]) >> BAND_BITS) & (SLOTS - 1)
        count = np.bincount(slot, minlength=SLOTS)
        least = int(self.needed(self.length).min())
        pair = count + np.roll(count, -1) >= least
        likely = np.flatnonzero((pair | np.roll(pair, 1))[slot])
        place, where = self.place_at[hit[likely]].astype(np.int64), where[likely]
        if len(likely) < least:
            return (np.zeros(0, dtype=np.int64),) * 5
        # Diagonals are shifted, so that none is negative.
        diagonal = where - place + len(self.data)
        widest = allowed(WINDOW)
        lower = diagonal % BAND < widest  # these lie in the overlap with the band before, too
        span = len(self.data) + WINDOW
        band = diagonal // BAND + 1
        keys = np.concatenate([band * span + place, (band[lower] - 1) * span + place[lower]])
        keys.sort()
        # Each place of an item counts once in a band.
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        one = np.flatnonzero(keys[least - 1 :] - keys[: max(len(keys) - least + 1, 0)] <= WINDOW - Q)
        item = np.searchsorted(self.first, keys[one] % span, "right") - 1
        needed = self.needed(self.length[item])
        last = keys[np.minimum(one + needed - 1, len(keys) - 1)]
        enough = (one + needed <= len(keys)) & (last - keys[one] <= WINDOW - Q)
        one, item, last = one[enough], item[enough], last[enough]
        band, place, last = keys[one] // span - 1, keys[one] % span, last % span
        # The windows that hold all these places begin at from_ to to; none is looked at twice.
        size = np.minimum(self.length[item], WINDOW)
        from_ = np.maximum(last + Q - size, self.first[item])
        to = np.minimum(place, self.first[item] + self.length[item] - size)
        same = (band[1:] == band[:-1]) & (item[1:] == item[:-1])
        from_[1:] = np.where(same, np.maximum(from_[1:], to[:-1] + 1), from_[1:])
        some = from_ <= to
        band, place, item, from_, to = (x[some] for x in (band, place, item, from_, to))
        return band * BAND - len(self.data), place, item, from_, to

    @staticmethod
    def needed(length: np.ndarray) -> np.ndarray:
        size = np.minimum(length, WINDOW)
        return size - Q + 1 - allowed(size) * Q

    def confirmed(
        self, data: bytes, nearest: np.ndarray, item: np.ndarray, from_: np.ndarray, to: np.ndarray
    ) -> np.ndarray:
        """Which rows have a window that begins at from_ to to and is found near the diagonals.

        Windows that begin close together are found only if what they have in common is, with the
        edits of a window; this is tried first.
        """
        text = np.frombuffer(data, dtype=np.uint8)
        size = np.minimum(self.length[item], WINDOW)
        row, begin = spread(from_, to, GROUP)
        end = np.minimum(begin + GROUP - 1, to[row])
        likely = self.aligned(text, nearest[row], end, size[row] - (end - begin), allowed(size[row]))
        which, begin = spread(begin[likely], end[likely], 1)
        row = row[likely][which]
        sure = np.zeros(len(item), dtype=bool)
        sure[row[self.aligned(text, nearest[row], begin, size[row], allowed(size[row]))]] = True
        return sure

    def aligned(
        self, text: np.ndarray, nearest: np.ndarray, begin: np.ndarray, size: np.ndarray, most: np.ndarray
    ) -> np.ndarray:
        """Which pieces of the items are found within so many edits, near diagonals from nearest.

        A path that touches one of these diagonals never leaves the band that is wider by the
        edits on either side. All pieces take a step together, with their rows of the alignment
        held as differences in the bits of a word (Myers 1999).
        """
        found = np.zeros(len(begin), dtype=bool)
        one, bits = np.uint64(1), self.bits
        for at in range(0, len(begin), STEP):
            part = slice(at, at + STEP)
            byte, bit = begin[part] >> 3, (begin[part] & 7).astype(np.uint64)
            mask = (one << size[part].astype(np.uint64)) - one
            top = mask ^ (mask >> one)
            where = nearest[part] + begin[part] - most[part]
            score = size[part].astype(np.int8)
            best = score.copy()
            up, down = mask.copy(), np.zeros_like(mask)
            for _ in range(int(size[part].max()) + BAND + 3 * allowed(WINDOW)):
                letter = self.letter[text[where]]
                equal = (bits[letter + byte] >> bit) & mask
                level = equal | down
                across = (((equal & up) + up) ^ up) | equal
                more, less = down | ~(across | up), up & across
                score += ((more & top) != 0).view(np.int8) - ((less & top) != 0).view(np.int8)
                np.minimum(best, score, out=best)
                more, less = more << one, less << one
                up, down = less | ~(level | more), more & level
                where += 1
            found[part] = best <= most[part]
        return found


class Short:
    """The items of a block with fewer than ``SHORTEST`` bytes, found exactly and as whole words."""

    @staticmethod
    def of(texts: list[str]) -> dict[bytes, list[int]]:
        """The normalised short items among the texts, with their numbers."""
        numbers: dict[bytes, list[int]] = {}
        for n, data in enumerate(map(normal, texts)):
            if 0 < len(data) < SHORTEST:
                numbers.setdefault(data, []).append(n)
        return numbers

    def __init__(self, numbers: dict[bytes, list[int]]) -> None:
        self.numbers = numbers
        self.automaton = ahocorasick.Automaton()
        for data in self.numbers:
            self.automaton.add_word(data.decode("latin-1"), data)
        if self.numbers:
            self.automaton.make_automaton()

    def search(self, text: bytes) -> set[int]:
        """The numbers of the items in a normalised text."""
        found: set[bytes] = set()
        if self.numbers:
            for last, item in self.automaton.iter(text.decode("latin-1")):  # a letter is a byte
                if item not in found and whole(text, last + 1 - len(item), last + 1):
                    found.add(item)
        return {n for item in found for n in self.numbers[item]}


def whole(text: bytes, start: int, end: int) -> bool:
    """Whether no word goes on across either end."""

    def joined(at: int) -> bool:
        before = text[max(at - 4, 0) : at].decode("utf-8", "ignore")[-1:]
        behind = text[at : at + 4].decode("utf-8", "ignore")[:1]
        return spaced(before) and spaced(behind)

    return not joined(start) and not joined(end)


def spaced(letter: str) -> bool:
    """Whether this is a letter or digit of a script that parts its words.

    Thai and Lao, and what lies from the radicals of Chinese on, do not.
    """
    return letter.isalnum() and not ("\u0e00" <= letter <= "\u0eff" or letter >= "\u2e80")


def letters_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each byte value where its bits begin, and 64 bits from every byte of them on.

    A bit says whether the value stands at a place of the data.
    """
    values = np.frombuffer(data, dtype=np.uint8)
    present = np.unique(values)
    wide = len(values) // 8 + 9
    rows = np.zeros((len(present) + 1, wide), dtype=np.uint8)
    for n, value in enumerate(present, start=1):
        packed = np.packbits(values == value, bitorder="little")
        rows[n, : len(packed)] = packed
    letter = np.zeros(256, dtype=np.int64)
    letter[present] = np.arange(1, len(present) + 1) * wide
    return letter, rows.reshape(-1)


def spread(from_: np.ndarray, to: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from_, from_ + step and so on up to to, and the row of each."""
    many = (to - from_) // step + 1
    row = np.repeat(np.arange(len(many)), many)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    return row, from_[row] + nth * step


def together(texts: Iterable[str]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Normalised texts with their numbers, gathered up to a bounded size.

    A longer text comes in parts, which overlap by more than a window and its edits.
    """
    numbers, parts, size = [], [], 0
    for number, text in enumerate(texts):
        data = normal(text or "")
        for start in range(0, len(data), TOGETHER):
            numbers.append(number)
            parts.append(data[start : start + TOGETHER + 2 * WINDOW])
            size += len(parts[-1])
            if size >= TOGETHER:
                yield numbers, parts
                numbers, parts, size = [], [], 0
    if parts:
        yield numbers, parts


def items_in(spark: SparkSession, text: Column, ids: list, texts: list[str]) -> Column:
    """The ids of the items of a block that a text contains, ascending."""
    ship(spark)
    shared = spark.sparkContext.broadcast((ids, Index.of(texts), Short.of(texts)))

    @F.pandas_udf("array<long>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, index, its_short = shared.value
        short = Short(its_short)
        for batch in batches:
            found: list[set[int]] = [set() for _ in batch]
            for numbers, parts in together(batch):
                for number, its in zip(numbers, index.search(parts)):
                    found[number].update(ids[n] for n in its)
            if short.numbers:
                for number, body in enumerate(batch):
                    found[number].update(ids[n] for n in short.search(normal(body)))
            yield pd.Series([sorted(its) for its in found], dtype=object)

    return find(F.coalesce(text, F.lit("")))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    into: str = "items",
) -> DataFrame:
    """``docs`` with a column ``into``: the ids of the benchmark items that the text contains.

    An item is contained if 48 bytes of it in a row, or all of it if it is shorter, are found with
    at most 13 edits per hundred bytes (six in 48, so that 42 bytes in a row always do), upper and
    lower case and kinds of white space aside. An item of fewer than 32 bytes is contained if it
    stands there without any edit, as whole words; one of white space alone never is. The benchmark
    is searched in blocks of bounded size, one pass over the texts each, which keeps the places of
    the rows that contain an item, and no texts. Null and empty texts contain nothing; items without
    text or id are left out. Other columns of ``docs`` are kept; a column that is called as ``into``
    is refused with a ``ValueError``.
    """
    if into.lower() in (name.lower() for name in docs.columns):
        raise ValueError(f"the documents have a column {into!r} already: name another one with into=")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).alias("id"), F.col(item_text).alias("body")).where(
        "id IS NOT NULL AND body IS NOT NULL"
    )
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = size // BLOCK + 1

    def those_of(block: int) -> Column:
        rows = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()
        rows.sort(key=lambda row: (row.id, row.body))
        return items_in(spark, F.col(text), [row.id for row in rows], [row.body for row in rows])

    if blocks == 1:
        return docs.withColumn(into, those_of(0))
    # The names of the places must not clash with columns of the documents.
    rows = placed(staged(docs.select(F.struct("*").alias("its")), "rows"))
    texts = rows.select("file", "row", F.col(f"its.{text}").alias(text))
    hits = [
        staged(texts.select("file", "row", those_of(block).alias("hits")).where(F.size("hits") > 0), "hits")
        for block in range(blocks)
    ]
    every = reduce(DataFrame.unionByName, hits)
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits"))))
    merged = every.groupBy("file", "row").agg(ids.alias("hits"))
    none = F.array().cast("array<long>")
    return rows.join(merged, ["file", "row"], "left").select("its.*", F.coalesce("hits", none).alias(into))
