"""Canonical Huffman codes of bounded length, and blocks of ids written with them.

A block is read without any other: it lists its documents, the bit offset of every ``STEP``-th id
(a checkpoint) and the bits, first bit highest. Decoding looks at as many bits as the longest code
has; the table gives the id and its length. All stretches between checkpoints are decoded side by
side, one id of each at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

STEP = 128
MAGIC = b"HUF1"
HEAD = struct.Struct("<4sIIIQ")  # magic, documents, ids, checkpoints, bytes of bits


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """The lengths of an optimal prefix code of at most ``limit`` bits, 0 for unused ids.

    Package-merge: at every level the symbols are merged by weight with pairs of the level
    below; of the last level the first 2n - 2 entries count, and each symbol is as long as the
    number of levels that hold it among theirs.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        place = np.argsort(merged, kind="stable")
        levels.append(place < len(order))
        merged = merged[place]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    taken, depth = 2 * len(order) - 2, np.zeros(len(order), dtype=np.int64)
    for symbols in reversed(levels):
        first = int(symbols[:taken].sum())
        depth[:first] += 1
        taken = 2 * (taken - first)
    lengths[order] = depth
    return lengths


@dataclass(frozen=True)
class Codebook:
    """The codes of all ids: shorter ones first, and by id within a length."""

    lengths: np.ndarray
    codes: np.ndarray
    longest: int

    @staticmethod
    def of(lengths: np.ndarray) -> Codebook:
        codes = np.zeros(len(lengths), dtype=np.uint64)
        longest = int(lengths.max(initial=1))
        code = 0
        for length in range(1, longest + 1):
            ids = np.flatnonzero(lengths == length)
            codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
            code = (code + len(ids)) << 1
        return Codebook(lengths.astype(np.uint64), codes, longest)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For every value of ``longest`` bits: the id whose code begins it, and its length."""
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        spans = 1 << (self.longest - self.lengths[order].astype(np.int64))
        ids = np.repeat(order, spans)
        room = (1 << self.longest) - len(ids)
        return (
            np.concatenate([ids, np.zeros(room, dtype=ids.dtype)]).astype(np.uint32),
            np.concatenate(
                [np.repeat(self.lengths[order], spans), np.zeros(room, dtype=np.uint64)]
            ).astype(np.int64),
        )


def _bits(book: Codebook, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of the ids as bytes, and the bit at which each begins."""
    lengths = book.lengths[ids]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros(total // 64 + 2, dtype=np.uint64)
    if total:
        codes, at = book.codes[ids], starts & np.uint64(63)
        word = (starts >> np.uint64(6)).astype(np.int64)
        over = (at + lengths).astype(np.int64) - 64  # bits that fall into the next word
        fits = np.where(over > 0, 0, -over).astype(np.uint64)
        spill = np.where(over > 0, over, 0).astype(np.uint64)
        firsts = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        words[word[firsts]] = np.bitwise_or.reduceat((codes >> spill) << fits, firsts)
        rest = np.flatnonzero(over > 0)
        words[word[rest] + 1] |= codes[rest] << (np.uint64(64) - spill[rest])
    return words.astype(">u8").tobytes()[: (total + 7) // 8], starts


def encode_block(book: Codebook, keys: Sequence[int | None], ids: Sequence[np.ndarray]) -> bytes:
    """A block of documents: their keys, the number of their ids, and the ids."""
    joined = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
    data, starts = _bits(book, joined)
    checkpoints = starts[::STEP].astype("<u8")
    known = np.array([key is not None for key in keys], dtype=np.uint8)
    return b"".join(
        [
            HEAD.pack(MAGIC, len(keys), len(joined), len(checkpoints), len(data)),
            np.array([key or 0 for key in keys], dtype="<i8").tobytes(),
            known.tobytes(),
            np.array([len(part) for part in ids], dtype="<u4").tobytes(),
            checkpoints.tobytes(),
            data,
        ]
    )


def decode_block(
    table: tuple[np.ndarray, np.ndarray], longest: int, block: bytes
) -> tuple[list[int | None], list[np.ndarray]]:
    """The keys and the ids of a block's documents."""
    magic, n_docs, n_ids, n_points, n_bytes = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block")
    at = HEAD.size

    def part(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(block, dtype=kind, count=count, offset=at)
        at += found.nbytes
        return found

    keys, known, counts = part("<i8", n_docs), part("u1", n_docs), part("<u4", n_docs)
    position = part("<u8", n_points).astype(np.int64)
    raw = np.zeros(n_bytes + 12, dtype=np.uint8)
    raw[:n_bytes] = part("u1", n_bytes)
    # The 40 bits from each byte on hold every code that begins in that byte.
    window = np.ndarray(n_bytes + 4, dtype=">u8", buffer=raw, strides=(1,)).astype(np.uint64)
    window >>= np.uint64(24)
    symbols, lengths = table
    entries = symbols.astype(np.int64) << 8 | lengths  # one look-up for both
    mask, reach = np.int64((1 << longest) - 1), 40 - longest
    out = np.zeros((STEP, n_points), dtype=np.uint32)
    last = n_ids - (n_points - 1) * STEP  # ids of the last stretch
    window = window.view(np.int64)
    for step in range(STEP):
        lanes = n_points if step < last else n_points - 1
        if lanes <= 0:
            break
        here = position[:lanes]
        index = (window[here >> 3] >> (reach - (here & 7))) & mask
        entry = entries[index]
        out[step, :lanes] = entry >> 8
        here += entry & 255
    ids = out.T.reshape(-1)[:n_ids]
    ends = np.cumsum(counts.astype(np.int64))
    return (
        [int(k) if there else None for k, there in zip(keys, known)],
        np.split(ids, ends[:-1]) if n_docs else [],
    )
