"""Token ids of a corpus as compressed binary files, in the order of the documents."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import TEXTS, chunks, kept, ship, staged
from barloom.llm.files import Writer, opened, read_ranges
from barloom.llm.huffman import Codebook, code_lengths, decode_block, encode_block
from barloom.llm.units import units
from barloom.sources.shared import new_folder

END = 0
BLOCK_IDS = 1 << 19
UNITS = 600_000
JOINED = 2_000
MANIFEST = "part int, file string, offset long, length long, first long, n_ids long"


class Numbers(dict):
    """Units by number; new ones get the next number and wait to be learned."""

    def __init__(self) -> None:
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        self.waiting.append(unit)
        return number


class Encoder:
    """A tokenizer file and the ids of the units it has met, as little-endian 16 or 32 bits.

    Texts become the numbers of their units, one look-up each; the ids of all units lie in one
    pool, from which those of a batch are gathered at once. When ``UNITS`` are known the encoder
    starts anew.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = id_type(self.tokenizer.get_vocab_size(with_added_tokens=True))
        added = self.tokenizer.get_added_tokens_decoder()
        self.marks = [token.content for token in added.values()]
        self.mark = min((key for key, token in added.items() if token.special), default=None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.tokenize = plain_model(self.tokenizer, self.marks)
        # Byte-level tokens have one character for each byte they stand for.
        self.widths = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, number in vocabulary.items():
            self.widths[number] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.numbers = Numbers()
        self.known: dict[str, bytes] = {"": b""}
        self.pool = np.empty(0, dtype=self.kind)
        self.starts, self.lengths = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def encode(self, texts: Sequence[str] | pa.Array) -> list[bytes]:
        """The ids of each text. Units that are new are given to the tokenizer together.

        Texts whose only white space are single blanks and line breaks are cut by ``pieces``, and
        equal ones of all texts are looked up once; the others are cut by ``units``, and so are
        texts that hold an added token.
        """
        if len(self.numbers) >= UNITS:
            self._forget()
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(texts, _ODD)
        for mark in self.marks:
            odd = pc.or_(odd, pc.match_substring(texts, mark))
        parts = list(map(units, texts.filter(odd).to_pylist()))
        sizes = np.array([len(part) for part in parts], dtype=np.int64)
        every = map(self.numbers.__getitem__, chain.from_iterable(parts))
        numbers = np.fromiter(every, dtype=np.int64, count=int(sizes.sum()))
        cut, counts = pieces(texts.filter(pc.invert(odd)))
        found = cut.dictionary_encode()
        distinct = np.array([self.numbers[unit] for unit in found.dictionary.to_pylist()], dtype=np.int64)
        numbers = np.concatenate([numbers, distinct[found.indices.to_numpy()]])
        sizes = np.concatenate([sizes, counts])
        self._grow()
        lengths = self.lengths[numbers]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        # Places in the pool, and of a chunk's ids, are below 2**31.
        places = np.repeat((self.starts[numbers] - ends[:-1]).astype(np.int32), lengths)
        places += np.arange(len(places), dtype=np.int32)
        data = self.pool[places].tobytes()
        borders = (ends[np.concatenate([[0], np.cumsum(sizes)])] * self.pool.itemsize).tolist()
        ids = [data[begin:end] for begin, end in zip(borders, borders[1:])]
        order = np.argsort(~odd.to_numpy(zero_copy_only=False), kind="stable")
        return [ids[place] for place in np.argsort(order).tolist()]

    def _grow(self) -> None:
        """Learn the units that wait, and put their ids into the pool."""
        new, self.numbers.waiting = self.numbers.waiting, []
        if not new:
            return
        places = np.flatnonzero(latin(new)) if self.tokenize is not None else []
        lengths = np.zeros(len(new), dtype=np.int64)
        direct, lengths[places] = self._model([new[n] for n in places])
        others = np.ones(len(new), dtype=bool)
        others[places] = False
        cut = [framed(new[n]) for n in np.flatnonzero(others).tolist()]
        known = self.known
        self._learn(list(set(chain.from_iterable(cut)).difference(known)))
        ids = [known[pieces[0]] if len(pieces) == 1 else b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        lengths[others] = np.array([len(part) for part in ids], dtype=np.int64) // self.pool.itemsize
        # The words of the model come first in the pool, the others behind them.
        starts = np.empty(len(new), dtype=np.int64)
        order = np.argsort(others, kind="stable")
        starts[order] = len(self.pool) + np.cumsum(lengths[order]) - lengths[order]
        self.starts = np.append(self.starts, starts)
        self.lengths = np.append(self.lengths, lengths)
        self.pool = np.concatenate([self.pool, direct, np.frombuffer(b"".join(ids), dtype=self.kind)])

    def _learn(self, new: list[str]) -> None:
        """Have the library encode new units: many in one text, parted again by the bytes of its
        tokens.

        Words of Latin letters are one part each to the pre-tokenizer, so they go straight to the
        library's model, as the characters that stand for their bytes. Other words behind one blank
        are parts of their own, too, and need nothing between them; other units are set apart by a
        special string, which it cuts out before it looks at what stands on either side.
        """
        if self.tokenize is not None:
            some = [new[n] for n in np.flatnonzero(latin(new)).tolist()]
            ids, lengths = self._model(some)
            ends = np.cumsum(lengths)
            self._keep(some, ids, ends - lengths, ends)
            new = [unit for unit in new if unit not in self.known]
        words = [unit for unit in new if is_word(unit)]
        for start in range(0, len(words), JOINED):
            some = words[start : start + JOINED]
            ids = self._ids(["".join(some)])[0]
            at = np.cumsum(self.widths[ids])
            wanted = np.cumsum([len(word.encode()) for word in some])
            ends = np.searchsorted(at, wanted)
            if at[-1] != wanted[-1] or not np.array_equal(at[ends], wanted):
                continue  # parted otherwise than supposed: left to the plain way below
            self._keep(some, ids, np.append(0, ends[:-1] + 1), ends + 1)
        plain = [unit for unit in new if unit not in self.known]
        plain = [u for u in plain if not any(mark in u for mark in self.marks)] if self.marks else []
        for start in range(0, len(plain) if self.mark is not None else 0, JOINED):
            some = plain[start : start + JOINED]
            text = self.tokenizer.id_to_token(self.mark).join(some)
            ids = self._ids([text])[0]
            ends = np.flatnonzero(ids == self.mark)
            self._keep(some, ids, np.append(0, ends + 1), np.append(ends, len(ids)))
        rest = [unit for unit in new if unit not in self.known]
        for unit, ids in zip(rest, self._ids(rest)):
            self.known[unit] = ids.tobytes()

    def _model(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids, one after another, and their numbers, of words that the pre-tokenizer leaves
        whole: the library's model alone encodes them."""
        tokenize, ids, ends = self.tokenize, [], [0]
        data = np.frombuffer("\n".join(words).encode(), dtype=np.uint8)
        signs = _BYTE_SIGNS[data].tobytes().decode("utf-16-le")
        for word in signs.split("\n") if words else ():
            ids += [token.id for token in tokenize(word)]
            ends.append(len(ids))
        return np.array(ids, dtype=self.kind), np.diff(np.array(ends, dtype=np.int64))

    def _keep(self, some: list[str], ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        data, size = ids.tobytes(), ids.itemsize
        for unit, begin, end in zip(some, (begins * size).tolist(), (ends * size).tolist()):
            self.known[unit] = data[begin:end]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(encoding.ids, dtype=self.kind) for encoding in found]


#: A word of Latin letters, with the blank before it or without; every version of Unicode that a
#: library may know takes them for letters.
_LATIN = "^ ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+$"
#: The characters by which byte-level models name the bytes: those that are not printable have
#: others. The line break stays itself.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_SIGNS = np.arange(256, dtype="<u2")
for _n, _byte in enumerate(b for b in range(256) if b not in _PRINTED):
    _BYTE_SIGNS[_byte] = _byte if _byte == 0x0A else 256 + _n


def latin(units: list[str]) -> np.ndarray:
    """Which of the units are words of Latin letters."""
    found = pc.match_substring_regex(pa.array(units, pa.string()), _LATIN)
    return found.to_numpy(zero_copy_only=False)


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Parts that the pre-tokenizer always cuts, of texts whose only white space are single blanks
    and line breaks: all parts of all texts, joined they are the texts, and their number by text.

    Cuts are before a blank, around a line break, and behind an ASCII letter before another sign of
    ASCII: no part of the pre-tokenizer goes on from a letter to anything else.
    """
    if not len(texts):
        return texts, np.zeros(0, dtype=np.int64)
    _, offsets, data = texts.buffers()
    borders = np.frombuffer(offsets, dtype=np.int32, count=len(texts) + 1)
    signs = np.frombuffer(data or b"", dtype=np.uint8, count=int(borders[-1]))
    cuts = (signs == 0x20) | (signs == 0x0A)
    letter = ((signs | 0x20) - np.uint8(0x61)) < 26
    cuts[1:] |= (letter[:-1] & ~letter[1:] & (signs[1:] < 0x80)) | (signs[:-1] == 0x0A)
    starts = borders[:-1]
    cuts[starts[starts < borders[1:]]] = True
    begins = np.flatnonzero(cuts)
    counts = np.diff(np.searchsorted(begins, borders))
    bounds = pa.py_buffer(np.append(begins, len(signs)).astype(np.int32))
    return pa.StringArray.from_buffers(len(begins), bounds, data or pa.py_buffer(b"")), counts


def plain_model(tokenizer, marks: Sequence[str]) -> Callable | None:
    """The function that encodes a part of a text, if the tokenizer does no more to a word than
    cut it out and name its bytes; None for any other tokenizer."""
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel

    cutter, model = tokenizer.pre_tokenizer, tokenizer.model
    if not isinstance(cutter, ByteLevel) or not cutter.use_regex or cutter.add_prefix_space:
        return None
    if not isinstance(model, BPE) or model.dropout or tokenizer.normalizer is not None:
        return None
    if latin([mark.strip() for mark in marks]).any():
        return None
    return model.tokenize


#: Two blanks or line breaks in a row, and any other white space.
_ODD = (
    r"[ \n][ \n]|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

_FRAMED = re.compile(r"( |\n|)([^\W\d_]+)([^\w\s]*)").fullmatch


def is_word(unit: str) -> bool:
    """Whether a unit is a blank and letters; the pre-tokenizer cuts before and behind it."""
    return unit[:1] == " " and unit[1:].isalpha()


def framed(unit: str) -> tuple[str, ...]:
    """A word without the line break before it and the marks behind it, and these.

    The pre-tokenizer cuts behind a line break that a letter follows, and between letters and
    marks. Units that look otherwise stay whole.
    """
    match = None if is_word(unit) else _FRAMED(unit)
    if match is None:
        return (unit,)
    before, letters, behind = match.groups()
    if before == "\n":
        return ("\n", letters, behind) if behind else ("\n", letters)
    return (before + letters, behind) if behind else (unit,)


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def encoder(path: str) -> Encoder:
    """One per Python worker, kept from task to task."""
    return kept(("encoder", path), lambda: Encoder(path))


def vocabulary_size(path: str) -> int:
    with open(path, encoding="utf-8") as source:
        config = json.load(source)
    added = (token["id"] for token in config["added_tokens"])
    return max([*config["model"]["vocab"].values(), *added]) + 1


def token_table(
    docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", order: Sequence[str] = ()
) -> DataFrame:
    """``(doc_id, ids)`` of every row of ``docs``; null and empty texts have no ids.

    The columns named in ``order`` are kept as ``order_0`` and so on.
    """
    ship(docs.sparkSession)
    kept = [F.col(name).alias(f"order_{n}") for n, name in enumerate(order)]
    schema = docs.select(F.col(key).cast("long").alias("doc_id"), *kept, F.lit(b"").alias("ids")).schema
    names = [field.name for field in schema]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary)
        for batch in batches:
            for some in chunks(batch, "body"):
                ids = known.encode(some.column("body"))
                columns = [some.column(name) for name in names[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names=names)

    body = F.coalesce(F.col(text), F.lit("")).alias("body")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), *kept, body)
    return staged(rows.mapInArrow(encode, schema), "token-ids", TEXTS)


def count_ids(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents, their end ids included."""
    kind = id_type(size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            column = batch.column("ids")
            total[END] += len(column)
            values = np.frombuffer(b"".join(column.to_pylist()), dtype=kind)
            total += np.bincount(values, minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"]
        )

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    total = np.zeros(size, dtype=np.int64)
    for row in counts.collect():  # one row per id of the vocabulary
        total[row.id] = row.n
    return total


def write_tokens(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    limit: int = 16,
    text: str = "text",
    key: str = "doc_id",
    order: Sequence[str] = (),
) -> DataFrame:
    """Write every document's ids and an end id in ascending order of the key; returns the manifest.

    ``folder`` gets the codebook and one file of blocks per task. Rows without a key come first;
    rows with equal keys are ordered by a hash of their ids. An empty table writes the codebook
    alone. Columns named in ``order`` go before the key.
    """
    tokens = token_table(docs, vocabulary, text, key, order)
    size = vocabulary_size(vocabulary)
    lengths = code_lengths(count_ids(tokens, size), max(limit, (size - 1).bit_length()))
    files, root = opened(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/codebook") as out:
        out.write(zlib.compress(lengths.tobytes()))
    kind = id_type(size)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook.of(lengths)
        part, first = TaskContext.get().partitionId(), 0
        out, held, rows = None, [], []

        def block() -> None:
            nonlocal out, first
            data = encode_block(book, [k for k, _ in held], [ids for _, ids in held])
            out = out or Writer(folder, ".ids")
            n_ids = sum(len(ids) for _, ids in held)
            rows.append((part, out.name, out.write(data), len(data), first, n_ids))
            first += n_ids
            held.clear()

        waiting = 0
        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(value.as_buffer(), dtype=kind).astype(np.int64)
                held.append((doc_id, np.append(ids, END)))
                waiting += len(ids) + 1
                if waiting >= BLOCK_IDS:
                    block()
                    waiting = 0
        if held:
            block()
        if out is not None:
            out.close()
        if rows:
            names = ("part", "file", "offset", "length", "first", "n_ids")
            columns = [pa.array(column) for column in zip(*rows)]
            columns[0] = columns[0].cast(pa.int32())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    places = [*(f"order_{n}" for n in range(len(order))), "doc_id", "same"]
    blocks = (
        tokens.withColumn("same", F.xxhash64("ids"))
        .repartitionByRange(*places)
        .sortWithinPartitions(*places)
        .select("doc_id", "ids")
        .mapInArrow(write, MANIFEST)
    )
    return staged(blocks, "token-manifest")


def read_tokens(manifest: DataFrame, folder: str, stretch: int = 16 << 20) -> DataFrame:
    """One row per document, from the files: where its ids start, their number and checksum."""
    ship(manifest.sparkSession)
    files, root = opened(folder)
    with files.open_input_file(f"{root}/codebook") as source:
        lengths = np.frombuffer(zlib.decompress(source.read()), dtype=np.uint8)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook.of(lengths)
        table = book.table()
        for batch in batches:
            names = ("file", "offset", "length")
            ranges = zip(*(batch.column(name).to_pylist() for name in names))
            for first, block in zip(
                batch.column("start").to_pylist(), read_ranges(folder, ranges, 0, stretch)
            ):
                keys, ids = decode_block(table, book.longest, block)
                counts = np.array([len(part) for part in ids], dtype=np.int64)
                sums = [zlib.crc32(part.astype("<u4")) for part in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        pa.array(first + np.cumsum(counts) - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("its_ids"))
    starts = parts.select("part", F.coalesce(F.sum("its_ids").over(earlier), F.lit(0)).alias("before"))
    tasks = (manifest.agg(F.sum("length")).first()[0] or 0) // (stretch // 4) + 1
    return (
        manifest.join(starts, "part")
        .select(
            "file",
            "offset",
            "length",
            (F.col("first") + F.col("before")).alias("start"),
            F.floor(F.col("offset") / (stretch // 4)).alias("place"),
        )
        .repartition(tasks, "file", "place")
        .sortWithinPartitions("file", "offset")
        .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def round_trip(
    spark: SparkSession, docs: DataFrame, vocabulary: str, order: Sequence[str] = ()
) -> DataFrame:
    """Documents written as token ids in the shared folder and read back."""
    folder = new_folder(spark, "token-files")
    manifest = write_tokens(docs, folder, vocabulary, order=order)
    return read_tokens(manifest, folder)
