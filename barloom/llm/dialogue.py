"""Repair of a conversation's structure by the cheapest edits, with an audit of the choices.

Every row is one of nine symbols: the initial of its role and its fault. Equal neighbours are
collapsed into runs; a symbol is a min-plus transition between the four states a well-formed
conversation can be in, and a run advances the costs through cached binary powers of it. The
choices are then unrolled from the front, always taking the least letter that stays cheapest.

Rows are range-partitioned by conversation and turn, so that no task holds a conversation because
it is long. Those that lie inside one task are solved there; those that lie in several are kept
as chunks of bounded size, whose transitions are composed backwards and whose states forwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache, lru_cache
from hashlib import sha256
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barloom.llm.common import SPACES, ship, staged

DELETE, INSERT, RELABEL, SPOILED = 2, 5, 1, 5
#: States: nothing yet, after the system's, the user's and the assistant's turn.
STATES = range(4)
FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FORCED = (2, 2, 3, 2)
ROLE_OF = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60
DOOMED = "x"

#: A chunk of a conversation that lies in several tasks has at most so many rows and bytes.
CHUNK_ROWS = 4_096
CHUNK_CHARS = 4 << 20

Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]


def _times(left: Matrix, right: Matrix) -> Matrix:
    columns = tuple(zip(*right))
    return tuple(tuple(min(FAR, *map(sum, zip(row, column))) for column in columns) for row in left)


def _advance(matrix: Matrix, after: Vector) -> Vector:
    return tuple(min(a + b for a, b in zip(row, after)) for row in matrix)


def _inserted() -> Matrix:
    """The cost of reaching one state from another by insertions alone."""
    rows = []
    for start in STATES:
        costs, state, paid = [FAR] * 4, start, 0
        while costs[state] == FAR:
            costs[state] = paid
            state, paid = FORCED[state], paid + INSERT
        rows.append(tuple(costs))
    return tuple(rows)


INSERTED = _inserted()
#: What is still to be paid behind the last row: nothing, or insertions up to an assistant's turn.
END: Vector = tuple(min(row[0], row[3]) for row in INSERTED)


@cache
def options(symbol: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """The edits of a row in a state, by letter: ``(letter, cost, next state)``."""
    found = [("D", DELETE, state)]
    if symbol != DOOMED:
        extra = SPOILED if symbol.isupper() else 0
        kept = FOLLOWS[state].get(symbol.lower())
        if kept is not None:
            found.append(("K", extra, kept))
        found.append(("R", RELABEL + extra, FORCED[state]))
    return tuple(found)


@cache
def power(symbol: str, bit: int) -> Matrix:
    """The transition of ``2 ** bit`` equal rows, insertions before each of them included."""
    if bit:
        half = power(symbol, bit - 1)
        return _times(half, half)
    rows = []
    for state in STATES:
        costs = [FAR] * 4
        for _, cost, after in options(symbol, state):
            costs[after] = min(costs[after], cost)
        rows.append(tuple(costs))
    return _times(INSERTED, tuple(rows))


def runs(symbols: str) -> list[tuple[str, int]]:
    return [(symbol, sum(1 for _ in same)) for symbol, same in groupby(symbols)]


def _powers(length: int) -> Iterator[int]:
    return (bit for bit in range(length.bit_length()) if length >> bit & 1)


def transition(symbols: str) -> Matrix:
    """The min-plus transition of a whole chunk."""
    whole: Matrix = tuple(tuple(0 if i == j else FAR for j in STATES) for i in STATES)
    for symbol, length in runs(symbols):
        for bit in _powers(length):
            whole = _times(whole, power(symbol, bit))
    return whole


def to_go(symbols: str, after: Vector) -> list[Vector]:
    """The costs still to be paid, by state, before each run and behind the last one."""
    found = [after]
    for symbol, length in reversed(runs(symbols)):
        for bit in _powers(length):
            after = _advance(power(symbol, bit), after)
        found.append(after)
    return found[::-1]


def unroll(symbols: str, state: int = 0, after: Vector = END, last: bool = True) -> tuple[str, int]:
    """The least of the cheapest audits from a state, and the state it ends in."""
    letters: list[str] = []
    costs = to_go(symbols, after)
    for (symbol, length), end in zip(runs(symbols), costs[1:]):
        inside = [end]
        for _ in range(length):
            inside.append(_advance(power(symbol, 0), inside[-1]))
        for left in range(length, 0, -1):
            before, behind = inside[left], inside[left - 1]
            while True:
                letter, state, stays = _cheapest(symbol, state, before, behind)
                letters.append(letter)
                if not stays:
                    break
    while last and after[state]:
        letters.append("I")
        state = FORCED[state]
    return "".join(letters), state


def _cheapest(symbol: str, state: int, before: Vector, behind: Vector) -> tuple[str, int, bool]:
    rest = before[state]
    delete, *others = options(symbol, state)
    if delete[1] + behind[state] == rest:
        return "D", state, False
    if INSERT + before[FORCED[state]] == rest:
        return "I", FORCED[state], True
    for letter, cost, after in others:
        if cost + behind[after] == rest:
            return letter, after, False
    raise AssertionError("no edit reaches the cheapest cost")


@lru_cache(maxsize=200_000)
def _short(symbols: str) -> tuple[str, int]:
    return unroll(symbols)[0], to_go(symbols, END)[0][0]


def solve(symbols: str) -> tuple[str, int]:
    """The audit of a whole conversation and its cost."""
    if len(symbols) <= 32:
        return _short(symbols)
    return unroll(symbols)[0], to_go(symbols, END)[0][0]


class Faults:
    """The symbols of rows one after another, and what the report counts."""

    def __init__(self, seen: Iterable[tuple[int, int]] = ()) -> None:
        self.seen = set(seen)
        self.symbols: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.days = 0
        self.first = self.last = ""
        self.lowest = self.highest = None

    def add(self, turn: int | None, role: str, text: str, digest: tuple[int, int]) -> None:
        body, initial = text.rstrip(SPACES), role[:1]
        again = digest in self.seen
        self.seen.add(digest)
        symbol = initial if initial in ("s", "u", "a") else "o"
        if not body:
            self.blank, symbol = self.blank + 1, DOOMED
        elif again:
            self.duplicate, symbol = self.duplicate + 1, DOOMED
        elif body[-1] not in ".!?":
            self.truncated, symbol = self.truncated + 1, symbol.upper()
        if self.symbols:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.last = initial
        self.symbols.append(symbol)
        if turn is not None and turn != self.highest:  # turns come in ascending order
            self.days += 1
            self.lowest = turn if self.lowest is None else self.lowest
            self.highest = turn

    def gaps(self) -> int:
        return 0 if self.lowest is None else self.highest - self.lowest + 1 - self.days


def apply(audit: str, rows: Sequence[tuple[str, str]], state: int = 0) -> list[tuple[str, str]]:
    """The rows after the edits of an audit, ``(role, text)`` each."""
    found, ahead = [], iter(rows)
    for letter in audit:
        if letter == "I":
            state = FORCED[state]
            found.append((ROLE_OF[state], ""))
            continue
        role, text = next(ahead)
        if letter == "K":
            state = FOLLOWS[state][role[0]]
            found.append((role, text))
        elif letter == "R":
            state = FORCED[state]
            found.append((ROLE_OF[state], text))
    return found


ROW = "struct<turn: bigint, role: string, text: string, h1: bigint, h2: bigint>"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPAIRED = "audit string, repaired array<struct<role: string, text: string>>"


def _schema(kind: T.DataType, columns: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(columns).fields])


def _mapped(
    rows: DataFrame, columns: str, work: Callable[[Iterator[tuple]], Iterable[tuple]], at_once: int = 512
) -> DataFrame:
    """Rows of a partition, as tuples and in their order, to rows of other columns."""
    ship(rows.sparkSession)
    schema = _schema(rows.schema["conv_id"].dataType, columns)
    arrow = to_arrow_schema(schema)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tuples = chain.from_iterable(zip(*(c.to_pylist() for c in batch.columns)) for batch in batches)
        held = []

        def packed() -> pa.RecordBatch:
            columns = [pa.array(c, field.type) for c, field in zip(zip(*held), arrow)]
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for found in work(tuples):
            held.append(found)
            if len(held) >= at_once:
                yield packed()
                held.clear()
        if held:
            yield packed()

    return rows.mapInArrow(mapped, schema)


def _chunks(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[2])
        if len(held) >= CHUNK_ROWS or chars >= CHUNK_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _solve_inside(tuples: Iterator[tuple]) -> Iterator[tuple]:
    """Conversations inside a partition as results, those at its ends and long ones as chunks."""
    place = TaskContext.get().partitionId() << 32
    held, first = None, True

    def opened(key, chunks: Iterable[list[tuple]]) -> Iterator[tuple]:
        nonlocal place
        for chunk in chunks:
            rows = [dict(zip(("turn", "role", "text", "h1", "h2"), row)) for row in chunk]
            yield (key, place, rows, *[None] * (len(COUNTS) + 2))
            place += 1

    for key, rows in groupby(tuples, itemgetter(0)):
        chunks = _chunks(row[1:] for row in rows)
        chunk = next(chunks)
        following = next(chunks, None)
        if held is not None:
            yield _result(*held)
            held = None
        if first or following is not None:
            yield from opened(key, chain([chunk], [following] if following else [], chunks))
        else:
            held = (key, chunk)
        first = False
    if held is not None:
        yield from opened(held[0], [held[1]])


def _result(key, rows: list[tuple]) -> tuple:
    faults = Faults()
    for turn, role, text, h1, h2 in rows:
        faults.add(turn, role, text, (h1, h2))
    audit, cost = solve("".join(faults.symbols))
    counts = (faults.gaps(), faults.blank, faults.duplicate, faults.truncated, faults.illegal, cost)
    repaired = apply(audit, [row[1:3] for row in rows])
    return (key, -1, None, *counts, audit, [{"role": r, "text": t} for r, t in repaired])


CHUNK = (
    "place bigint, symbols string, first string, last string, blank bigint, duplicate bigint, "
    "truncated bigint, illegal bigint, lowest bigint, highest bigint, days bigint"
)


def _summed(tuples: Iterator[tuple]) -> Iterator[tuple]:
    """A chunk's symbols and counts, given what earlier chunks have said already."""
    for key, place, rows, seen in tuples:
        faults = Faults((s["h1"], s["h2"]) for s in seen or ())
        for row in rows:
            faults.add(row["turn"], row["role"], row["text"], (row["h1"], row["h2"]))
        yield (
            key, place, "".join(faults.symbols), faults.first, faults.last,
            faults.blank, faults.duplicate, faults.truncated, faults.illegal,
            faults.lowest, faults.highest, faults.days,
        )


def _backwards(tuples: Iterator[tuple]) -> Iterator[tuple]:
    """Chunk transitions, the last chunk first, to the costs still to be paid behind each chunk."""
    for key, chunks in groupby(tuples, itemgetter(0)):
        after, last = END, True
        for _, place, flat in chunks:
            before = _advance(tuple(tuple(flat[4 * i : 4 * i + 4]) for i in STATES), after)
            yield key, place, list(after), last, before[0]
            after, last = before, False


def _ends(tuples: Iterator[tuple]) -> Iterator[tuple]:
    for key, place, symbols, after, last in tuples:
        yield key, place, [unroll(symbols, s, tuple(after), last)[1] for s in STATES]


def _forwards(tuples: Iterator[tuple]) -> Iterator[tuple]:
    """The state every chunk begins in; the conversation's counts come with its last chunk."""
    for key, chunks in groupby(tuples, itemgetter(0)):
        state, cost, last_initial, turn = 0, None, None, None
        lowest, days = None, 0
        sums = [0, 0, 0, 0]
        for row in chunks:
            (_, place, ends, last, whole, first, last_of, *counts, low, high, its_days) = row
            cost = whole if cost is None else cost
            sums = [a + b for a, b in zip(sums, counts)]
            if last_initial is not None:
                sums[3] += last_initial + first not in LEGAL
            if low is not None:
                days += its_days - (low == turn)
                lowest = low if lowest is None else lowest
                turn = high
            gaps = 0 if lowest is None else turn - lowest + 1 - days
            yield (key, place, state, *((gaps, *sums, cost) if last else [None] * 6))
            state, last_initial = ends[state], last_of


def _edited(tuples: Iterator[tuple]) -> Iterator[tuple]:
    for key, place, rows, symbols, after, last, state, *counts in tuples:
        audit, _ = unroll(symbols, state, tuple(after), last)
        repaired = apply(audit, [(row["role"], row["text"]) for row in rows], state)
        yield (key, place, *counts, audit, [{"role": r, "text": t} for r, t in repaired])


def _spread(rows: DataFrame, *, by: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    dealt = rows.repartition(*by)
    return dealt.sortWithinPartitions(*order) if order else dealt


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """Chunks with what else is known of them; the key may be null."""
    its = right.withColumnsRenamed({"conv_id": "its_id", "place": "its_place"})
    same = F.col("conv_id").eqNullSafe(F.col("its_id")) & (F.col("place") == F.col("its_place"))
    return left.join(its, same, "left").drop("its_id", "its_place")


def _solve_chunks(chunks: DataFrame) -> DataFrame:
    """The pieces of conversations that lie in several chunks."""
    # A digest is met at most once per chunk from here on, however often its rows repeat it.
    digests = chunks.select("conv_id", "place", F.explode("rows").alias("row")).select(
        "conv_id", "place", F.col("row.h1").alias("h1"), F.col("row.h2").alias("h2")
    ).distinct()
    firsts = digests.groupBy("conv_id", "h1", "h2").agg(F.min("place").alias("first_place"))
    its = firsts.withColumnsRenamed({"conv_id": "its_id", "h1": "its_h1", "h2": "its_h2"})
    same = (
        F.col("conv_id").eqNullSafe(F.col("its_id"))
        & (F.col("h1") == F.col("its_h1"))
        & (F.col("h2") == F.col("its_h2"))
    )
    seen = (
        digests.join(its, same)
        .where(F.col("place") > F.col("first_place"))
        .groupBy("conv_id", "place")
        .agg(F.collect_list(F.struct("h1", "h2")).alias("seen"))  # at most a chunk's rows
    )
    known = _joined(chunks.select("conv_id", "place", "rows"), seen)
    summed = staged(_mapped(known.select("conv_id", "place", "rows", "seen"), CHUNK, _summed), "chunks")

    def moved(tuples: Iterator[tuple]) -> Iterator[tuple]:
        for key, place, symbols in tuples:
            yield key, place, list(chain.from_iterable(transition(symbols)))

    moves = _mapped(summed.select("conv_id", "place", "symbols"), "place bigint, moves array<bigint>", moved)
    later_first = [F.col("conv_id"), F.col("place").desc()]
    costs = staged(
        _mapped(
            _spread(moves, by=["conv_id"], order=later_first),
            "place bigint, after array<bigint>, ends_here boolean, whole bigint",
            _backwards,
        ),
        "costs",
    )
    known = _joined(summed.select("conv_id", "place", "symbols"), costs).select(
        "conv_id", "place", "symbols", "after", "ends_here"
    )
    ends = _mapped(_spread(known, by=["conv_id", "place"]), "place bigint, ends array<int>", _ends)
    known = _joined(_joined(ends, costs), summed.drop("symbols")).select(
        "conv_id", "place", "ends", "ends_here", "whole", "first", "last",
        "blank", "duplicate", "truncated", "illegal", "lowest", "highest", "days",
    )
    starts = _mapped(
        _spread(known, by=["conv_id"], order=["conv_id", "place"]),
        "place bigint, state int, " + ", ".join(f"{name} bigint" for name in COUNTS),
        _forwards,
    )
    known = _joined(
        _joined(_joined(chunks.select("conv_id", "place", "rows"), summed.select("conv_id", "place", "symbols")), costs),
        starts,
    ).select("conv_id", "place", "rows", "symbols", "after", "ends_here", "state", *COUNTS)
    columns = "place bigint, " + ", ".join(f"{name} bigint" for name in COUNTS) + ", " + REPAIRED
    return _mapped(known, columns, _edited, at_once=1)


def repair(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The repaired conversations in pieces: ``(conv_id, place, counts, audit, repaired)``.

    A piece has the audit and the repaired rows of a stretch of one conversation; ``place`` orders
    a conversation's pieces and is -1 for one that has no other. Nearly all have one; the counts come with the last piece and are null
    in the others. Rows are taken by turn, nulls first, those of one turn by role and a hash of the
    text, so that equal rows are neighbours. A null role or text is one space, a null key is a
    conversation of its own, an empty table gives no row, and other columns are not read.

    The cheapest edits (delete 2, insert 5, another role 1, an undeleted truncated row 5; blank
    and duplicate rows must go) give a system's turn or none, then user and assistant in turn, or
    nothing at all.
    """
    said, who = F.coalesce(F.col(text), F.lit(" ")), F.coalesce(F.col(role), F.lit(" "))
    plain = rows.select(
        F.col(key).alias("conv_id"), F.col(turn).cast("long").alias("turn"), who.alias("role"), said.alias("text")
    ).withColumns(
        {
            "h1": F.xxhash64("role", "text"),
            "h2": F.xxhash64(F.lit(1), "text", "role"),
            "nr": F.monotonically_increasing_id(),
        }
    )
    order = ["conv_id", "turn", "role", "h1", "h2", "nr"]
    placed = plain.repartitionByRange(*order).sortWithinPartitions(*order).drop("nr")
    counts = ", ".join(f"{name} bigint" for name in COUNTS)
    first = staged(
        _mapped(placed, f"place bigint, rows array<{ROW}>, {counts}, {REPAIRED}", _solve_inside),
        "conversations",
    )
    whole = first.where("rows IS NULL").drop("rows")
    return whole.unionByName(staged(_solve_chunks(first.where("rows IS NOT NULL")), "pieces"))


def _digested(tuples: Iterator[tuple]) -> Iterator[tuple]:
    """Audits and hashes of conversations whose pieces come one after another."""
    for key, pieces in groupby(tuples, itemgetter(0)):
        letters, digest, begun, counts = [], sha256(), False, [0] * len(COUNTS)
        for _, _, audit, lines, *its in pieces:
            letters.append(audit)
            counts = its if its[0] is not None else counts
            if lines is not None:
                digest.update((("\n" if begun else "") + lines).encode())
                begun = True
        yield (key, *counts, "".join(letters), digest.hexdigest())


def reported(pieces: DataFrame) -> DataFrame:
    """One row per conversation: its counts, the whole audit and the hash of its repaired rows.

    The hash of a conversation in many pieces is streamed by one task, a piece at a time, as it is
    defined byte after byte.
    """
    line = F.transform("repaired", lambda row: F.concat(row["role"], F.lit(":"), row["text"]))
    lines = F.when(F.size("repaired") > 0, F.array_join(line, "\n")).alias("lines")
    known = pieces.select("conv_id", "place", "audit", lines, *COUNTS)
    counts = ", ".join(f"{name} bigint" for name in COUNTS)
    whole = known.where("place = -1")
    several = _mapped(
        _spread(known.where("place >= 0"), by=["conv_id"], order=["conv_id", "place"]),
        f"{counts}, audit string, repaired_sha256 string",
        _digested,
    )
    digest = F.sha2(F.coalesce("lines", F.lit("")).cast("binary"), 256).alias("repaired_sha256")
    return whole.select("conv_id", *COUNTS, "audit", digest).unionByName(several)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by a checksum of key and turn: ``(conv_id, turn, role, text)``.

    Of twenty values 0 drops the row, 1 empties the text, 2 removes its full stops, question and
    exclamation marks, 3 repeats the row and 4 makes it the user's. Nulls are one space.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    said = F.coalesce("text", F.lit(" "))
    fate = F.col("fate")
    return (
        rows.select("conv_id", "turn", "role", "text", (F.crc32(name.cast("binary")) % 20).alias("fate"))
        .where(fate != 0)
        .withColumn("copy", F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            "conv_id",
            "turn",
            F.when(fate == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
            F.when(fate == 1, "").when(fate == 2, F.translate(said, ".!?", "")).otherwise(said).alias("text"),
        )
    )


def with_lost(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Results with a row of zeros for every conversation of ``rows`` that has none."""
    its = found.withColumnRenamed("conv_id", "its_id")
    every = rows.select("conv_id").distinct()
    joined = every.join(its, F.col("conv_id").eqNullSafe(F.col("its_id")), "left").drop("its_id")
    nothing = F.lit(sha256(b"").hexdigest())
    return joined.select(
        "conv_id",
        *(F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in COUNTS),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
    )
