"""A byte-pair tokenizer compiled into a deterministic transducer that emits token counts.

A sequence of tokens is what the merges make of a text exactly if each two neighbours are what
they make of those two, and every text has one such sequence. Reading bytes, the machine follows
all tokens that might be under way: where one ends next to a token it may follow, the prefix read
so far has its sequence. A state holds the last token of that sequence and, for each token under
way, the token before it, the place in the trie and its count against the whole prefix. States
are made when first reached; a transition is annotated with the tokens it adds, which may be
negative where a byte joins tokens. A chunk of a text is a map from states to states with counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import regex

from barloom.llm.units import Memo, units

#: Fixed: how the byte-level pre-tokenizer splits text before the merges.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: The last token and, for each under way, the token before it, its place in the trie, its count.
State = tuple[int, tuple[tuple[int, int, int], ...]]
#: From each state that something may begin in to the state it ends in and the tokens it adds.
StateMap = dict[State, tuple[State, int]]
START: State = (-1, ())


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write bytes as characters: printable ones as themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in shown]
    names = {chr(byte): byte for byte in shown}
    return names | {chr(256 + at): byte for at, byte in enumerate(hidden)}


class Machine:
    """The transducer of one vocabulary file, with at most ``limit`` transitions in memory."""

    def __init__(self, path: str, limit: int = 500_000) -> None:
        with open(path, encoding="utf-8") as source:
            config = json.load(source)
        byte = _byte_of_char()
        vocab = {
            bytes(byte[c] for c in token): number for token, number in config["model"]["vocab"].items()
        }
        self.bytes_of = {number: token for token, number in vocab.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(config["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = (bytes(byte[c] for c in part) for part in (a, b))
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
            self.made.setdefault(vocab[left + right], (rank, vocab[left], vocab[right]))
        self.single = [vocab[bytes([value])] for value in range(256)]
        self.specials = [t["content"] for t in config["added_tokens"] if t["special"]]
        self._split = (
            regex.compile("|".join(regex.escape(s) for s in self.specials)).split
            if self.specials
            else lambda text: [text]
        )
        self.longest = max(map(len, vocab))
        self._pieces = regex.compile(PATTERN).findall
        self.child: dict[int, int] = {}  # trie: node * 256 + byte -> node, 0 is the root
        self.token_at = [-1]
        for token, number in vocab.items():
            node = 0
            for value in token:
                step = node << 8 | value
                if step not in self.child:
                    self.child[step] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.child[step]
            self.token_at[node] = number
        self.valid: dict[int, bool] = {}
        self.known = Memo(lambda piece: self.count_piece(piece.encode()))
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.states = [START]
        self.number = {START: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def _number_of(self, state: State) -> int:
        number = self.number.get(state)
        if number is None:
            number = self.number[state] = len(self.states)
            self.states.append(state)
        return number

    def merged(self, data: bytes) -> list[int]:
        """The merges themselves, applied lowest rank first."""
        parts = [self.single[value] for value in data]
        while len(parts) > 1:
            best, where = None, 0
            for at, pair in enumerate(zip(parts, parts[1:])):
                found = self.merges.get(pair)
                if found is not None and (best is None or found < best):
                    best, where = found, at
            if best is None:
                break
            parts[where : where + 2] = [best[1]]
        return parts

    def alone(self, token: int) -> bool:
        """Whether the merges make this token of its own bytes."""
        known = self.valid.get(token)
        if known is None:
            known = self.valid[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def may_follow(self, before: int, token: int) -> bool:
        """Whether the merges leave a border between the two.

        Their merges are undone, the latest first; what touches the border then must not have a
        merge that comes before the one just undone. Of equal merges the left one comes first.
        """
        if not self.alone(token):
            return False
        left, right, limit = before, token, len(self.merges)
        while left >= 0:
            across = self.merges.get((left, right))
            if across is not None and across[0] < limit:
                return False
            made_left, made_right = self.made.get(left), self.made.get(right)
            if made_left is None and made_right is None:
                return True
            if made_right is None or (made_left is not None and made_left[0] > made_right[0]):
                limit, left = made_left[0], made_left[2]
            else:
                limit, right = made_right[0] + 1, made_right[1]
        return True

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """A transition made when first taken: the next state and the tokens it adds."""
        last, under_way = self.states[state]
        going, ended = [], None
        for before, node, count in (*under_way, (last, 0, 0)):
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            going.append((before, node, count))
            token = self.token_at[node]
            if token >= 0 and ended is None and self.may_follow(before, token):
                ended = (token, count + 1)
        token, added = ended
        target = (token, tuple((before, node, count - added) for before, node, count in going))
        number = self._number_of(target)
        move = self.moves[state << 8 | byte] = (number, added)
        return move

    def count_piece(self, data: bytes) -> int:
        return self.run(START, data)[1]

    def run(self, start: State, data: bytes) -> tuple[State, int]:
        """The state that bytes lead to from a state, and the tokens they add."""
        if len(self.moves) > self.limit:
            self._forget()
        moves, state, total = self.moves, self._number_of(start), 0
        for byte in data:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._step(state, byte)
            state, added = move
            total += added
        return self.states[state], total

    def run_all(self, starts: Iterable[State], data: bytes) -> StateMap:
        """``run`` from many states at once; those that have met go on as one."""
        live, at, block = {start: [(start, 0)] for start in starts}, 0, 4
        while at < len(data):
            met: dict[State, list[tuple[State, int]]] = {}
            for state, its in live.items():
                state, added = self.run(state, data[at : at + block])
                met.setdefault(state, []).extend((start, count + added) for start, count in its)
            live, at, block = met, at + block, min(2 * block, 256)
        return {start: (state, count) for state, its in live.items() for start, count in its}

    def pieces(self, text: str) -> list[str | None]:
        """What the pre-tokenizer makes of a text; none stands for a special string."""
        first, *others = self._split(text)
        found = self._pieces(first)
        for part in others:
            found += [None, *self._pieces(part)]
        return found

    def count_unit(self, text: str) -> int:
        """Tokens of a text by itself; special strings in it count as the one token they are."""
        if (text[1:] if text.startswith(" ") else text).isalpha():
            return self.count_piece(text.encode())
        if not any(special in text for special in self.specials):
            return sum(map(self.known.__getitem__, self._pieces(text)))
        return self.count_pieces(self.pieces(text))

    def count_pieces(self, pieces: list[str | None]) -> int:
        return sum(1 if piece is None else self.known[piece] for piece in pieces)


class Chunk(NamedTuple):
    """A stretch of a text. Its ends are borders of pieces, or lie within a piece (``from_inside``,
    ``to_inside``); then ``before`` is the text that leads to its first character."""

    body: str
    from_inside: bool
    to_inside: bool
    before: str


class TokenCounter:
    """Counts tokens of texts and of chunks of texts."""

    def __init__(self, path: str) -> None:
        self.machine = Machine(path)
        self.known = Memo(self.machine.count_unit)
        self.behind = Memo(self._states_behind, limit=1_000)
        specials = (f"(?={regex.escape(special)})" for special in self.machine.specials)
        self._places = regex.compile("|".join([self._borders, *specials])).finditer

    def count(self, text: str) -> int:
        return sum(map(self.known.__getitem__, units(text)))

    # Places where a piece always ends, whatever stands further away: behind letters, behind digits,
    # before white space, behind other signs that cannot begin a contraction, before the last of
    # several white spaces; special strings end the piece before them.
    _borders = (
        r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?=[\x20\x09-\x0D])"
        r"|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])|(?<=\s)(?=[\x20\x09-\x0D]\S)"
    )
    # Eight of a kind: the place between the fourth and the fifth lies within a piece.
    _alike = regex.compile(
        r"\p{L}{8}|\p{N}{8}|[^\s\p{L}\p{N}]{8}|[\x20\x09-\x0D]{8}"
    ).fullmatch

    def _splits_special(self, text: str, at: int) -> bool:
        """Whether a special string goes over a place, or follows one character behind it."""
        for special in self.machine.specials:
            found = text.find(special, max(0, at - len(special) + 1), at + 1 + len(special))
            if found >= 0 and found != at:
                return True
        return False

    def _border(self, text: str, at: int, size: int) -> tuple[int, bool]:
        """The next place from ``at`` on where a chunk may end, and whether it lies within a piece."""
        while at < len(text):
            upto = min(at + size, len(text))
            for match in self._places(text, at, upto):
                if not self._splits_special(text, match.start()):
                    return match.start(), False
            alike = at >= 4 and TokenCounter._alike(text, at - 4, at + 4)
            if alike and not self._splits_special(text, at):
                return at, True
            at = upto
        return len(text), False

    def cut(self, text: str, size: int) -> Iterator[Chunk]:
        """A text in chunks of about ``size`` characters, in one pass. Only a run of letters, digits,
        signs or white space of that length is cut within a piece."""
        start, inside, reach = 0, False, 2 * self.machine.longest
        while start < len(text):
            end, to_inside = self._border(text, start + size, size)
            before = text[max(0, start - reach) : start] if inside else ""
            yield Chunk(text[start:end], inside, to_inside, before)
            start, inside = end, to_inside

    def states_behind(self, before: str) -> set[State]:
        """The states a chunk may begin in: those that the text before it leads to, read from each
        of the places where a token that matters may have begun."""
        return self.behind[self.machine.pieces(before)[-1]]

    def _states_behind(self, last: str) -> set[State]:
        return {
            self.machine.run(START, last[at:].encode())[0]
            for at in range(min(len(last), self.machine.longest))
        }

    def chunk_map(self, chunk: Chunk) -> StateMap:
        """For each state the chunk may begin in, the state it ends in and the tokens it adds.

        At a border of pieces the machine is at its start. A chunk that begins within a piece is
        read from the states that may stand there; they soon meet.
        """
        machine, pieces = self.machine, self.machine.pieces(chunk.body)
        first = pieces.pop(0) if chunk.from_inside else None
        through = chunk.to_inside and not pieces
        last = pieces.pop().encode() if chunk.to_inside and pieces else b""
        end, count = machine.run(START, last)
        count += machine.count_pieces(pieces)
        if first is None:
            return {START: (end, count)}
        found = machine.run_all(self.states_behind(chunk.before), first.encode())
        if through:
            return found
        return {start: (end, added + count) for start, (_, added) in found.items()}

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """The map of two chunks in a row; associative. What leads to a state that ``b`` was not
        read from is left out."""
        return {
            start: (b[state][0], count + b[state][1]) for start, (state, count) in a.items() if state in b
        }

    def scan(self, maps: list[StateMap]) -> StateMap:
        """The map of many chunks, composed in pairs."""
        while len(maps) > 1:
            pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])]
            maps = pairs + maps[len(pairs) * 2 :]
        return maps[0]

    def total(self, whole: StateMap) -> int | None:
        """The tokens of a whole text; none if its chunks led to a state that was not foreseen."""
        return whole[START][1] if START in whole else None


def packed(found: StateMap) -> str:
    return json.dumps([(start, *end) for start, end in found.items()])


def unpacked(text: str) -> StateMap:
    def state(value: list) -> State:
        return value[0], tuple(map(tuple, value[1]))

    return {state(start): (state(end), count) for start, end, count in json.loads(text)}


@cache
def counter(path: str) -> TokenCounter:
    """One per Python worker, kept from task to task."""
    return TokenCounter(path)
