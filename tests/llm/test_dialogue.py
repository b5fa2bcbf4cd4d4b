from __future__ import annotations

import random
import zlib
from hashlib import sha256

from barloom.llm import dialogue
from tests.llm.helpers import SPACES

SCHEMA = "conv_id long, turn long, role string, text string, place long, audit string, h1 string, cost double"
INITIALS = {"system": "s", "user": "u", "assistant": "a"}


def frame(spark, rows):
    return spark.createDataFrame([(*row, 7, "clash", "clash", 7.0) for row in rows], SCHEMA).repartition(3)


def cheapest(rows):
    """By hand: for every state the cheapest, least audit of the rows so far, with its result.

    ``rows`` are ``(role, text, fault)``; states are the last initial, insertions are tried up to two.
    """
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    forced = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def inserted(ways):
        found = dict(ways)
        for state, (cost, audit, out) in ways.items():
            for n in (1, 2):
                state = forced[state]
                cost, audit, out = cost + 5, audit + "I", (*out, f"{names[state]}:")
                found[state] = min(found.get(state, (9**9, "", ())), (cost, audit, out))
        return found

    for role, text, fault in rows:
        after = {}

        def take(state, way):
            after[state] = min(after.get(state, (9**9, "", ())), way)

        for state, (cost, audit, out) in inserted(best).items():
            take(state, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if role[:1] and role[:1] in follows[state]:
                take(role[0], (cost + more, audit + "K", (*out, f"{role}:{text}")))
            new = forced[state]
            take(new, (cost + more + 1, audit + "R", (*out, f"{names[new]}:{text}")))
        best = after
    return min(way for state, way in inserted(best).items() if state in ("", "a"))


def brute(rows):
    result = []
    for key in {row[0] for row in rows}:
        its = sorted(
            ((turn, role or " " if role is None else role, " " if text is None else text) for k, turn, role, text in rows if k == key),
            key=lambda r: (r[0] is not None, r[0] or 0, r[1]),
        )
        seen, marked, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in its:
            body = text.rstrip(SPACES)
            fault = "" if body and body[-1] in ".!?" else "truncated"
            fault = "blank" if not body else "duplicate" if (role, text) in seen else fault
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault))
        turns = {turn for turn, _, _ in its if turn is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(its, its[1:])]
        illegal = sum(pair not in ("su", "ua", "au") for pair in pairs)
        cost, audit, out = cheapest(marked)
        digest = sha256("\n".join(out).encode()).hexdigest()
        result.append((key, gaps, *counts.values(), illegal, cost, audit, digest))
    return sorted(result, key=str)


def check(spark, rows):
    found = dialogue.reported(dialogue.repair(frame(spark, rows))).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def some_rows(rng, key, n, texts=("One.", "Two?", "half", "", " \n", "Three! ", "é.", None)):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    return [(key, 2 * turn, rng.choice(roles), rng.choice(texts)) for turn in range(n)]


def test_symbols_against_all_ways():
    rng = random.Random(3)
    for _ in range(400):
        symbols = "".join(rng.choices("suaosUAOSx", k=rng.randint(0, 3)))
        symbols = "".join(c * rng.choice((1, 1, 2, 7)) for c in symbols)
        names = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
        rows = [(names[c.lower()], "", "blank" if c == "x" else "truncated" if c.isupper() else "") for c in symbols]
        cost, audit, out = cheapest(rows)
        assert dialogue.solve(symbols) == (audit, cost)
        edited = dialogue.apply(audit, [row[:2] for row in rows])
        assert tuple(f"{role}:{text}" for role, text in edited) == out
        at = rng.randint(0, len(symbols))
        whole = dialogue._times(dialogue.transition(symbols[:at]), dialogue.transition(symbols[at:]))
        assert dialogue._advance(whole, dialogue.END)[0] == cost


def test_many_conversations_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [row for key in range(60) for row in some_rows(rng, key, rng.randint(1, 9))]
    rows += some_rows(rng, None, 5) + [(70, None, "user", "no turn."), (70, 3, "assistant", "Yes.")]
    rows += [(71, None, "user", "x" * 200_000 + "."), (71, None, "user", None), (72, 1, "user", "Again.")]
    rows += [(72, 1, "user", "Again.")] * 3
    check(spark, rows)


def test_empty_table(spark):
    empty = frame(spark, [])
    found = dialogue.with_lost(dialogue.reported(dialogue.repair(dialogue.damaged(empty))), empty)
    assert found.collect() == []


def test_one_conversation_over_all_tasks(spark):
    rng = random.Random(5)
    texts = [f"Text {n % 20_000}{'.' if n % 3 else ''}" for n in range(60_000)]
    rows = some_rows(rng, 1, 40_000, texts) + some_rows(rng, 2, 30) + some_rows(rng, 0, 30)
    rows += [(1, 7, "user", "the same row.")] * 6_000
    check(spark, rows)
    pieces = dialogue.repair(frame(spark, rows)).where("conv_id = 1")
    assert pieces.count() > 8


def test_damage(spark):
    rows = [(key, turn, "user", "Well. Then? Yes!") for key in range(40) for turn in (None, 1, 2, 3)]
    rows += [(None, 5, None, None)]
    expected = []
    for key, turn, role, text in rows:
        name = ":".join(" " if value is None else str(value) for value in (key, turn))
        fate = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else text.translate(str.maketrans("", "", ".!?")) if fate == 2 else text
        expected += [(key, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    found = dialogue.damaged(frame(spark, rows)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    lost = dialogue.with_lost(dialogue.reported(dialogue.repair(frame(spark, []))), frame(spark, rows)).collect()
    assert len(lost) == 41
    assert {tuple(row)[1:] for row in lost} == {(0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())}
