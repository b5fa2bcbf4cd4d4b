"""Small corpora with every awkward row: nulls, empty and long texts, ties, copies, odd columns."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "size long, shard int, target double, score double, words string, v long, id string"
)
SYLLABLES = ["ka", "lo", "mi", "ren", "su", "tor", "vel", "zan", "bri", "dox"]
SPACES = " \t\n\x0b\x0c\r"


def prose(rng: random.Random, words: int, line: int = 12) -> str:
    found = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(words)]
    lines = [" ".join(found[at : at + line]) for at in range(0, words, line)]
    return ".\n".join(lines)


def row(doc_id, text, source="a"):
    extra = (7, 7, 7.0, 7.0, "clash", 7, "clash")
    return (doc_id, text, "en", source, len(text or ""), *extra)


def odd_texts() -> list[str | None]:
    rng = random.Random(5)
    return [
        None,
        "",
        " \t\r\n ",
        "one",
        "two words",
        "Ünïcode ẞtraße 😀 日本語",
        prose(rng, 40),
        prose(rng, 400),
        prose(rng, 9000),
        "again and again " * 300,
        "x" * 50_000,
        "\n\n\nline\n  LINE \nline\r\n",
        "no\xa0break <|endoftext|> it's  done  ",
    ]


def odd_rows() -> list[tuple]:
    """Every odd text under its own key, once more under the same key, and without a key."""
    texts = odd_texts()
    rows = [row(10 + n, text, source="ab"[n % 2]) for n, text in enumerate(texts)]
    rows += [row(10 + n, text, source="ab"[n % 2]) for n, text in enumerate(texts)]
    rows += [row(None, text, source=None) for text in texts[:5]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words_of(text: str | None) -> list[str]:
    """By hand: words are what stands between the six ASCII white space characters."""
    found, word = [], ""
    for letter in (text or "") + " ":
        if letter in SPACES:
            if word:
                found.append(word)
            word = ""
        else:
            word += letter
    return found


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def documents(spark, folder="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{folder}/documents.parquet")
