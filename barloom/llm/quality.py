"""Quality rules as a ledger: every rule is evaluated once, policies only look at its bits.

A text's measurements and a mask of the rules it fails are computed in one pass. A policy is a
version and a mask of the rules that count; applying one, comparing several, or asking what a
rule alone removes needs nothing but the stored bits.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import SPACES, let, words_of

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Fixed: each rule's name and when a text fails it. The order gives the bits.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("capitals", "2 * n_capitals > word_chars"),
)
BASE = ("few_words", "repeated_words")
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": BASE,
    "2": (*BASE, "symbols", "repeated_lines", "word_length", "capitals"),
}
MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_capitals",
)


def mask(names: tuple[str, ...]) -> int:
    return sum(1 << bit for bit, (name, _) in enumerate(RULES) if name in names)


def without(text: Column, characters: str) -> Column:
    """A text's length once these characters are taken out."""
    return F.char_length(F.translate(text, characters, ""))


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a window of ``width`` words that the text holds more than once.

    Windows are compared by a 64-bit hash. Sorting them by hash puts equal ones side by side;
    their positions, sorted again, cover the words counted.
    """

    def window(words: Column, at: Column) -> Column:
        parts = [F.get(words, (at + shift).cast("int")) for shift in range(width)]
        return F.struct(F.xxhash64(*parts).alias("h"), at.alias("at"))

    def positions(ordered: Column) -> Column:
        pairs = F.zip_with(
            ordered,
            F.slice(ordered, F.lit(2), F.size(ordered)),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])),
        )
        found = F.flatten(F.filter(pairs, lambda pair: pair.isNotNull()))
        return F.sort_array(F.array_distinct(found))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        return F.aggregate(
            at,
            start,
            lambda seen, now: F.struct(
                (seen["n"] + F.least(F.lit(width), now - seen["last"])).alias("n"),
                now.alias("last"),
            ),
            lambda seen: seen["n"],
        )

    def count(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(words) - width)
        ordered = F.sort_array(F.transform(starts, lambda at: window(words, at)))
        counted = let(ordered, lambda windows: covered(positions(windows)))
        return F.when(F.size(words) > width, counted).otherwise(F.lit(0))

    return let(words, count)


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: measurements and ``failed``, the mask of rules it fails.

    A null text counts as empty: no words, and so the first rule fails. Repeated rows are kept,
    the key may be null, an empty table gives no row, and other columns are not read.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    lines = F.filter(
        F.split(body, "\n"), lambda line: F.translate(line, SPACES, "") != ""
    )
    measured = (
        docs.select(F.col(key).alias("doc_id"), F.col(text).alias("body"))
        .withColumns(
            {
                "word_counts": let(
                    words_of(F.col("body")),
                    lambda words: F.struct(
                        F.size(words).alias("n"), repeated_words(words).alias("repeated")
                    ),
                ),
                "line_counts": let(
                    lines,
                    lambda found: F.struct(
                        F.size(found).alias("n"),
                        F.size(F.array_distinct(found)).alias("different"),
                    ),
                ),
                "n_chars": F.char_length(body),
            }
        )
        .select(
            "doc_id",
            F.col("word_counts.n").cast("long").alias("n_words"),
            without(body, SPACES).cast("long").alias("word_chars"),
            (F.col("n_chars") - without(body, SYMBOLS)).cast("long").alias("n_symbols"),
            (F.col("line_counts.n") - F.col("line_counts.different"))
            .cast("long")
            .alias("n_dup_lines"),
            F.col("word_counts.repeated").cast("long").alias("n_repeat_words"),
            F.col("line_counts.n").cast("long").alias("n_lines"),
            (F.col("n_chars") - without(body, UPPER)).cast("long").alias("n_capitals"),
        )
    )
    bits = (
        F.when(F.expr(failing), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
        for bit, (_, failing) in enumerate(RULES)
    )
    return measured.withColumn("failed", reduce(Column.bitwiseOR, bits))


def judged(rows: DataFrame, policy: str) -> DataFrame:
    """A ledger with ``base_failed`` and the verdict ``kept`` of a policy."""
    def fails(names: tuple[str, ...]) -> Column:
        return F.col("failed").bitwiseAND(F.lit(mask(names))) != 0

    return rows.withColumns(
        {"base_failed": fails(BASE), "kept": ~fails((*BASE, *POLICIES[policy]))}
    )


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents failing it, and documents that it alone removes.

    The ledger is first counted by mask, so that a few dozen rows are left for the rules.
    """
    used = mask(POLICIES[policy])
    patterns = rows.groupBy("failed").agg(F.count("*").alias("n"))
    rules = F.array(
        *(
            F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("bit"))
            for bit, (name, _) in enumerate(RULES)
            if name in POLICIES[policy]
        )
    )
    each = patterns.select("n", F.col("failed").bitwiseAND(F.lit(used)).alias("mask"), F.explode(rules).alias("r"))
    fails = F.col("mask").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("mask") == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("only_by_it"),
    )
