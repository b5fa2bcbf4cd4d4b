"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule: a level that changes linearly between knots of training time.
Its integral, scaled to the source's target, is the demand in words up to a time. Documents of a
source are lined up in the order of a hash, repeated as often as the target asks, and a document
that begins after so many words is due at the time when the demand reaches them. Sorting all
copies by that time gives the training order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import count_words

Schedule = Sequence[tuple[float, float]]

WEIGHTS = (5, 2, 1)
#: Knots ``(time, level)``: heavy sources fade out, light ones fade in.
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)),
)


def due(share: Column, schedule: Schedule) -> Column:
    """The time at which a share (0 to 1) of the schedule's integral is reached."""
    areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(schedule, schedule[1:])]
    whole, done, found = math.fsum(areas), 0.0, F.lit(float(schedule[-1][0]))
    steps = []
    for area, (t0, a), (t1, b) in zip(areas, schedule, schedule[1:]):
        steps.append((done, done + area, t0, a, (b - a) / (t1 - t0)))
        done += area
    for start, end, t0, level, slope in reversed(steps):
        beyond = share * F.lit(whole) - F.lit(start)
        root = F.sqrt(F.lit(level * level) + F.lit(2 * slope) * beyond)
        inside = F.lit(t0) + F.lit(2.0) * beyond / (F.lit(level) + root)
        found = F.when(share * F.lit(whole) < F.lit(end), inside).otherwise(found)
    return found


def targets(
    sizes: DataFrame, weights: Sequence[float], budget: float, repeats: float
) -> DataFrame:
    """``(source, source_size, kind, target)`` from one row ``(source, source_size)`` per source.

    Sources take the weights in turn, by code point, null last. Each gets its weight's share of
    ``budget`` times all words, but at most ``repeats`` times its own; what is cut off goes to the
    others by weight. That is the highest water level at which the targets fill the budget.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kind = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("kind") + 1)
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.lit(budget) * F.sum("source_size").over(everything)
    rest = wanted - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))
    later = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(earlier), F.lit(0.0)
    )
    return (
        sizes.withColumn("kind", kind)
        .withColumn("weight", weight)
        .withColumn("most", F.lit(repeats) * F.col("source_size"))
        .withColumn("level", rest / later)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(F.col("most"), F.col("weight") * F.col("level")))
        .select("source", "source_size", "kind", "target")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Schedule] = SCHEDULES,
    budget: float = 1.5,
    repeats: int = 2,
    whole: bool = False,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    carried: Sequence[str] = (),
    size: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: how often and when the mix takes it.

    ``copies`` holds ``(position, words)`` of every copy taken, ``taken`` the sum of the words.
    The last copy of a source is cut to the words still missing, so that a source gives its
    target to the word; with ``whole`` a copy is taken as a whole if its middle lies before the
    target. A null source is a source, a null text has no words and is never taken, repeated rows
    stand behind one another, and an empty table gives no row. Columns named in ``carried`` are
    kept, others are not read. Where the words have been counted, ``size`` names their column; the
    text is not read then, and rows of one key are told apart by what is carried.
    """
    words = count_words(F.col(text)) if size is None else F.col(size)
    same = F.xxhash64(text) if size is None else F.xxhash64(*carried)
    name = F.coalesce(F.col(key).cast("string"), same.cast("string"))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        words.alias("size"),
        F.md5(name.cast("binary")).alias("turn"),
        same.alias("same"),
        *(F.col(name).alias(f"carried_{name}") for name in carried),
    ).withColumn("bucket", F.substring("turn", 1, 3))

    # Words before each bucket of a source, so that no window ever holds a whole source.
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket")
    starts = buckets.select(
        F.col("source").alias("of"),
        F.col("bucket").alias("its"),
        (F.sum("words").over(earlier) - F.col("words")).alias("start"),
    )
    sizes = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    goals = targets(sizes, weights, budget, repeats).withColumnRenamed("source", "of_goal")

    behind = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size", "same")
    begin = F.col("start") + F.sum("size").over(
        behind.rowsBetween(Window.unboundedPreceding, 0)
    ) - F.col("size")
    lined = (
        rows.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("its")))
        .withColumn("begin", begin)
        .join(goals, F.col("source").eqNullSafe(F.col("of_goal")))
    )
    goal = F.floor(F.col("target") + 0.5).cast("long")

    def copy(number: int) -> Column:
        first = F.col("begin") + F.col("source_size") * number
        left = goal - first
        if whole:
            words = F.when(2 * left >= F.col("size"), F.col("size")).otherwise(F.lit(0))
        else:
            words = F.greatest(F.lit(0), F.least(F.col("size"), left))
        share = F.least(first / F.col("target"), F.lit(1.0))
        position = F.lit(None).cast("double")
        for kind, schedule in enumerate(schedules):
            position = F.when(F.col("kind") == kind, due(share, schedule)).otherwise(position)
        taken = F.when(F.col("size") > 0, words).otherwise(F.lit(0)).cast("long")
        return F.struct(position.alias("position"), taken.alias("words"))

    copies = F.filter(F.array(*(copy(n) for n in range(repeats))), lambda c: c["words"] > 0)
    return lined.withColumn("copies", copies).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.aggregate(
            "copies", F.lit(0).cast("long"), lambda total, c: total + c["words"]
        ).alias("taken"),
        F.get(F.transform("copies", lambda c: c["position"]), F.lit(0)).alias("position"),
        "copies",
        *(F.col(f"carried_{name}").alias(name) for name in carried if name not in ("doc_id", "source")),
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy that the mix takes, range-sorted by its position in training."""
    copies = mixed.withColumn("taken_copy", F.explode("copies")).withColumns(
        {"position": F.col("taken_copy.position"), "words": F.col("taken_copy.words")}
    )
    order = [F.col("position"), F.col("doc_id")]
    return (
        copies.drop("copies", "taken_copy", "taken")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )
