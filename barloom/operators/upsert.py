"""Keyed tables: last write wins, and which rows of a delivery are new."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import schema as S
from barloom.operators import validate


def one_per_key(
    rows: DataFrame, key: Sequence[str] = S.BAR_KEY, versioned: bool = False
) -> DataFrame:
    """One row per key from a delivery that may repeat keys.

    The highest ``version`` wins, as the sources number the rows in the order of arrival; each
    value is picked by it, which keeps the aggregate a hash aggregate. Rows without that column
    have no order of arrival, and the greater values win, so that the outcome never depends on how
    rows are dealt out. Copies are combined before the shuffle, so a key repeated without end
    still sends one row per task. ``versioned`` keeps the winner's version, null without one.
    """
    values = [name for name in rows.columns if name not in (*key, "version")]
    if "version" in rows.columns:
        picked = [F.max_by(name, "version").alias(name) for name in values]
        kept = [F.max("version").alias("version")] if versioned else []
        return rows.groupBy(*key).agg(*picked, *kept)
    best = F.max(F.struct(*values)).alias("best")
    found = rows.groupBy(*key).agg(best).select(*key, *(f"best.{name}" for name in values))
    return found.withColumn("version", F.lit(None).cast(S.VERSION)) if versioned else found


def merge(
    target: DataFrame, updates: DataFrame, key: Sequence[str] = S.BAR_KEY, marked: bool = False
) -> DataFrame:
    """The target with every updated key overwritten and every new key added.

    Both sides hold a key at most once. Without versions each value is picked by side, so the
    aggregate keeps plain numbers and stays a hash aggregate that combines before the shuffle.

    Where the target has a ``version``, an update that landed before the row it meets changes
    nothing, so that the same deliveries leave the same table in whatever order they are merged.
    An update without a version has no place in that order: it overwrites, and the row keeps its
    version, so that no delivery older than the overwritten one comes back. The rows of a key are
    ordered and the first is taken whole, as versions are too wide to be kept once for each value.
    ``marked`` adds ``altered``: whether a row is new or holds other values than the target's.
    """
    values = [name for name in target.columns if name not in (*key, "version")]
    both = target.withColumn("side", F.lit(0)).unionByName(updates.withColumn("side", F.lit(1)))
    if "version" not in target.columns:
        return both.groupBy(*key).agg(*(F.max_by(name, "side").alias(name) for name in values))
    # Of one version the update wins: the row was taken in again.
    blind = (F.col("side") == 1) & F.col("version").isNull()
    order = (blind.desc(), F.col("version").desc_nulls_last(), F.col("side").desc())
    ranked = Window.partitionBy(*key).orderBy(*order)

    def beaten(name: str) -> Column:
        return F.lead(name).over(ranked)

    added = {"rank": F.row_number().over(ranked), "its_version": F.coalesce("version", beaten("version"))}
    if marked:
        held = beaten("side") == 0
        for name in values:
            held = held & F.col(name).eqNullSafe(beaten(name))
        added["altered"] = (F.col("side") == 1) & ~F.coalesce(held, F.lit(False))
    found = both.withColumns(added).where("rank = 1").withColumn("version", F.col("its_version"))
    return found.select(*target.columns, *(["altered"] if marked else []))


def new_rows(
    updates: DataFrame, target: DataFrame, mode: str = "upsert", newest: DataFrame | None = None
) -> DataFrame:
    """The rows of a delivery that a load in ``mode`` stores.

    ``upsert`` stores all of them. ``global`` keeps rows after the newest day of the whole
    target, so a stock that lags behind is never filled. ``per_stock`` keeps rows after each
    stock's own newest day. An empty target makes every row new. ``newest`` is a one-row frame
    with the target's newest day, where that is known without reading the whole target.
    """
    marked = validate.newer(
        updates.withColumn("reason", F.lit(None).cast("string")), target, mode, newest
    )
    return marked.where(F.col("reason").isNull()).drop("reason")
