"""A lookup join that stays even when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A salted join spreads the rows of one key over this many join keys.
SALTS = 32


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    spread_by: Column,
    how: str = "inner",
    salted: bool = False,
) -> DataFrame:
    """Join many facts to a narrow lookup on one key.

    Spark broadcasts the lookup while its size is under ``spark.sql.autoBroadcastJoinThreshold``
    and sorts and merges beyond it; nothing is counted while the query is defined. ``salted`` is
    for a lookup too long for that whose keys are uneven: every lookup row is repeated once per
    salt and every fact is given one salt from ``spread_by``, which must not change when a task is
    run again. A fact meets each of its lookup rows exactly once either way.
    """
    if not salted:
        return facts.join(lookup, key, how)
    salt = F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    repeated = lookup.withColumn("salt", copies).hint("merge")
    return facts.withColumn("salt", salt).join(repeated, [key, "salt"], how).drop("salt")
