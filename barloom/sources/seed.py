"""The stock and pair lists a new warehouse starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom import schema as S


def stocks(spark: SparkSession) -> DataFrame:
    rows = [
        (number, symbol, symbol.removesuffix(S.SEED_SUFFIX), True)
        for number, symbol in enumerate(S.SEED_SYMBOLS, start=1)
    ]
    return spark.createDataFrame(rows, S.STOCKS)


def stock_pairs(spark: SparkSession) -> DataFrame:
    ids = {symbol: number for number, symbol in enumerate(S.SEED_SYMBOLS, start=1)}
    rows = []
    for number, name in enumerate(S.SEED_PAIRS, start=1):
        first, second = (ids[side + S.SEED_SUFFIX] for side in name.split("-"))
        rows.append((number, name, first, second))
    return spark.createDataFrame(rows, S.STOCK_PAIRS)
