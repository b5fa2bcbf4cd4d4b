"""The registered queries over the text tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    binary,
    decontam,
    dialogue,
    language,
    linededup,
    mix,
    neardup,
    phrases,
    quality,
    shard,
    tokens,
    toxicity,
    warc,
)
from barloom.llm.common import staged, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TOKEN_LIMIT = 1024


def op1_shard_minimax(spark: SparkSession, folder: str) -> DataFrame:
    return shard.shard_by_bytes(table(spark, folder, "documents"), shards=8)


def op2_mix_curriculum(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix.mix(table(spark, folder, "documents"))
    order = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return (
        mixed.select("doc_id", "source", "size", "source_size", "target", "taken", "position")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )


def op3_bottom_k(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), width=3, percent=85)


def op4_quality_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(quality.ledger(table(spark, folder, "documents")), "2")


def quality_ablation(spark: SparkSession, folder: str) -> DataFrame:
    """What each rule of either policy removes, from one ledger that is written once."""
    rows = staged(quality.ledger(table(spark, folder, "documents")), "ledger")
    found = [
        quality.ablation(rows, policy).withColumn("policy", F.lit(policy)) for policy in quality.POLICIES
    ]
    return reduce(DataFrame.unionByName, found)


def op5_token_transducer(spark: SparkSession, folder: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, folder, "documents"), VOCABULARY)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_token_huffman(spark: SparkSession, folder: str) -> DataFrame:
    return binary.round_trip(spark, table(spark, folder, "documents"), VOCABULARY)


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontam.contaminated(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items")


def op8_toxicity_instances(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, folder, "documents"), min_chars=1, min_docs=10)
    digest = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return found.select("doc_id", "n_lines", "n_dropped", digest)


def op10_warc_index_first(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.archived(spark, table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_dialogue_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    pieces = dialogue.repair(dialogue.damaged(rows))
    return dialogue.with_lost(dialogue.reported(pieces), rows)


def op12_phrase_stripes(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


def op13_language_models(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_minimax": op1_shard_minimax,
    "op2_mix_curriculum": op2_mix_curriculum,
    "op3_bottom_k": op3_bottom_k,
    "op4_quality_ledger": op4_quality_ledger,
    "op5_token_transducer": op5_token_transducer,
    "op6_token_huffman": op6_token_huffman,
    "op7_decontaminate": op7_decontaminate,
    "op8_toxicity_instances": op8_toxicity_instances,
    "op9_line_dedup": op9_line_dedup,
    "op10_warc_index_first": op10_warc_index_first,
    "op11_dialogue_repair": op11_dialogue_repair,
    "op12_phrase_stripes": op12_phrase_stripes,
    "op13_language_models": op13_language_models,
    "quality_ablation": quality_ablation,
}
