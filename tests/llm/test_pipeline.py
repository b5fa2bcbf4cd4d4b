from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import decontam, mix, neardup, toxicity
from barloom.llm.common import staged
from tests.llm.helpers import documents, frame, odd_rows, prose, row

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    """Each stage against a plain computation on its own input."""
    docs = documents(spark)
    columns = docs.columns
    kept = {}
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "near-duplicates", "decontamination", "mixing"):
        docs = staged(stages[name](spark, docs, FOLDER), "stage")
        assert docs.columns == columns
        kept[name] = [r.asDict() for r in docs.collect()]
        assert kept[name]
    marks = {r.doc_id for r in toxicity.score(documents(spark), spark.read.parquet(f"{FOLDER}/labels.parquet")).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in kept["toxicity"]} == marks

    from tests.llm.test_neardup import brute

    rows = [(r["doc_id"], r["text"]) for r in kept["toxicity"]]
    roots = {component for _, _, component in brute(rows, 5, 80)}
    assert {r["doc_id"] for r in kept["near-duplicates"]} == roots

    items = [decontam.normal(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in kept["decontamination"]}
    for r in kept["near-duplicates"]:
        data = decontam.normal(r["text"])
        if any(item in data for item in items):
            assert r["doc_id"] not in left

    sizes = {r["doc_id"]: r for r in kept["decontamination"]}
    for r in kept["mixing"]:
        assert r == sizes[r["doc_id"]]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(
        (r["doc_id"], zlib.crc32(np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()))
        for r in kept["mixing"]
    )
    final = stages["token files"](spark, docs, FOLDER).collect()
    assert sorted((r.doc_id, r.ids_crc32) for r in final) == want
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "token files"


def test_odd_rows_pass_every_stage(spark):
    wanted = list(corpus_pipeline.COLUMNS)
    docs = frame(spark, odd_rows())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, FOLDER), "stage")
        assert docs.columns == wanted
    assert docs.where(F.col("doc_id").isNull()).count() >= 1
    assert corpus_pipeline.write_token_files(spark, docs, FOLDER).count() == docs.count()


def test_near_copies_by_row(spark):
    """Keys that repeat over different texts, and copies without a key."""
    rng = random.Random(21)
    copied, own, other, keyless = (prose(rng, 60) for _ in range(4))
    rows = [row(1, copied), row(2, copied), row(2, own), row(2, own), row(3, other)]
    rows += [row(None, keyless), row(None, keyless), row(None, other), row(None, ""), row(None, "")]
    rows += [row(4, ""), row(4, ""), row(4, None, source="b")]
    rows += [row(6, keyless + " more", source="b"), row(6, keyless + " more", source="a")]
    kept = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), FOLDER).collect()
    got = sorted(((r.doc_id or 0, r.text or "", r.source) for r in kept))
    want = [(1, copied, "a"), (2, own, "a"), (3, other, "a"), (6, keyless + " more", "a")]
    assert got == sorted([*want, (0, keyless, "a"), (0, other, "a"), (0, "", "a"), (0, "", "a"), (4, "", "a")])


def test_empty_table_stays_empty(spark):
    docs = documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, FOLDER), "stage")
    assert docs.collect() == []


def test_token_files_stand_in_training_order(spark):
    """The files hold the copies by the positions that the mix gave them."""
    docs = documents(spark)
    mixed = staged(corpus_pipeline.mix_sources(spark, docs, FOLDER), "stage")
    found = corpus_pipeline.write_token_files(spark, mixed, FOLDER).collect()
    got = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    due = sorted((c.position, r.doc_id) for r in mix.mix(docs, whole=True).collect() for c in r.copies)
    assert got == [doc_id for _, doc_id in due]
    assert got != sorted(got)
    numbered = mix.mix(docs.repartition(3), whole=True).where("size(copies) = 2").count()
    assert numbered > 0 and len(got) > len(set(got))


def test_stages_discard_the_scratch_of_the_one_before(spark):
    from barloom.sources.shared import exists

    stages = dict(corpus_pipeline.STAGES)
    docs = staged(stages["mixing"](spark, documents(spark), FOLDER), "stage")
    names = list(corpus_pipeline._scratch[spark.sparkContext.applicationId])
    assert names and all(exists(spark, name) for name in names)
    assert staged(stages["token files"](spark, docs, FOLDER), "stage").count() == docs.count()
    assert not any(exists(spark, name) for name in names)
