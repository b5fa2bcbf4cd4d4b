from __future__ import annotations

import gzip

import pytest

from barloom.llm import warc
from barloom.llm.files import opened
from barloom.sources.shared import new_folder

SCHEMA = "page_id long, url string, html string, digest string, file string, payload binary"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", b"clash") for r in rows], SCHEMA).repartition(3)


ROWS = [
    (1, "http://a/", "<p>one</p>"),
    (2, "http://b/\r\nX: y", "<p>one</p>"),
    (9, None, "<p>one</p>"),
    (4, "http://d/", None),
    (5, "http://e/", ""),
    (6, "http://f/", "ünï 😀" * 2000),
    (7, "http://g/", "\r\n\r\nWARC/1.1\r\n"),
    (None, "http://h/", "<p>one</p>"),
    (None, "http://i/", "nobody's"),
    (3, "http://j/", "twice"),
    (3, "http://j/", "twice"),
]


def expected(rows, min_bytes=0):
    best = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        if page_id is not None and len(body) >= min_bytes:
            best[body] = max(best.get(body, page_id), page_id)
    found = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        to = best.get(body) if len(body) >= min_bytes else None
        revisit = to is not None and to != page_id
        kind = "revisit" if revisit else "response"
        found.append((page_id, len(body), warc.digest_of(body), kind, to if revisit else None))
    return sorted(found, key=str)


@pytest.mark.parametrize("min_bytes", [0, 6])
def test_round_trip(spark, min_bytes):
    found = warc.archived(spark, pages(spark, ROWS), min_bytes).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=str) == expected(ROWS, min_bytes)


def test_index_and_selected_reads(spark):
    folder = new_folder(spark, "warc-test")
    index = warc.write_archives(pages(spark, ROWS), folder, file_bytes=400)
    rows = index.collect()
    assert len({r.file for r in rows}) > 1
    files, root = opened(folder)
    for r in rows:
        with files.open_input_file(f"{root}/{r.file}") as source:
            record = gzip.decompress(source.read_at(r.length, r.offset))
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    some = warc.read_records(index.where("page_id IN (1, 6, 9)"), folder, stretch=300).collect()
    payloads = {r.page_id: r.payload and r.payload.decode() for r in some}
    assert payloads == {1: None, 6: "ünï 😀" * 2000, 9: "<p>one</p>"}


def test_empty(spark):
    assert warc.archived(spark, pages(spark, [])).collect() == []


def test_damage_is_noticed(spark):
    whole = warc.record_bytes(1, "u", b"payload", warc.digest_of(b"other"), None, False)
    assert warc.parsed(whole)["payload"] == b"payload"
    with pytest.raises(Exception):
        warc.parsed(whole[:-20] + b"x" * 20)
