"""WARC archives, index first.

Tasks write archives of gzipped records and, for every record, a row with its file, offset,
length, URL and digest. Readers pick rows of that index, sort them by file and offset, deal them
out by stretches of a file, and fetch neighbouring records with one read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import ship, staged
from barloom.llm.files import Writer, read_ranges
from barloom.sources.shared import new_folder

#: Fixed: what the format prescribes.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

INDEX = (
    "file string, offset long, length long, url string, digest string, page_id long, "
    "record_type string, refers_to long"
)
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str) -> str:
    """A value without the control characters that would end its line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool
) -> bytes:
    """One gzipped record: the page as an HTTP response, or a revisit of another one."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head = VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n"
    return gzip.compress(head + block + b"\r\n\r\n", compresslevel=3, mtime=0)


def parsed(record: bytes) -> dict:
    """A record's headers, payload and the length of the payload its HTTP head states."""
    data = zlib.decompress(record, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version.encode() != VERSION:
        raise ValueError(f"not a record: {version[:20]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return fields | {"payload": payload, "stated": stated}


def _number(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "none" else int(text)


def plan_records(
    pages: DataFrame, min_bytes: int = 0, key: str = "page_id", html: str = "html", url: str = "url"
) -> DataFrame:
    """Pages with their digest and, where another page holds the same payload, which it is.

    Of pages with one payload of at least ``min_bytes`` the largest key is the response. Pages
    without a key revisit it too, and are responses if no page of the group has a key.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        body.alias("payload"),
        F.sha1(body).alias("sha"),
    )
    large = F.octet_length("payload") >= min_bytes
    shared = (
        rows.where(large)
        .groupBy("sha")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("pages"))
        .where("pages > 1 AND original IS NOT NULL")
        .select("sha", "original")
    )
    refers = F.when(
        large & ~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")
    )
    return rows.join(shared, "sha", "left").select(
        "page_id", "url", "payload", refers.alias("refers_to")
    )


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = 256 << 20, **columns: str
) -> DataFrame:
    """Write every page as a record; returns the index, one row per record.

    Null pages are empty payloads, null URLs leave the header out, repeated rows become records
    of their own, an empty table writes no archive. An archive holds up to ``file_bytes``.
    """
    ship(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                payload = row["payload"]
                digest = digest_of(payload)
                revisit = row["refers_to"] is not None
                data = record_bytes(row["page_id"], row["url"], payload, digest, row["refers_to"], revisit)
                if out is None or out.length + len(data) > file_bytes:
                    if out is not None:
                        out.close()
                    out = Writer(folder, ".warc.gz")
                found.append(
                    {
                        "file": out.name,
                        "offset": out.write(data),
                        "length": len(data),
                        "url": row["url"],
                        "digest": digest,
                        "page_id": row["page_id"],
                        "record_type": "revisit" if revisit else "response",
                        "refers_to": row["refers_to"],
                    }
                )
            yield pa.RecordBatch.from_pylist(found, schema=index_schema)
        if out is not None:
            out.close()

    index_schema = pa.schema(
        [
            ("file", pa.string()),
            ("offset", pa.int64()),
            ("length", pa.int64()),
            ("url", pa.string()),
            ("digest", pa.string()),
            ("page_id", pa.int64()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
        ]
    )
    records = plan_records(pages, min_bytes, **columns)
    return staged(records.mapInArrow(write, INDEX), "warc-index")


def read_records(
    index: DataFrame,
    folder: str,
    stretch: int = 4 << 20,
    gap: int = 64 << 10,
    payloads: bool = True,
) -> DataFrame:
    """The records that rows of the index name, read back from the archives.

    Each payload is checked against the digest in its header. Rows are dealt out by stretches of
    a file, so that neighbours are read together and no task needs a whole archive.
    """
    ship(index.sparkSession)
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload", pa.binary()),
        ]
    )

    def records(data: Iterator[bytes]) -> Iterator[dict]:
        for raw in data:
            got = parsed(raw)
            digest = got["WARC-Payload-Digest"].removeprefix("sha1:")
            revisit = got["WARC-Type"] == "revisit"
            if not revisit and digest_of(got["payload"]) != digest:
                raise ValueError(f"payload of {got['WARC-Record-ID']} does not match its digest")
            yield {
                "page_id": _number(got["WARC-Record-ID"]),
                "url": got.get("WARC-Target-URI"),
                "payload_bytes": got["stated"],
                "payload_digest": digest,
                "record_type": got["WARC-Type"],
                "refers_to": _number(got["WARC-Refers-To"]) if revisit else None,
                "payload": got["payload"] if payloads and not revisit else None,
            }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("file", "offset", "length")
            ranges = zip(*(batch.column(name).to_pylist() for name in names))
            rows, held = [], 0
            for row in records(read_ranges(folder, ranges, gap, stretch)):
                rows.append(row)
                held += len(row["payload"] or b"")
                if held > stretch:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    place = F.floor(F.col("offset") / stretch).alias("place")
    tasks = (index.agg(F.sum("length")).first()[0] or 0) // stretch + 1
    return (
        index.select("file", "offset", "length", place)
        .repartition(tasks, "file", "place")
        .sortWithinPartitions("file", "offset")
        .select("file", "offset", "length")
        .mapInArrow(read, RECORDS)
    )


def archived(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages written to archives in the shared folder and read back without their payloads."""
    folder = new_folder(spark, "warc")
    index = write_archives(pages, folder, min_bytes)
    return read_records(index, folder, payloads=False)
