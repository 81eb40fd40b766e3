"""WARC archives: written with an index first, read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, spread_join, stage_table

INDEX = "page_id long, url string, file string, offset long, length long, digest string, payload_bytes long, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _urn(*of: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, repr(of))}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, first: int | None, kind: str, date: str, place: str) -> tuple[bytes, str]:
    """One record as a gzip member, and the payload's digest in base32.

    A response's id follows from its page and payload, so that revisits can
    name it before it is written; a revisit's id follows from its own place.
    """
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = _HTTP + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id, digest) if kind == 'response' else _urn(place)}"]
    head += [f"WARC-Date: {date}"] + [f"X-Page-ID: {page_id}"] * (page_id is not None)
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(first, digest)}"]
        head += [f"X-Refers-To-Page: {first}"] * (first is not None)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    member = zlib.compressobj(1, zlib.DEFLATED, 31)
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return member.compress(raw) + member.flush(), digest


def parse_record(member: bytes) -> dict:
    """Headers and payload of a record; a response's digest and length are those of the bytes read."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    number = lambda text: None if text is None else int(text)
    digest, length = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    if payload is not None:
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged: its payload's digest is {found}, not {digest}")
        length = len(payload)
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number(fields.get("X-Page-ID")),
        "url": None if url is None else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url),
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("X-Refers-To-Page")),
        "payload_bytes": length,
        "payload_digest": digest,
        "payload": payload,
    }


def write_archives(pages: DataFrame, folder: str, *, min_bytes: int = 0, file_bytes: int = 256 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of (page_id, url, html) and return the index.

    Rows are grouped by the payload's SHA-256 to find the smallest page_id of
    equal payloads (pre-aggregated; the join deals payloads that very many rows
    share over several tasks). Each task writes its own files, under names no other attempt
    uses, and its index rows count only if the task commits, so a lost
    executor leaves at most an orphan file that no index row points to.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("k", F.unhex(F.sha2("payload", 256)))
    firsts = stage_table(rows.groupBy("k").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")), "warc-firsts")
    kind = F.when((F.length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), "revisit").otherwise("response")
    rows = spread_join(rows, firsts, ["k"], "n", ["page_id", "url"]).select("page_id", "url", "payload", "first", kind.alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        for b in batches:
            index = []
            for page_id, url, payload, first, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name, at = f"pages-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                member, digest = record_bytes(page_id, url, payload, first, k, date, f"{name} {at}")
                out.write(member)
                index.append((page_id, url, name, at, len(member), digest, len(payload), k))
                at += len(member)
                if at >= file_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_pylist([dict(zip(_INDEX_ARROW.names, r, strict=True)) for r in index], _INDEX_ARROW)
        if out is not None:
            out.close()

    return stage_table(rows.mapInArrow(run, INDEX), "warc-index")


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_INDEX_ARROW, _RECORD_ARROW = (pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in s.split(", ")]) for s in (INDEX, RECORD))


def read_records(index: DataFrame, folder: str, *, gap: int = 64 << 10, most: int = 4 << 20, task_bytes: int = 128 << 20) -> DataFrame:
    """The records that the rows of `index` point to, payloads included.

    Index rows are dealt out and sorted by file and offset, to so many tasks
    that each has about `task_bytes` of records to read, or less where that
    leaves cores without work; ranges that follow
    each other within `gap` bytes are fetched as one read of up to about
    `most` bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        opened: tuple = (None, None)

        def fetch(ranges: list[tuple[str, int, int]]) -> pa.RecordBatch:
            nonlocal opened
            name, low = ranges[0][:2]
            if opened[0] != name:
                if opened[1] is not None:
                    opened[1].close()
                opened = (name, fs.open_input_file(f"{root}/{name}"))
            opened[1].seek(low)
            data = opened[1].read(ranges[-1][1] + ranges[-1][2] - low)
            return pa.RecordBatch.from_pylist([parse_record(data[o - low : o - low + n]) for _, o, n in ranges], _RECORD_ARROW)

        run: list[tuple[str, int, int]] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if run and (r[0] != run[-1][0] or r[1] - run[-1][1] - run[-1][2] > gap or r[1] - run[0][1] > most):
                    yield fetch(run)
                    run = []
                run.append(r)
        if run:
            yield fetch(run)
        if opened[1] is not None:
            opened[1].close()

    total = index.agg(F.sum("length")).first()[0] or 0
    n_tasks = max(1, -(-total // task_bytes), min(-(-total // most), 2 * index.sparkSession.sparkContext.defaultParallelism))
    wanted = index.select("file", "offset", "length").repartitionByRange(n_tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Write all pages as WARC records in the shared folder and read them back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to.
    Defined cases: a null html is an empty payload; a null url gives a record
    without target; rows that repeat the smallest page_id of a payload are all
    responses; a null page_id never is the smallest, so it revisits the others
    (payloads that only null ids have are responses); other columns are
    ignored; an empty table gives an empty result.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder, min_bytes=min_bytes)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def query(spark, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first,
         list_aggregate(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + ((CAST('0x' || substr(sha1(coalesce(html, '')), CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS INTEGER)
                        >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), 'string_agg', '') AS payload_digest
  FROM pages)
"""
