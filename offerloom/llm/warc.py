"""Operator 1, WARC: archives of request, response or revisit, and metadata records; transaction assembly by WARC-Concurrent-To.

Writing: every page is one capture of three records. Equal payloads of at least REVISIT_BYTES are stored once, by the
capture with the largest page_id, and the others revisit it (identical-payload-digest profile, WARC-Refers-To). Which
page keeps a payload is a grouped maximum over SHA-1 digests, joined back on the digest; only (page_id, digest) pairs
and the pages' rows are shuffled, and that join's keys can be split where one payload is hot. Archives are gzip files
with one member for each record, written under a temporary name and renamed, so a repeated task is harmless.

Reading: archives are streamed record by record. Records meet on the id of the capture's main record (their own for a
response or revisit, WARC-Concurrent-To for the others), and each capture becomes one nested row; what a revisit refers
to is found through WARC-Refers-To among the captures.

Defined cases: a null html is an empty payload; a null url leaves out the target header; control characters of a url
are percent-encoded; rows that repeat a page_id and its payload share their record ids, and each gives its own
capture row; a null page_id is written as none and read back as null; an empty table
gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import scratch, table, written
from offerloom.llm.files import FileSet

REVISIT_BYTES = 1000
#: Bytes of records, before compression, after which an archive ends.
ARCHIVE_BYTES = 64 << 20
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "type string, record_id string, concurrent_to string, target string, date string, refers_to string, payload_digest string, payload_bytes long, page_id long, block_bytes long, archive string, at long"


def chosen(pages: DataFrame) -> DataFrame:
    """Pages with payload digest, and the page that keeps a payload which this one repeats (refers, null: it keeps it)."""
    page = pages.select(F.col("page_id").cast("long"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html").cast("long"))
    shared = page.where(f"size >= {REVISIT_BYTES}").groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1")
    shared = written(shared.select(F.unhex("digest").alias("key"), "keeper"), "shared-payloads")
    joined = page.join(shared, F.unhex("digest") == F.col("key"), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers"))


def _urn(kind: str, page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page}:{digest}')}>"


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in headers if v is not None), b"Content-Length: %d" % len(block)])
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def capture(page: object, url: str | None, html: str, digest: str, refers: int | None, date: str) -> list[bytes]:
    """The three records of a page: main record, request and metadata."""
    payload = html.encode()
    target = None if url is None else _clean(url)
    path = "/" + (target or "").split("://", 1)[-1].partition("/")[2]
    host = (target or "").split("://", 1)[-1].partition("/")[0]
    main = _urn("main", page, digest)
    sha1 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    shared = [("WARC-Date", date), ("WARC-Target-URI", target)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers is None:
        first = record([("WARC-Type", "response"), ("WARC-Record-ID", main), *shared, ("WARC-Payload-Digest", sha1), ("Content-Type", "application/http;msgtype=response")], http + payload)
    else:
        first = record([("WARC-Type", "revisit"), ("WARC-Record-ID", main), *shared, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn("main", refers, digest)), ("WARC-Payload-Digest", sha1), ("Content-Type", "application/http;msgtype=response")], http)
    ask = record([("WARC-Type", "request"), ("WARC-Record-ID", _urn("request", page, digest)), ("WARC-Concurrent-To", main), *shared, ("Content-Type", "application/http;msgtype=request")], f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    fields = "".join(f"{k}: {v}\r\n" for k, v in (("page-id", page), ("payload-bytes", len(payload))) if v is not None)
    about = record([("WARC-Type", "metadata"), ("WARC-Record-ID", _urn("metadata", page, digest)), ("WARC-Concurrent-To", main), *shared, ("Content-Type", "application/warc-fields")], fields.encode())
    return [first, ask, about]


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> list[str]:
    """Writes every page; returns the archives' names (one or a few for each task)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, part, n, names = FileSet(folder), TaskContext.get().partitionId(), 0, []
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers"))))
        row = next(rows, None)
        while row is not None:
            name, size = f"pages-{part:06d}-{n:04d}.warc.gz", 0
            with files.writing(name) as out:
                while row is not None and size < ARCHIVE_BYTES:
                    page, url, html, digest, refers = row
                    for raw in capture(page, url, html, digest, refers, date):
                        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                        out.write(deflate.compress(raw) + deflate.flush())
                        size += len(raw)
                    row = next(rows, None)
            names.append(name)
            n += 1
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string())})

    return sorted(r.name for r in chosen(pages).mapInArrow(write, "name string").collect())


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream; a record is held whole, never the archive."""
    held = b""
    while True:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            held = held or stream.read(1 << 20)
            if not held:
                if parts:
                    raise ValueError("an archive ends inside a record")
                return
            parts.append(inflate.decompress(held))
            held = inflate.unused_data
        yield b"".join(parts)


def parsed(raw: bytes) -> dict:
    """Headers and digests of one record; fields of a metadata record's block under their names."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    h = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    block = rest[: int(h["content-length"])]
    out = {"type": h["warc-type"], "record_id": h["warc-record-id"], "concurrent_to": h.get("warc-concurrent-to"), "target": h.get("warc-target-uri"), "date": h.get("warc-date"), "refers_to": h.get("warc-refers-to"), "block_bytes": len(block)}
    if out["type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        out |= {"payload_digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload)}
    elif "warc-payload-digest" in h:
        out["payload_digest"] = base64.b32decode(h["warc-payload-digest"].split(":", 1)[1]).hex()
    if out["type"] == "metadata":
        fields = dict(line.split(": ", 1) for line in block.decode().split("\r\n") if ": " in line)
        out |= {"page_id": int(fields["page-id"]) if "page-id" in fields else None, "payload_bytes": int(fields["payload-bytes"])}
    return out


def read_records(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """A row for each record of the archives."""
    fields = [f.split() for f in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = FileSet(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows: list[dict] = []
                with files.reading(name) as stream:
                    for at, raw in enumerate(members(stream)):
                        rows.append(parsed(raw) | {"archive": name, "at": at})
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pydict({f: pa.array([r.get(f) for r in rows], kinds[k]) for f, k in fields})
                            rows = []
                yield pa.RecordBatch.from_pydict({f: pa.array([r.get(f) for r in rows], kinds[k]) for f, k in fields})

    if not names:
        return spark.createDataFrame([], RECORD)
    return spark.createDataFrame([(n,) for n in names], "name string").repartition(len(names)).mapInArrow(read, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its main record joined with its request and metadata through WARC-Concurrent-To, and
    with the capture that it revisits (original) through WARC-Refers-To. Records are read more than once: a written table."""
    main = records.where("type in ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), F.struct(*[f.split()[0] for f in RECORD.split(", ")]).alias("main"))
    sides = records.where("concurrent_to is not null").groupBy(F.col("concurrent_to").alias("of")).agg(
        *[F.min(F.when(F.col("type") == kind, F.struct("record_id", "target", "date", "page_id", "payload_bytes", "block_bytes", "archive", "at"))).alias(kind) for kind in ("request", "metadata")]
    )
    captures = main.join(sides, F.col("capture_id") == F.col("of"), "left").drop("of")
    # the captures that others refer to, each once, so that one which very many revisit is one row of the join's side
    wanted = records.where("type = 'revisit'").select(F.col("refers_to").alias("wanted")).distinct()
    known = captures.select("capture_id", F.col("metadata.page_id").alias("page_id")).join(wanted, F.col("capture_id") == F.col("wanted"), "left_semi")
    known = written(known.groupBy("capture_id").agg(F.min("page_id").alias("page_id")).select(F.col("capture_id").alias("known_id"), "page_id"), "referred-captures")
    joined = captures.join(known, F.col("main.refers_to") == F.col("known_id"), "left")
    return joined.select("capture_id", "main", "request", "metadata", F.when(F.col("known_id").isNotNull(), F.struct(F.col("known_id").alias("record_id"), "page_id")).alias("original"))


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    captures = transactions(written(read_records(spark, folder, write_archives(table(spark, sf_dir, "pages"), folder)), "warc-records"))
    return captures.select(
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("main.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("main.payload_digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        F.col("original.page_id").alias("refers_to"),
    )


QUERIES = {"op1_warc_transactions": op1_warc_transactions}
SQL = {
    "op1_warc_transactions": """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
k AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k
"""
}
