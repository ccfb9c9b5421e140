"""WARC archives with revisit resolution.

Headers alone (page_id, url, digest, size) are shuffled by payload digest; of equal
payloads the capture with the largest page_id keeps its payload, the others become
revisit records that refer to it, written with fresh headers.  Archives are .warc.gz
streams with one gzip member per record.  Spark's text writer writes them, so any
store that Spark reaches will do: a row is a run of whole records of about ROW_BYTES,
its last byte is zero (records end in a member of less than 16 MiB), so the rows
leave it out and the writer's separator is "\\0".  A file holds ROWS_PER_FILE rows,
so its size is bounded by bytes and not by records; only a record of more than
ROW_BYTES compressed bytes makes a larger row, alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, written

MIN_PAYLOAD = 0  # bytes; smaller payloads are always stored
ROW_BYTES = 2 << 20  # compressed bytes of records in a row of the writer
ROWS_PER_FILE = 16
MEMBER = 8 << 20  # bytes of a record per gzip member
_CHUNK = 64 << 10  # compressed bytes read at a time
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SAFE = "!#$%&'()*+,/:;=?@[]~-._"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, date: str = DATE) -> bytes:
    """One record; with ``refers_to`` a revisit without payload."""
    digest = base32_sha1(payload)
    target = quote(url, safe=_SAFE) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-Id: {refers_to}"]
        if refers_url:
            head.append(f"WARC-Refers-To-Target-URI: {quote(refers_url, safe=_SAFE)}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_members(record: bytes) -> bytes:
    """The record as gzip members (more than one only beyond MEMBER bytes); the last byte is zero."""
    out = []
    for at in range(0, len(record), MEMBER):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(c.compress(record[at : at + MEMBER]) + c.flush())
    return b"".join(out)


def resolve_revisits(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, url, html, refers_to, refers_url): the original of every repeated payload, null for originals."""
    digest, size = F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size")
    heads = written(pages.select("page_id", "url", digest, size).where(F.col("size") >= min_payload), "warc-heads")
    shared = heads.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("o"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("o.page_id").alias("refers_to"), F.col("o.url").alias("refers_url"))
    met = heads.join(shared, "digest").where("refers_to IS NOT NULL AND NOT coalesce(page_id = refers_to, false)")
    # one decision per capture, however often its row is repeated; it is found again by page_id, so no digest is hot
    again = written(met.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to", "refers_url").distinct(), "warc-revisits")
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    out = base.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.sha1(F.col("html").cast("binary")) == F.col("d")), "left")
    return out.select("page_id", "url", "html", "refers_to", "refers_url")


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) below ``path``.

    Null html is an empty payload, a null url gets a urn.  Rows that repeat the
    page_id of an original are originals too.  Other columns are ignored; an
    empty table writes no record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["record"])
            held.clear()
            return out

        for b in batches:
            for i in range(b.num_rows):
                page, url, html, refers, refers_url = (c[i].as_py() for c in b.columns)
                record = gzip_members(build_record(page, url, html.encode("utf-8", "surrogatepass"), refers, refers_url))
                if held and size + len(record) > ROW_BYTES:
                    yield row()
                    size = 0
                held.append(record)
                size += len(record)
        if held:
            yield row()

    rows = resolve_revisits(pages, min_payload).mapInArrow(run, "record binary")
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", ROWS_PER_FILE).text(path)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a .warc.gz file; raises on a damaged record."""
    pending = bytearray()
    rest = memoryview(data)
    while rest or pending:
        if rest:
            d = zlib.decompressobj(31)
            for at in range(0, len(rest), _CHUNK):
                pending += d.decompress(rest[at : at + _CHUNK])
                if d.eof:
                    rest = rest[min(at + _CHUNK, len(rest)) - len(d.unused_data) :]
                    break
            else:
                raise ValueError("truncated gzip member")
        while pending:
            cut = pending.find(b"\r\n\r\n")
            if cut < 0:
                break
            head = dict(line.split(": ", 1) for line in pending[:cut].decode().split("\r\n")[1:])
            end = cut + 4 + int(head["Content-Length"])
            if len(pending) < end + 4:
                break
            yield head, bytes(pending[cut + 4 : end])
            del pending[: end + 4]
        if not rest and pending:
            raise ValueError("truncated record")


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of all records; digests are checked."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for head, block in parse_archive(content.as_buffer()):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if base32_sha1(block) != head["WARC-Block-Digest"].removeprefix("sha1:"):
                        raise ValueError(f"damaged block in {head['WARC-Record-ID']}")
                    body = block.split(b"\r\n\r\n", 1)[1]
                    kind = head["WARC-Type"]
                    if kind == "response" and (base32_sha1(body) != digest or len(body) != int(head["X-Payload-Length"])):
                        raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
                    page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
                    row = (page and int(page), head["WARC-Target-URI"], int(head["X-Payload-Length"]), digest, kind, refers and int(refers))
                    rows.append((*row, body if kind == "response" else None) if payload else row)
                    held += len(body) * payload
                    if held > MEMBER:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    return files.select("content").mapInArrow(run, kind)


def archive_report(pages: DataFrame) -> DataFrame:
    """Contract rows of op5: write the archives to the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path, payload=False).drop("url")


def oracle_sql() -> str:
    """The contract rows of ``pages`` in DuckDB's SQL, without archives: for unique page_ids."""
    bit = "CAST(substr(bits, 5 * i + {0}, 1) AS INTEGER)"
    five = " + ".join(f"{16 >> k} * {bit.format(k + 1)}" for k in range(5))
    return f"""
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string([substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', c) - 3, 4) FOR c IN string_split(h, '')], '') AS bits,
  max(page_id) OVER (PARTITION BY h) AS original FROM d)
SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {five}, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to
FROM b"""
