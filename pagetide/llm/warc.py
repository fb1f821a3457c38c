"""Operator 8: WARC archives with revisit resolution.

Headers (page, digest, size) alone are shuffled by payload digest to find each payload's original
record; payloads are shuffled once, by page, and written once.  Later copies become revisit records
that refer to the original.  Archives hold one Spark task's records each and are read back whole,
record by record along Content-Length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DATE = "2024-01-01T00:00:00Z"
# Mean archive size.  Spark's binary reader loads one archive at a time per task.
ARCHIVE_BYTES = 12 << 20
CRLF = "\r\n"

RECORD_SCHEMA = ("record_id string, record_type string, page_id long, url string, refers_to string, "
                 "header_digest string, payload_digest string, payload_bytes long, payload binary")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four groups of 40 bits, re-lettered."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts]))


def _urn(*parts: Column) -> Column:
    """A record id that a retried task writes again unchanged."""
    h = _digest(*parts)
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def resolve(pages: DataFrame, min_payload: int = 0, page_id: str = "page_id", url: str = "url",
            html: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, record_id, refers_to,
    refers_page, refers_url), one row per input row.

    Of the rows with equal payloads of at least ``min_payload`` bytes the smallest (page_id, url) is
    the response, null ids last; the others revisit it.  A null html is an empty payload.  Of fully
    repeated rows the first is a response if any is.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", base32_sha1(F.col("payload")))
    rows = rows.withColumn("key", _digest(F.col("page_id"), F.col("url"), F.col("payload_digest")))
    headers = rows.drop("payload").distinct()
    first = (headers.where(F.col("payload_bytes") >= min_payload)
                    .groupBy("payload_digest", "payload_bytes")
                    .agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id",
                                        F.col("url").isNull().alias("no_url"), "url")).alias("first")))
    named = headers.join(first, ["payload_digest", "payload_bytes"], "left").select("key", "first")
    # One shuffle of payloads, by a key that fully repeated rows alone share: they are numbered in place.
    joined = rows.join(named, "key").withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0))))
    own = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    revisit = F.col("first").isNotNull() & (~own | (F.col("copy") > 1))
    target = _urn(F.col("first.page_id"), F.col("first.url"), F.col("payload_digest"), F.lit(1))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        _urn(F.col("page_id"), F.col("url"), F.col("payload_digest"), F.col("copy")).alias("record_id"),
        F.when(revisit, target).alias("refers_to"),
        F.when(revisit, F.col("first.page_id")).alias("refers_page"),
        F.when(revisit, F.col("first.url")).alias("refers_url"))


def _line(name: str, value: Column) -> Column:
    """A header line; control characters of the value are written as %XX, a null value gives no line."""
    clean = value.cast("string")
    for code in (0, 9, 10, 13):
        clean = F.replace(clean, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def records(resolved: DataFrame, date: str = DATE) -> DataFrame:
    """(record binary): one whole WARC record per row, headers made afresh."""
    is_response = F.col("record_type") == "response"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    block_bytes = F.octet_length(http) + F.when(is_response, F.col("payload_bytes")).otherwise(F.lit(0))
    head = F.concat(
        F.lit(VERSION + CRLF),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Refers-To", F.col("refers_to")),
        _line("WARC-Refers-To-Target-URI", F.col("refers_url")),
        F.when(is_response, "").otherwise(f"WARC-Profile: {REVISIT_PROFILE}{CRLF}"),
        _line("X-Page-ID", F.col("page_id")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block_bytes),
        F.lit(CRLF))
    body = F.when(is_response, F.col("payload")).otherwise(F.lit(b""))
    return resolved.select(F.concat(head.cast("binary"), http.cast("binary"), body).cast("string").alias("value"))


def write_archives(resolved: DataFrame, folder: str, per_archive: int) -> str:
    """Write the records as ``folder``/part-*, at most ``per_archive`` to a file.  Spark's text writer
    puts the two line ends that close a WARC record after each row, and its commit protocol survives
    lost executors.  Each file is one gzip stream."""
    (records(resolved).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", per_archive)
                      .option("compression", "gzip").text(folder))
    return folder


def records_per_archive(pages: DataFrame, html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> int:
    """How many records of mean size make ``archive_bytes``."""
    mean = pages.agg(F.avg(F.coalesce(F.octet_length(html), F.lit(0)))).first()[0] or 0.0
    return max(1, int(archive_bytes / (mean + 600)))


def _parse(data: bytes):
    """The records of one archive: (header dict, block), following Content-Length."""
    at, end = 0, len(data)
    while at < end:
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split(CRLF)
        if not re.fullmatch(r"WARC/\d+\.\d+", lines[0]):
            raise ValueError(f"no WARC record at byte {at}")
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(header["content-length"])
        begin = stop + 4
        yield header, data[begin:begin + size]
        at = begin + size + 4


def _reader(with_payload):
    def run(batches):
        yield from _read(batches, with_payload)
    return run


def _read(batches, with_payload):
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    for batch in batches:
        rows, held = [], 0
        for data in batch.column("content").to_pylist():
            for header, block in _parse(gzip.decompress(data)):
                http_end = block.find(b"\r\n\r\n")
                payload = block[http_end + 4:] if header["warc-type"] == "response" else None
                sha = payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode()
                rows.append({
                    "record_id": header["warc-record-id"], "record_type": header["warc-type"],
                    "page_id": int(header["x-page-id"]) if "x-page-id" in header else None,
                    "url": header.get("warc-target-uri"), "refers_to": header.get("warc-refers-to"),
                    "header_digest": header.get("warc-payload-digest", "").removeprefix("sha1:"),
                    "payload_digest": sha or None, "payload_bytes": None if payload is None else len(payload),
                    "payload": payload if with_payload else None})
                held += len(block) if with_payload else 1000
                if held > 4 << 20:
                    yield _batch(rows, names)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, names)


def _batch(rows, names):
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """(record_id, record_type, page_id, url, refers_to, header_digest, payload_digest,
    payload_bytes, payload) of every record; digest and size of responses are taken from the payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(_reader(with_payload), RECORD_SCHEMA)


def resolved_records(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to = page id): revisits get
    size and digest from the original that they refer to (null if the archives do not hold it)."""
    found = read_archives(spark, folder, with_payload=False)
    originals = (found.where("record_type = 'response'")
                      .select(F.col("record_id").alias("o_id"), F.col("page_id").alias("o_page"),
                              F.col("payload_bytes").alias("o_bytes"), F.col("payload_digest").alias("o_digest")))
    joined = found.join(originals, F.col("refers_to") == F.col("o_id"), "left")
    return joined.select("page_id", "url", F.coalesce("payload_bytes", "o_bytes").alias("payload_bytes"),
                         F.coalesce("payload_digest", "o_digest").alias("payload_digest"), "record_type",
                         F.col("o_page").alias("refers_to"))
