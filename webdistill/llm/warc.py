"""WARC archives with revisit records in place of repeated payloads, and their reader."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webdistill.llm import common

END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null; control characters can't end the line early."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\\x00-\\x1f\\x7f]+", " "), F.lit("\r\n")), F.lit(""))


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat(F.coalesce(page.cast("string"), F.lit("")), F.lit("|"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _rows(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8"))).withColumn("size", F.octet_length("payload").cast("long"))


def resolve(pages: DataFrame, least: int, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Pages with ``digest``, ``size`` and, where another page's record holds the same payload, that page.

    Of equal payloads of ``least`` bytes or more the largest id keeps the payload (null ids lose to all; without any id
    nothing is a revisit). Only headers (digest, id, URL) are shuffled by digest, summed up before, so a payload that a
    third of the pages share is one row a task there. Of the digests those that occur twice go back to the pages; payloads
    aren't shuffled as long as these digests fit a broadcast, which is measured. Beyond that pages are joined by digest,
    and Spark splits frequent ones.
    """
    rows = _rows(pages, id_col, url_col, payload_col)
    kept = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max(F.struct("page", "url")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    kept = common.save(kept.select(F.col("digest").alias("of"), F.col("kept.page").alias("to_page"), F.col("kept.url").alias("to_url")), "warc-repeated")
    small = F.broadcast if common.fits(kept) else lambda x: x
    joined = rows.join(small(kept), (F.col("digest") == F.col("of")) & (F.col("size") >= least), "left")
    revisit = F.coalesce(F.col("to_page").isNotNull() & ~F.col("page").eqNullSafe(F.col("to_page")), F.lit(False))
    return joined.withColumn("revisit", revisit).drop("of")


#: Largest payloads of each kind of file, and its records: no file holds more than about 256 MB before compression.
SIZES = [(64 << 10, 4000), (4 << 20, 64), (None, 1)]


def write(pages: DataFrame, path: str, least: int = 1000, date: str = "2024-01-01T00:00:00Z", records: int = 4000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write one WARC/1.1 record a page: a response, or a revisit that refers to the response with its payload.

    Every header is made anew. Null payloads are empty; pages that repeat (same id and payload) are responses each.
    Files are gzip streams of about 256 MB of payloads at most (``SIZES``: pages of a size are in files of so many
    records, and of ``records`` at most), so readers can take them in parallel. Spark's text sink writes them (its line end is the end of a record),
    so any store that Spark writes to will do. Empty tables make an empty archive.
    """
    rows = resolve(pages, least, id_col, url_col, payload_col)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page"), F.col("digest"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(F.col("revisit"), _record_id(F.col("to_page"), F.col("digest")))),
        _line("WARC-Refers-To-Target-URI", F.when(F.col("revisit"), F.col("to_url"))),
        _line("WARC-Profile", F.when(F.col("revisit"), F.lit(_PROFILE))),
        _line("X-Page-Id", F.col("page")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
        block,
    )
    least_size = 0
    largest = pages.agg(F.max(F.octet_length(payload_col))).first()[0] or 0
    for most, n in SIZES:
        if least_size and largest <= least_size:
            break
        part = rows.where((F.col("size") > least_size if least_size else F.lit(True)) & (F.col("size") <= most if most else F.lit(True)))
        part.select(record.alias("value")).write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", min(n, records)).text(path)
        least_size = most


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive, by the records' own lengths.

    The stream is inflated a record at a time.
    """
    source = io.BytesIO(data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=source)) if data[:2] == b"\x1f\x8b" else source
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8").rstrip("\r\n").partition(": ")
            fields[k.lower()] = v
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} doesn't end where it says")
        yield fields, block


def read(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, page_id STRING, url, record_type, payload_digest, refers_to_record, payload BINARY`` of all archives.

    The payload is null for revisits. A response whose payload doesn't fit its digest is an error.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "page_id", "url", "record_type", "payload_digest", "refers_to_record", "payload"]
        types = [*(pa.string(),) * 6, pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                found, size = [], 0
                for f, block in records(content.as_py()):
                    payload = block[re.search(rb"\r\n\r\n", block).end() :] if f["warc-type"] == "response" else None
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {f['warc-record-id']} doesn't fit its digest")
                    found.append((f["warc-record-id"], f.get("x-page-id"), f.get("warc-target-uri"), f["warc-type"], digest, f.get("warc-refers-to"), payload))
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)
                        found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "record_id string, page_id string, url string, record_type string, payload_digest string, refers_to_record string, payload binary")


def headers(rows: DataFrame) -> DataFrame:
    """``record_id, page_id, record_type, payload_digest, refers_to_record, payload_bytes`` without the payloads."""
    return rows.select("record_id", "page_id", "record_type", "payload_digest", "refers_to_record", F.octet_length("payload").cast("long").alias("payload_bytes"))


def joined(found: DataFrame) -> DataFrame:
    """Revisits joined to their original responses, for ``payload_bytes`` and ``refers_to``; responses as they are."""
    original = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), "payload_bytes").dropDuplicates(["refers_to_record"])
    revisits = found.where("record_type = 'revisit'").drop("payload_bytes").join(original, "refers_to_record", "left")
    return found.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("string")).unionByName(revisits)
