"""Token-ID output: ids of whole texts in ORC files, in ascending document order, and their reader."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webdistill.llm import common, worker
from webdistill.llm.encoding import Encoder

#: Bytes of ids that a worker holds before it hands them on.
FLUSH = 8 << 20


def encoder(path: str, cache: int = 96 << 20) -> Encoder:
    """One encoder a worker process, so that its caches last over tasks."""
    return worker.held("encoder", (path, cache), lambda: Encoder(path, cache))


def int_lists(parts: list[bytes]) -> pa.ListArray:
    """An array of int32 lists over the joined little-endian ids; no id is boxed."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def encode(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids ARRAY<INT>`` of every whole text, the end id last. Row order within partitions is kept.

    A null or empty text has the end id only. Repeated rows stay; columns other than the two read are not carried.
    """
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer).encode
        for batch in batches:
            ids, texts, at, held, size = batch.column(0), batch.column(1), 0, [], 0
            for k, text in enumerate(texts):
                held.append(enc(text.as_py()) + tail)
                size += len(held[-1])
                if size >= FLUSH or k == len(texts) - 1:
                    lists = int_lists(held)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(at, len(held)), pa.array([len(p) // 4 for p in held], pa.int64()), lists], ["doc_id", "n_tokens", "ids"]
                    )
                    at, held, size = k + 1, [], 0

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>")


def write_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 64 << 20, stride: int = 10_000, bloom_fpp: float = 0.01) -> None:
    """Write ids as ORC: one file a range of document ids, files and rows in ascending order (null ids first).

    Ids are run-length encoded integers. Each stripe holds row indexes (minimum and maximum every ``stride`` rows) and a
    Bloom filter on ``doc_id``, so readers take stripes in parallel and skip those without the ids they look for. Texts
    are dealt out by range before they are encoded: sampling the ranges reads no text twice through the encoder.
    """
    ranged = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first())
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    (
        encode(ranged, tokenizer, end_id)
        .write.option("orc.compress", "ZSTD")
        .option("orc.compression.zstd.level", "1")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(stride))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .orc(path)
    )


def read_orc(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The files' rows with the name of each row's file; filters on ``doc_id`` reach the stripes' indexes."""
    return spark.read.schema(f"doc_id {id_type}, n_tokens bigint, ids array<int>").orc(path).withColumn("file", F.col("_metadata.file_name"))


def checksums(rows: DataFrame) -> DataFrame:
    """``file, doc_id, n_tokens, ids_crc32`` counted from the ids themselves."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
            data, at = memoryview(flat).cast("B"), (4 * ends.astype(np.int64)).tolist()
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], ["file", "doc_id", "n_tokens", "ids_crc32"]
            )

    return rows.select("file", "doc_id", "ids").mapInArrow(run, f"file string, doc_id {kind}, n_tokens long, ids_crc32 long")


def starts(rows: DataFrame) -> DataFrame:
    """Add ``start``, the tokens of all documents before each: those of earlier files, and earlier ones in its file.

    Files are in the order of their smallest ids, not of their names. The window over files has no key: one row a file
    meets in one task, which is bounded by the number of files. The order within a file is found in the task that holds
    the file's rows; rows that repeat an id follow each other by checksum.
    """
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("least"))
    before = Window.orderBy(F.col("least").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(files, "file").withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside")
