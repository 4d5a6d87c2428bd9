"""Exact deduplication against a persistent index of digests. Native DataFrame functions only.

The index is a table bucketed and sorted by digest. What a load brings is reduced to the first row of each digest,
held against the index by a sort-merge anti-join that reads the index as it lies, and appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webdistill.llm import common

#: A digest of more than this share of all rows goes to the rows by a broadcast: there are fewer than ``1 / HEAVY`` of
#: them, of less than 100 bytes each. Other digests are joined by a shuffle, in which no key is that large.
HEAVY = 1 / (1 << 17)
#: Fixed by the contract: characters that don't count.
SPACE = " \t\n\x0b\x0c\r"


def normal(text: Column) -> Column:
    """A text without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sha, n_chars, row``: SHA-256 of the normalised text, code points of the original one, a number of the row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.unhex(F.sha2(normal(F.col(text_col)).cast("binary"), 256))
    return docs.select(F.col(id_col).alias("doc_id"), sha.alias("sha"), F.length(text).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("row"))


class DigestIndex:
    """The digests seen so far: ``sha, keep_id, n_chars, row, load``, one row a digest, in a bucketed and sorted table.

    ``name`` is a table of the session's catalog with its files in ``path`` (a shared folder; the warehouse where none
    is given); it is made by the first load and stays as long as the catalog. ``buckets`` is fixed with the first load:
    take so many that a bucket of 60 bytes a digest fits into a task. Within a load the row with the most code points stays, then that of the smallest id
    (null first), then any one of equal rows; a digest that the index has keeps the row of the earlier load.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int = 64):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, found: DataFrame, load: str) -> None:
        """Add what the index lacks of a written table of ``digests``; a load that brings nothing leaves an empty index at least."""
        order = F.struct(-F.col("n_chars"), "doc_id", "row")
        first = found.groupBy("sha").agg(F.min_by(F.struct(F.col("doc_id").alias("keep_id"), "n_chars", "row"), order).alias("x"))
        new = first.select("sha", "x.*", F.lit(load).alias("load"))
        if self.spark.catalog.tableExists(self.name):
            new = new.join(self.table().hint("merge"), "sha", "left_anti")
        to = new.repartition(self.buckets, "sha").write.bucketBy(self.buckets, "sha").sortBy("sha").mode("append").option("compression", "zstd")
        with common.released(self.spark):
            (to.option("path", self.path) if self.path else to).saveAsTable(self.name, format="parquet")

    def verdicts(self, found: DataFrame) -> DataFrame:
        """For each row of ``digests``: ``doc_id, sha, row``, the ``keep_id`` and kept row of its digest, and how many rows of ``found`` share it.

        Counts are summed before they are shuffled and meet the index by a sort-merge join. Digests of very many rows
        then go to the rows by a broadcast of bounded size, the others by a shuffle; no digest makes a large task.
        """
        total = found.count()
        groups = found.groupBy("sha").agg(F.count("*").alias("group_size")).join(self.table().hint("merge"), "sha")
        groups = common.save(groups.select("sha", "group_size", "keep_id", F.col("row").alias("kept_row"), "load"), "digest-groups")
        heavy = (F.col("group_size") > 1) & (F.col("group_size") > HEAVY * total)
        few = F.broadcast(groups.where(heavy).select("sha", F.struct("group_size", "keep_id", "kept_row", "load").alias("known")))
        rows = found.join(few, "sha", "left")
        light = rows.where("known IS NULL").drop("known").join(groups.where(~heavy), "sha")
        columns = ["doc_id", "sha", "row", "keep_id", "kept_row", "load", "group_size"]
        return rows.where("known IS NOT NULL").select("doc_id", "sha", "row", "known.*").select(columns).unionByName(light.select(columns))


def dedup(docs: DataFrame, index: DigestIndex, loads: list[Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A verdict for each of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``; the index grows by what is new.

    ``loads`` are conditions on ``n_chars`` that part the rows; they are loaded one after the other, so a row of an
    earlier load stays before any of a later one. Texts are read once and only digests are shuffled. ``group_size``
    counts the rows of ``docs``. Null and empty texts are equal to texts of white space alone. Of rows that repeat (same
    id and text) one is kept. An empty table gives no rows; other columns don't matter.
    """
    found = common.save(digests(docs, id_col, text_col), "digests")
    load = uuid.uuid4().hex
    for k, condition in enumerate(loads):
        index.append(found.where(condition), f"{load}-{k}")
    rows = index.verdicts(found)
    kept = (F.col("row") == F.col("kept_row")) & F.startswith("load", F.lit(load))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


#: DuckDB SQL of the same over ``documents``; a null id comes first.
SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS n_chars, sha256(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS sha FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY n_chars DESC, doc_id NULLS FIRST) AS k FROM n)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha ORDER BY k) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size, k = 1 AS kept, sha AS text_sha256
FROM r
"""
