"""From raw documents to packed training sequences in five stages, each an operator of ``webdistill.llm``.

Every stage takes all that the one before kept. The first four return the columns of ``documents``; the last returns the
pieces of packed sequences (see ``webdistill.llm.packing.pack``) with a checksum in place of the ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webdistill.llm import common, jaccard, lines, packing, quality, toxicity


def _kept(docs: DataFrame, verdicts: DataFrame, keep: str) -> DataFrame:
    """Documents without those whose verdict isn't ``keep``; only the rejected ids meet the documents."""
    return common.without(docs, verdicts.where(f"NOT ({keep})").select("doc_id"), "doc_id")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    return _kept(docs, toxicity.rate(docs, common.table(spark, sf_dir, "labels")), "predicted = 0")


def outliers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far outside their language and source go."""
    return _kept(docs, quality.judge(docs, floor=quality.FLOOR), "kept")


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur over a source go from the texts; all documents stay. ``n_chars`` follows the text."""
    columns = docs.columns
    out = lines.drop_boilerplate(docs)
    n = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return jaccard.drop_near_copies(docs, n=5, num=80, den=100)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents that are left, in sequences of at most 4096."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxic), ("quality rules", outliers), ("line dedup", boilerplate), ("n-gram Jaccard join", near_copies), ("packing", packed)]

#: The method of most stages is beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.save(docs, name.replace(" ", "-"))
    return docs
