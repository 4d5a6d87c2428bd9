"""The queries of this subpackage: op1 to op13 and the pipeline."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webdistill.llm import bpe, common, digests, infill, jaccard, lines, packing, periods, quality, tokens, topk, toxicity, urls, warc


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(common.table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    path = common.new_path(spark, "token-ids")
    tokens.write_orc(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    found = common.save(tokens.checksums(tokens.read_orc(spark, path)), "token-sums")
    return tokens.starts(found).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.decode_documents(bpe.encode_documents(docs, vocabulary), vocabulary)
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(common.table(spark, sf_dir, "documents"), floor=quality.FLOOR).drop("distance")


def op5_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    path = common.new_path(spark, "warc")
    warc.write(pages, path)
    found = common.save(warc.headers(warc.read(spark, path)), "warc-headers")
    return warc.joined(found).select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.drop_boilerplate(common.table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: Fixed by the contract: verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op9_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(common.table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = docs.withColumn("words", F.when(h % 10 == 0, common.words(F.col("text")))).withColumn("n", F.size("words")).withColumn("g", F.floor(h / 10))
    planted = planted.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    word = lambda w, i: F.when(i >= F.col("a"), F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(w)
    text = F.when(F.col("a").isNotNull(), F.array_join(F.transform("words", word), " ")).otherwise(F.col("text"))
    found = planted.select("doc_id", periods.find(text).alias("found")).select("doc_id", "found.*").withColumn("top", periods.longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length DIV top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads of an index, long texts first: what the index has is then never shorter than what comes."""
    index = digests.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", common.new_path(spark, "digest-index"))
    return digests.dedup(common.table(spark, sf_dir, "documents"), index, [F.col("n_chars") >= 2000, F.col("n_chars") < 2000])


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    h1, h2, h3, h4 = infill.draws(F.col("doc_id"), seed=1)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", infill.form(F.col("text"), h3, h4).alias("form"), infill.cut(F.col("text"), h1, h2).alias("parts"))
    docs = docs.select("doc_id", "form", "parts", infill.arrange(F.col("form"), F.col("text"), F.col("parts")).alias("output"))
    moved = lambda part: F.when(F.col("form") != "plain", F.length(f"parts.{part}").cast("long")).alias(f"{part}_chars")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    restored = infill.restore(F.col("form"), F.col("output"))
    return docs.select("doc_id", "parts.n", "form", moved("prefix"), moved("middle"), digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_cost_balanced_packing, op3_orc_token_ids, op4_robust_outliers, op5_toxicity_neighbours, op6_warc_revisits, op7_line_dedup, op8_exact_top_k, op9_url_language_model, op10_forced_boundary_bpe, op11_periodic_runs, op12_digest_index, op13_fill_in_middle, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_warc_revisits": WARC_SQL,
        "op8_exact_top_k": topk.SQL.format(scale=64, k=20),
        "op7_line_dedup": lines.SQL.format(ratio=0.1, least=5),
        "op9_url_language_model": urls.sql(RULES),
        "op12_digest_index": digests.SQL,
        "op13_fill_in_middle": infill.SQL,
    }


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p WHERE octet_length(encode(h)) >= 1000 GROUP BY h)
SELECT page_id, octet_length(encode(p.h)) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN m ON p.h = m.h
"""
