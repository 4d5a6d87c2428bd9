"""The pipeline's stages: each one's decisions take effect, clean documents stay, and all ids are packed."""

import zlib

import duckdb
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_jaccard import brute as brute_components
from webdistill.llm import toxicity
from webdistill.llm.encoding import packed

D = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").withColumn("__gone", F.lit(1)).drop("__gone")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], D).cache())
        assert kept[-1].columns == columns
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in kept]
    # toxicity: what goes is what the scores say
    model = toxicity.fit(docs, spark.read.parquet(f"{D}/labels.parquet"), ~toxicity.held_out(F.col("doc_id")))
    want = {r.doc_id for r in docs.collect() if model.score(r.text)[0] < 0.7}
    assert ids[1] == want
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    clean = [i for i, t in labels.items() if not t]
    assert sum(i in ids[1] for i in clean) > 0.98 * len(clean)
    # quality: base failures are gone
    assert ids[2] < ids[1] and len(ids[2]) > 0.75 * len(ids[1])
    # line dedup keeps all documents
    assert ids[3] == ids[2]
    # near copies: the smallest id of each group stays
    rows = [(r.doc_id, r.text) for r in kept[3].collect()]
    assert ids[4] == {i for i, _, c in brute_components(rows, 5, 80, 100) if i == c}
    # packing
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, kept[4], D).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == ids[4]
    for r in kept[4].collect():
        own = t.encode(r.text, add_special_tokens=False).ids + [2]
        for p in pieces[r.doc_id]:
            assert p.ids_crc32 == zlib.crc32(packed(own[p.start : p.start + p.length])) and p.doc_tokens == len(own)
        assert sum(p.length for p in pieces[r.doc_id]) == len(own)


def test_line_stage_equals_sql(spark):
    from webdistill.llm import lines

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    want = sorted(c.execute(lines.SQL.format(ratio=0.1, least=5)).fetchall())
    got = lines.drop_boilerplate(spark.read.parquet(f"{D}/documents.parquet")).select("doc_id", "n_lines", "n_dropped", F.md5("text")).collect()
    assert sorted(map(tuple, got)) == want


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"](spark, "/root/testdata/sf0.001").count() > 0
