"""DataFrame operators, and the queries against their SQL on the small tables."""

import os

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webdistill.functions.extract import Options
from webdistill.operators import evaluate
from webdistill.operators import pages as P
from webdistill.plans import queries as Q
from webdistill.streaming import pages as streaming

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{D}/pages.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = Q.queries()[name](spark, D)
    want = db.execute(Q.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert key(got.select(*columns).collect()) == key(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_query_runs(spark, name):
    assert Q.queries()[name](spark, D).count() >= 3


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_errors_are_rows(spark):
    f = P.PageFrame(frame(spark, [(1, "nope", "<p>x"), (2, None, None), (3, "http://a.com", "<p>Some words here are enough.")]))
    assert {r.page_id: r.kind for r in f.errors().collect()} == {1: "InvalidUrl", 2: "NoContent"}
    assert [r.page.markdown for r in f.ok().collect()] == ["Some words here are enough."]


def test_pages_of_nothing(spark):
    f = P.PageFrame(frame(spark, []))
    assert f.flat().count() == f.nodes().count() == f.links().count() == 0


def test_filters_reach_the_scan(spark):
    plan = Q._pages(spark, D).where("page_id < 10").extract()._jdf.queryExecution().toString()
    assert "LessThan(page_id,10)" in plan


def test_native_ranking_equals_kernel(spark):
    rows = P.top_candidates(Q._pages(spark, D).rank_features(), 5).collect()
    assert rows and all(abs(r.rank_score - r.score) < 1e-9 for r in rows)


ODD_METADATA = [
    "<html lang=en><title>A long title of words</title><meta property=og:title content='Other title'><meta name=twitter:title content='other title'><meta name=author content='A B'><p>x",
    "<meta name=author content='Ann Lee'><meta property=article:author content='ann lee'><p itemprop=author>Bob Ray</p><a rel=author>Ann Lee</a><h1>T",
    "<meta property=og:site_name content='The (Site) \\\\E+'><title>Words of a long title | The (Site) \\\\E+</title><meta name=keywords content='the site e, Bread,bread , b-r'>",
    "<meta property=og:site_name content='Site'><meta property=og:title content='site — All of it'>", "<meta property=og:site_name content='Site'><meta property=og:title content='Site'>",
    "<meta name=author content='n/a'><meta name=author content='By Élan Ö'><meta name=citation_author content='ÉLAN Ö'>" + "".join(f"<meta name=citation_author content='Writer {i}'>" for i in range(14)),
    "", None, "<html lang=de_AT dir=RTL><link rel=canonical href=/c><meta property=og:url content=http://b.com/><meta property=og:image content=/i.png>",
    "<script type='application/ld+json'>" + '{"@type":"Article","name":"N","headline":"H","keywords":["a","b, A"],"author":["X","Y"],"publisher":{"name":"P"}}' + "</script>",
]


def test_native_metadata_equals_kernel(spark):
    pages = P.PageFrame(frame(spark, [(i, "http://x.com/a", h) for i, h in enumerate(ODD_METADATA)]))
    from webdistill.functions import metadata as M
    from webdistill.functions.parser import parse

    in_rows = {r.page_id: r.asDict() for r in P.resolve_metadata(pages.meta_candidates()).collect()}
    for r in pages.metadata().collect():
        html = ODD_METADATA[r.page_id] or ""
        d = parse(html)
        want = M.resolved(M.candidates(d, "http://x.com/a", "http://x.com/a", M.json_items(d)))
        got = r.asDict()
        assert in_rows[got["page_id"]] == got
        assert {k: v for k, v in got.items() if k != "page_id"} == want
    assert len(in_rows) == len(ODD_METADATA) and in_rows[1]["authors"] == ["Ann Lee", "Bob Ray"] and in_rows[2]["title"] == "Words of a long title" and in_rows[2]["tags"] == ["Bread", "b-r"]


def test_metadata_is_resolved_within_rows(spark):
    plan = P.PageFrame(Q._table(spark, D)).metadata()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and plan.count("ArrowEvalPython") == 1


def test_subtree_text(spark):
    rows = P.subtree_text(P.PageFrame(frame(spark, [(1, None, "<div><p>abc</p><p>de <b>f</b></p></div>")])).nodes()).collect()
    assert {(r.tag, r.text_chars) for r in rows} >= {("div", 6), ("b", 1), ("body", 6)}


def test_evaluation(spark):
    pairs = spark.createDataFrame([(1, "a b b c", "b b d"), (2, "", ""), (3, None, "x")], "page_id long, result string, reference string")
    got = {r.page_id: (round(r.precision, 3), round(r.recall, 3)) for r in evaluate.reference_scores(pairs).collect()}
    assert got == {1: (0.5, 0.667), 2: (1.0, 1.0), 3: (0.0, 0.0)}
    scores = spark.createDataFrame([("x", 1.0), ("x", None), ("y", 0.0)], "c string, s double")
    assert {r.c: (r.n, r.s) for r in evaluate.report(scores, "c", ["s"]).collect()} == {"x": (2, 1.0), "y": (1, 0.0), None: (3, 0.5)}
    a, b = (spark.createDataFrame(x, "id long, s double") for x in ([(1, 1.0), (2, 0.5)], [(1, 1.0), (2, 0.6), (3, 1.0)]))
    assert {r.id for r in evaluate.gate(a, b, "id", ["s"]).collect()} == {2, 3}


def test_bytes(spark):
    rows = spark.createDataFrame([(1, "http://a.com", bytearray(b"<p>caf\xe9 au lait for all of us</p>"), None)], "page_id long, url string, body binary, content_type string")
    assert "café" in P.PageFrame.from_bytes(rows).flat().first().text


def test_stream_drops_repeats(spark, tmp_path):
    frame(spark, [(1, "http://a.com", "<p>one two three four five"), (2, "http://a.com", "<p>one two three four five")]).coalesce(1).write.parquet(str(tmp_path / "in"))
    found = streaming.extract_stream(streaming.read_pages(spark, str(tmp_path / "in")), Options(), once_per_url=True)
    seen = []
    streaming.each_batch(found, lambda df, _: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert len(seen) == 1 and os.path.isdir(tmp_path / "cp")


def test_links(spark):
    f = P.PageFrame(frame(spark, [(1, "http://a.com/x", "<a href=/y#z>t</a><a href='javascript:x'>q</a><a name=n>n</a>"), (2, "http://a.com/y", "<p>w")]))
    assert [(r.href, r.text) for r in f.links().collect()] == [("http://a.com/y#z", "t")]
    assert [(r.page_id, r.target_id) for r in P.internal_links(f.links(), f.pages).collect()] == [(1, 2)]
    assert f.links().where(F.col("ord") == 0).count() == 1


def test_visible_text_and_order(spark):
    row = spark.createDataFrame([("# A *b*\n\n- [c](http://x) \\* d\n\n| e | f |\n| --- | --- |",)], "m string").select(evaluate.visible_text(F.col("m")).alias("t")).first()
    assert row.t.split() == ["A", "b", "c", "*", "d", "e", "f"]
    assert evaluate.order_kept("a b c d", "a x c b d") == 0.75 and evaluate.order_kept("", "a") == 1.0
    assert evaluate.retained_order(spark.createDataFrame([(1, "a b", "a b")], "page_id long, result string, reference string")).first().order_kept == 1.0


def test_columns_keep_few_pages_at_a_time(spark, monkeypatch):
    """What a column makes of pages leaves the worker in pieces, whatever Spark's batches hold; long pages go sooner."""
    from webdistill.operators import kernels as K

    found = {}
    monkeypatch.setattr(K.F, "arrow_udf", lambda run, schema: found.setdefault("run", run) and (lambda *columns: None))
    K._column("array<struct<n int, m map<string,string>>>", lambda h: [{"n": len(h or ""), "m": {"a": "b"}}], "html")
    texts = ["x"] * (2 * K.BATCH_ROWS + 1) + ["y" * K.BATCH_CHARS] * 3 + [None]
    taken = []
    pieces = found["run"](taken.append(len(a)) or a for a in [pa.array(texts), pa.array([], pa.string())])
    assert len(next(pieces)) == K.BATCH_ROWS and taken == [len(texts)]
    sizes = [len(x) for x in pieces]
    assert K.BATCH_ROWS + sum(sizes) == len(texts) and max(sizes) <= K.BATCH_ROWS and sizes[-3:] == [1, 1, 1]


def test_pieces_stay_with_their_rows(spark):
    rows = frame(spark, [(i, "http://a.com", None if i % 7 == 0 else "<p>" * (i % 5) + f"text {i}") for i in range(500)]).coalesce(1)
    got = P.PageFrame(rows).texts_in("p").where("trim(text) <> ''").collect()
    assert {r.page_id: r.text for r in got} == {i: f"text {i}" for i in range(500) if i % 7 and i % 5}
    assert rows.select("page_id", P.K.page_nodes("html").alias("n"), P.K.page_links("html", "url").alias("l")).where("size(n) > 0 AND size(l) = 0").count() == 500
