"""Ops 11, 12 and 13 against brute force, SQL and exact round trips."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from webdistill.llm import common, digests, infill, periods
from webdistill.llm import queries as Q

D = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a b " * 20), (4, "a b " * 20), (5, "ab" * 20), (6, "é x <P> " * 7), (7, "a\x00b \U0001f600z" * 3), (None, "x y " * 9), (8, "word " * 60_000)]


def brute_runs(ids, least=12):
    """Every maximal stretch of every period, straight from the definition."""
    out, n = set(), len(ids)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q) and (i, j - i + q) not in {(s, m) for s, m, _ in out}:
                out.add((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("few", [0, 1 << 13])
def test_runs_equal_brute_force(monkeypatch, few):
    monkeypatch.setattr(periods, "FEW_CELLS", few)
    r = random.Random(5)
    texts = [[], [1], [1] * 11, [1] * 12, [1] * 300, [1, 2] * 40 + [1], [0] * 20 + [1] + [0] * 20]
    for k in range(300):
        n, letters = r.randrange(2, 120), r.choice((1, 2, 3, 30))
        ids = [r.randrange(letters) for _ in range(n)]
        for _ in range(r.randrange(3)):
            a, p = r.randrange(n), r.randrange(1, 20)
            for i in range(a + p, min(n, a + p * r.randrange(2, 9))):
                ids[i] = ids[i - p]
        texts.append(ids)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    texts.append(fib[-1])
    assert max(map(len, map(brute_runs, texts))) > 5
    for ids in texts:
        got = [tuple(map(int, x)) for x in periods.runs(np.array(ids, np.int32)).T]
        assert got == brute_runs(ids), ids


def test_runs_in_small_pieces(monkeypatch):
    """Few cells at a time change nothing."""
    r = random.Random(6)
    ids = np.array([r.randrange(2) for _ in range(200)] + [0, 1, 2] * 60 + [5] * 100, np.int32)
    want = periods.runs(ids).tolist()
    monkeypatch.setattr(periods, "FEW_CELLS", 0)
    monkeypatch.setattr(periods, "MOST_CELLS", 64)
    assert periods.runs(ids).tolist() == want


def collapsed(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_run_columns(spark):
    docs = spark.createDataFrame([(i, t, 9) for i, t in ODD], "doc_id long, text string, runs int").repartition(3)
    rows = docs.select("doc_id", "text", periods.find(F.col("text")).alias("f")).select("doc_id", "text", "f", periods.longest(F.col("f.runs")).alias("top")).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        words = (r.text or "").encode().split()
        words = [w.decode() for w in words]
        want = brute_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        assert (r.f.n_words, [tuple(x) for x in r.f.runs], r.f.collapsed) == (len(words), want, collapsed(words, want))
        assert (tuple(r.top) if r.top else None) == (min(want, key=lambda x: (-x[1], x[0], x[2])) if want else None)


def test_periodic_runs_query(spark):
    want = {}
    for i, text in common.table(spark, D, "documents").select("doc_id", "text").collect():
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[a + (k - a) % p] if k >= a else w for k, w in enumerate(words)]
        runs = [tuple(map(int, x)) for x in periods.runs(np.unique(words, return_inverse=True)[1].astype(np.int32) if n else np.zeros(0, np.int32)).T]
        if n < 400:
            assert runs == brute_runs(words)
        s, m, q = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        want[i] = (len(runs), s, m, q, m and 1000 * m // q, *(hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in runs), collapsed(words, runs))))
    got = {r[0]: tuple(r)[1:] for r in Q.op11_periodic_runs(spark, D).collect()}
    assert got == want and sum(v[0] > 0 for v in want.values()) > 10


@pytest.mark.parametrize("name", ["op12_digest_index", "op13_fill_in_middle"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    want = db.execute(Q.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    got = Q.queries()[name](spark, D).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr) and len(got) > 100


def verdicts(spark, rows, index, loads=None):
    docs = spark.createDataFrame([(*r, b"x", 1) for r in rows], "doc_id long, text string, sha binary, row int")
    return digests.dedup(docs, index, loads or [F.lit(True)]).collect()


def new_index(spark):
    return digests.DigestIndex(spark, "t_" + common.new_path(spark, "i").rsplit("-", 1)[1], common.new_path(spark, "index"), buckets=4)


@pytest.mark.parametrize("heavy", [0.0, 1.0])
def test_exact_dedup(spark, monkeypatch, heavy):
    """Repeated digests by a broadcast (all are heavy), or by a shuffle (none is)."""
    monkeypatch.setattr(digests, "HEAVY", heavy)
    index = new_index(spark)
    rows = [(5, "a b"), (3, "ab"), (2, "a\n b"), (9, "a\n b"), (7, "c"), (7, "c"), (1, None), (4, ""), (6, " "), (None, "z"), (10, "z"), (8, "q " * 100_000), (11, "q" * 100_000)]
    got = verdicts(spark, rows, index)
    size = {"ab": 4, "c": 2, "": 2, " ": 1, "z": 2, "q" * 100_000: 2}
    keep = {"ab": 2, "c": 7, "": 1, " ": 6, "z": None, "q" * 100_000: 8}
    text = {hashlib.sha256(k.encode()).hexdigest(): k for k in size}
    assert len(got) == len(rows)
    for r in got:
        assert (r.group_size, r.keep_id) == (size[text[r.text_sha256]], keep[text[r.text_sha256]])
    assert sorted(r.doc_id or 0 for r in got if r.kept) == [0, 1, 2, 6, 7, 8]
    # a later load: what is known stays out, what is new is appended
    again = verdicts(spark, [(100, "a  b     long"), (101, "ab"), (102, "new"), (102, "new")], index)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in again) == [(100, 100, 1, True), (101, 2, 1, False), (102, 102, 2, False), (102, 102, 2, True)]
    assert index.table().count() == len(size) + 2 == index.table().select("sha").distinct().count()


def test_loads_in_order(spark):
    index = new_index(spark)
    got = verdicts(spark, [(1, "a"), (2, "a "), (3, "b"), (4, "b")], index, [F.col("n_chars") > 1, F.col("n_chars") <= 1])
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in got) == [(1, 2, False), (2, 2, True), (3, 3, True), (4, 3, False)]


def test_nothing_to_dedup(spark):
    index = new_index(spark)
    assert verdicts(spark, [], index) == [] and index.table().count() == 0
    assert len(verdicts(spark, [(1, "a")], index)) == 1


def test_index_is_read_as_it_lies(spark):
    """The anti-join reads the index in its buckets: no exchange of it, a sort-merge join."""
    index = new_index(spark)
    verdicts(spark, [(i, str(i)) for i in range(50)], index)
    new = spark.createDataFrame([(b"x",)], "sha binary").repartition(4, "sha").join(index.table().hint("merge"), "sha", "left_anti")
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange") == 1


def test_infill_round_trip(spark):
    rows = [*ODD, (20, "<S"), (21, "x<P"), (22, "<<M"), (23, "ab-cd ef\nghß" * 9)]
    docs = spark.createDataFrame([(i, t, "form") for i, t in rows], "doc_id long, text string, parts string").repartition(3)
    for kind in ("plain", "psm", "spm"):
        cut = docs.select("doc_id", "text", infill.cut(F.col("text"), F.col("doc_id") * 7919, F.lit(3)).alias("c"))
        out = cut.withColumn("o", infill.arrange(F.lit(kind), F.col("text"), F.col("c"))).withColumn("r", infill.restore(F.lit(kind), F.col("o"))).collect()
        assert len(out) == len(rows)
        for r in out:
            text = r.text or ""
            assert r.c.prefix + r.c.middle + r.c.suffix == text
            if "<P>" not in text:
                assert r.r == text
            units = __import__("re").findall("[A-Za-z]+|[^A-Za-z]", text)
            a, b = sorted(x % (len(units) + 1) for x in ((r.doc_id or 0) * 7919, 3))
            assert (r.c.n, r.c.prefix, r.c.middle) == (len(units), "".join(units[:a]), "".join(units[a:b]))


def test_infill_forms(spark):
    t = [None, "", "x<M>y", "fine"]
    docs = spark.createDataFrame([(x,) for x in t], "text string")
    forms = lambda a, b: [r[0] for r in docs.select(infill.form(F.col("text"), F.lit(a), F.lit(b))).collect()]
    assert forms(189, 19) == ["plain"] * 3 + ["spm"] and forms(189, 20) == ["plain"] * 3 + ["psm"] and forms(90, 0) == ["plain"] * 4
    h = hashlib.sha256(b"1:17").hexdigest()
    assert spark.range(17, 18).select(*infill.draws(F.col("id"), 1)).first() == tuple(int(h[8 * k : 8 * k + 8], 16) for k in range(4))


def test_nothing_to_cut_or_probe(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert none.select(periods.find(F.col("text"))).count() == none.select(infill.cut(F.col("text"), F.col("doc_id"), F.col("doc_id"))).count() == 0
