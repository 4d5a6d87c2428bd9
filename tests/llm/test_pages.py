"""Ops 6, 7 and 9 against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from webdistill.llm import common, lines, urls, warc
from webdistill.llm import queries as Q
from webdistill.llm.queries import RULES


def test_warc_round_trip(spark):
    big, other = "é\r\n\r\nWARC/1.0\r\n" * 100, "<p>" + "y" * 1200
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: 1", big), (3, None, big), (4, "u", "s"), (5, "v", "s"), (6, "w", None), (7, "x", other), (7, "x", other), (None, "n", other), (8, "e", "")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    path = common.new_path(spark, "w")
    warc.write(pages, path, records=2)
    back = warc.read(spark, path)
    assert back.count() == len(rows)
    payloads = Counter(bytes(r.payload) for r in back.where("record_type = 'response'").collect())
    assert payloads[big.encode()] == 1 and payloads[b""] == 2
    found = defaultdict(list)
    for r in warc.joined(warc.headers(back)).collect():
        found[r.page_id].append(r)
    for i, _, html in rows:
        data = (html or "").encode()
        for r in found[None if i is None else str(i)]:
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {k: v[0].refers_to for k, v in found.items() if v[0].record_type == "revisit"} == {"1": "3", "2": "3", None: "7"}
    assert len(found["7"]) == 2


def test_warc_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = common.new_path(spark, "w")
    warc.write(pages, path)
    assert warc.joined(warc.headers(warc.read(spark, path))).count() == 0


def test_line_dedup(spark):
    rows = [(i, f"nav\nown {i}\n \nnav", "h", 1) for i in range(8)] + [(100, None, "h", 1), (101, "", None, 1), (102, "nav", None, 1), (103, "rare\nnav", "g", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_dropped int")
    got = {r.doc_id: r for r in lines.drop_boilerplate(docs, ratio=0.5, least=3).collect()}
    assert len(got) == len(rows)
    for i in range(8):
        assert (got[i].text, got[i].n_lines, got[i].n_dropped) == (f"own {i}\n ", 4, 2)
    assert got[100].text is None and got[100].n_lines == 0 and got[101].text == "" and got[102].text == "nav" and got[103].n_dropped == 0


def brute(rules, rows):
    sym = {c: i + 1 for i, c in enumerate(urls.ALPHABET)}
    counts = {"allow": Counter(), "block": Counter()}
    grams = []
    for host, path, ruled in rows:
        codes = [urls.START] * 2 + [sym.get(c, 0) for c in (host + path).lower()]
        g = list(zip(codes, codes[1:], codes[2:], strict=False))
        grams.append(g)
        if ruled:
            counts[ruled].update(g)

    def p(k, a, b, c):
        n = counts[k]
        one, two = [x for x in n.items()], [(x, m) for x, m in n.items() if x[1] == b]
        three = [(x, m) for x, m in n.items() if x[:2] == (a, b)]
        low = (sum(m for x, m in one if x[2] == c) + 1) / (sum(n.values()) + urls.SIZE)
        for own in (two, three):
            if total := sum(m for _, m in own):
                t = len({x[2] for x, _ in own})
                low = (sum(m for x, m in own if x[2] == c) + t * low) / (total + t)
        return low

    return [sum(math.log(p("block", *x)) - math.log(p("allow", *x)) for x in g) / len(g) if g else None for g in grams]


def test_url_filter(spark):
    given = ["http://a.example.com/en/7", "http://EXAMPLE.com/en/8?x#y", "https://b.net/de/1", "https://x.example.net/de/8", "ftp://org/es/", "http://other.example.org/fr/1", "no scheme", None, "http://", "http://com/en/é/漢?q", "x://y://z/en/"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(given)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(pages, RULES).collect()}
    assert len(got) == len(given)
    want = ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/", None, None, None, None, "com/en/", None]
    assert [got[i].rule for i in range(len(given))] == want
    assert (got[1].host, got[1].path) == ("example.com", "/en/8") and (got[6].host, got[7].path, got[8].host) == ("", "", "")
    assert (got[10].host, got[10].path) == ("y:", "//z/en/")
    verdict = {f"{h}{p}": v for v, h, p in RULES}
    scores = brute(RULES, [(got[i].host, got[i].path, verdict.get(got[i].rule)) for i in range(len(given))])
    for i, s in enumerate(scores):
        assert (got[i].score is None) == (s is None) and (s is None or abs(got[i].score - s) < 1e-9)
    of = {v: [s for i, s in enumerate(scores) if got[i].rule and verdict[got[i].rule] == v] for v in ("allow", "block")}
    mean, spread = ({v: f(x) for v, x in of.items()} for f in (np.mean, np.std))
    limit = mean["block"] - spread["block"] / (spread["allow"] + spread["block"]) * (mean["block"] - mean["allow"])
    for i, s in enumerate(scores):
        assert got[i].verdict == (verdict[got[i].rule] if got[i].rule else "block" if s is not None and s > limit else "allow")


def test_url_filter_calibrates_on_urls(spark):
    """Many URLs of few lengths: scores and threshold are those of single URLs, not of groups that share a length."""
    r = random.Random(3)
    hosts = ["a.com", "b.com", "www.example.com", "c.net", "x.example.net", "d.org", "e.example.org"]
    given = [f"http://{r.choice(hosts)}/{r.choice(('en', 'de', 'es', 'fr'))}/{''.join(r.choice('78ab-xyzq') for _ in range(r.choice((1, 2, 4))))}" for _ in range(500)]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").repartition(5)
    got = {x.page_id: x for x in urls.judge(pages, RULES).collect()}
    verdict = {f"{h}{p}": v for v, h, p in RULES}
    scores = brute(RULES, [(got[i].host, got[i].path, verdict.get(got[i].rule)) for i in range(500)])
    assert max(abs(got[i].score - s) for i, s in enumerate(scores)) < 1e-9
    of = {v: [s for i, s in enumerate(scores) if got[i].rule and verdict[got[i].rule] == v] for v in ("allow", "block")}
    assert min(map(len, of.values())) > 20
    mean, spread = ({v: f(x) for v, x in of.items()} for f in (np.mean, np.std))
    limit = mean["block"] - spread["block"] / (spread["allow"] + spread["block"]) * (mean["block"] - mean["allow"])
    free = [i for i in range(500) if not got[i].rule]
    want = {i: "block" if scores[i] > limit else "allow" for i in free}
    assert {i: got[i].verdict for i in free} == want and len(set(want.values())) == 2


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_url_filter_equals_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '/root/testdata/{sf}/pages.parquet'")
    want = db.execute(urls.sql(RULES))
    columns = [x[0] for x in want.description]
    got = Q.op9_url_language_model(spark, f"/root/testdata/{sf}").select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_url_filter_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert urls.judge(pages, []).collect()[0].verdict == "allow"
    assert urls.judge(pages.where("false"), RULES).count() == 0


def test_url_filter_repeats_and_long_urls(spark):
    long = "http://net/de/" + "a/b" * 50_000
    rows = [(1, long, 1), (1, long, 1), (1, "http://q.com/fr/", 1), (None, "http://q.com/en/", 1), (None, "http://q.com/en/", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, copies int")
    got = Counter((r.page_id, r.host, r.rule, r.verdict if r.rule else None) for r in urls.judge(pages, RULES).collect())
    assert got == {(1, "net", "net/de/", "allow"): 2, (1, "q.com", None, None): 1, (None, "q.com", "com/en/", "block"): 2}


def test_line_dedup_clashing_names_and_empty(spark):
    docs = spark.createDataFrame([(i, f"nav\nown {i}", "h", 1, 2, 3, 4) for i in range(8)], "doc_id long, text string, source string, host int, drops int, __host int, kept int")
    got = lines.drop_boilerplate(docs, ratio=0.5, least=3)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"] and {r.text for r in got.collect()} == {f"own {i}" for i in range(8)}
    assert lines.drop_boilerplate(docs.where("false")).count() == 0
    long = spark.createDataFrame([(1, "nav\n" * 200_000 + "end", "h"), (2, "nav", "h"), (3, "nav", "h")], "doc_id long, text string, source string")
    assert {r.doc_id: r.text for r in lines.drop_boilerplate(long, ratio=0.5, least=3).collect()} == {1: "end", 2: "", 3: ""}


def test_warc_long_payloads_lie_alone(spark):
    rows = [(1, "a", "x" * (5 << 20)), (2, "b", "y" * 100_000), (3, "c", "z"), (4, "d", "x" * (5 << 20)), (5, "e", None)]
    path = common.new_path(spark, "w")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    back = {r.page_id: r for r in warc.joined(warc.headers(warc.read(spark, path))).collect()}
    assert {k: (r.payload_bytes, r.refers_to) for k, r in back.items()} == {"1": (5 << 20, "4"), "2": (100_000, None), "3": (1, None), "4": (5 << 20, None), "5": (0, None)}
    assert len(spark.read.format("binaryFile").load(path).collect()) == 4
