"""Structured data, the scoring view, ends of content, shells and kept structure: exact pages, SQL and brute force."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from webdistill.functions import coverage as C
from webdistill.functions import extract as X
from webdistill.functions import metadata as M
from webdistill.functions import scoring, shell, terminal
from webdistill.functions import structured as D
from webdistill.functions.compile import compile_content
from webdistill.functions.extract import Options, extract
from webdistill.functions.parser import parse
from webdistill.operators import kernels
from webdistill.operators import pages as P
from webdistill.operators import structure as S
from webdistill.plans import queries as Q
from webdistill.plans import structure as T

SF = "/root/testdata/sf0.001"


def text(k, n=4):
    return " ".join(f"This is sentence {k}.{i} of the text, and it is long enough to count." for i in range(n))


def p(k, n=4):
    return f"<p>{text(k, n)}</p>"


def ld(*items):
    return f"<script type='application/ld+json'>{json.dumps({'@context': 'https://schema.org', '@graph': items})}</script>"


def frame(spark, rows):
    return P.PageFrame(spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string"))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(T.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    want = db.execute(T.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    got = T.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    key = lambda rows: sorted(repr(tuple(r)) for r in rows)
    got, want = key(got.select(*columns).collect()), key(want.fetchall())
    assert got == want and len(want) > 40


# -- structured data
def test_ten_items_and_the_page_takes_its_own():
    items = [{"@type": "NewsArticle", "headline": f"Story number {i} about thing{i}", "url": f"http://a.com/{i}/", "author": {"name": f"Author {i}"}} for i in range(10)]
    page = lambda head: f"<title>Story number 3 about thing3</title>{head}<body><article><h1>Story number 3 about thing3</h1>{p(1)}{p(2)}</article>"
    authors = lambda *x: extract(page(ld(*x)), "http://a.com/3")["metadata"]["authors"]
    assert authors(*items) == ["Author 3"]
    assert authors(*items, dict(reversed(items[3].items()))) == ["Author 3"]  # the same item again
    twin = items[3] | {"author": {"name": "Other"}}
    assert authors(*items, twin) == []  # two fit equally well
    assert authors({"@type": "Product", "name": "Story number 3 about thing3", "author": "P", "url": "http://a.com/3"}, items[3]) == []
    assert authors({"@type": "Product", "name": "Other things", "author": "P"}, items[3]) == ["Author 3"]
    assert authors({"@type": "Article", "author": "Alone"}) == ["Alone"]


def test_fingerprints():
    a = {"x": [1, {"b": None, "a": "é"}], "y": True}
    assert D.fingerprint(a) == D.fingerprint({"y": True, "x": [1, {"a": "é", "b": None}]})
    assert len({D.fingerprint(x) for x in (a, {}, [], None, 0, False, "", {"x": 1}, {"x": "1"}, [1, 2], [2, 1])}) == 11


def test_identity_titles():
    d = parse("<title>Doc</title><main><h1>A <button>copy link</button><input value=x><span aria-hidden=true>§</span>name of it</h1></main>")
    assert D.identity_title(d, "Doc") == "A name of it"
    assert D.identity_title(parse("<h1>x</h1>"), "Doc") == "Doc" and D.identity_title(parse("<h1>x</h1>"), "") == "x"


def test_agreement_by_hand():
    assert D.agreement("A b, c!", "a b c") == 1.0
    # has a and bb of "a bb ccc" (8 characters), misses ccc (3); two of its four words are in it
    c, q = 1 - 3 / 8, 2 / 4
    assert D.agreement("a bb x y", "a bb ccc") == pytest.approx(2 * c * q / (c + q))
    assert D.agreement("", "a") == D.agreement("a", "") == D.agreement("x", "a b") == 0.0


ODD_BODY = " ".join(f"Sentence {i} says that thing{i} is thing{i + 1}, plainly." for i in range(40))
ODD = f"<title>Odd one</title>{ld({'@type': 'NewsArticle', 'headline': 'Odd one', 'articleBody': ODD_BODY})}<body><div class='sidebar widget'><div class=promo-x><span>{ODD_BODY[:900]}</span><i>{ODD_BODY[900:]}</i></div><p>share this</p></div><div class=content><p>{p(4)}</p></div>"


def test_text_in_an_odd_container():
    r = extract(ODD, "http://a.com/3", Options(diagnostics=True))
    assert r["diagnostics"][0]["source"] == "StructuredData" and r["diagnostics"][0]["accepted"]
    assert r["text"].startswith("Sentence 0 says") and "share this" not in r["text"] and "of the text" not in r["text"]
    assert kernels.located_of(ODD, "http://a.com/3") == {"tag": "div", "name": "promo-x", "agreement": pytest.approx(1.0)}


@pytest.mark.parametrize(
    "body,want",
    [
        ("<div id=a><p>alpha beta gamma <b>delta epsilon</b> zeta eta theta</p></div>", "p"),  # the smallest of equal ones; over inline elements
        ("<div id=a><p>alpha beta gamma</p><p>delta epsilon zeta eta theta</p></div>", None),  # not over paragraphs
        ("<nav><p>alpha beta gamma delta epsilon zeta eta theta</p></nav>", None),
        ("<p hidden>alpha beta gamma delta epsilon zeta eta theta</p>", None),
        ("<p>alpha beta gamma delta epsilon zeta " + "other words here " * 30, None),  # too little of it
        ("<p>alpha beta gamma delta epsilon zeta eta</p><section><p>alpha beta gamma delta epsilon zeta eta theta</p></section>", "p"),
    ],
)
def test_locate(body, want):
    found = D.locate(parse(f"<body>{body}").first("body"), ["Alpha beta, gamma delta epsilon zeta eta theta"], X.hidden)
    assert (found[0].tag if found else None) == want
    assert D.locate(parse(f"<body>{body}").first("body"), ["alpha beta gamma delta", ""], X.hidden) is None  # too short


def brute_locate(root, hint):
    """Every element's agreement, straight from the definition."""
    said = lambda x: " ".join(y.text for y in x.walk() if y.tag == "#text")
    scores = [(D.agreement(said(x), hint), len(D.T.words(said(x))), -D.depth(x), x) for x in [root, *root.elements()]]
    start = " ".join(D.T.words(hint)[:6])
    scores = [s for s in scores if s[0] >= D.GOOD and start in " ".join(D.T.words(said(s[3])))]
    best = max(scores, key=lambda s: s[0])[0]
    return min((s for s in scores if s[0] >= best - D.NEAR), key=lambda s: (s[1], -s[0], s[2]))[3]


def test_locate_equals_brute_force():
    words = [f"w{i % 37}x{i}" for i in range(300)]
    for cut in (40, 120, 250, 299):
        html = f"<body><div><p>{text(1)}</p><div>{' '.join(words[:cut])}</div> <em>{' '.join(words[cut:])}</em></div><p>{text(2)}</p>"
        body = parse(html).first("body")
        assert D.locate(body, [" ".join(words)], X.hidden)[0] is brute_locate(body, " ".join(words))


def test_structured_roots_equal_brute_force(spark):
    got = {r.page_id: r for r in T.structured_roots(spark, SF).collect()}
    found = 0
    for i, html in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", T._with_text()).collect():
        d = parse(html)
        hint = M.json_items(d)[0]["articleBody"]
        if got[i].tag is None:
            assert len(D.T.words(hint)) < 5 or not any(f" {' '.join(D.T.words(hint)[:6])} " in f" {' '.join(D.T.words(x.raw_text()))} " for x in d.elements("p"))
            continue
        want = brute_locate(d.first("body"), hint)
        assert (got[i].tag, got[i].name) == (want.tag, want.get("class") or None)
        assert got[i].agreement == pytest.approx(D.agreement(" ".join(x.text for x in want.walk() if x.tag == "#text"), hint), abs=1e-8)
        found += 1
    assert found >= 30 and len(got) >= 40


def test_agreements_equal_kernel(spark):
    rows = [(1, "A b, c!", "a b c"), (2, "a bb x y", "a bb ccc"), (3, None, "a"), (4, "", ""), (5, "x y", "a"), (6, "é É ß_1 ٣", "é ß_1"), (7, "w " * 5000, "w v")]
    got = {r.page_id: r.agreement for r in S.agreements(spark.createDataFrame(rows, "page_id long, text string, hint string")).collect()}
    assert got == {i: pytest.approx(D.agreement(a or "", b or "")) for i, a, b in rows}


def test_page_items_equal_kernel(spark):
    art = lambda n, u=None, **k: {"@type": "Article", "headline": n, **({"url": u} if u else {}), **k}
    sets = [
        ([art("One two", "http://a.com/x/"), art("Three four")], "Three four", "http://a.com/x?q#f"), ([art("Same"), art("Same", k=1)], "Same", None), ([art("Same"), dict(reversed(art("Same").items()))], "Same", None),
        ([art("No")], "Words", "http://b.com"), ([art("a"), art("b")], "c", "http://b.com"), ([art(None, "http://A.com/y"), art("zz")], "t", "http://a.com/y/"), ([{"@type": "Article", "mainEntityOfPage": {"@id": "http://a.com/"}}, art("q")], "q r", "http://a.com"),
        ([], "x", "http://a.com"),
    ]
    rows = [(i, k, json.dumps(x), t, u) for i, (items, t, u) in enumerate(sets) for k, x in enumerate(items)]
    got = {r.page_id: json.loads(r.item) for r in S.page_items(spark.createDataFrame(rows, "page_id long, ord int, item string, title string, url string")).collect()}
    assert got == {i: w for i, (items, t, u) in enumerate(sets) if (w := D.only_best(items, t, u)) is not None} and len(got) >= 4


# -- the scoring view
def test_view_leaves_the_tree_alone():
    html = "<body><div role=heading aria-level=3>Head</div><div role=list><div role=listitem> 3. x</div><div role=listitem>4) y</div></div><div><p>one</p></div><div>a<b>b</b><ul><li>c</li></ul>d</div><div></div><div role=list><div role=listitem>1. x</div><div role=listitem>3. y</div></div>"
    shape = lambda n: n.text if n.tag == "#text" else f"{n.tag}({' '.join(map(shape, n.children))})"
    body = parse(html).first("body")
    before = shape(body)
    v = scoring.View(body, X.Stats(body))
    assert shape(body) == before
    tags = [v.tag(x) for x in body.children]
    assert tags == ["h3", "ol", "div", "div", "p", "ul"]
    assert [v.tag(x) for x in body.children[1].children] == ["li", "li"] and v.starts == {id(body.children[1]): 3} and sorted(v.texts.values()) == ["x", "y"]
    wrapper = body.children[2]
    assert id(wrapper) in v.passed and v.parent(wrapper.children[0]) is body
    said = [("".join(x.raw_text() for x in s.nodes), s.parent.tag) for s in v.seeds]
    assert ("one", "body") in said and ("ab", "div") in said and ("d", "div") in said and ("Head", "body") in said
    assert v.count(body, "heading_count") == 1 and v.count(body, "list_item_count") == 5 and v.count(body.children[1], "list_item_count") == 2


def test_view_of_nested_wrappers():
    body = parse("<body>" + "<div>" * 3000 + f"<p>{text(1)}</p>").first("body")
    v = scoring.View(body, X.Stats(body))
    points = scoring.readability(v, lambda _: 0)
    last = body.elements("div")[-1]
    assert [n.tag for n, _ in points.values()] == ["div"] * 5 and id(last) not in points  # the DIV that wraps the paragraph is passed over


def test_standing_equals_brute_force(spark):
    html = "<body><main><article>a<article>b</article></article><div role=article>c<p itemprop=articleBody>d</p></div></main><article>e</article><div>f</div>"
    body = parse(html).first("body")
    found = [X.Candidate(x, {"Readability"} if x.tag == "p" else {"Semantic"}, 0.0, 7.0, {}, 0) for x in body.elements()]
    view = scoring.View(body, X.Stats(body))
    for c, s in zip(found, scoring.standings(view, found), strict=True):
        up = [x for x in c.node.ancestors() if scoring.authoritative(x)]
        assert s.under == bool(up) and s.within == sum(scoring.authoritative(x) for x in [c.node, *c.node.elements()])
        assert s.points_within == any(x.tag == "p" for x in [c.node, *c.node.elements()])
        peers = [x for x in c.node.elements() if (x.tag == "article" or x.get("role") == "article") and next(a for a in x.ancestors() if scoring.authoritative(a)) is c.node] if scoring.authoritative(c.node) else []
        assert (s.peers, s.peer_points) == (len(peers), 7.0 * len(peers))
    native = sorted((r.node_id, r.under, r.within) for r in S.semantic_standing(frame(spark, [(None, html), (None, ""), (None, None)]).nodes()).collect())
    want = sorted((s.under, s.within) for c, s in zip(found, scoring.standings(view, found), strict=True) if scoring.authoritative(c.node))
    assert sorted(x[1:] for x in native) == want and len(native) == 6


def test_complete_root_bonus():
    f = {"word_count": 100, "paragraph_count": 6, "heading_count": 3, "table_count": 5, "code_block_count": 1, "figure_count": 0, "list_item_count": 2}
    e = scoring.Evidence(8, 80, 1, True)
    assert scoring.complete_root_bonus(e, f) == 20 + 100 / 80 + 3 + 4.5 + 9 + 3 + 1 + 2 + 1 + 4
    for weak in (scoring.Evidence(8, 80, 1, False), scoring.Evidence(7, 80, 1, True), scoring.Evidence(8, 79, 1, True)):
        assert scoring.complete_root_bonus(weak, f) == 0
    assert scoring.complete_root_bonus(e, f | {"heading_count": 2}) == 0


def test_role_lists_become_numbered():
    items = "".join(f"<div role=listitem>{n}. Step {n}</div>" for n in (3, 4, 5))
    assert "3. Step 3\n1. Step 4\n1. Step 5" in extract(f"<article>{p(1)}<div role=list>{items}</div>{p(2)}</article>", None)["markdown"]
    assert "- 3. Step 3" in extract(f"<article>{p(1)}<div role=list>{items.replace('4.', '9.')}</div>{p(2)}</article>", None)["markdown"].replace("\\", "")


def test_ordered_lists_equal_brute_force(spark):
    lists = [["1. a", "2. b"], ["3) a", "4) b", "5) c"], ["1. a", "3. b"], ["1. a", "b"], ["1. a"], ["2. a", "1. b"], [" 7. ", "8. b"], ["1.a", "2.b"], ["1. a", "", "2. b"]]
    html = "".join("<ul>" + "".join(f"<li><b>{x}</b>9. tail</li>" if x else "<li></li>" for x in items) + "</ul>" for items in lists)
    got = sorted((r.n_items, r.start) for r in S.ordered_lists(frame(spark, [(None, html)]).nodes()).collect())
    from webdistill.functions.lists import ordered_markers

    found = [ordered_markers([x for x in ul.children if x.tag == "li"]) for ul in parse(html).elements("ul")]
    assert got == sorted((len(m), m[0][0]) for m in found if m) == [(2, 1), (2, 7), (3, 3)]


# -- ends of content
RELATED = "<ul><li><a href=/1>First other story of the site</a><li><a href=/2>Second other story of the site</a></ul>"


@pytest.mark.parametrize(
    "tail,gone",
    [
        (f"<section><h2>Related articles</h2>{RELATED}</section>", True),
        (f"<h2>Related articles</h2>{RELATED}", True),
        (f"<div><h3>You may also like</h3><div>{RELATED}</div></div><hr>", True),
        (f"<h2>Mehr zum Thema</h2>{RELATED}", True),
        (f"<div class=newsletter-box>Subscribe to our letters</div><div class=related>{RELATED}</div>", True),
        (f"<h2>Related Work</h2>{RELATED}", False),
        (f"<h2>Related articles</h2>{RELATED}{p(3)}{p(4)}", False),  # in the middle
        ("<h2>Related articles</h2><p>We compared ours to other articles, and found them alike in all that counts.</p>", False),
        ("<div class=related><pre>code = 1</pre></div><div class=related><pre>code = 2</pre></div>", False),
    ],
)
def test_terminal_sequences(tail, gone):
    md = extract(f"<article><h1>Own title of it</h1>{p(1)}{p(2)}{tail}</article>", "http://a.com/x")["markdown"]
    assert text(1) in md and text(2) in md
    assert (("other story" not in md and "Subscribe" not in md and "code" not in md and "alike" not in md) if gone else ("other story" in md or "code" in md or "alike" in md)), md


def test_notes_after_a_terminal_run_stay():
    md = extract(f"<article>{p(1)}<p>Noted<sup><a href='#fn1'>1</a></sup> here.</p>{p(2)}<h2>Related articles</h2>{RELATED}<div class=footnotes><ol><li id=fn1>The note.</li></ol></div></article>", "http://a.com/x")["markdown"]
    assert "other story" not in md and "[^1]: The note." in md


def test_positions_equal_kernel(spark):
    html = f"<body><header>Top of it</header><article><p>{text(1)}</p><pre>  x  </pre></article><footer><p>End</p> words</footer>"
    at = terminal.Positions(parse(html).first("body"))
    want = sorted((x.tag, at.before(x), at.text(x), at.after(x), at.near_start(x), at.near_end(x)) for x in at.order if x.tag[0] != "#")
    rows = S.positions(frame(spark, [(None, html), (None, None)]).nodes()).where("page_id = 0").select("tag", "chars_before", "text_chars", "chars_after", "near_start", "near_end").collect()
    assert sorted(map(tuple, rows)) == want
    flat = at.root.raw_text().split()
    assert at.text(at.root) == sum(len(" ".join(x.text.split())) for x in at.order if x.tag == "#text") and flat[0] == "Top"
    whole = T.edge_elements(spark, SF).where("tag = 'footer'").agg(F.min("n_near_end"), F.max("n")).first()
    assert tuple(whole) == (1, 1)


# -- streamed parts and shells
def spliced(html):
    body = parse(f"<body>{html}").first("body")
    n = shell.splice(body)
    return n, " ".join(body.raw_text().split())


def place(i, kind="B"):
    return f"<!--$?--><template id='{kind}:{i}'></template>wait{i}<!--/$-->"


def part(i, inside):
    return f"<div hidden id='S:{i}'>{inside}</div>"


@pytest.mark.parametrize(
    "html,want",
    [
        (f"a {place(0)} z{part(0, 'x')}", (1, "a x z")),
        (f"a {place(0)} z", (0, "a wait0 z")),  # no part
        (f"{place(0)}{part(0, 'x' + place(1))}{part(1, ' y' + place(2))}{part(2, ' w')}", (3, "x y w")),  # a chain
        (f"{part(2, ' w')}{place(0)}{part(1, ' y' + place(2))}{part(0, 'x' + place(1))}", (3, "x y w")),  # in any order
        (f"{place(0)} {part(0, 'x' + place(1))}{part(1, 'y' + place(0))}", (0, "wait0 xwait1ywait0")),  # a circle
        (f"{place(0)} {part(0, 'x' + place(0))}", (0, "wait0 xwait0")),  # a part in itself
        (f"{place(0)} {part(0, 'x' + place(7))}", (0, "wait0 xwait7")),  # a part that misses one
        (f"<template id='P:0'></template>{part(0, 'x' + place(7))}", (1, "xwait7")),  # nothing is lost where nothing is shown until then
        (f"{place(0)}{part(0, 'one')}{part(0, 'two')}", (1, "onetwo")),  # the first of a key
        (f"<template id='B:0'></template>wait {part(0, 'x')}", (1, "xwait")),  # no end is marked: nothing goes
        (f"{place(0)}<div id='S:0'>x</div>", (0, "wait0x")),  # not hidden: no part
        (f"<!--$?--><template id='rB:1f'></template>a<!--$-->b<!--/$-->c<!--/$-->d<div hidden id='rS:1f'>x</div>", (1, "xd")),  # bounds within bounds
        ("<template id='B:0'>kept</template>" + part(0, "x"), (0, "keptx")),
    ],
)
def test_splicing(html, want):
    assert spliced(html) == want


def test_long_chains_of_parts():
    n = 3000
    html = place(0) + "".join(part(i, f"p{i} " + (place(i + 1) if i + 1 < n else "")) for i in range(n))
    got = spliced(html)
    assert got[0] == n and got[1].split() == [f"p{i}" for i in range(n)]


def test_streamed_pages_equal_plain_ones(spark):
    got = {r.page_id: r.markdown_md5 for r in T.streamed_segments(spark, SF).collect()}
    plain = {r.page_id: r[1] for r in Q._pages(spark, SF).extract().select("page_id", F.md5("page.markdown")).collect()}
    assert got == plain and len(got) > 40


ARTICLE = "<main><h1>Recovery guide</h1><p>Stop writes before the snapshot is attached to the new volume.</p><p>Verify the restored checksum before traffic resumes on the replica.</p><p>Keep the old volume for one week before you delete it.</p></main>"


@pytest.mark.parametrize(
    "html,shown",
    [
        (f"<div id=root>Loading…</div><noscript>{ARTICLE}</noscript>", True),
        (f"<div id=root></div><template>{ARTICLE}</template>", True),
        (f"<div class=spinner></div><button>Menu</button><noscript>{ARTICLE}</noscript>", True),
        (f"<header>Site</header><div id=my-app></div><noscript>{ARTICLE}</noscript>", True),
        (f"<noscript>{ARTICLE}</noscript>", False),  # no sign of a program
        (f"<div id=root><p>Words of its own.</p></div><noscript>{ARTICLE}</noscript>", False),
        (f"<div id=root><img src=x.png></div><template>{ARTICLE}</template>", False),
        (f"<div id=root><button><img src=x.png></button></div><template>{ARTICLE}</template>", False),
        (f"<div id=root><svg width=16 height=16></svg></div><template>{ARTICLE}</template>", True),
        (f"<div id=root><svg width=300 height=200></svg></div><template>{ARTICLE}</template>", False),
        ("<div id=root></div><noscript><h1>Hi</h1><p>You need to enable JavaScript to run this app, it is needed here for all that there is to see on it.</p><p>Please turn it on in the settings of your browser, then load this page once more.</p></noscript>", False),
        ("<div id=root></div><noscript>Short.</noscript>", False),
    ],
)
def test_shells(html, shown):
    row = kernels.page(f"<body>{html}", "http://a.com/", Options())
    assert ("checksum" in (row["text"] or "")) == shown
    body = parse(f"<body>{html}").first("body")
    assert (shell.reveal(body, X.hidden) is not None) == shown


def test_one_copy_is_shown():
    row = kernels.page(f"<body><div id=app></div><noscript>{ARTICLE}</noscript><template>{ARTICLE.replace("</main>", "<p>And a little more of it is told here.</p></main>")}</template>", "http://a.com/", Options())
    assert row["text"].count("checksum") == 1 and "a little more" in row["text"]


def test_shell_pages_query(spark):
    rows = T.shell_pages(spark, SF).collect()
    assert len(rows) > 40 and sum(r.error_kind is None for r in rows) > 40


# -- kept structure
STRUCTURED = """<article><h2>One</h2><h2>Two</h2><h2>Three</h2><ul><li>a <b>b</b><ul><li>inner</li></ul></li><li>c</li><li>c</li></ul><ol><li>x<li>y</ol><pre>k</pre>
<figure><img src=/f.png alt=pic></figure><img src=/g.png><p>n<sup><a href=#fn1>1</a></sup> <math alttext='x^2'></math></p><table><tr><th>h<tr><td>v</table><ol><li id=fn1>note</ol></article>"""


def test_structure_by_hand():
    s = C.measure(compile_content(parse(STRUCTURED).first("body"), "http://a.com/"))
    assert (s.code_blocks, s.tables, s.visuals, s.headings, s.math, s.notes) == (1, 1, 2, 3, 1, {"1"})
    assert s.items == {"a b": 1, "c": 2, "inner": 1, "x": 1, "y": 1} and s.substantial == {"a b": 1, "c": 2}
    less = C.measure(compile_content(parse("<ul><li>c</li></ul><h2>q</h2><pre>1</pre><pre>2</pre>").first("body"), None))
    got = {x["category"]: (x["source_count"], x["result_count"], x["coverage"]) for x in C.coverage(s, less)}
    assert got["SubstantialListItems"] == (3, 1, 1 / 3) and got["Headings"] == (3, 1, 1 / 3) and got["CodeBlocks"] == (1, 2, 1.0) and got["FootnoteDefinitions"] == (1, 0, 0.0)
    assert C.score(C.coverage(s, s)) == 1.0 and C.score(C.coverage(less, s)) == 0.5 and C.score([]) is None


def test_coverage_in_diagnostics():
    a = extract(f"<article>{p(1)}{p(2)}<h2>A</h2><h2>B</h2><h2>C</h2><ul><li>q<li>r<li>s</ul></article>", None, Options(diagnostics=True))["diagnostics"][0]
    assert a["coverage"] == 1.0 and {x["category"] for x in a["categories"]} == {"Headings", "SubstantialListItems"} and a["normalization"]["tables"] == 0


def test_native_coverage_equals_kernel(spark):
    pages = [("http://a.com/", STRUCTURED), ("http://a.com/", f"<article>{p(1)}{p(2)}</article>"), ("http://a.com/", f"<body>{STRUCTURED}{p(1)}{p(2)}<div class=sidebar><ul><li>z<li>z<li>y</ul></div>")]
    f = frame(spark, pages)
    whole, best = Options(content_root=("tag", "body")), Options(content_root=("tag", "article"))
    got = {}
    for r in S.semantic_coverage(f.blocks(whole), f.blocks(best)).collect():
        got.setdefault(r.page_id, {})[r.category] = (r.source_count, r.result_count, r.coverage)
    for i, (u, h) in enumerate(pages):
        a, b = (C.measure(extract(h, u, o)["blocks"]) for o in (whole, best))
        assert got.get(i, {}) == {x["category"]: (x["source_count"], x["result_count"], pytest.approx(x["coverage"])) for x in C.coverage(a, b)}
    assert got[2]["SubstantialListItems"][0] > got[2]["SubstantialListItems"][1]


def test_coverage_reads_each_side_once(spark):
    plan = T.semantic_coverage(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "Join" not in plan


def test_tapes(spark):
    f = frame(spark, [("http://a.com/", STRUCTURED), ("http://a.com/", f"<article>{p(1)}<blockquote><p>q<ul><li>a<ul><li>b</ul></ul></blockquote></article>")])
    blocks = f.blocks().cache()
    assert S.tape_faults(blocks).count() == 0 and blocks.count() > 60
    faulty = lambda where, **change: {r.rule for r in S.tape_faults(blocks.where("page_id = 0").where(where).select("*").withColumns({k: F.expr(v) for k, v in change.items()})).collect()}
    last = blocks.where("page_id = 0").agg(F.max("ord")).first()[0]
    assert "Unclosed" in faulty(f"ord < {last - 1}") or "Unclosed" in faulty(f"ord <> {last}")
    assert "Negative" in faulty("NOT (op = 'Table' AND NOT close)") and "Place" in faulty("NOT (op = 'TableRow')")
    assert "Mismatch" in faulty("true", op="CASE WHEN op = 'Table' AND close THEN 'List' ELSE op END")
    assert "Level" in faulty("true", level="CASE WHEN op = 'Heading' THEN 7 END") and "Address" in faulty("true", src="CASE WHEN op = 'Image' THEN 'javascript:x' END")
    assert T.tape_faults(spark, SF).agg(F.sum("n_faults"), F.sum(F.col("n_opening") - F.col("n_closing")), F.min("n_operations")).first()[:2] == (0, 0)


def test_tape_query_reads_pages_once(spark):
    plan = T.tape_faults(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan
    blocks = frame(spark, [("http://a.com/", STRUCTURED)]).blocks().where("NOT (op = 'TableRow')")
    marks = S.tape_marks(blocks)
    assert marks.count() == blocks.count() and marks.agg(F.sum(F.size("rules"))).first()[0] == S.tape_faults(blocks).count() > 0


def test_odd_rows(spark):
    """Nulls, empty and broken pages give rows of nothing, and no error."""
    f = frame(spark, [(None, None), ("x", ""), ("http://a.com/", "<script type='application/ld+json'>{"), ("http://a.com/", "</p><template id='B:0'>")])
    assert S.streamed_parts(f.nodes()).count() == 1 and S.ordered_lists(f.nodes()).count() == S.tape_faults(f.blocks()).count() == 0
    assert f.pages.select(kernels.structured_root("html", "url").alias("r")).where("r.tag IS NOT NULL").count() == 0
    empty = f.pages.limit(0)
    assert S.semantic_coverage(P.PageFrame(empty).blocks(), P.PageFrame(empty).blocks()).count() == S.positions(P.PageFrame(empty).nodes()).count() == 0
    assert M.described(parse(""), None, []) == (None, False)
