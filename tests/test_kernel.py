"""The page kernel on small pages: parsing, metadata, content, blocks, renderers."""

import pytest

from webdistill.functions import metadata as M
from webdistill.functions import render
from webdistill.functions import text as T
from webdistill.functions.compile import compile_content, tape
from webdistill.functions.extract import Options, PageError, extract, hidden_style
from webdistill.functions.parser import UNTRUSTED, Budget, LimitError, parse
from webdistill.operators import kernels
from webdistill.sources.decode import decode_html


def shape(node):
    return node.text if node.tag == "#text" else f"{node.tag}({' '.join(map(shape, node.children))})"


@pytest.mark.parametrize(
    "html,want",
    [
        ("<p><b>a<br><p>c", "p(b(a br())) p(b(c))"),
        ("<p>1<b>2<i>3</b>4</i>5</p>", "p(1 b(2 i(3)) i(4) 5)"),
        ("<b>1<p>2</b>3</p>", "b(1) p(b(2) 3)"),
        ("<table><tr><td>a</td>y<td>b</table>z", "y table(tbody(tr(td(a) td(b)))) z"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "ul(li(a) li(b ul(li(c))))"),
        ("<a href=1>x<a href=2>y</a>", "a(x) a(y)"),
        ("<svg><path /><p>q", "svg(path()) p(q)"),
        ("<div><p>a<div>b</div>c", "div(p(a) div(b) c)"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "dl(dt(a) dd(b) dt(c))"),
        ("<pre>\n\nx</pre>", "pre(\nx)"),
        ("&amp;lt; &copy &notit;", "&lt; © ¬it;"),
        ("<select><option>a<option>b</select>c", "select(option(a) option(b)) c"),
        ("<!-- x --><!doctype html>a", "a"),
        ("<table><table><tr><td>x", "table() table(tbody(tr(td(x))))"),
        ("a < b <3", "a < b <3"),
    ],
)
def test_trees(html, want):
    assert " ".join(map(shape, parse(html).first("body").children)) == want


def test_scripts_titles_and_formatting_limit():
    d = parse("<title>A &amp; <b></title><script>x='</p>'</script><body>" + "<p><b>x" * 6)
    assert d.first("title").raw_text() == "A & <b>" and d.first("script").raw_text() == "x='</p>'"
    deepest = max(sum(a.tag == "b" for a in x.ancestors()) for x in d.walk() if x.tag == "#text" and x.text == "x")
    assert deepest == 4  # three that are reconstructed and its own


def test_deep_nesting_and_budget():
    assert sum(1 for _ in parse("<div>" * 8000 + "x").walk()) > 8000
    with pytest.raises(LimitError) as e:
        parse("<div>" * 8000, UNTRUSTED)
    assert e.value.resource == "depth" and e.value.limit == 512
    with pytest.raises(LimitError):
        parse("<p>x</p>" * 100, Budget(elements=50))


def test_decoding():
    assert decode_html("é".encode()) == "é"
    assert decode_html(b"\xe9") == "é"
    assert decode_html("é".encode("utf-16")) == "é"
    assert decode_html(b"<meta charset=iso-8859-2>\xb1")[-1] == "ą"
    assert decode_html(b"\xb1", "text/html; charset='ISO-8859-2'") == "ą"
    assert decode_html(b"<meta charset=utf-16>\xc3\xa9") == "<meta charset=utf-16>é"


def test_addresses():
    assert T.resolve("http://a.com/b/c", "../d?x#y") == "http://a.com/d?x#y"
    assert T.resolve("http://a.com", "//B.com") == "http://b.com/"
    assert T.resolve(None, "x/y") == "x/y" and T.resolve(None, "#f") == "#f"
    assert T.resolve("http://a.com", "javascript:x") is None and T.resolve("http://a.com", "java\tscript:x") is None
    assert T.resolve("http://a.com", "mailto:a@b.c") == "mailto:a@b.c"
    assert T.resolve("http://a.com:80/x", "/é") == "http://a.com/%C3%A9"


def test_titles_with_separators():
    assert T.page_title("Harbour, | lights.", None) == "Harbour, | lights." and T.page_title("Alpha beta gamma delta | x", None) == "Alpha beta gamma delta | x"
    assert T.page_title("Alpha beta > Site", None) == "Site" and T.page_title("A good long title indeed » Site", None) == "A good long title indeed"
    whole = "Harbours | bridges | ferries | lighthouses."
    assert T.page_title(whole, whole) == whole and T.page_title(whole, "Other") == "Harbours | bridges | ferries"
    for title in (whole, "Harbour, | lights."):
        page = extract(f"<title>{title}</title><body><article><h1>{title}</h1><h2>Part</h2><p>Some words that are long enough to stay, all of them.</p></article>", "http://a.com/x", Options())
        assert page["metadata"]["title"] == title and page["markdown"].startswith("## Part")


def test_titles():
    assert T.page_title("How to bake good bread | Kitchen", None) == "How to bake good bread"
    assert T.page_title("Short", "The only heading") == "The only heading" or T.page_title("Short", None) == "Short"
    assert T.matches_title("How to bake", "How to bake | Site") and not T.matches_title("Other words", "How to bake")


PAGE = """<html lang="en_GB"><head><title>How to bake good bread | Kitchen</title><meta property="og:title" content="How to bake good bread">
<meta property="og:site_name" content="Kitchen"><meta name="keywords" content="bread, oven, Bread, kitchen"><link rel=canonical href="/bread">
<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"NewsArticle","headline":"How to bake good bread","author":[{"name":"Ada Baker"}],"datePublished":"2024-05-01"}]}</script></head>
<body><nav><a href="/">Home</a> <a href="/a">All</a></nav><div class="newsletter">Sign up for our newsletter</div><article><h1>How to bake good bread</h1>
<p>Bread needs flour, water, salt and time. Mix them well, and wait until the dough has risen twice.</p><h2>Steps <a href="#s">#</a></h2><ol start="2"><li>Knead it</li><li>Wait</li></ol>
<p hidden>Secret</p><p>Bake it <em>hot</em> at 230&nbsp;degrees for half an hour, then let it cool on a rack, as <a href="tips.html">our tips</a> say.</p>
<table><tr><th>Flour</th><th>Water</th></tr><tr><td>500 g</td><td>350 g</td></tr></table><pre><code class="language-py">bake()</code></pre>
<img src="/loaf.jpg" alt="A loaf"><h3>Related stories</h3><ul><li><a href="/x">Rolls for everyone</a></li><li><a href="/y">Cakes for everyone</a></li></ul></article>
<footer>&copy; Kitchen</footer></body></html>"""


def test_whole_page():
    p = extract(PAGE, "https://www.kitchen.com/b/bread?x=1", Options(diagnostics=True, metadata_diagnostics=True, retain_structured_data=True))
    m = p["metadata"]
    assert (m["title"], m["site_name"], m["language"], m["canonical_url"]) == ("How to bake good bread", "Kitchen", "en-GB", "https://www.kitchen.com/bread")
    assert m["authors"] == ["Ada Baker"] and m["published_time"] == "2024-05-01" and m["tags"] == ["bread", "oven"]
    md = p["markdown"]
    for want in ("## Steps", "2. Knead it\n1. Wait", "*hot*", "[our tips](https://www.kitchen.com/b/tips.html)", "| Flour | Water |\n| --- | --- |\n| 500 g | 350 g |", "```py\nbake()\n```", "![A loaf](https://www.kitchen.com/loaf.jpg)"):
        assert want in md, md
    for gone in ("Secret", "newsletter", "Home", "Rolls", "Kitchen", "# How to bake"):
        assert gone not in md, md
    assert p["diagnostics"][0]["accepted"] and len(p["structured_data"]) == 1
    assert [x for x in p["metadata_diagnostics"] if x["field"] == "title" and x["selected"]][0]["source"] == "json_ld"
    assert p["metrics"]["table_count"] == 1 and p["metrics"]["code_block_count"] == 1
    assert "<ol start=\"2\">" in p["html"] and "Flour" in p["text"]


def test_options_and_errors():
    p = extract(PAGE, "https://k.com/", Options(links=False, images=False, max_line_width=40))
    assert "](" not in p["markdown"] and all(len(x) <= 40 for x in p["markdown"].split("\n") if not x.startswith(("|", "`")))
    assert "Flour" in extract(PAGE, None, Options(content_root=("tag", "table")))["text"]
    for kind, args in {"InvalidUrl": ("x", "nope"), "ContentRootNotFound": (PAGE, None, Options(content_root=("id", "q"))), "NoContent": ("", None), "ResourceLimit": (PAGE, None, Options(budget=Budget(input_bytes=10)))}.items():
        with pytest.raises(PageError) as e:
            extract(*args)
        assert e.value.kind == kind


@pytest.mark.parametrize(
    "html",
    ["<h1>Access Denied</h1><p>You don't have permission to access this page. Reference #18.2", "<body>Please enable JavaScript to run this app.", "<div class=spinner>Loading...</div>", "<button>a</button><input><span>x"],
)
def test_barriers_and_shells(html):
    with pytest.raises(PageError) as e:
        extract(html, "http://a.com")
    assert e.value.kind == "NoContent"


def test_visibility():
    assert hidden_style("display:none") and not hidden_style("display:none;display:block") and hidden_style("display:none !important;display:block") and hidden_style("opacity: 0")
    text = "word, " * 80
    p = extract(f"<body><div style='display:none'><p>{text}</p><p>other {text}</p></div><p>Hi</p>", None)
    assert p["metrics"]["word_count"] > 100  # hidden content is taken where nothing else is there


def blocks(html):
    return compile_content(parse(f"<body>{html}").first("body"), "http://a.com/")


def test_blocks_and_markdown():
    md = lambda h: render.markdown(blocks(h))
    assert md("<p>a*b_c [d]") == "a\\*b\\_c \\[d\\]"
    assert md("<p># x<p>1. y<p>- z") == "\\# x\n\n1\\. y\n\n\\- z"
    assert md("<ul><li>a<ul><li>b</ul><li><input type=checkbox checked> c</ul>") == "- a\n  - b\n- [x] c"
    assert md("<blockquote><p>a<p>b</blockquote>") == "> a\n>\n> b"
    assert md("<pre>a\n```\nb</pre>") == "````\na\n```\nb\n````"
    assert md("<p>x<sup><a href=#fn1>1</a></sup></p><ol><li id=fn1>n <a href=#r>↩</a></ol>") == "x[^1]\n\n[^1]: n"
    assert md("<div class='admonition warning'><p class=admonition-title>Careful</p><p>x</div>") == "> **Careful**\n>\n> x"
    assert md("<dl><dt>t<dd>d</dl>") == "t\n\n: d"
    assert md("<p><math alttext='x^2'><mi>x</mi></math> y") == "$x^2$ y"
    assert md("<figure><img src=a.png alt=z><figcaption>cap</figcaption></figure>") == "![z](http://a.com/a.png)\n\ncap"
    assert md("<img srcset='a.png 1x, b.png 2x' alt=q>") == "![q](http://a.com/b.png)"
    assert md("<iframe src='https://www.youtube.com/embed/abc?x=1' title=V></iframe>") == "[V](https://www.youtube.com/watch?v=abc)"
    assert md("<table role=presentation><tr><td>a<td>b</table>") == "a\n\nb"
    assert md("a<br>b<hr><h2>h</h2>") == "a  \nb\n\n---\n\n## h"
    assert md("<p><a href=/x><a href=/y>z</a></a> <a href='javascript:1'>q</a>") == "[z](http://a.com/y) q"


def test_tape_is_balanced():
    open_at = []
    for x in tape(blocks("<ul><li>a<b>c</b><li>d</ul><table><tr><th>x<tr><td>y</table>")):
        if x["close"]:
            assert open_at.pop() == x["op"]
        elif x["op"] not in ("Text",):
            open_at.append(x["op"])
    assert not open_at


def test_discussions():
    html = "<table>" + "".join(f"<tr class=athing><td class=ind indent={d}></td><td><a class=hnuser>u{i}</a><div class=commtext>Comment {i}</div>" for i, d in enumerate([0, 1, 1, 0])) + "</table>"
    p = extract(html, "https://news.ycombinator.com/item?id=1")
    assert p["kind"] == "Discussion" and p["markdown"].count("> > **u") == 2 and "Comment 3" in p["markdown"]


def test_agreement_raises_scores():
    found = [M.Candidate("title", "A", "twitter", 86, 0), M.Candidate("title", "B", "html_meta", 84, 1), M.Candidate("title", "b", "open_graph", 80, 2)]
    assert M.resolved(found)["title"] == "B"


def test_listing_tables_math_and_jobs():
    rows = "".join(f"<tr><td>{i}.<td><a href=/{i}>Story {i}</a><tr><td><td>{i} points" for i in range(1, 5))
    md = render.markdown(blocks(f"<table>{rows}</table>"))
    assert md.startswith("1. [Story 1](http://a.com/1)  \n   1 points\n1. [Story 2]"), md
    assert render.markdown(blocks("<p><math><mfrac><mi>a</mi><msup><mi>b</mi><mn>2</mn></msup></mfrac></math> x")) == "$\\frac{a}{b^{2}}$ x"
    job = '<script type="application/ld+json">{"@context":"https://schema.org","@type":"JobPosting","title":"Baker","hiringOrganization":{"name":"Kitchen"},"jobLocation":{"address":{"addressLocality":"Bern"}},"baseSalary":{"currency":"CHF","value":{"minValue":5,"maxValue":6,"unitText":"HOUR"}}}</script>'
    p = extract(job + "<main><p>" + "We bake bread every night, and look for help. " * 5 + "</main>", "http://a.com/")
    assert p["markdown"].startswith("**Role:** Baker\n\n**Company:** Kitchen\n\n**Location:** Bern\n\n**Salary:** CHF 5–6 per hour"), p["markdown"]


@pytest.mark.parametrize("depth", [300, 2000, 8000])
def test_deep_nesting_loses_nothing(depth):
    """Content below very many elements is kept; the text, Markdown and HTML are those of the flat page."""
    body = "<p>Deep words of a real text, kept whole and in order. " * 12
    made = [kernels.page(f"<html><head><title>T</title></head><body>{'<div>' * n}{body}{'</div>' * n}</body></html>", "http://a.example/x", Options()) for n in (1, depth)]
    assert made[1]["error"] is None and made[1]["text"] == made[0]["text"] and made[1]["markdown"] == made[0]["markdown"]


SHAPES = {
    "div": lambda n: "<div>" * n, "article": lambda n: "<article>" * n, "blockquote": lambda n: "<blockquote>" * n, "li": lambda n: "<ul><li>" * n, "span": lambda n: "<span>" * n,
    "b": lambda n: "<div><b>" * n, "td": lambda n: "<table><tr><td>" * (n // 8), "details": lambda n: "<details><summary>s</summary>" * n, "dl": lambda n: "<dl><dd>" * n,
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_any_deep_nesting_keeps_the_text(shape):
    """No depth and no kind of element makes an error of a page or costs its text."""
    body = "".join(f"<p>Deep words {k} of a real text, kept whole and in order.</p>" for k in range(30))
    for n in (30, 8000):
        row = kernels.page(f"<html><head><title>T</title></head><body>{SHAPES[shape](n)}{body}", "http://a.example/x", Options())
        assert row["error"] is None
        at = [row["text"].find(f"Deep words {k} of") for k in range(30)]
        assert at == sorted(at) and at[0] >= 0 and all(f"Deep words {k} of" in row["markdown"] and f"Deep words {k} of" in row["html"] for k in range(30))


def test_time_grows_in_proportion():
    """Text at each of many levels, and levels of many kinds: twice the page takes less than three times the time."""
    import time

    def took(html):
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            kernels.page(html, "http://a.example/x", Options())
            best = min(best, time.perf_counter() - start)
        return best

    for unit in ("<div><p>Text of this level, some words to count.", "<article>x y z", "<ul><li>item of the list", "<table><tr><td>cell", "<blockquote><p>quoted words here"):
        a, b = took(unit * 1000), took(unit * 2000)
        assert b < 3 * a, (unit, a, b)


def test_shallow_trees():
    from webdistill.functions.compile import BLOCK_TAGS
    from webdistill.functions.dom import shallow

    d = parse("<body><nav><a href=/x>n</a></nav>" + "<div>a<i>b</i>" * 300 + "<table><tr><td>t</table><p>end" + "</div>c" * 300).first("body")
    said = d.raw_text()
    assert shallow(d, 100, BLOCK_TAGS, lambda x: False) > 150 and d.raw_text() == said
    assert max(sum(1 for _ in x.ancestors()) for x in d.walk()) <= 110 and d.first("nav") and d.first("table").first("td").raw_text() == "t"
    assert shallow(d, 200, BLOCK_TAGS, lambda x: False) == 0
    e = parse("<body>" + "<div>" * 60 + "<div hidden>" + "<div>" * 300 + "secret" + "</div>" * 301 + "shown").first("body")
    shallow(e, 100, BLOCK_TAGS, lambda x: "hidden" in x.attrs)
    assert e.raw_text() == "shown"
