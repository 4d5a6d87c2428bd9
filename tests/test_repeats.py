"""Views for other screens, tables of contents, line numbers, unknown forums and gates of quality: exact pages."""

import pytest

from webdistill.functions import discussion, render, repeats
from webdistill.functions import extract as X
from webdistill.functions.compile import compile_content
from webdistill.functions.extract import Options, PageError, extract
from webdistill.functions.parser import parse


def p(k, n=4):
    return "<p>" + " ".join(f"This is sentence {k}.{i} of the text, and it is long enough to count." for i in range(n)) + "</p>"


def md(inside, url="http://a.com/x"):
    return extract(f"<title>T</title><article><h1>Own title of it</h1>{p(1)}{inside}{p(2)}</article>", url)["markdown"]


ROWS = [("Alpha", "one"), ("Beta", "two"), ("Gamma", "three"), ("Delta", "four")]
TABLE = "<table><tr><th>Name<th>Value</tr>" + "".join(f"<tr><td>{a}<td>{b}</tr>" for a, b in ROWS) + "</table>"
CARDS = "<ul>" + "".join(f"<li><b>{a}</b> {b}</li>" for a, b in ROWS) + "</ul>"


@pytest.mark.parametrize(
    "html,table,cards",
    [
        (f"<div class='hidden md:block'>{TABLE}</div><div class='md:hidden'>{CARDS}</div>", True, False),
        (f"<div class='md:hidden'>{CARDS}</div><p>Between the two of them.</p><div class='hidden md:table'>{TABLE}</div>", True, False),
        (f"<div class='d-none d-md-block'>{TABLE}</div><div class='d-md-none'>{CARDS}</div>", True, False),
        (f"<div class='hidden md:block'>{TABLE}</div><div class='md:hidden'>{CARDS.replace('Beta', 'Other').replace('two', 'thing')}</div>", True, True),  # not the same
        (f"<div class='hidden md:block'>{TABLE}</div><div>{CARDS}</div>", True, True),  # shown on all screens
        (f"<div class='md:hidden'>{CARDS}</div>", False, True),
    ],
)
def test_views_of_the_same(html, table, cards):
    out = md(html)
    assert ("| Alpha | one |" in out) == table and ("- **Alpha** one" in out) == cards and ("Between the two" in out) == ("Between" in html)


def test_views_of_lists():
    out = md(f"<div class='hidden lg:block'>{CARDS}</div><div class='lg:hidden'><p>Alpha one, Beta two, Gamma three, Delta four</p></div>")
    assert "- **Alpha** one" in out and "Alpha one, Beta" not in out


LINKS = "<ul><li><a href='#a'>First part</a><li><a href='#b'>Second part</a></ul>"
PARTS = f"<h2 id=a>First part</h2>{p(3)}<h2 id=b>Second part</h2>{p(4)}"


@pytest.mark.parametrize(
    "html,gone",
    [
        (f"<div class=toc>{LINKS}</div>{PARTS}", True),
        (f"<div><h3>On this page</h3>{LINKS}</div>{PARTS}", True),
        (f"<section aria-label='Table of contents'>{LINKS}</section>{PARTS}", True),
        (f"<details><summary>Inhalt</summary>{LINKS}</details>{PARTS}", True),
        (f"<div class=toc>{LINKS}</div>", False),  # nothing that it could list
        (f"<div class=protocol>{LINKS}</div>{PARTS}", False),
        (f"<div class=toc>{LINKS.replace('#', '/')}</div>{PARTS}", False),  # leads to other pages
    ],
)
def test_tables_of_contents(html, gone):
    out = md(html)
    assert ("- [First part](" not in out) == gone and ("## First part" in out) == ("<h2" in html)


@pytest.mark.parametrize(
    "html,want",
    [
        ("<table class=highlight><tr><td class=gutter><pre>1\n2\n3</pre></td><td class=code><pre>a = 1\nb = 2\nc = 3</pre></td></tr></table>", "```\na = 1\nb = 2\nc = 3\n```"),
        ("<div><div class=line-numbers><span>1</span>\n<span>2</span></div><pre>a\nb</pre></div>", "```\na\nb\n```"),
        ("<pre><span class=lineno>1</span>a = 1\n<span class=lineno>2</span>b = 2</pre>", "```\na = 1\nb = 2\n```"),
        ("<pre>1\n2\n3</pre>", "```\n1\n2\n3\n```"),  # numbers that are the code
        ("<table><tr><th>n<th>code</tr><tr><td>1<td><pre>x\ny</pre></tr></table>", "| n | code |"),
    ],
)
def test_line_numbers(html, want):
    out = md(html)
    assert want in out and (want == "| n | code |" or out.count("```") == 2), out


def test_no_gutter_without_all_numbers():
    root = parse("<div><pre>1\n2\n4</pre><pre>a\nb\nc</pre></div>").first("body")
    assert repeats.drop_gutters(root) == 0


FORUM = f"""<div id=app><article class=h-entry><h1><a class=u-url href=/1>Why is bread good</a></h1><a class=p-author>ann</a><div class=e-content>{p(1)}{p(2)}</div></article>
<section>{{}}</section></div>"""


def reply(i, author, text, inside=""):
    return f"<div class=comment data-shortid={i}><a class=author>{author}</a><div class=comment_text><p>{text}</p></div>{inside}</div>"


def test_an_unknown_forum_gives_a_thread():
    replies = reply("a", "bob", "Since it is warm.", reply("b", "cy", "And fresh.", reply("d", "bob", "Yes."))) + reply("c", "di", "I like cake.") + reply("c", "di", "I like cake.")
    page = extract(f"<title>Why is bread good</title>{FORUM.format(replies)}", "http://forum.unknown/1")
    out = page["markdown"]
    assert page["kind"] == "Discussion" and "This is sentence 1.0" in out and out.count("I like cake.") == 1
    assert "> **bob**\n>\n> Since it is warm.\n>\n> > **cy**\n> >\n> > And fresh.\n> >\n> > > **bob**" in out and "> **di**" in out


def test_questions_and_answers():
    answers = "".join(f"<div itemprop=suggestedAnswer itemscope itemtype=https://schema.org/Answer><div itemprop=text><p>Answer number {k} to it.</p></div><span itemprop=author>user{k}</span></div>" for k in (1, 2))
    page = extract(f"<main itemscope itemtype='https://schema.org/Question'><h1 itemprop=name>How so</h1><div itemprop=text>{p(1)}</div>{answers}</main>", "http://q.unknown/")
    assert page["kind"] == "Discussion" and "> **user2**\n>\n> Answer number 2 to it." in page["markdown"]


@pytest.mark.parametrize("replies", ["", reply("a", "bob", "One alone."), reply("a", "x", "Same.") + reply("b", "y", "Same."), "<div class=comment>no id</div>" * 3])
def test_pages_that_are_no_discussion(replies):
    assert discussion.thread(parse(FORUM.format(replies)).first("body")) is None
    assert discussion.thread(parse(f"<article>{p(1)}</article>{reply('a', 'x', 'One.')}{reply('b', 'y', 'Two.')}").first("body")) is None


def measured(inside):
    blocks = compile_content(parse(f"<body>{inside}").first("body"), "http://a.com/")
    return render.metrics(blocks), render.plain_text(blocks)


LINKED = " ".join(f"<a href=/{k}>Another page of this site {k}</a>" for k in range(4))


@pytest.mark.parametrize(
    "html,links,values",
    [
        (f"<h2>{LINKED}</h2>", True, False), (f"<h2>{LINKED}</h2><h3>x</h3>", False, False), (f"<p>{LINKED}</p>", False, False), (f"<ul><li>{LINKED}<li>a<li>b</ul>", False, False), ("<h2><a href=/x>Short</a></h2>", False, False),
        ("<p>12 345 67</p>", False, True), ("<p>a 12 34</p>", False, True), ("<p>Price 12 of many words</p>", False, False), ("<h2>12 345</h2>", False, False), ("<p>*** ... ***</p>", False, True), ("<p>" + "12 " * 30 + "</p>", False, False),
    ],
)
def test_gates_of_results(html, links, values):
    m, text = measured(html)
    assert (X.link_only(m), X.incoherent(m, text)) == (links, values)


def test_roots_that_are_notices():
    node = lambda a: parse(f"<div {a}>x").first("div")
    assert all(X.boilerplate_root(node(a)) for a in ("id=cookie", "class='Not-Found'", "class='access denied'"))
    assert not any(X.boilerplate_root(node(a)) for a in ("id=cookies-recipe", "class='page not-found'", "title=cookie"))
    attempts = extract(f"<body><main class='sign-in'>{p(1)}</main><div>{p(2)}{p(3)}</div>", "http://a.com/", Options(diagnostics=True))["diagnostics"]
    assert attempts[0]["rejection"] == "BoilerplateRoot" or attempts[0]["root"] != "main"
    assert sum(a["accepted"] for a in attempts) == 1
    with pytest.raises(PageError):
        extract("<body><div>12 345 67</div>", "http://a.com/")


def test_prose_may_say_the_same_again():
    again = "<p>The very same paragraph stands here, and is said in full each time.</p>"
    md = lambda inside: extract(f"<title>T</title><article><h1>Own title of it</h1>{p(1)}{inside}{p(2)}</article>", "http://a.com/x", Options(repeats=True))["markdown"]
    made = md(again + p(3) + again)
    assert made.count("The very same paragraph") == 2
    listed = "<ul><li>The first of the items of this list</li><li>The second of the items of it</li></ul>"
    assert md(listed + p(3) + listed).count("The first of the items") == 2
    assert md(f"<div>{again}</div>{p(3)}<div>{again}</div>").count("The very same paragraph") == 1
