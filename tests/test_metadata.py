"""Dates in words, their roles, and lists of authors."""

import pytest

from webdistill.functions import dates
from webdistill.functions import metadata as M
from webdistill.functions.extract import extract, hidden
from webdistill.functions.parser import parse
from webdistill.functions.people import people

TEXT = "<p>" + "This is a sentence of the article, and it is long enough to count as text. " * 3 + "</p>"


@pytest.mark.parametrize(
    "text,want",
    [
        ("on March 3, 2021, at noon", "March 3, 2021"), ("3. März 2021", "March 3, 2021"), ("le 1er août 1999", "August 1, 1999"), ("3 de marzo de 2021", "March 3, 2021"), ("12 Sept. 2020", "September 12, 2020"),
        ("May 31st 2022", "May 31, 2022"), ("FEBRUARY 2 2020", "February 2, 2020"), ("March 32, 2021", None), ("March 2021", None), ("March 3, 20211", None), ("3 2021", None), ("Maybe 3, 2021", None), ("", None), ("March 99, 2020 and May 1, 2020", "May 1, 2020"),
    ],
)
def test_written_dates(text, want):
    assert dates.written(text) == want


@pytest.mark.parametrize(
    "line,marker,want",
    [
        ("Published March 3, 2021 · Updated May 1, 2022", None, [("published_time", "March 3, 2021"), ("modified_time", "May 1, 2022")]),
        ("First published on: March 3, 2021; last updated as of May 1, 2022", None, [("published_time", "March 3, 2021"), ("modified_time", "May 1, 2022")]),
        ("Veröffentlicht am 3. März 2021 | Zuletzt aktualisiert: 1. Mai 2022", None, [("published_time", "March 3, 2021"), ("modified_time", "May 1, 2022")]),
        ("Publié le 3 mars 2021, mis à jour le 1 mai 2022", None, [("published_time", "March 3, 2021"), ("modified_time", "May 1, 2022")]),
        ("Publicado el 3 de marzo de 2021 · Actualizado el 1 de mayo de 2022", None, [("published_time", "March 3, 2021"), ("modified_time", "May 1, 2022")]),
        ("March 3, 2021", None, []), ("March 3, 2021", "published_time", [("published_time", "March 3, 2021")]), ("Edited by Ann on March 3, 2021", None, []),
        ("The law was published by them, and then in force from March 3, 2021", None, []), ("Published March 3, 2021 in a book that many people have read since", None, []),
    ],
)
def test_lines_of_dates(line, marker, want):
    assert dates.line_dates(line, marker) == want


@pytest.mark.parametrize(
    "html,published,modified",
    [
        ("<h1>Title of it</h1><p>Published March 3, 2021</p>", "March 3, 2021", None),
        ("<h1>Title of it</h1><p class=entry-date>March 3, 2021</p>", "March 3, 2021", None),
        ("<h1>Title of it</h1><p class='date updated'>March 3, 2021</p>", None, "March 3, 2021"),
        ("<h1>Title of it</h1><div itemprop=startDate><span>Posted March 3, 2021</span></div>", None, None),
        ("<h1>Title of it</h1><p hidden>Published March 3, 2021</p>", None, None),
        ("<h1>Title of it</h1>" + TEXT * 3 + "<p>Published March 3, 2021</p>", None, None),  # far from the heading
        ("<h1>Title of it</h1><p><span>Updated</span> on <time datetime=2022-05-01T10:00>May 1</time></p>", None, "2022-05-01T10:00"),
        ("<h1>Title of it</h1><p>Published <time datetime=2021-03-03>3/3</time> · Updated <time datetime=2022-05-01>1/5</time></p>", "2021-03-03", "2022-05-01"),
        ("<h1>Title of it</h1><time class=updated datetime=2022-05-01>x</time><time datetime=2021-03-03>y</time>", "2021-03-03", "2022-05-01"),
        ("<h1>Title of it</h1><time class='published updated' datetime=2021-03-03>y</time>", "2021-03-03", None),
        ("<h1>Title of it</h1><time itemprop=dateModified class=published datetime=2021-03-03>y</time>", None, "2021-03-03"),
        ("<h1>Title of it</h1><time itemprop=startDate datetime=2021-03-03>y</time>", None, None),
        ("<h1>Title of it</h1><p>Edited by <b>Ann</b> <time datetime=2021-03-03>y</time></p>", "2021-03-03", None),
        ("<h1>Title of it</h1><p>Mis à jour le <time>1 mai 2022</time></p>", None, "May 1, 2022"),
    ],
)
def test_dates_of_pages(html, published, modified):
    m = extract(f"<article>{html}{TEXT}</article>", "http://a.com/")["metadata"]
    assert (m["published_time"], m["modified_time"]) == (published, modified)


def test_dates_of_nothing():
    assert dates.candidates(parse("").first("body"), None, hidden) == [] and M.resolved([])["published_time"] is None


@pytest.mark.parametrize(
    "value,want",
    [
        ("Ann Lee, Bob Ray and Cy Dee", (["Ann Lee", "Bob Ray", "Cy Dee"], True)), ("Ann Lee; Bob Ray", (["Ann Lee", "Bob Ray"], True)), ("Ann Lee and Bob Ray", (["Ann Lee", "Bob Ray"], False)),
        ("García Márquez, Gabriel José", (["García Márquez", "Gabriel José"], False)), ("Smith, John", ([], False)), ("Jane Doe, PhD", ([], False)), ("Jane Doe, John Roe, M.D.", ([], False)), ("Johnson & Johnson", ([], False)),
        ("Ludwig van Beethoven, Vincent van Gogh, Ann Lee", (["Ludwig van Beethoven", "Vincent van Gogh", "Ann Lee"], True)), ("News Desk, Ann Lee, Bob Ray", ([], False)), ("Ann Lee", ([], False)), ("", ([], False)), ("Agent 47, Ann Lee, Bob Ray", ([], False)),
        ("By Ann Lee, by Bob Ray, and Cy Dee", (["Ann Lee", "Bob Ray", "Cy Dee"], True)),
    ],
)
def test_people(value, want):
    assert people(value) == want


@pytest.mark.parametrize(
    "head,body,want",
    [
        ("<meta name=author content='Ann Lee, Bob Ray, Cy Dee'>", "", ["Ann Lee", "Bob Ray", "Cy Dee"]),
        ("<meta name=author content='Ann Lee and Bob Ray'>", "", ["Ann Lee and Bob Ray"]),
        ("<meta name=author content='Ann Lee and Bob Ray'>", "<a rel=author>Bob Ray</a>", ["Ann Lee", "Bob Ray"]),
        ("<meta name=citation_author content='Lee, Ann'><meta name=citation_author content='Ray, Bob'>", "", ["Lee, Ann", "Ray, Bob"]),
        ("<meta property=article:author content='Ann Lee; Bob Ray'>", "<span itemprop=author>Ann Lee; Bob Ray</span>", ["Ann Lee", "Bob Ray"]),
    ],
)
def test_author_lists(head, body, want):
    assert extract(f"<head>{head}</head><article><h1>Title of it</h1>{body}{TEXT}</article>", "http://a.com/")["metadata"]["authors"] == want
