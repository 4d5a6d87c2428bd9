"""Parts of a page that say again what it says elsewhere: views for other screens, tables of contents, line numbers."""

from __future__ import annotations

import re
from collections import Counter

from webdistill.functions import text as T
from webdistill.functions.dom import Node, intervals

_WIDTH = r"(?:sm|md|lg|xl|2xl|xxl|min-\[[^\]]*\]|max-\[[^\]]*\])"
_SHOWN = re.compile(rf"{_WIDTH}:(?:block|table|flex|grid)|d-(?:sm|md|lg|xl|xxl)-(?:block|table|flex|grid)")
_HIDDEN = re.compile(rf"{_WIDTH}:hidden|d-(?:sm|md|lg|xl|xxl)-none")
_CONTENTS = ("on this page", "table of contents", "contents", "toc", "in this article", "inhalt", "inhaltsverzeichnis", "auf dieser seite", "sommaire", "table des matières", "contenido", "en esta página")
_TOC_NAME = re.compile(r"table[-_]of[-_]contents|(?:^|[\s_-])toc(?:$|[\s_-])", re.I)
_NUMBERS = re.compile(r"(?:^|[\s_-])(?:line-?numbers?|line-?nos?|linenos?|gutter|hljs-ln-n|blob-num|ln)(?:$|[\s_-])", re.I)


# -- views for wide and narrow screens
def screen(node: Node) -> str | None:
    """``wide`` for what is shown on wide screens only, ``narrow`` for what is hidden on them, else None."""
    tokens = node.tokens("class")
    hidden = "hidden" in tokens or "d-none" in tokens
    if hidden and any(_SHOWN.fullmatch(t) for t in tokens):
        return "wide"
    return "narrow" if not hidden and any(_HIDDEN.fullmatch(t) for t in tokens) else None


def said(node: Node) -> Counter:
    """What a subtree says, text by text; for tables without their heads."""
    out: Counter = Counter()
    stack = [node]
    while stack:
        x = stack.pop()
        if x.tag == "#text":
            out.update(T.words(x.text))
        elif x.tag not in ("th", "caption", "script", "style"):
            stack.extend(x.children)
    return out


def drop_views(root: Node) -> int:
    """Of a wide and a narrow view of the same the one without a table goes, or else the narrow one; returns how many went.

    Views are found wherever they stand under one parent; both say the same if nine tenths of the words of the one that
    stays, heads of tables aside, are in the other.
    """
    gone = 0
    groups: dict[int, list[tuple[Node, str]]] = {}
    for node in root.walk():
        if "class" in node.attrs and node.parent is not None and node is not root and (kind := screen(node)):
            groups.setdefault(id(node.parent), []).append((node, kind))
    for views in groups.values():
        wide, narrow = ([v for v, k in views if k == kind] for kind in ("wide", "narrow"))
        for w in wide:
            for n in narrow:
                if n.parent is None or w.parent is None:
                    continue
                tables = w.first("table") is not None, n.first("table") is not None
                stays, goes = (n, w) if tables == (False, True) else (w, n)
                own = said(stays)
                if own.total() >= 4 and (own & said(goes)).total() >= 0.9 * own.total():
                    goes.detach()
                    gone += 1
    return gone


# -- tables of contents
def is_toc(node: Node) -> bool:
    """Whether an element says that it lists the page's own parts, and does."""
    links = [x for x in node.walk() if x.tag == "a" and x.get("href")]
    if len(links) < 2 or not any(x.tag in ("nav", "ol", "ul") for x in node.walk()):
        return False
    labels = [node.get("aria-label"), *(h.raw_text() for h in node.elements("h2", "h3", "h4", "h5", "h6", "summary", "strong", "p")[:3])]
    named = bool(_TOC_NAME.search(node.name())) or any(T.squeeze(x).rstrip(":").lower() in _CONTENTS for x in labels)
    return named and sum(x.get("href").strip().startswith("#") for x in links) >= 0.8 * len(links)


def drop_toc(root: Node) -> int:
    """Take tables of contents out where two or more headings that they could list stand outside; returns how many went."""
    order, place, end = intervals(root)
    heads = [place[id(x)] for x in order if re.fullmatch("h[1-6]", x.tag)]
    gone = 0
    for node in order:
        if node.tag not in ("div", "nav", "aside", "section", "details", "ul", "ol") or node is root or node.parent is None or end[id(node)] - place[id(node)] > 1000:
            continue
        if any(x is not root and x.parent is None for x in node.ancestors()) or not is_toc(node):
            continue
        outside = [h for h in heads if not place[id(node)] <= h < end[id(node)]]
        text = sum(len(" ".join(x.text.split())) for x in node.walk() if x.tag == "#text")
        if len(outside) >= 2 and text < 4000:
            node.detach()
            gone += 1
    return gone


# -- line numbers
def _counts_up(text: str) -> int:
    """How many lines a text has if each is the number after the one before, else 0."""
    lines = text.split()
    if len(lines) < 2 or not all(x.isascii() and x.isdigit() for x in lines):
        return 0
    return len(lines) if [int(x) for x in lines] == list(range(int(lines[0]), int(lines[0]) + len(lines))) else 0


def drop_gutters(root: Node) -> int:
    """Take line numbers of code out: columns of numbers beside it, and numbers in it; returns how many elements went.

    A table that held one column of numbers and one of code becomes the code.
    """
    gone = 0
    for pre in root.elements("pre", "code"):
        for x in pre.elements("span", "i", "b", "em", "a", "td", "div"):
            if x.parent is not None and _NUMBERS.search(x.name()) and x.raw_text().strip().isdigit():
                x.detach()
                gone += 1
    for cell in root.elements("td", "th", "div", "pre"):
        row = cell.parent
        if row is None or len(beside := [x for x in row.children if x.tag[0] != "#"]) != 2 or beside[0] is not cell:
            continue
        code = beside[1] if beside[1].tag == "pre" else beside[1].first("pre")
        if code is None or cell.tag not in ("pre", "td", "th") and cell.first("pre") is None and not _NUMBERS.search(cell.name()):
            continue
        n = _counts_up("\n".join(x.text for x in cell.walk() if x.tag == "#text"))
        if n and n <= code.raw_text().strip("\n").count("\n") + 1 + code.raw_text().count("\n\n"):
            cell.detach()
            gone += 1
            table = next((x for x in row.ancestors() if x.tag == "table"), row if row.tag == "table" else None)
            if row.tag == "tr" and table is not None and len(table.elements("tr")) == 1:
                table.replace(code)
    return gone
