"""Structured data and the page it stands on: which item describes the page, and where its text is to be seen."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence
from typing import Any
from urllib.parse import urlsplit

from webdistill.functions import text as T
from webdistill.functions.dom import Node

#: Types of items that describe a page but are no article. Fixed values.
GENERAL = frozenset(("WebPage", "Product", "Recipe", "Event", "Book", "Movie", "VideoObject", "JobPosting"))
#: Elements that part the flow of words; a phrase doesn't reach across their bounds. Fixed values.
FLOW = frozenset("address article blockquote body details div figcaption figure footer h1 h2 h3 h4 h5 h6 header li main nav p pre section summary td th".split())
#: A match is good from this on, and as good as the best within so much.
GOOD, NEAR = 0.55, 0.08


# -- which item
def fingerprint(item: Any) -> str:
    """Equal for JSON values that differ in the order of keys at most."""
    return hashlib.sha256(json.dumps(item, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def title_of(item: dict[str, Any]) -> str | None:
    return next((item[k] for k in ("headline", "name", "title") if isinstance(item.get(k), str)), None)


def address_of(value: Any) -> str | None:
    """The address that a value gives: itself, its ``url`` or its ``@id``; of a list the first."""
    if isinstance(value, list):
        return next((a for x in value if (a := address_of(x))), None)
    if isinstance(value, dict):
        return address_of(value.get("url") or value.get("@id"))
    return value if isinstance(value, str) else None


def same_page(a: str | None, b: str | None) -> bool:
    """Whether two addresses have the same host and path, a slash at the end aside."""
    try:
        x, y = urlsplit(a or ""), urlsplit(b or "")
        return bool(x.hostname) and x.hostname == y.hostname and x.path.rstrip("/") == y.path.rstrip("/")
    except ValueError:
        return False


def identity_score(item: dict[str, Any], title: str, url: str | None) -> int:
    """100 for a title like the page's, in proportion for one less so, and 150 for the page's address."""
    own = title_of(item)
    mine = address_of(item.get("url")) or address_of(item.get("mainEntityOfPage")) or address_of(item.get("@id"))
    return (int(100 * T.similarity(own, title)) if own else 0) + (150 if same_page(mine, url) else 0)


def only_best(items: Iterable[dict[str, Any]], title: str, url: str | None) -> dict[str, Any] | None:
    """The item of the highest score; none if several share it or it is 0, unless there is but one item. Equal items count once."""
    distinct = list({fingerprint(x): x for x in reversed(list(items))}.values())[::-1]
    if len(distinct) == 1:
        return distinct[0]
    scores = [identity_score(x, title, url) for x in distinct]
    top = max(scores, default=0)
    return distinct[scores.index(top)] if top > 0 and scores.count(top) == 1 else None


def primary(articles: Sequence[dict[str, Any]], general: Sequence[dict[str, Any]], title: str, url: str | None) -> tuple[dict[str, Any] | None, bool]:
    """The item that describes the page, and whether it is an article; an article and a general item of one score rule each other out."""
    a, g = only_best(articles, title, url), only_best(general, title, url)
    if a is not None and g is not None:
        mine, other = identity_score(a, title, url), identity_score(g, title, url)
        return (None, False) if mine == other else (a, True) if mine > other else (g, False)
    return (a, True) if a is not None else (g, False)


def texts_of(item: dict[str, Any] | None) -> list[str]:
    return [item[k] for k in ("articleBody", "text") if isinstance(item.get(k), str)] if item else []


# -- the page's own title
def heading_text(heading: Node) -> str:
    """What a heading says, without the controls in it."""
    parts: list[str] = []
    stack = list(reversed(heading.children))
    while stack:
        node = stack.pop()
        if node.tag == "#text":
            parts.append(node.text)
        elif node.tag not in ("input", "select", "textarea") and node.get("aria-hidden").lower() != "true" and not (node.tag == "button" and _utility(node)):
            stack.extend(reversed(node.children))
    return T.squeeze("".join(parts))


def _utility(button: Node) -> bool:
    labels = (button.raw_text(), button.get("aria-label"), button.get("title"))
    return any(T.squeeze(x).lower() in ("copy", "copy item path", "copy link", "copy permalink", "permalink") for x in labels)


def identity_title(document: Node, page_title: str) -> str:
    """The title to hold items against: a heading of an article or main part that stands out, else the page's title, else its first heading."""
    best: tuple[int, str] | None = None
    first = ""
    for h in document.elements("h1"):
        value = heading_text(h)
        first = first or value
        if not value or any(x.tag in ("nav", "footer", "aside") for x in h.ancestors()):
            continue
        confidence = 82 if h.has_ancestor("article") else 80 if h.has_ancestor("main") else 78
        confidence += 2 * (len(value.split()) >= 4) + 4 * ("p-name" in h.tokens("class"))
        if best is None or confidence > best[0]:
            best = confidence, value
    return best[1] if best and best[0] > 78 else page_title or first


# -- where its text stands
class Words:
    """The visible words of a tree in order; each element has those from ``start`` to before ``end``."""

    def __init__(self, root: Node, hidden):
        self.words: list[str] = []
        self.flow: list[int] = []
        self.owner: list[Node] = []
        self.start: dict[int, int] = {}
        self.end: dict[int, int] = {}
        self.at: dict[str, list[int]] = {}
        flow, flows = 0, [0]
        stack: list[tuple[Node, bool]] = [(root, False)]
        last: int | None = None
        while stack:
            node, leaving = stack.pop()
            if leaving:
                self.end[id(node)] = len(self.words)
                if node.tag in FLOW:
                    flows.pop()
                continue
            if node.tag == "#text":
                if flows[-1] != last:  # another flow, or the same one after another: a phrase starts anew
                    last, flow = flows[-1], flow + 1
                for w in T.words(node.text):
                    self.at.setdefault(w, []).append(len(self.words))
                    self.words.append(w)
                    self.flow.append(flow)
                    self.owner.append(node.parent or root)
                continue
            if node.tag[0] == "#" and node.tag != "#document" or node.tag in ("script", "style", "template", "meta", "link") or node is not root and hidden(node):
                last = None
                continue
            self.start[id(node)] = len(self.words)
            if node.tag in FLOW:
                flows.append(id(node))
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children))

    def places(self, phrase: list[str]) -> Iterable[int]:
        """Where a phrase begins, within one flow."""
        n = len(phrase)
        for i in self.at.get(phrase[0], ()):
            if self.words[i : i + n] == phrase and self.flow[i] == self.flow[i + n - 1]:
                yield i

    def inside(self, node: Node) -> tuple[int, int]:
        return self.start[id(node)], self.end[id(node)]


class Agreement:
    """How well an ever wider stretch of words agrees with a text: harmonic mean of how much of the text it has and how much of it the text has."""

    def __init__(self, words: list[str], hint: list[str]):
        self.words, self.hint, self.known = words, hint, set(hint)
        self.chars = sum(map(len, hint)) + len(hint) - 1
        count: dict[str, int] = {}
        for w in hint:
            count[w] = count.get(w, 0) + 1
        self.weight = {w: n * (len(w) + 1) for w, n in count.items()}
        self.lo = self.hi = -1
        self.common, self.missing, self.met = 0, sum(self.weight.values()), set()

    def widen(self, lo: int, hi: int) -> float:
        """The agreement of words ``lo`` to before ``hi``, which hold those of the call before."""
        fresh = range(lo, hi) if self.lo < 0 else [*range(lo, self.lo), *range(self.hi, hi)]
        for i in fresh:
            w = self.words[i]
            if w in self.known:
                self.common += 1
                if w not in self.met:
                    self.met.add(w)
                    self.missing -= self.weight[w]
        self.lo, self.hi = lo, hi
        coverage = 1 - max(self.missing - 1, 0) / self.chars
        precision = self.common / (hi - lo) if hi > lo else 0.0
        return 2 * coverage * precision / (coverage + precision) if coverage + precision > 0 else 0.0


def agreement(text: str, hint: str) -> float:
    """The agreement of a whole text with a hint; ``operators.structure.text_agreement`` is the same as a column."""
    words, wanted = T.words(text), T.words(hint)
    return Agreement(words, wanted).widen(0, len(words)) if words and wanted else 0.0


def _navigation(node: Node) -> bool:
    return any(x.tag in ("a", "nav") or "navigation" in x.tokens("role") for x in [node, *node.ancestors()])


def locate(root: Node, texts: Iterable[str], hidden) -> tuple[Node, float] | None:
    """The smallest element that shows one of the texts, and how well it agrees; None if none agrees well.

    Places are found by the text's first five or six words, which may lie over several elements of one flow. From each
    place on all elements around it are judged, each once, from the inside out.
    """
    hints = [w for x in texts if len(w := T.words(x)) >= 5]
    if not hints:
        return None
    visible = Words(root, hidden)
    found: dict[int, tuple[Node, int, float]] = {}
    for hint in hints:
        seen: set[int] = set()
        for i in visible.places(hint[:6]):
            last = i + len(hint[:6])
            node: Node | None = visible.owner[i]
            judge = Agreement(visible.words, hint)
            if _navigation(node):
                continue
            while node is not None and node.tag != "#document" and id(node) not in seen:
                lo, hi = visible.inside(node)
                if lo <= i and hi >= last:
                    seen.add(id(node))
                    score = judge.widen(lo, hi)
                    if score >= GOOD and score > found.get(id(node), (node, 0, 0.0))[2]:
                        found[id(node)] = node, hi - lo, score
                if node is root:
                    break
                node = node.parent
    fit = [x for x in found.values() if not _navigation(x[0])]
    if not fit:
        return None
    best = max(x[2] for x in fit)
    node, _, score = min((x for x in fit if x[2] >= best - NEAR), key=lambda x: (x[1], -x[2], -depth(x[0])))
    return node, score


def depth(node: Node) -> int:
    return sum(1 for _ in node.ancestors())
