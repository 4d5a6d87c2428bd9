"""One page to its main content: candidates, ranking, cleanup, attempts and the result."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass, field
from typing import Any

from webdistill.functions import metadata as M
from webdistill.functions import coverage as C
from webdistill.functions import render, repeats, scoring, shell, specialised, terminal
from webdistill.functions import structured as D
from webdistill.functions import text as T
from webdistill.functions.compile import BLOCK_TAGS, VIDEO, Block, compile_content, compile_counted, tape
from webdistill.functions.dom import Node, shallow
from webdistill.functions.visibility import hidden, hidden_style
from webdistill.functions.parser import Budget, LimitError, parse, parse_fragment

# Name patterns that speak for and against content.
UNLIKELY = re.compile(
    r"-ad-|ai2html|banner|breadcrumbs|bibliograph|citation|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|ref-list|related|remark|replies|rss|shoutbox|"
    r"sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|recommender|recent-changes|revision-history|yom-remote",
    re.I,
)
POSITIVE = re.compile(r"article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story", re.I)
NEGATIVE = re.compile(
    r"-ad-|bibliograph|citation|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|ref-list|related|recommender|recent-changes|"
    r"revision-history|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget",
    re.I,
)
# Clutter by name, role and words. Own choice of patterns.
_CLUTTER = re.compile(
    r"(?:^|[\s_\-])(?:ads?|advert\w*|sponsor\w*|promo\w*|newsletter\w*|subscri\w+|signup|cookie\w*|consent|gdpr|share\w*|sharing|social\w*|breadcrumbs?|pagination|pager|related\w*|recommend\w*|"
    r"sidebar|skyscraper|popup|modal|outbrain|taboola|comment-?list|comments?|disqus\w*|author-?bio|toc-?rail|print-?link|login|account)(?:$|[\s_\-])",
    re.I,
)
_READING_TIME = re.compile(r"^\d+\s*min(?:ute)?s?\s+read$|^reading time\b.{0,20}$", re.I)
_REGION_BLOCKS = frozenset("article blockquote figure h1 h2 h3 h4 h5 h6 li p pre section table".split())
_PAGER = re.compile(r"^(?:(?:previous|prev|next|older|newer|first|last|page|of|\d+|[«»‹›<>|…./-])\s*)+$", re.I)
_JS_NOTICE = re.compile(r"(?:enable|requires?|turn on|activate[rz]?)\s+javascript|javascript\s+(?:is\s+)?(?:required|disabled)", re.I)
_DENIED = re.compile(r"^(?:access denied|attention required|just a moment|are you (?:a )?(?:human|robot)|verify you are human|403 forbidden|accès refusé|pardon our interruption)", re.I)
_PERMISSION = re.compile(r"permission to access|unusual (?:traffic|activity)|automated (?:traffic|requests)|checking your browser|security check|reference (?:#|id)|ray id|trafic automatisé", re.I)
_LOADING = re.compile(r"^(?:loading|please wait|chargement)[\s.…]*$", re.I)
_CONTENT_NAME = re.compile(r"(?:^|[\s_\-])(?:article-?body|post-?content|entry-?content|article-?content|story-?body|main-?content)(?:$|[\s_\-])", re.I)

#: Pages of more levels are made less deep first: what is looked up around an element then takes bounded time.
MOST_LEVELS = 100

_DIGIT, _END = re.compile(r"\d"), re.compile(r"[.!?](?=\s|$)")
STRATEGIES = ("Normal", "RelaxedCleanup", "BroadContent", "StructuredDataHint", "RelaxedVisibility", "BodyFallback")


@dataclass(frozen=True)
class Options:
    """How to extract; ``content_root`` and ``content_hint`` are (kind, value) with kind id, class or tag."""

    budget: Budget = field(default_factory=Budget)
    structured_data: bool = True
    diagnostics: bool = False
    metadata_diagnostics: bool = False
    retain_structured_data: bool = False
    content_hint: tuple[str, str] | None = None
    content_root: tuple[str, str] | None = None
    links: bool = True
    images: bool = True
    max_line_width: int = 0
    repeats: bool = False  # prose and lists that say the same again stay


class PageError(Exception):
    def __init__(self, kind: str, message: str, resource: str | None = None, limit: int | None = None):
        super().__init__(message)
        self.kind, self.message, self.resource, self.limit = kind, message, resource, limit


# -- measures
class Stats:
    """Words, characters, links and marks of every subtree, in one pass."""

    def __init__(self, root: Node):
        self.of: dict[int, list[float]] = {}
        order = [(x, None) for x in root.walk()]
        for node, _ in reversed(order):
            if node.tag == "#text":
                squeezed = " ".join(node.text.split())
                own = [len(squeezed), len(squeezed.split()), 0.0, squeezed.count(",") + squeezed.count("、"), len(_END.findall(squeezed)), 0, len(_DIGIT.findall(squeezed))]
            else:
                own = [0, 0, 0.0, 0, 0, 0, 0]
                for c in node.children:
                    for i, v in enumerate(self.of[id(c)]):
                        own[i] += v
                if node.tag == "a":
                    own[2] = own[0] * (0.3 if node.get("href").startswith("#") else 1.0)
                if node.tag == "p" and own[0]:
                    own[5] += 1
            self.of[id(node)] = own

    def chars(self, node: Node) -> int:
        return int(self.of[id(node)][0])

    def words(self, node: Node) -> int:
        return int(self.of[id(node)][1])

    def density(self, node: Node) -> float:
        own = self.of[id(node)]
        return own[2] / own[0] if own[0] else 0.0

    def commas(self, node: Node) -> int:
        return int(self.of[id(node)][3])

    def ends(self, node: Node) -> int:
        return int(self.of[id(node)][4])

    def paragraphs(self, node: Node) -> int:
        return int(self.of[id(node)][5])

    def digits(self, node: Node) -> int:
        return int(self.of[id(node)][6])


def class_weight(node: Node) -> int:
    out = 0
    for name in (node.get("class"), node.get("id")):
        if name:
            out += 25 * bool(POSITIVE.search(name)) - 25 * bool(NEGATIVE.search(name))
    return out


# -- preparation
def prepare(body: Node) -> None:
    """Reveal noscript images, drop scripts and styles, breaks in a row to paragraphs, fonts to spans."""
    for node in [x for x in body.walk() if x.tag in ("noscript", "script", "style", "template", "link", "meta", "#comment")]:
        if node.tag == "noscript" and node.parent is not None:
            inner = node.elements("img") or [x for n in (parse_fragment(node.raw_text()) if "<img" in node.raw_text() else []) for x in n.walk() if x.tag == "img"]
            if len(inner) == 1 and not T.squeeze("".join(x.raw_text() for x in node.children if x.tag != "#text")):
                before = next((x for x in reversed(node.parent.children[: node.index()]) if x.tag != "#text" or x.text.strip()), None)
                if before is not None and before.tag == "img":
                    before.detach()
                node.replace(inner[0])
                continue
        if node.parent is not None:
            node.detach()
    for node in body.elements("font"):
        node.tag = "span"
    for br in body.elements("br"):
        if br.parent is None or br.has_ancestor("pre", "code") or br.parent.tag == "p":
            continue
        at, siblings = br.index(), br.parent.children
        end = at + 1
        while end < len(siblings) and (siblings[end].tag == "br" or siblings[end].tag == "#text" and not siblings[end].text.strip()):
            end += 1
        if sum(x.tag == "br" for x in siblings[at:end]) < 2:
            continue
        parent, p = br.parent, Node("p")
        for x in siblings[at:end]:
            x.detach()
        while at < len(parent.children) and parent.children[at].tag not in BLOCK_TAGS and parent.children[at].tag != "br":
            p.append(parent.children[at])
        if p.raw_text().strip() or p.children:
            parent.insert(at, p)


def strip_hidden(body: Node, relaxed: bool) -> int:
    """Remove hidden subtrees (and dialogs); relaxed keeps those that hold content. Returns the characters removed."""
    gone = 0
    for node in body.elements():
        if node.parent is None or node is body:
            continue
        dialog = node.tag == "dialog" or node.get("role") in ("dialog", "alertdialog") or node.get("aria-modal") == "true"
        if not dialog and not hidden(node):
            continue
        if relaxed and not dialog and node.get("aria-hidden").lower() != "true" and (len(node.elements("p")) >= 2 or node.elements("ul", "ol", "pre", "table", "figure") or node.tag in ("article", "main")):
            continue
        gone += len(T.squeeze(node.raw_text()))
        node.detach()
    return gone


# -- candidates
@dataclass
class Candidate:
    node: Node
    sources: set[str]
    prior: float
    readability: float
    features: dict[str, float]
    order: int
    score: float = 0.0


class Names:
    """What the names of elements and of those around them say, each looked at once."""

    def __init__(self, view: scoring.View):
        self.clutter: set[int] = set()
        self.poor: set[int] = set()
        for node in view.order:
            name = node.name() if "class" in node.attrs or "id" in node.attrs else ""
            if id(node.parent) in self.clutter or name and node.tag not in ("body", "html") and _CLUTTER.search(name):
                self.clutter.add(id(node))
            if name and NEGATIVE.search(name) and not POSITIVE.search(name):
                self.poor.add(id(node))

    def inherited(self, node: Node) -> bool:
        """Whether one of the three elements next around has a name that speaks against content."""
        for _ in range(3):
            node = node.parent
            if node is None or node.tag == "#document":
                return False
            if id(node) in self.poor:
                return True
        return False


def features(node: Node, view: scoring.View, names: Names) -> dict[str, float]:
    stats, name = view.stats, node.name()
    return {
        "word_count": stats.words(node), "text_chars": stats.chars(node), "paragraph_count": stats.paragraphs(node), **{k: view.count(node, k) for k in scoring.COUNTED},
        "link_density": stats.density(node), "link_text_chars": stats.of[id(node)][2], "digit_chars": stats.digits(node), "sentence_end_count": stats.ends(node), "comma_count": stats.commas(node),
        "positive_name": 25.0 * bool(POSITIVE.search(name)), "negative_name": 25.0 * bool(NEGATIVE.search(name) or names.inherited(node)),
        "utility_name": float(id(node) in names.clutter),
    }


def rank(readability_score: float, prior: float, f: dict[str, float]) -> float:
    """The ranking score of a candidate; ``operators.pages.ranking_score`` is the same as a column."""
    tiny = lambda *xs: sum(min(x / 1e5, 0.001) for x in xs)
    structure = 0.0
    if f["list_item_count"] >= 3 and f["paragraph_count"] <= 1 and f["link_density"] >= 0.5:
        structure += min(1.5 * f["list_item_count"], 12)
    if f["paragraph_count"] <= 2:
        structure += min(4 * f["code_block_count"], 12) + min(4 * f["table_count"], 12)
    structure += tiny(f["heading_count"], f["figure_count"], f["image_count"], f["protected_block_count"])
    negative = 0.1 * f["negative_name"] if f["positive_name"] else f["negative_name"] * min(1 + 0.6 * max(readability_score, 0), 125)
    penalty = 0.0
    p = f["paragraph_count"]
    if p >= 40 and not f["heading_count"] and not f["table_count"] and not f["code_block_count"] and f["comma_count"] <= 2 and f["word_count"] <= 4 * p and f["digit_chars"] > 0:
        if f["digit_chars"] >= f["word_count"] / 5 or f["sentence_end_count"] >= 1.5 * p:
            penalty = min(2 * p, 160)
    return (
        readability_score + prior + tiny(f["word_count"]) + min(f["text_chars"] / 1e6, 0.001) + tiny(p, f["sentence_end_count"], f["comma_count"]) + structure
        + min(f["link_text_chars"] / 1e6, 0.001) + 0.001 * f["positive_name"] - negative - min(0.2 * f["link_density"], 0.1) - penalty - 48 * f["utility_name"]
    )


def discover(body: Node, stats: Stats, weights: bool, hint: tuple[str, str] | None, evidence: scoring.Evidence | None = None, located: Node | None = None) -> list[Candidate]:
    """Candidates of all sources with features and scores, best first; five are kept.

    ``located`` is the element that shows the text of the page's structured data, ``evidence`` what the page says else.
    """
    evidence = evidence or scoring.Evidence()
    found: dict[int, Candidate] = {}
    view = scoring.View(body, stats)
    names = Names(view)
    points = scoring.readability(view, class_weight if weights else lambda _: 0)

    def add(node: Node, source: str, prior: float) -> None:
        if id(node) in found:
            old = found[id(node)]
            again = source == "Semantic" and source in old.sources
            old.sources.add(source)
            old.prior = max(old.prior, prior)
            if again:  # further signs of the same kind add little
                old.prior = max(old.prior, min(old.prior + 0.00025, 0.004))
        else:
            found[id(node)] = Candidate(node, {source}, prior, points.get(id(node), (node, 0.0))[1], features(node, view, names), view.place[id(node)])

    aside: set[int] = set()
    for node in view.order:
        if node.tag in ("nav", "footer", "aside") or id(node.parent) in aside:
            aside.add(id(node))
        if node.tag[0] == "#" or not stats.chars(node) or id(node) in aside:
            continue
        if node.tag == "article":
            add(node, "Semantic", 0.003)
        if node.tag == "main" or node.get("role") == "main":
            add(node, "Semantic", 0.0025)
        if node.get("role") == "article":
            add(node, "Semantic", 0.00275)
        if "articleBody" in node.tokens("itemprop"):
            add(node, "Semantic", 0.0035)
        if ("class" in node.attrs or "id" in node.attrs) and _CONTENT_NAME.search(node.name()):
            add(node, "Semantic", 0.0025)
        if node.tag in ("section", "td", "div") and any(view.tag(c) in ("ul", "ol", "pre", "table", "figure") for c in node.children):
            add(node, "Generic", 0.0)
        if hint and matches(node, hint):
            add(node, "CallerHint", 0.02)
    for node, p in points.values():
        if p > 0 and not (UNLIKELY.search(node.name()) and not re.search(r"and|article|body|column|main|shadow|content", node.name(), re.I)):
            add(node, "Readability", 0.0)
    if located is not None:  # what the page itself says is its text has no name that speaks against it
        add(located, "StructuredData", 40.0)
        found[id(located)].features |= {"negative_name": 0.0, "utility_name": 0.0}
    if not any(scoring.authoritative(c.node) and c.features["word_count"] >= 80 for c in found.values()) and id(body) not in found:
        whole = features(body, view, names)
        if scoring.complete_root_bonus(evidence, whole):
            add(body, "Generic", 0.0)
    everything = list(found.values())
    kept = []
    for c, standing in zip(everything, scoring.standings(view, everything), strict=True):
        semantic, own, f = "Semantic" in c.sources, scoring.authoritative(c.node), c.features
        full, distinct = standing.points_within or scoring.meaningful(f), scoring.distinct(f)
        if semantic and not own and not full:
            continue
        only_generic = c.sources == {"Generic"} and c.node is not body
        if only_generic and not (distinct or c.node.tag == "td" and full):
            continue
        c.score = rank(c.readability, c.prior, f) + 0.01 * only_generic
        if own and full and not standing.under and standing.within <= 1:
            c.score += 25 * (1 - min(f["text_chars"], 100) / 100)
        if (c.node.tag == "main" or "main" in c.node.tokens("role")) and f["text_chars"] <= 1000 and standing.peers >= 2:
            c.score += standing.peer_points + 0.1
        if c.node is body or own and any(hidden(x) for x in [c.node, *c.node.ancestors()]):
            c.score += scoring.complete_root_bonus(evidence, f)
        kept.append(c)
    return sorted(kept, key=lambda c: (-c.score, c.order))[:5]


def matches(node: Node, target: tuple[str, str]) -> bool:
    kind, value = target
    return node.get("id") == value if kind == "id" else value in node.tokens("class") if kind == "class" else node.tag == value.lower()


def single_article(top: Candidate, usable: list[Candidate], stats: Stats) -> Node | None:
    """The one article of a page whose best candidate lies around it, if it has half or more of that one's text outside navigation and clutter."""
    own = [c.node for c in usable if scoring.authoritative(c.node)]
    outer = [x for x in own if not any(y in own for y in x.ancestors())]
    if len(outer) != 1 or scoring.authoritative(top.node) or not any(x is top.node for x in outer[0].ancestors()):
        return None
    around = {id(x) for x in outer[0].ancestors()}
    chars = stats.chars(top.node)
    stack = list(top.node.children)
    while stack:
        x = stack.pop()
        if x is outer[0] or x.tag[0] == "#":
            continue
        if id(x) not in around and (x.tag in ("nav", "footer", "aside") or ("class" in x.attrs or "id" in x.attrs) and _CLUTTER.search(x.name())):
            chars -= stats.chars(x)
        else:
            stack.extend(x.children)
    return outer[0] if stats.paragraphs(outer[0]) and 2 * stats.chars(outer[0]) >= chars else None


def choose(body: Node, ranked: list[Candidate], stats: Stats, texts: list[str] | None = None) -> tuple[list[Node], str]:
    """The content's roots and the source that chose them; ``texts`` are those of the page's structured data."""
    usable = [c for c in ranked if not c.features["utility_name"] or "StructuredData" in c.sources]
    if not usable:
        return [body], "Body"
    top = usable[0]
    if texts:
        # of candidates that are as good the one that agrees clearly better with the structured data
        agrees = lambda c: max(D.agreement(c.node.raw_text(), x) for x in texts)
        own = agrees(top)
        tied = [(agrees(c), -c.order, c) for c in usable[1:] if c.node is not body and c.score >= top.score - max(0.03 * abs(top.score), 1)]
        if tied and (best := max(tied, key=lambda x: x[:2]))[0] >= max(0.6, own + 0.1):
            return [best[2].node], "StructuredData"
    if "StructuredData" in top.sources:
        return [top.node], "StructuredData"
    if (single := single_article(top, usable, stats)) is not None:
        return [single], "Semantic"
    bar = top.score - max(0.25 * abs(top.score), 5)
    for c in usable:
        if "CallerHint" in c.sources and c.score >= bar:
            return [c.node], "CallerHint"
    for c in usable:
        if "articleBody" in c.node.tokens("itemprop") and c.score >= bar and stats.chars(c.node) >= 0.55 * stats.chars(top.node):
            return [c.node], "Semantic"
    # a semantic root around, or nearly all of, the best one gives the better boundary
    within = [c for c in usable if "Semantic" in c.sources and stats.chars(c.node) >= 0.8 * stats.chars(top.node) and c.score >= bar]
    within = [c for c in within if top.node in c.node.ancestors() or c.node is top.node or c.node in top.node.ancestors()]
    if within:
        best = min(within, key=lambda c: (stats.chars(c.node), c.order))
        node = best.node
        if node.tag == "article" and sum(x.tag == "article" and stats.chars(x) > 0.5 * stats.chars(node) for x in (node.parent.children if node.parent else [])) > 1:
            return [node.parent], "SharedParent"
        return [node], "Semantic"
    node = top.node
    while node.parent is not None and node.parent.tag not in ("body", "html", "#document") and len([x for x in node.parent.children if x.tag != "#text" or x.text.strip()]) == 1:
        node = node.parent
    return siblings(node, top, stats), "+".join(sorted(top.sources))


def siblings(node: Node, top: Candidate, stats: Stats) -> list[Node]:
    """The node and those beside it that read like parts of it."""
    if node.parent is None or node.tag == "body":
        return [node]
    out, bar, by = [], max(10.0, 0.2 * top.score), node.get("class")
    for x in node.parent.children:
        if x is node:
            out.append(x)
        elif x.tag == "p":
            n, d = stats.chars(x), stats.density(x)
            if n > 80 and d < 0.25 or 0 < n <= 80 and d == 0 and re.search(r"[.!?](\s|$)", x.raw_text()):
                out.append(x)
        elif x.tag in ("div", "section", "article") and not _CLUTTER.search(x.name()):
            bonus = 0.2 * top.score if by and x.get("class") == by else 0
            if (2 + stats.commas(x) + min(stats.chars(x) / 100, 3)) * stats.paragraphs(x) * (1 - stats.density(x)) + bonus >= bar:
                out.append(x)
    return out


# -- cleanup
def hard_cleanup(root: Node) -> None:
    """What is never content: controls, embeds but those of known video hosts, tracking images."""
    for node in root.elements():
        if node.parent is None:
            continue
        tag = node.tag
        if tag in ("script", "style", "noscript", "template", "button", "select", "textarea", "object", "embed", "canvas", "dialog", "link", "meta", "svg"):
            label = node.get("aria-label") if tag == "svg" else ""
            node.replace(Node("#text", text=label)) if label else node.detach()
        elif tag == "input" and not (node.get("type").lower() == "checkbox" and any(x.tag == "li" for x in node.ancestors())):
            node.detach()
        elif tag == "iframe" and not VIDEO.search(node.get("src")):
            node.detach()
        elif tag == "img":
            size = [int(v) for k in ("width", "height") if (v := node.get(k)).isdigit()]
            if len(size) == 2 and max(size) <= 2 or re.search(r"(?:pixel|tracking|spacer|beacon)\b", node.get("src"), re.I):
                node.detach()
        elif tag == "a" and node.get("href").strip().lower().startswith("javascript:"):
            node.tag, node.attrs = "span", {}
        for name in [k for k in node.attrs if k.startswith("on")]:
            del node.attrs[name]
    repeats.drop_gutters(root)
    repeats.drop_views(root)


def chrome_cleanup(root: Node, stats: Stats, whole: int) -> None:
    """Navigation, footers and headers around the content."""
    for node in root.elements("nav", "footer", "header", "aside", "menu", "form"):
        if node.parent is None or any(x is not root and x.tag == "article" and node.tag == "header" for x in node.ancestors()) and node.elements("h1", "h2"):
            continue
        if node.tag == "header" and (node.elements("h1", "p", "figure") or node.has_ancestor("blockquote")):
            continue
        if node.tag == "aside" and (node.get("role") == "note" or re.search(r"admonition|callout|note|footnote", node.name(), re.I)):
            continue
        if node.tag == "form" and stats.words(node) > 80 and stats.paragraphs(node) >= 2:
            continue
        if node.tag == "footer" and node.has_ancestor("blockquote", "figure"):
            continue
        if stats.chars(node) < 0.6 * whole or node.tag == "nav":
            node.detach()
    for node in root.elements():
        if node.parent is not None and node.get("role") in ("navigation", "banner", "contentinfo", "search", "complementary"):
            node.detach()


def clutter_cleanup(root: Node, stats: Stats, whole: int, discussion: bool, repeats: bool = False) -> None:
    """Peripheral blocks by name, heading, links and words; what holds code, tables or most of the text is kept."""
    for node in root.elements():
        if node.parent is None or id(node) not in stats.of or node.tag in ("html", "body", "article", "main", "code", "pre", "td", "th", "tr", "table"):
            continue
        n, d = stats.chars(node), stats.density(node)
        block = node.tag in BLOCK_TAGS
        if not block or n > 0.5 * whole:
            continue
        short, links = n < 350 or n < whole / 5, sum(x.tag == "a" for x in node.walk())
        name, text = node.name(), T.squeeze(node.raw_text())
        protected = any(x.tag in ("pre", "table", "figure", "math") for x in node.walk()) or node.has_ancestor("pre", "table", "figure", "blockquote")
        hit = _CLUTTER.search(name)
        if discussion and hit and "comment" in hit[0].lower():
            continue
        if hit and not protected and (short or d >= 0.3) and stats.ends(node) <= 8:
            node.detach()
        elif node.tag in ("ul", "ol", "div", "section", "p") and links >= 3 and d >= 0.6 and n < 500 and not protected and re.search(r"nav|menu|links|list-?inline|tags", name, re.I):
            node.detach()
        elif short and not protected and (_READING_TIME.match(text) or links and len(text) <= 120 and _PAGER.match(text)):
            node.detach()
    seen: set[tuple] = set()
    nodes = root.elements("p", "div", "section", "ul")
    if repeats:  # regions that hold blocks only
        nodes = [x for x in root.elements("article", "aside", "div", "main", "section") if any(c.tag in _REGION_BLOCKS for c in x.children)]
    alike = Counter((id(x.parent), x.tag) for x in nodes)
    for node in nodes:
        if node.parent is None or alike[id(node.parent), node.tag] < 2:  # nothing that it could repeat
            continue
        text = T.squeeze(node.raw_text())
        key = id(node.parent), node.tag, T.folded(text)
        if len(text) >= 48 and key in seen and not node.elements("img", "pre", "table"):
            node.detach()
        seen.add(key)


_MEDIA = ("img", "iframe", "video", "audio", "math", "input", "hr", "br", "table", "pre")


def drop_empty(root: Node) -> None:
    full: set[int] = set()  # elements that hold text or media, found from their children: those come first here
    for node in reversed(root.elements()):
        if any(id(x) in full or x.tag in _MEDIA or x.tag == "#text" and x.text.strip() for x in node.children):
            full.add(id(node))
        elif node.tag in ("p", "div", "section", "span", "ul", "ol", "li", "article", "aside", "header", "footer", "figure", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6") and node.parent is not None:
            node.detach()
    for node in root.elements("p"):
        if re.fullmatch(r"[\s*•·|_\-–—~.]{1,40}", node.raw_text() or "x") and not node.elements("img", "hr"):
            node.detach()


def drop_title(root: Node, title: str | None) -> None:
    """The heading that only repeats the page's title."""
    if not title:
        return
    for head in root.elements("h1", "h2"):
        if T.matches_title(head.raw_text(), title):
            head.detach()
            return


# -- quality
def source_measure(body: Node, stats: Stats, title: str | None = None) -> tuple[int, int]:
    """Words and characters of the page outside its chrome, small clutter and the heading that repeats its title."""
    words, chars = stats.words(body), stats.chars(body)
    most = chars / 2
    stack = list(reversed(body.children))
    heading = title
    while stack:
        node = stack.pop()
        if node.tag[0] == "#":
            continue
        own = node.tag in ("nav", "footer", "aside", "header") and not any(x.tag in ("article", "main") for x in node.ancestors())
        own = own or ("class" in node.attrs or "id" in node.attrs) and stats.chars(node) < most and bool(_CLUTTER.search(node.name()))
        if heading and node.tag in ("h1", "h2") and T.matches_title(node.raw_text(), heading):
            own, heading = True, None
        if own:
            words, chars = words - stats.words(node), chars - stats.chars(node)
        else:
            stack.extend(reversed(node.children))
    return max(words, 0), max(chars, 0)


def is_good(m: dict, words: int, chars: int) -> bool:
    if not m["text_chars"] or not m["has_alphanumeric_text"]:
        return False
    coverage = m["text_chars"] / chars if chars else 1.0
    if words <= 60 or chars <= 400:
        return coverage >= 0.45
    structured = m["code_block_count"] or m["table_count"] or m["list_item_count"] >= 3
    long_enough = (m["word_count"] >= 150 or m["text_chars"] >= 1000) and m["paragraph_count"] >= 3 and coverage >= 0.05
    return coverage >= 0.6 or m["word_count"] >= 80 and coverage >= 0.3 or long_enough or bool(structured) and m["word_count"] >= 20 and coverage >= 0.25


#: Names of elements that are never the content. Fixed values.
BOILERPLATE = frozenset(
    "accessdenied applicationshell captcha consent cookie forbidden login maintenance newsletter notfound paywall signin subscribe subscription verify verification".split()
)


def boilerplate_root(node: Node) -> bool:
    """Whether an element's class or id, letters and digits alone, names a notice of the site."""
    return any("".join(c for c in node.get(k).lower() if c.isascii() and c.isalnum()) in BOILERPLATE for k in ("id", "class"))


def link_only(m: dict) -> bool:
    """Whether a semantic root is a list of links and no more."""
    parts = m["paragraph_count"] + m["code_block_count"] + m["table_count"] + m["figure_count"]
    return m["text_chars"] >= 60 and m["link_density"] >= 0.75 and not parts and m["heading_count"] <= 1 and m["list_item_count"] < 3


def incoherent(m: dict, text: str) -> bool:
    """Whether a very short result has values, but no words or structure that say what they are."""
    if m["text_chars"] > 200 or m["word_count"] > 20 or m["has_contextual_structure"]:
        return False
    letters, digits = sum(c.isalpha() for c in text), sum(c.isdigit() for c in text)
    return not letters or letters <= 16 and digits >= max(2 * letters, 4)


def suspiciously_small(m: dict, words: int, chars: int) -> bool:
    return not m["text_chars"] or words >= 80 and m["word_count"] < 15 or chars >= 1000 and m["text_chars"] < 0.15 * chars


def attempt_score(m: dict, chars: int, specific: bool) -> float:
    coverage = m["text_chars"] / chars if chars else 0.0
    structure = min(20, m["heading_count"] + m["list_item_count"] + 2 * m["table_count"] + 2 * m["code_block_count"])
    return 100 * coverage + 12 * specific + structure - min(12 * m["link_density"], 10)


def barrier(body: Node, text: str) -> bool:
    """Whether the page only says that it can't be seen."""
    heads = [T.squeeze(x.raw_text()) for x in body.elements("h1", "h2", "title")]
    return len(text.split()) <= 150 and any(_DENIED.match(h) for h in [*heads, text[:60]]) and bool(_PERMISSION.search(text))


def waits(body: Node, text: str) -> bool:
    """Whether the page only waits for a program."""
    n = len(text.split())
    if n <= 20 and len(text) <= 200 and _JS_NOTICE.search(text) or n <= 12 and _LOADING.match(text):
        return True
    return n <= 20 and len(body.elements("button", "input", "select", "textarea")) >= 2 and not body.elements("p")


# -- the whole
def _body(document: Node) -> Node:
    body = document.first("body")
    if body is None:
        raise PageError("NoBody", "the document has no body")
    return body


def excerpt(blocks: list[Block]) -> str | None:
    return next((T.squeeze(render.plain_text([b])) for x in blocks for b in x.walk() if b.op == "Paragraph" and render.plain_text([b]).strip()), None)


def extract(html: str | None, url: str | None = None, options: Options | None = None) -> dict[str, Any]:
    """The page of a text. Raises ``PageError`` where there is none."""
    o = options or Options()
    if url is not None and not T.is_absolute(url):
        raise PageError("InvalidUrl", f"not an absolute address: {url[:200]}")
    try:
        document = parse(html or "", o.budget)
    except LimitError as e:
        raise PageError("ResourceLimit", str(e), e.resource, e.limit) from e
    base_node = next((x for x in document.elements("base") if x.get("href")), None)
    base = T.resolve(url, base_node.get("href"), ("http", "https")) if base_node is not None else url
    body = _body(document)
    shallow(body, MOST_LEVELS, BLOCK_TAGS, hidden)
    items = M.json_items(document, o.budget.json_ld_bytes, o.budget.json_ld_items, o.budget.json_ld_depth) if o.structured_data else []
    found = M.candidates(document, url, base, items)
    meta = M.resolved(found)
    if any(x.tag in ("template", "noscript") for x in body.walk()):
        shell.splice(body)
        shell.reveal(body, hidden)
    prepare(body)
    kind, special = specialised.find(document, url)
    attempts: list[dict[str, Any]] = []
    chosen: tuple[list[Block], dict] | None = None
    everything = T.squeeze(body.raw_text())
    if o.content_root:
        target = next((x for x in body.walk() if x.tag[0] != "#" and matches(x, o.content_root)), None)
        if target is None:
            raise PageError("ContentRootNotFound", f"no element for {o.content_root}")
        work = target.copy()
        holder = Node("div")
        holder.append(work)
        strip_hidden(holder, False)
        hard_cleanup(holder)
        blocks = compile_content(holder, base)
        chosen = blocks, render.metrics(blocks)
        attempts.append({"strategy": "ContentRoot", "root": target.tag, "accepted": True, "rejection": None, "score": 0.0})
    elif special is not None:
        hard_cleanup(special)
        blocks = compile_content(special, base)
        chosen = blocks, render.metrics(blocks)
        attempts.append({"strategy": "Specialised", "root": kind, "accepted": True, "rejection": None, "score": 0.0})
    else:
        if barrier(body, everything):
            raise PageError("NoContent", "the page is an access barrier")
        if waits(body, everything):
            raise PageError("NoContent", "the page is an application shell")
        probe = body.copy()
        gone = strip_hidden(probe, False)
        visible = len(T.squeeze(probe.raw_text()))
        best: tuple[float, list[Block], dict, dict] | None = None
        texts = [x for x in D.texts_of(M.described(document, url, items)[0]) if len(T.words(x)) >= 5]
        evidence = scoring.Evidence(len(meta["title"] or ""), len(meta["description"] or ""), len(items), gone > 0 and strip_hidden(body.copy(), True) < gone)
        recover = gone >= 2 * visible and gone >= 100 and (visible <= 200 or len(probe.raw_text().split()) <= 30)
        for strategy in sorted(STRATEGIES, key=lambda x: x != "RelaxedVisibility") if recover else STRATEGIES:
            if strategy == "RelaxedVisibility" and not recover:
                continue
            if strategy == "StructuredDataHint" and not texts:
                continue
            work = body.copy()
            strip_hidden(work, strategy == "RelaxedVisibility")
            located = D.locate(work, texts, hidden) if texts else None
            if strategy == "StructuredDataHint" and located is None:
                continue
            stats = Stats(work)
            words, chars = source_measure(work, stats, meta["title"])
            if strategy == "BodyFallback":
                roots, source = [work], "Body"
            elif strategy == "StructuredDataHint":
                roots, source = [located[0]], "StructuredData"
            else:
                ranked = discover(work, stats, strategy != "BroadContent", o.content_hint, evidence, located[0] if located else None)
                roots, source = choose(work, ranked, stats, texts)
            holder = Node("div")
            holder_chars = sum(stats.chars(r) for r in roots)
            for r in [x for x in roots]:
                holder.append(r)
            hard_cleanup(holder)
            whole = C.measure(compile_content(holder.copy(), base)) if o.diagnostics else None
            chrome_cleanup(holder, stats, holder_chars)
            if strategy != "BodyFallback":
                repeats.drop_toc(holder)  # nothing is lost with it, so relaxed strategies drop it too
            if strategy in ("Normal", "StructuredDataHint", "RelaxedVisibility"):
                terminal.drop_terminal(holder)
                clutter_cleanup(holder, stats, holder_chars, kind == "Discussion", o.repeats)
            drop_title(holder, meta["title"])
            drop_empty(holder)
            blocks, flattened = compile_counted(holder, base)
            m = render.metrics(blocks)
            gate = "BoilerplateRoot" if all(map(boilerplate_root, roots)) else "Incoherent" if incoherent(m, render.plain_text(blocks)) else "LinkOnly" if source == "Semantic" and link_only(m) else None
            good = gate is None and is_good(m, words, chars)
            score = attempt_score(m, chars, source not in ("Body",))
            note = {"strategy": strategy, "root": roots[0].tag, "source": source, "accepted": good, "rejection": None if good else "Empty" if not m["text_chars"] else gate or "LowQuality", "score": score}
            if whole is not None:
                categories = C.coverage(whole, C.measure(blocks))
                note |= {"coverage": C.score(categories), "categories": categories, "normalization": C.normalization(blocks, flattened)}
            attempts.append(note)
            if m["text_chars"] and m["has_alphanumeric_text"] and gate is None and (best is None or score > best[0]):
                best = score, blocks, m, note
            if good:
                best = score, blocks, m, note
                break
        if best is not None and (best[3]["accepted"] or not suspiciously_small(best[2], words, chars)):
            chosen = best[1], best[2]
            best[3]["accepted"] = True
        if chosen is None:
            article = next((x for x in items if isinstance(x.get("articleBody"), str) and len(x["articleBody"].split()) >= 3 and len(x["articleBody"]) >= 20), None)
            if article is not None and (meta["authors"] or meta["published_time"]):
                blocks = [Block("Paragraph", [Block("Text", text=T.squeeze(p))]) for p in re.split(r"\n\s*\n", article["articleBody"]) if p.strip()]
                chosen = blocks, render.metrics(blocks)
                attempts.append({"strategy": "MetadataFallback", "root": "articleBody", "accepted": True, "rejection": None, "score": 0.0})
        if chosen is None:
            raise PageError("NoContent", "no content was found")
    blocks, m = chosen
    if not m["text_chars"] and not m["image_count"] and not m["media_count"]:
        raise PageError("NoContent", "no content was found")
    if job := specialised.job_summary(items):
        kind = kind or "JobListing"
        blocks = [Block("Paragraph", [Block("Strong", [Block("Text", text=f"{k}:")]), Block("Text", text=f" {v}")]) for k, v in job] + blocks
        m = render.metrics(blocks)
    if meta["description"] is None:
        meta["description"] = excerpt(blocks)
    return {
        "metadata": meta,
        "markdown": render.markdown(blocks, o.links, o.images, o.max_line_width),
        "html": render.canonical_html(blocks),
        "text": render.plain_text(blocks),
        "metrics": m,
        "blocks": blocks,
        "kind": kind,
        "diagnostics": attempts if o.diagnostics else None,
        "metadata_diagnostics": M.provenance(found) if o.metadata_diagnostics else None,
        "structured_data": [json.dumps(x, ensure_ascii=False) for x in items] if o.retain_structured_data else None,
    }


__all__ = ["Options", "PageError", "extract", "hidden", "hidden_style", "tape"]
