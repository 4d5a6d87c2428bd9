"""How scoring sees a tree, and how candidates lie to one another. Nothing here changes the tree."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass

from webdistill.functions.compile import BLOCK_TAGS
from webdistill.functions.dom import Node, intervals
from webdistill.functions.lists import ordered_markers, role_items

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: What is counted below an element, by the tags that the view shows.
COUNTED = {
    "heading_count": frozenset(HEADINGS), "list_item_count": frozenset(("li",)), "code_block_count": frozenset(("pre",)), "table_count": frozenset(("table",)),
    "figure_count": frozenset(("figure",)), "image_count": frozenset(("img",)), "protected_block_count": frozenset(("pre", "table", "figure", "blockquote")),
}
_KINDS = {t: [k for k, tags in COUNTED.items() if t in tags] for tags in COUNTED.values() for t in tags}


def authoritative(node: Node) -> bool:
    """Whether an element says itself that it is the content."""
    return node.tag in ("article", "main") or any(r in ("article", "main") for r in node.tokens("role")) or "articleBody" in node.tokens("itemprop")


@dataclass(frozen=True)
class Seed:
    """A text that gives points to the elements around it: an element, or a run of inline nodes of ``parent``."""

    nodes: tuple[Node, ...]
    parent: Node | None


class View:
    """A tree with headings and lists by their roles, and with DIVs taken for paragraphs where they are used as such.

    ``place`` and ``end`` are an element's interval in document order; counts below it are found by where the counted lie.
    A DIV that only wraps one paragraph, or only inline nodes, is passed over (``parent``); one without blocks is a ``p``;
    inline nodes between a DIV's blocks are paragraphs without an element. Semantic DIVs stay.
    """

    def __init__(self, root: Node, stats, semantic: Callable[[Node], bool] = authoritative):
        self.root, self.stats = root, stats
        self.order, self.place, self.end = intervals(root)
        self.tags: dict[int, str] = {}
        self.starts: dict[int, int] = {}  # numbers that role lists begin with
        self.texts: dict[int, str] = {}  # texts without the numbers that those lists show themselves
        self.passed: dict[int, Node | None] = {}  # DIVs that only wrap, and what is around them
        self.seeds: list[Seed] = []
        blocks: set[int] = set()  # elements with a block below
        for node in reversed(self.order):
            if any(c.tag in BLOCK_TAGS or id(c) in blocks for c in node.children):
                blocks.add(id(node))
        self._roles()
        self._divs(blocks, semantic)
        self.found: dict[str, list[int]] = {k: [] for k in COUNTED}
        for i, node in enumerate(self.order):
            for k in _KINDS.get(self.tag(node), ()):
                self.found[k].append(i)

    def tag(self, node: Node) -> str:
        return self.tags.get(id(node), node.tag)

    def parent(self, node: Node) -> Node | None:
        """The element around a node, those passed over left out."""
        up = self.passed[id(node.parent)] if id(node.parent) in self.passed else node.parent
        return up if up is not None and up.tag != "#document" else None

    def count(self, node: Node, what: str) -> int:
        """How many elements of a kind lie in a subtree, its root included."""
        places = self.found[what]
        return bisect_left(places, self.end[id(node)]) - bisect_left(places, self.place[id(node)])

    def chars(self, seed: Seed) -> int:
        return sum(self.stats.chars(x) for x in seed.nodes)

    def _roles(self) -> None:
        for node in self.order:
            if "role" not in node.attrs:
                continue
            if "heading" in node.tokens("role") and node.get("aria-level").strip() in tuple("123456"):
                self.tags[id(node)] = "h" + node.get("aria-level").strip()
            items = role_items(node)
            if not items:
                continue
            if node.tag not in ("ol", "ul"):
                markers = ordered_markers(items)
                self.tags[id(node)] = "ol" if markers else "ul"
                if markers:
                    self.starts[id(node)] = markers[0][0]
                    self.texts |= {id(text): rest for _, text, rest in markers}
            self.tags |= {id(x): "li" for x in items}

    def _divs(self, blocks: set[int], semantic: Callable[[Node], bool]) -> None:
        prepared: set[int] = set()
        inline = lambda x: x.tag == "#text" or x.tag not in BLOCK_TAGS and id(x) not in blocks and x.tag[0] != "#"
        for div in self.order:
            if self.tag(div) != "div" or div is self.root:
                continue
            parts: list[tuple[Node, ...]] = []
            run: list[Node] = []
            for child in [*div.children, None]:
                if child is not None and inline(child):
                    run.append(child)
                    continue
                if any(x.tag != "#text" or x.text.strip() for x in run):
                    parts.append(tuple(run))
                run = []
                if child is not None and child.tag[0] != "#":
                    parts.append((child,))
            virtual = [p for p in parts if inline(p[0])]
            seeds = [p for p in parts if inline(p[0]) or self.tag(p[0]) == "p"]
            if not semantic(div) and len(parts) == 1 and seeds and self.stats.density(div) < 0.25:
                self.passed[id(div)] = self.parent(div)
                self.seeds.append(Seed(parts[0], self.passed[id(div)]))
            elif not semantic(div) and id(div) not in blocks and not virtual:
                self.tags[id(div)] = "p"
                self.seeds.append(Seed((div,), div.parent))
                prepared.add(id(div))
                continue
            else:
                self.seeds += [Seed(p, div) for p in seeds]
            prepared |= {id(p[0]) for p in seeds}
        for node in self.order:
            tag = self.tag(node)
            if id(node) in prepared or node is self.root:
                continue
            if tag in ("p", "pre", "td", "section", *HEADINGS[1:]):
                if tag == "section" and id(node) in blocks or tag == "td" and any(x.tag in ("p", "div", "table") for x in self.order[self.place[id(node)] + 1 : self.end[id(node)]]):
                    continue
                self.seeds.append(Seed((node,), self.parent(node)))


def readability(view: View, weight: Callable[[Node], int]) -> dict[int, tuple[Node, float]]:
    """Points of the view's texts passed on to five elements around them, divided by 1, 2, 6, 9 and 12; links take their share off."""
    stats = view.stats
    points: dict[int, tuple[Node, float]] = {}
    for seed in view.seeds:
        n = view.chars(seed)
        if n < 25:
            continue
        value = 2 + sum(stats.commas(x) for x in seed.nodes) + min(n / 100, 3)
        node = seed.parent
        for share in (1, 2, 6, 9, 12):
            if node is None or node.tag == "html":
                break
            if id(node) not in points:
                tag = view.tag(node)
                base = {"div": 5, "pre": 3, "td": 3, "blockquote": 3}.get(tag, 0)
                base -= 3 * (tag in ("address", "ol", "ul", "dl", "dd", "dt", "li", "form")) + 5 * (tag in (*HEADINGS, "th"))
                points[id(node)] = node, base + weight(node)
            points[id(node)] = node, points[id(node)][1] + value / share
            node = view.parent(node)
    return {k: (node, p * (1 - stats.density(node))) for k, (node, p) in points.items()}


@dataclass
class Standing:
    """How a candidate lies to the others: whether one with points lies in it, whether it lies in an authoritative one, how
    many of those lie in it (itself included), and the articles right below it with their points."""

    points_within: bool
    under: bool = False
    within: int = 0
    peers: int = 0
    peer_points: float = 0.0


def standings(view: View, found: list) -> list[Standing]:
    """The standing of each candidate, by one pass over them in document order."""
    order = sorted(range(len(found)), key=lambda i: view.place[id(found[i].node)])
    out = [Standing("Readability" in c.sources, within=int(authoritative(c.node))) for c in found]
    around: list[int] = []
    parent: dict[int, int] = {}
    nearest: dict[int, int | None] = {}  # the authoritative candidate next around
    for i in order:
        node = found[i].node
        while around and view.end[id(found[around[-1]].node)] <= view.place[id(node)]:
            around.pop()
        near = None
        if around:
            parent[i] = near = around[-1]
            near = near if authoritative(found[near].node) else nearest[near]
        nearest[i] = near
        out[i].under = near is not None
        if near is not None and (node.tag == "article" or "article" in node.tokens("role")) and view.stats.chars(node):
            out[near].peers += 1
            out[near].peer_points += found[i].readability
        around.append(i)
    for i in reversed(order):
        if i in parent:
            out[parent[i]].points_within |= out[i].points_within
            out[parent[i]].within += out[i].within
    return out


@dataclass(frozen=True)
class Evidence:
    """What the rest of a page says about its content: lengths of title and description, structured items, hidden content."""

    title_chars: int = 0
    description_chars: int = 0
    structured_items: int = 0
    hidden: bool = False


def complete_root_bonus(evidence: Evidence, f: dict[str, float]) -> float:
    """Points for a root that is a whole document, where the page hides content; 0 where the evidence is weak. Fixed values."""
    weak = not evidence.hidden or evidence.title_chars < 8 or evidence.description_chars < 80
    if weak or f["word_count"] < 80 or f["paragraph_count"] < 6 or f["heading_count"] < 3:
        return 0.0
    prose = min(f["word_count"], 800) / 80 + min(f["paragraph_count"], 20) / 2 + 1.5 * min(f["heading_count"], 12)
    blocks = 3 * min(f["table_count"], 3) + 3 * min(f["code_block_count"], 3) + 2 * min(f["figure_count"], 3) + 0.5 * min(f["list_item_count"], 8)
    return 22 + prose + blocks + min(evidence.description_chars, 400) / 80 + 4 * min(evidence.structured_items, 4)


def meaningful(f: dict[str, float]) -> bool:
    """Whether a candidate without points still holds something."""
    return distinct(f) or bool(f["paragraph_count"] and f["word_count"] >= 3 and f["sentence_end_count"])


def distinct(f: dict[str, float]) -> bool:
    return bool(f["code_block_count"] or f["table_count"] or f["list_item_count"] >= 3 or f["figure_count"])
