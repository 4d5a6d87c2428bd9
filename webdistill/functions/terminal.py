"""What follows the content: runs of related links, subscriptions and promotion at its end."""

from __future__ import annotations

import re
from itertools import accumulate

from webdistill.functions.dom import Node, intervals

#: So much text may stand between a place and the content's end, or start, for it to be near; so much must come before what goes.
NEAR, BEFORE = 100, 300
#: What has more nodes than this, or more than this share of the text, is no end piece.
MOST_NODES, MOST_SHARE = 1000, 0.4
_HEADING = re.compile("h[2-6]")
# Own choice of words and names.
_RELATED = re.compile(
    r"(?:related (?:articles|content|posts|stories|links|reading)|recommended(?: reading| for you)?|read next|next steps|more (?:stories|articles|posts|context)|more (?:from|on) \S.{0,60}|"
    r"you (?:may|might) also (?:like|enjoy)|collection|ähnliche artikel|mehr zum thema|das könnte (?:sie|dich) auch interessieren|à lire aussi|articles (?:liés|similaires)|sur le même sujet|"
    r"artículos relacionados|también te puede interesar|lee también)\W*",
    re.I,
)
_MAYBE = re.compile(r"(?:related|further reading|see also|read more|siehe auch|voir aussi|véase también)\W*", re.I)
_OPENING = re.compile(
    r"(?:continue reading|get new posts|here's a preview|more from |other posts|read next|related (?:posts|stories|articles)|subscribe|sign up for|try (?:my|our) |you (?:may|might) also like|our products|"
    r"sponsored|abonnieren|newsletter|abonnez|suscríbe)",
    re.I,
)
_NAME = re.compile(r"(?:article|post|entry)-?_?footer|banner|keep[-_]reading|navbox|newsletter|portal\b|promo|recommend|related|subscri|read-?next|more-?stories", re.I)
_PROMOTION = re.compile(r"banner|promo", re.I)
_NOTES = re.compile(r"footnote|endnote|references", re.I)


class Positions:
    """How much text comes before and after any element of a tree, by running sums over the document order."""

    def __init__(self, root: Node):
        self.root = root
        self.order, self.place, self.end = intervals(root)
        self.chars = [0, *accumulate(len(" ".join(x.text.split())) if x.tag == "#text" else 0 for x in self.order)]
        self.links = [0, *accumulate(int(x.tag == "a" and bool(x.get("href"))) for x in self.order)]
        self.linked = [0] * (len(self.order) + 1)
        self.held = [0, *accumulate(int(x.tag in ("pre", "table", "figure", "math", "video", "audio")) for x in self.order)]
        until = 0
        for i, x in enumerate(self.order):
            if x.tag == "a":
                until = max(until, self.end[id(x)])
            self.linked[i + 1] = self.linked[i] + (self.chars[i + 1] - self.chars[i] if i < until else 0)

    def within(self, sums: list[int], node: Node) -> int:
        return sums[self.end[id(node)]] - sums[self.place[id(node)]]

    def text(self, node: Node) -> int:
        return self.within(self.chars, node)

    def before(self, node: Node) -> int:
        return self.chars[self.place[id(node)]] - self.chars[0]

    def after(self, node: Node) -> int:
        return self.chars[-1] - self.chars[self.end[id(node)]]

    def near_start(self, node: Node) -> bool:
        return self.before(node) <= NEAR

    def near_end(self, node: Node) -> bool:
        return self.after(node) <= NEAR


def is_heading(node: Node) -> bool:
    return bool(_HEADING.fullmatch(node.tag)) or "heading" in node.tokens("role") or bool(re.search(r"section-?title", node.name(), re.I))


def opening(node: Node, most: int = 240) -> str:
    """The first words of a subtree."""
    out, n = [], 0
    for x in node.walk():
        if x.tag == "#text" and x.text.strip():
            out.append(" ".join(x.text.split()))
            n += len(out[-1])
            if n > most:
                break
    return " ".join(out)[:most]


def related_heading(node: Node) -> int:
    """2 for a heading that says that links to other pages follow, 1 for one that may say so, else 0."""
    if not is_heading(node):
        return 0
    text = opening(node, 128)
    return 2 if _RELATED.fullmatch(text) else 1 if _MAYBE.fullmatch(text) else 0


def segments(children: list[Node]) -> list[list[Node]]:
    """Siblings parted before each heading and notes: what a heading heads belongs to it. Texts of white space are left out."""
    out: list[list[Node]] = []
    for x in children:
        if x.tag == "#comment" or x.tag == "#text" and not x.text.strip():
            continue
        if out and is_heading(out[-1][0]) and not is_heading(x) and not _NOTES.search(x.name()):
            out[-1].append(x)
        else:
            out.append([x])
    return out


def score(segment: list[Node], at: Positions) -> tuple[int, bool]:
    """Signs that a segment leads away from the page, and whether it is one that does so for sure."""
    links = sum(at.within(at.links, x) for x in segment)
    text, linked = sum(map(at.text, segment)), sum(at.within(at.linked, x) for x in segment)
    first = segment[0]
    head = first if is_heading(first) else next((x for x in at.order[at.place[id(first)] : at.end[id(first)]] if is_heading(x)), None)
    leads = head is not None and at.before(head) - at.before(first) <= 8
    kind = related_heading(head) if leads else 0
    listed = links >= 2 and linked >= 0.35 * max(text - (at.text(head) if kind else 0), 1)
    out = int(any(x.tag in ("footer", "nav", "form") for x in segment)) + int(any(_NAME.search(x.name()) for x in segment if "class" in x.attrs or "id" in x.attrs))
    out += int(bool(_OPENING.match(opening(first)))) + int(kind == 2 and listed) + int(kind == 1 and links >= 2 and linked >= 0.6 * text)
    pictured = any(x.tag in ("img", "table") for y in segment for x in y.walk())
    promotion = links >= 2 and pictured and any(_PROMOTION.search(x.name()) for y in segment for x in y.walk() if x.tag[0] != "#") and bool(_OPENING.match(opening(first)))
    return out, kind == 2 and listed or promotion


def terminal_runs(root: Node) -> list[list[Node]]:
    """Runs of last siblings, near the content's end, that lead away from the page.

    From the end of each element's children segments are taken while they have signs of it; notes and empty parts between
    are passed. A run counts with two signs' segments or one that is sure, when enough text comes before it (for a sure one, twice its own will do). What holds
    code, tables, figures or formulas, or much of the text, ends a run.
    """
    at = Positions(root)
    whole = at.text(root)
    out: list[list[Node]] = []
    gone = 0  # subtrees before this place lie in a run already
    for node in at.order:
        if node.tag[0] == "#" and node is not root or not node.children or not at.near_end(node) or at.place[id(node)] < gone:
            continue
        parts = segments(node.children)
        if len(parts) < 2:
            continue
        run: list[list[Node]] = []
        signs, sure, after = 0, False, 0
        for segment in reversed(parts):
            text = sum(map(at.text, segment))
            if all(_NOTES.search(x.name()) for x in segment) and text or not text and not any(at.within(at.held, x) for x in segment):
                if not text and run:
                    run.append(segment)
                continue
            if text > MOST_SHARE * whole or at.end[id(segment[-1])] - at.place[id(segment[0])] > MOST_NODES:
                break
            n, certain = score(segment, at)
            held = any(at.within(at.held, x) for x in segment) and not certain
            if not n or held or text > 1500 and not certain:
                break
            run.append(segment)
            signs, sure, after = signs + 1, sure or certain, after + text
        while run and not sum(map(at.text, run[-1])):
            run.pop()
        if not run or not (sure or signs >= 2):
            continue
        start = at.place[id(run[-1][0])]
        before = at.chars[start] - at.chars[at.place[id(node)]]
        if before >= BEFORE or sure and before >= 2 * after:
            out.append([x for s in reversed(run) for x in s])
            gone = max(at.end[id(x)] for x in out[-1])
    return out


def drop_terminal(root: Node) -> int:
    """Take the terminal runs out; returns how many elements went."""
    found = [x for run in terminal_runs(root) for x in run]
    for x in found:
        x.detach()
    return len(found)
