"""HTML documents to trees, by the WHATWG parsing rules.

Covered: character references, raw text and script elements, implied html/head/body, paragraphs and other end tags left
out, active formatting elements with reconstruction and the adoption agency, tables with foster parenting, selects,
templates (their contents are children) and foreign content. Limits are counted while the tree grows.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

from webdistill.functions.dom import Node

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("style xmp iframe noembed noframes script".split())
ESCAPABLE = frozenset(("title", "textarea"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt "
    "embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link "
    "listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style "
    "summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search "
    "section summary ul h1 h2 h3 h4 h5 h6 pre listing form table hr plaintext".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes script style template title".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
TABLE_PARTS = frozenset(("table", "caption", "colgroup", "tbody", "thead", "tfoot", "tr", "td", "th", "template"))
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())

_TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTR = re.compile(r"""[\s/]*(?:(=?[^\s/>=]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)|(?=>)))?)""")
_SPACES = " \t\n\f\r"
_LEGACY = re.compile(r"&([A-Za-z][A-Za-z0-9]*)(?=[=A-Za-z0-9])")


class LimitError(Exception):
    def __init__(self, resource: str, limit: int):
        super().__init__(f"{resource} over {limit}")
        self.resource, self.limit = resource, limit


@dataclass(frozen=True)
class Budget:
    """Limits of a parse; 0 is none."""

    input_bytes: int = 0
    nodes: int = 0
    elements: int = 0
    attributes: int = 0
    attributes_per_element: int = 0
    text_bytes: int = 0
    depth: int = 0
    json_ld_bytes: int = 0
    json_ld_items: int = 0
    json_ld_depth: int = 0


#: Limits for pages of unknown origin.
UNTRUSTED = Budget(16 << 20, 2_000_000, 1_000_000, 4_000_000, 512, 16 << 20, 512, 4 << 20, 10_000, 128)


def _attribute_text(value: str) -> str:
    if "&" not in value:
        return value
    # a name without semicolon that goes on with a letter, a digit or = is no reference inside an attribute
    kept = _LEGACY.sub(lambda m: m[0] if f"{m[1]};" in html.entities.html5 and value[m.end() : m.end() + 1] == ";" else f"&amp;{m[1]}", value)
    return html.unescape(kept)


class Parser:
    def __init__(self, budget: Budget | None = None):
        self.budget = budget or Budget()
        self.document = Node("#document")
        self.stack: list[Node] = []
        self.no_p: tuple[int, Node | None] = (0, None)
        self.active: list[Node | None] = []
        self.head: Node | None = None
        self.body: Node | None = None
        self.form: Node | None = None
        self.foster = False
        self.seen: set[str] = set()  # tags of all elements made so far: what never was made needs no search of the stack
        self.nodes = self.n_elements = self.n_attributes = self.text_bytes = 0

    # -- counting
    def over(self, resource: str, value: int) -> None:
        limit = getattr(self.budget, resource)
        if limit and value > limit:
            raise LimitError(resource, limit)

    def made(self, tag: str, attrs: dict[str, str], ns: str = "html") -> Node:
        self.nodes += 1
        self.n_elements += 1
        self.n_attributes += len(attrs)
        self.over("nodes", self.nodes)
        self.over("elements", self.n_elements)
        self.over("attributes", self.n_attributes)
        self.over("attributes_per_element", len(attrs))
        self.seen.add(tag)
        return Node(tag, attrs, ns=ns)

    # -- the stack of open elements
    @property
    def current(self) -> Node:
        return self.stack[-1]

    def in_scope(self, *tags: str, barrier: frozenset[str] = SCOPE) -> bool:
        for node in reversed(self.stack):
            if node.tag in tags and node.ns == "html":
                return True
            if node.tag in barrier or node.ns != "html" and node.tag in ("foreignObject", "desc", "title", "mi", "mo", "mn", "ms", "mtext", "annotation-xml"):
                return False
        return False

    def implied(self, but: str = "") -> None:
        while self.stack and self.current.tag in IMPLIED and self.current.tag != but:
            self.stack.pop()

    def pop_to(self, *tags: str) -> None:
        while self.stack and self.stack.pop().tag not in tags:
            pass

    def close_p(self) -> None:
        if "p" not in self.seen:
            return
        stack, (known, top) = self.stack, self.no_p
        # no p is in scope at the place that was looked at last, if that still is as it was: look above it only
        for i in range(len(stack) - 1, known - 1 if known <= len(stack) and (not known or stack[known - 1] is top) else -1, -1):
            node = stack[i]
            if node.tag == "p" and node.ns == "html":
                self.implied("p")
                self.pop_to("p")
                return
            if node.tag in SCOPE or node.tag == "button" or node.ns != "html" and node.tag in ("foreignObject", "desc", "title", "mi", "mo", "mn", "ms", "mtext", "annotation-xml"):
                break
        if stack:
            self.no_p = len(stack), stack[-1]

    # -- insertion
    def place(self) -> tuple[Node, int]:
        target = self.current
        if self.foster and target.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            for i in range(len(self.stack) - 1, -1, -1):
                node = self.stack[i]
                if node.tag == "template":
                    return node, len(node.children)
                if node.tag == "table":
                    if node.parent is not None:
                        return node.parent, node.index()
                    return self.stack[i - 1], len(self.stack[i - 1].children)
        return target, len(target.children)

    def insert(self, tag: str, attrs: dict[str, str], ns: str = "html", push: bool = True) -> Node:
        node = self.made(tag, attrs, ns)
        parent, at = self.place()
        node.parent = parent
        parent.children.insert(at, node)
        if push:
            self.stack.append(node)
            self.over("depth", len(self.stack))
        return node

    def text(self, data: str) -> None:
        if not data:
            return
        self.text_bytes += len(data)
        self.over("text_bytes", self.text_bytes)
        parent, at = self.place()
        if at and parent.children[at - 1].tag == "#text":
            parent.children[at - 1].text += data
            return
        self.nodes += 1
        self.over("nodes", self.nodes)
        node = Node("#text", text=data)
        node.parent = parent
        parent.children.insert(at, node)

    def comment(self, data: str) -> None:
        self.nodes += 1
        self.over("nodes", self.nodes)
        node = Node("#comment", text=data)
        parent, at = self.place()
        node.parent = parent
        parent.children.insert(at, node)

    # -- active formatting elements
    def reconstruct(self) -> None:
        i = len(self.active)
        while i and (entry := self.active[i - 1]) is not None and not any(x is entry for x in self.stack):
            i -= 1
        for k in range(i, len(self.active)):
            old = self.active[k]
            self.active[k] = self.insert(old.tag, dict(old.attrs))

    def activate(self, node: Node) -> None:
        same = []
        for x in reversed(self.active):
            if x is None:
                break
            if x.tag == node.tag and x.attrs == node.attrs:
                same.append(x)
        if len(same) >= 3:
            self.active = [x for x in self.active if x is not same[-1]]
        self.active.append(node)

    def clear_active(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def adopt(self, tag: str) -> None:
        """End tag of a formatting element."""
        if self.current.tag == tag and not any(x is self.current for x in self.active):
            self.stack.pop()
            return
        for _ in range(8):
            entry = None
            for x in reversed(self.active):
                if x is None:
                    break
                if x.tag == tag:
                    entry = x
                    break
            if entry is None:
                self.other_end(tag)
                return
            at = next((i for i, x in enumerate(self.stack) if x is entry), -1)
            if at < 0:
                self.active = [x for x in self.active if x is not entry]
                return
            if not self.in_scope(tag):
                return
            furthest = next((i for i in range(at + 1, len(self.stack)) if self.stack[i].tag in SPECIAL and self.stack[i].ns == "html"), -1)
            if furthest < 0:
                del self.stack[at:]
                self.active = [x for x in self.active if x is not entry]
                return
            block, common = self.stack[furthest], self.stack[at - 1]
            mark = next(i for i, x in enumerate(self.active) if x is entry)
            last, i, n = block, furthest, 0
            while True:
                n += 1
                i -= 1
                node = self.stack[i]
                if node is entry:
                    break
                listed = next((k for k, x in enumerate(self.active) if x is node), -1)
                if n > 3 and listed >= 0:
                    del self.active[listed]
                    mark -= listed < mark
                    listed = -1
                if listed < 0:
                    del self.stack[i]
                    furthest -= 1
                    continue
                new = self.made(node.tag, dict(node.attrs))
                self.active[listed] = self.stack[i] = new
                if last is block:
                    mark = listed + 1
                new.append(last)
                last = new
            last.detach()
            if common.tag in ("table", "tbody", "tfoot", "thead", "tr"):
                was, self.foster = self.foster, True
                keep, self.stack = self.stack, self.stack[:at]
                parent, where = self.place()
                self.stack, self.foster = keep, was
                parent.insert(where, last)
            else:
                common.append(last)
            new = self.made(entry.tag, dict(entry.attrs))
            for child in list(block.children):
                new.append(child)
            block.append(new)
            listed = next(i for i, x in enumerate(self.active) if x is entry)
            self.active.insert(mark, new)
            del self.active[listed + (mark <= listed)]
            self.stack = [x for x in self.stack if x is not entry]
            self.stack.insert(next(i for i, x in enumerate(self.stack) if x is block) + 1, new)

    def other_end(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            node = self.stack[i]
            if node.tag == tag:
                self.implied(tag)
                del self.stack[i:]
                return
            if node.tag in SPECIAL and node.ns == "html":
                return

    # -- structure around the body
    def ensure_html(self, attrs: dict[str, str] | None = None) -> None:
        if not self.stack:
            node = self.made("html", attrs or {})
            self.document.append(node)
            self.stack = [node]
        elif attrs:
            for k, v in attrs.items():
                self.stack[0].attrs.setdefault(k, v)

    def ensure_head(self) -> None:
        self.ensure_html()
        if self.head is None:
            self.head = self.made("head", {})
            self.stack[0].append(self.head)
            self.stack = [self.stack[0], self.head]

    def ensure_body(self, attrs: dict[str, str] | None = None) -> None:
        if self.body is None:
            self.ensure_head()
            self.stack = self.stack[:1]
            self.body = self.insert("body", attrs or {})
        elif attrs:
            for k, v in attrs.items():
                self.body.attrs.setdefault(k, v)

    # -- tags
    def characters(self, data: str) -> None:
        if self.body is None and not any(x.tag in ("template", "noscript") for x in self.stack):
            rest = data.lstrip(_SPACES)
            if self.head is not None and data != rest and self.head in self.stack:
                self.text(data[: len(data) - len(rest)])
            if not rest:
                return
            self.ensure_body()
            data = rest
        node = self.current
        if node.tag in ("table", "tbody", "tfoot", "thead", "tr", "colgroup") and node.ns == "html":
            if data.strip(_SPACES):
                self.foster = True
                self.reconstruct()
                self.text(data)
                self.foster = False
            else:
                self.text(data)
            return
        if node.ns == "html" and data.strip(_SPACES):
            self.reconstruct()
        self.text(data)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if self.stack and self.current.ns != "html" and not self.leaves_foreign(tag, attrs):
            self.insert(tag, attrs, self.current.ns, push=not closed)
            return
        if tag == "html":
            self.ensure_html(attrs)
            return
        if tag == "head":
            self.ensure_head()
            return
        if self.body is None:
            inside = any(x.tag in ("template", "noscript") for x in self.stack)
            if not inside and (tag in HEAD_ONLY or tag == "noscript"):
                self.ensure_head()
                if self.head not in self.stack:
                    self.stack.append(self.head)
                self.insert(tag, attrs, push=tag not in VOID)
                return
            if not inside:
                if tag == "frameset":
                    return
                self.ensure_body(attrs if tag == "body" else None)
                if tag == "body":
                    return
            elif tag == "body":
                return
        elif tag == "body":
            self.ensure_body(attrs)
            return
        self.in_body(tag, attrs, closed)

    def leaves_foreign(self, tag: str, attrs: dict[str, str]) -> bool:
        node = self.current
        if node.ns == "svg" and node.tag in ("foreignobject", "desc", "title") or node.ns == "math" and node.tag in ("mi", "mo", "mn", "ms", "mtext") and tag not in ("mglyph", "malignmark"):
            return True
        if node.tag == "annotation-xml" and node.get("encoding").lower() in ("text/html", "application/xhtml+xml"):
            return True
        if tag in CLOSES_P | HEADINGS or tag in ("b", "big", "body", "br", "code", "dd", "dt", "em", "embed", "head", "i", "img", "li", "meta", "nobr", "ruby", "s", "small", "span", "strong", "strike", "sub", "sup", "tt", "u", "var"):
            if node.ns == "svg" and tag in ("a", "title") or node.ns == "math" and tag in ("menu",) and False:
                return False
            while self.stack and self.current.ns != "html" and self.current.tag != "foreignobject":
                self.stack.pop()
            return True
        return False

    def table_context(self) -> str:
        """The innermost part of a table that is open: table, section, row, caption or cell; empty outside."""
        if self.seen.isdisjoint(TABLE_PARTS):
            return ""
        for node in reversed(self.stack):
            if node.ns != "html":
                continue
            if node.tag in ("td", "th"):
                return "cell"
            if node.tag in ("tr", "caption", "table", "template", "colgroup"):
                return {"template": ""}.get(node.tag, node.tag)
            if node.tag in ("tbody", "thead", "tfoot"):
                return "section"
        return ""

    def clear_to(self, *tags: str) -> None:
        while self.current.tag not in tags and self.current.tag not in ("html", "template"):
            self.stack.pop()

    def in_body(self, tag: str, attrs: dict[str, str], closed: bool = False) -> None:
        context = self.table_context()
        in_table = context in ("table", "section", "tr", "colgroup") and self.current.tag in ("table", "tbody", "thead", "tfoot", "tr", "colgroup")
        if tag in ("caption", "colgroup", "col", "tbody", "thead", "tfoot", "tr", "td", "th"):
            self.table_part(tag, attrs, context)
            return
        if in_table:
            if self.current.tag == "colgroup":
                self.stack.pop()
            if tag == "table":
                self.end("table")
                self.in_body(tag, attrs)
                return
            if tag in ("style", "script", "template"):
                self.insert(tag, attrs)
                return
            if tag == "input" and attrs.get("type", "").lower() == "hidden":
                self.insert(tag, attrs, push=False)
                return
            if tag == "form":
                return
            self.foster = True
            self.flow(tag, attrs, closed)
            self.foster = False
            return
        self.flow(tag, attrs, closed)

    def table_part(self, tag: str, attrs: dict[str, str], context: str) -> None:
        if not context:
            if any(x.tag == "template" for x in self.stack):
                self.insert(tag, attrs, push=tag != "col")
            return
        if context in ("cell", "caption"):
            if context == "caption":
                self.end("caption")
            else:
                self.close_cell()
            self.table_part(tag, attrs, self.table_context())
            return
        if context == "colgroup" and tag != "col":
            self.clear_to("colgroup")
            self.stack.pop()
            context = "table"
        if tag in ("td", "th"):
            if context == "table":
                self.clear_to("table")
                self.insert("tbody", {})
                context = "section"
            if context == "section":
                self.clear_to("tbody", "thead", "tfoot")
                self.insert("tr", {})
            self.clear_to("tr")
            self.insert(tag, attrs)
            self.active.append(None)
        elif tag == "tr":
            if context == "tr":
                self.clear_to("tr")
                self.stack.pop()
            if self.table_context() == "table":
                self.clear_to("table")
                self.insert("tbody", {})
            self.clear_to("tbody", "thead", "tfoot")
            self.insert(tag, attrs)
        else:
            if context == "tr":
                self.clear_to("tr")
                self.stack.pop()
            if self.table_context() == "section":
                self.clear_to("tbody", "thead", "tfoot")
                self.stack.pop()
            self.clear_to("table")
            if tag == "col":
                if self.table_context() != "colgroup":
                    self.insert("colgroup", {})
                self.insert("col", attrs, push=False)
                return
            self.insert(tag, attrs)
            if tag == "caption":
                self.active.append(None)

    def close_cell(self) -> None:
        self.implied()
        self.pop_to("td", "th")
        self.clear_active()

    def flow(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if any(x.tag == "select" for x in self.stack[-3:]) and tag not in ("script", "template"):
            if tag == "option":
                if self.current.tag == "option":
                    self.stack.pop()
                self.insert(tag, attrs)
                return
            if tag == "optgroup":
                self.implied()
                self.insert(tag, attrs)
                return
            if tag == "select":
                self.end("select")
                return
            if tag in ("input", "keygen", "textarea"):
                self.end("select")
            else:
                return
        if tag in CLOSES_P:
            if tag == "form" and self.form is not None and not any(x.tag == "template" for x in self.stack):
                return
            self.close_p()
            if tag in HEADINGS and self.current.tag in HEADINGS:
                self.stack.pop()
            node = self.insert(tag, attrs, push=tag != "hr")
            if tag == "form":
                self.form = node
            return
        if tag in ("li", "dd", "dt"):
            closes = ("li",) if tag == "li" else ("dd", "dt")
            for node in reversed(self.stack):
                if node.tag in closes:
                    self.implied(node.tag)
                    self.pop_to(node.tag)
                    break
                if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                    break
            self.close_p()
            self.insert(tag, attrs)
            return
        if tag == "button":
            if self.in_scope("button"):
                self.implied()
                self.pop_to("button")
            self.reconstruct()
            self.insert(tag, attrs)
            return
        if tag in FORMATTING:
            if tag == "a":
                for x in reversed(self.active):
                    if x is None:
                        break
                    if x.tag == "a":
                        self.adopt("a")
                        self.active = [y for y in self.active if y is not x]
                        self.stack = [y for y in self.stack if y is not x]
                        break
            if tag == "nobr" and self.in_scope("nobr"):
                self.adopt("nobr")
            self.reconstruct()
            self.activate(self.insert(tag, attrs))
            return
        if tag in ("applet", "marquee", "object"):
            self.reconstruct()
            self.insert(tag, attrs)
            self.active.append(None)
            return
        if tag in ("rb", "rtc", "rp", "rt"):
            if self.in_scope("ruby"):
                self.implied("rtc" if tag in ("rp", "rt") else "")
            self.insert(tag, attrs)
            return
        if tag in ("option", "optgroup"):
            if self.current.tag == "option":
                self.stack.pop()
            self.reconstruct()
            self.insert(tag, attrs)
            return
        if tag in ("svg", "math"):
            self.reconstruct()
            self.insert(tag, attrs, tag, push=not closed)
            return
        if tag == "image":
            tag = "img"
        if tag in VOID:
            if tag not in ("base", "link", "meta", "param", "source", "track", "col"):
                self.reconstruct()
            self.insert(tag, attrs, push=False)
            return
        if tag == "frame" or tag == "frameset":
            return
        if tag not in RAW and tag not in ESCAPABLE and tag not in ("template", "noscript"):
            self.reconstruct()
        node = self.insert(tag, attrs)
        if tag == "template":
            self.active.append(None)
        del node

    def end(self, tag: str) -> None:
        if not self.stack:
            if tag in ("html", "body", "br", "head"):
                self.ensure_body()
            return
        if self.current.ns != "html":
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].ns == "html":
                    break
                if self.stack[i].tag == tag:
                    del self.stack[i:]
                    return
            if not any(x.tag == tag and x.ns == "html" for x in self.stack):
                return
        if tag == "br":
            self.start("br", {}, False)
            return
        if tag == "p":
            if not self.in_scope("p", barrier=SCOPE | {"button"}):
                self.ensure_body()
                self.insert("p", {})
            self.implied("p")
            self.pop_to("p")
            return
        if self.body is None:
            if tag == "head" and self.head in self.stack:
                self.stack = self.stack[:1]
            elif tag in ("body", "html"):
                self.ensure_body()
            elif any(x.tag == tag for x in self.stack[1:]):
                self.pop_to(tag)
                if tag == "template":
                    self.clear_active()
            return
        if tag in ("html", "body", "head"):
            return  # what follows still belongs to the body
        if tag in ("td", "th"):
            if self.in_scope(tag, barrier=frozenset(("table", "html", "template"))):
                self.implied()
                self.pop_to(tag)
                self.clear_active()
            return
        if tag in ("table", "tbody", "thead", "tfoot", "tr", "caption"):
            if self.in_scope(tag, barrier=frozenset(("html", "template") + (("table",) if tag != "table" else ()))):
                if tag in ("table", "tbody", "thead", "tfoot", "tr") and any(x.tag in ("td", "th") for x in self.stack[self.last(tag) :]):
                    self.close_cell()
                self.implied()
                self.pop_to(tag)
                if tag == "caption":
                    self.clear_active()
            return
        if tag == "form":
            self.form = None
        if tag == "template":
            if any(x.tag == "template" for x in self.stack):
                self.pop_to("template")
                self.clear_active()
            return
        if tag in HEADINGS:
            if self.in_scope(*HEADINGS):
                self.implied()
                self.pop_to(*HEADINGS)
            return
        if tag == "li":
            if self.in_scope("li", barrier=SCOPE | {"ol", "ul"}):
                self.implied("li")
                self.pop_to("li")
            return
        if tag in ("dd", "dt") or tag in CLOSES_P or tag == "button" or tag in ("applet", "marquee", "object"):
            if self.in_scope(tag):
                self.implied(tag)
                self.pop_to(tag)
                if tag in ("applet", "marquee", "object"):
                    self.clear_active()
            return
        if tag in FORMATTING:
            self.adopt(tag)
            return
        self.other_end(tag)

    def last(self, tag: str) -> int:
        return max(i for i, x in enumerate(self.stack) if x.tag == tag)

    # -- tokens
    def feed(self, source: str) -> Node:
        self.over("input_bytes", len(source.encode("utf-8", "surrogatepass")) if self.budget.input_bytes else 0)
        source = source.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "�")
        at, n = 0, len(source)
        if source[:1] == "﻿":
            at = 1
        skip_newline = False
        while at < n:
            lt = source.find("<", at)
            if lt != at:
                data = source[at : lt if lt >= 0 else n]
                if skip_newline and data[0] == "\n":
                    data = data[1:]
                skip_newline = False
                if data:
                    self.characters(html.unescape(data) if "&" in data else data)
                if lt < 0:
                    break
                at = lt
            skip_newline = False
            nxt = source[at + 1 : at + 2]
            if nxt == "!":
                if source.startswith("<!--", at):
                    end = re.compile(r"--!?>|\Z").search(source, at + (2 if source[at + 4 : at + 5] == ">" else 4))
                    if source.startswith(("<!--$", "<!--/$"), at) and self.stack:  # bounds of streamed parts; other comments say nothing
                        self.comment(source[at + 4 : end.start()])
                    at = end.end()
                elif source.startswith("<![CDATA[", at) and self.stack and self.current.ns != "html":
                    end = source.find("]]>", at)
                    self.text(source[at + 9 : end if end >= 0 else n])
                    at = end + 3 if end >= 0 else n
                else:
                    end = source.find(">", at)
                    at = end + 1 if end >= 0 else n
                continue
            if nxt == "?":
                end = source.find(">", at)
                at = end + 1 if end >= 0 else n
                continue
            if nxt == "/":
                m = _TAG_NAME.match(source, at + 2)
                if m:
                    end = self.tag_end(source, m.end())
                    if end < 0:
                        break
                    self.end(m[0].lower())
                    at = end
                elif source[at + 2 : at + 3] == ">":
                    at += 3
                else:
                    end = source.find(">", at)
                    at = end + 1 if end >= 0 else n
                continue
            m = _TAG_NAME.match(source, at + 1)
            if not m:
                self.characters("<")
                at += 1
                continue
            tag, attrs, closed, at = self.read_tag(source, m)
            if at < 0:
                break
            self.start(tag, attrs, closed)
            if self.stack and self.current.ns == "html" and self.current.tag == tag and (tag in RAW or tag in ESCAPABLE):
                end = self.raw_end(source, at, tag)
                data = source[at:end]
                if tag == "textarea" and data[:1] == "\n":
                    data = data[1:]
                self.text(html.unescape(data) if tag in ESCAPABLE and "&" in data else data)
                self.stack.pop()
                close = source.find(">", end)
                at = close + 1 if close >= 0 else n
            elif tag in ("pre", "listing"):
                skip_newline = True
            elif tag == "plaintext":
                self.text(source[at:])
                break
        self.ensure_body()
        return self.document

    @staticmethod
    def raw_end(source: str, at: int, tag: str) -> int:
        pattern = re.compile(rf"</{tag}(?=[\s/>])", re.I)
        found = pattern.search(source, at)
        if tag == "script" and found:
            open_comment = source.find("<!--", at, found.start())
            if open_comment >= 0 and source.find("-->", open_comment, found.start()) < 0 and re.search(r"<script[\s/>]", source[open_comment : found.start()], re.I):
                found = pattern.search(source, found.end()) or found
        return found.start() if found else len(source)

    @staticmethod
    def tag_end(source: str, at: int) -> int:
        end = source.find(">", at)
        return end + 1 if end >= 0 else -1

    @staticmethod
    def read_tag(source: str, m: re.Match) -> tuple[str, dict[str, str], bool, int]:
        at, attrs, n = m.end(), {}, len(source)
        while True:
            while at < n and source[at] in " \t\n\f/":
                at += 1
            if at >= n:
                return "", {}, False, -1
            if source[at] == ">":
                return m[0].lower(), attrs, source[at - 1] == "/", at + 1
            a = _ATTR.match(source, at)
            name = a[1].lower()
            value = a[2] if a[2] is not None else a[3] if a[3] is not None else a[4]
            if a.end() == at:
                at += 1
                continue
            at = a.end()
            if name and name not in attrs:
                attrs[name] = _attribute_text(value) if value is not None else ""


def parse(source: str, budget: Budget | None = None) -> Node:
    """The document of an HTML text. Raises ``LimitError`` beyond the budget."""
    return Parser(budget).feed(source)


def parse_fragment(source: str, budget: Budget | None = None) -> list[Node]:
    """The nodes of a text parsed as the inside of a body."""
    document = parse(f"<!doctype html><body>{source}", budget)
    body = document.first("body")
    nodes = list(body.children)
    for x in nodes:
        x.detach()
    return nodes
