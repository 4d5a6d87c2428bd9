"""Cleaned trees to semantic blocks: what a page says, without how it was marked up."""

from __future__ import annotations

import re
from collections.abc import Iterator

from webdistill.functions import text as T
from webdistill.functions.dom import Node
from webdistill.functions.lists import ordered_markers, role_items

BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul iframe video audio html menu hgroup search".split()
)
CALLOUTS = ("note", "warning", "tip", "important", "caution", "info")
_LANGUAGE = re.compile(r"(?:^|\s)(?:language-|lang-|highlight-source-|brush:\s*)([\w+#.\-]+)")
#: Players of videos that are kept. Own choice.
VIDEO = re.compile(r"//(?:www\.)?(?:youtube(?:-nocookie)?\.com/embed/|player\.vimeo\.com/video/|dailymotion\.com/embed/|player\.twitch\.tv)", re.I)
_ORDERED = re.compile(r"^\s*(\d+)[.)]\s+")


class Block:
    """One operation with its payload and what lies inside."""

    __slots__ = ("op", "attrs", "inside")

    def __init__(self, op: str, inside: list[Block] | None = None, **attrs):
        self.op, self.inside, self.attrs = op, inside if inside is not None else [], attrs

    def __repr__(self) -> str:
        return f"{self.op}{self.attrs or ''}{self.inside or ''}"

    def walk(self) -> Iterator[Block]:
        yield self
        for x in self.inside:
            yield from x.walk()


INLINE = frozenset(("Text", "Emphasis", "Strong", "Strikethrough", "InlineCode", "Link", "Image", "HardBreak", "FootnoteReference", "TaskMarker", "InlineMath"))
_FORMATS = {"b": "Strong", "strong": "Strong", "em": "Emphasis", "i": "Emphasis", "del": "Strikethrough", "s": "Strikethrough", "strike": "Strikethrough"}
_INLINE_CODE = ("code", "kbd", "samp", "tt")


def inline_text(blocks: list[Block]) -> str:
    out = []
    for b in blocks:
        if b.op in ("Text", "InlineCode", "InlineMath"):
            out.append(b.attrs["text"])
        elif b.op == "HardBreak":
            out.append("\n")
        elif b.op not in ("Image", "FootnoteReference", "TaskMarker"):
            out.append(inline_text(b.inside))
    return "".join(out)


class Compiler:
    def __init__(self, base: str | None):
        self.base = base
        self.notes: dict[str, str] = {}  # fragment -> label
        self.definitions: list[Block] = []
        self.flattened = 0  # tables that only lay out

    # -- inline content
    def inline(self, nodes: list[Node], under: frozenset[str] = frozenset()) -> list[Block]:
        out: list[Block] = []
        for node in nodes:
            out += self.one_inline(node, under)
        return out

    def one_inline(self, node: Node, under: frozenset[str]) -> list[Block]:
        tag = node.tag
        if tag == "#text":
            return [Block("Text", text=T.collapse(node.text))] if node.text else []
        if tag[0] == "#":
            return []
        if tag == "br":
            return [Block("HardBreak")]
        if tag == "img":
            found = self.image(node)
            return [found] if found else []
        if tag == "input":
            return [Block("TaskMarker", checked="checked" in node.attrs)] if node.get("type").lower() == "checkbox" else []
        if tag in _INLINE_CODE:
            return [Block("InlineCode", text=T.squeeze(node.raw_text()))] if T.squeeze(node.raw_text()) else []
        if tag == "math" or node.get("data-latex") or "math-tex" in node.tokens("class"):
            return [self.math(node)]
        if tag == "a":
            inside = self.inline(node.children, under | {"Link"})
            href = T.resolve(self.base, node.get("href"))
            fragment = node.get("href")[1:] if node.get("href").startswith("#") else ""
            if fragment in self.notes:
                return [Block("FootnoteReference", label=self.notes[fragment])]
            if href is None or "Link" in under or not (inline_text(inside).strip() or any(b.op == "Image" for x in inside for b in x.walk())):
                return inside
            return [Block("Link", inside, href=href, title=node.get("title") or None, fragment_only=node.get("href").strip().startswith("#"))]
        op = _FORMATS.get(tag)
        if op and op not in under:
            inside = self.inline(node.children, under | {op})
            return [Block(op, inside)] if inline_text(inside).strip() or any(b.op == "Image" for x in inside for b in x.walk()) else inside
        if tag == "sup" and len(refs := self.inline(node.children, under)) == 1:
            return refs
        return self.inline(node.children, under)

    def math(self, node: Node) -> Block:
        note = next((x for x in node.walk() if x.tag == "annotation" and "tex" in x.get("encoding").lower()), None)
        source = T.squeeze(node.get("data-latex") or (note.raw_text() if note is not None else "") or node.get("alttext") or tex_of(node))
        display = node.get("display") == "block" or node.tag in ("div", "p") or node.get("mode") == "display"
        return Block("DisplayMath" if display else "InlineMath", text=source)

    def image(self, node: Node) -> Block | None:
        best, width = "", -1.0
        for part in (node.get("srcset") or node.get("data-srcset")).split(", "):
            pieces = part.strip().rstrip(",").split()
            if pieces:
                size = float(pieces[1][:-1]) if len(pieces) > 1 and re.fullmatch(r"\d+(\.\d+)?[wx]", pieces[1]) else 1.0
                if size > width and T.resolve(self.base, pieces[0], ("http", "https")):
                    best, width = pieces[0], size
        for name in ("src", "data-src", "data-original", "data-lazy-src", "data-url"):
            if not best and node.get(name) and not node.get(name).startswith("data:"):
                best = node.get(name)
        source = T.resolve(self.base, best, ("http", "https")) if best else None
        alt = T.squeeze(node.get("alt"))
        if source is None:
            return Block("Text", text=alt) if alt else None
        return Block("Image", src=source, alt=alt, title=node.get("title") or None, width=_number(node.get("width")), height=_number(node.get("height")))

    # -- blocks
    def blocks(self, nodes: list[Node]) -> list[Block]:
        out: list[Block] = []
        run: list[Node] = []

        def flush() -> None:
            inside = tidy(self.inline(run))
            run.clear()
            if inside:
                out.append(Block("Paragraph", inside))

        for node in nodes:
            if node.tag == "#comment":
                continue
            if node.tag in BLOCK_TAGS or node.tag[0] != "#" and any(x.tag in BLOCK_TAGS for x in node.walk()):
                flush()
                out += self.block(node)
            else:
                run.append(node)
        flush()
        return out

    def block(self, node: Node) -> list[Block]:
        tag, cls = node.tag, node.get("class").lower()
        if re.fullmatch("h[1-6]", tag) or node.get("role") == "heading":
            level = int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else min(6, max(1, _number(node.get("aria-level")) or 2))
            if any(x.tag in BLOCK_TAGS for x in node.elements()):
                return self.blocks(node.children)
            inside = tidy([b for b in self.inline(node.children) if not (b.op == "Link" and inline_text(b.inside).strip() in ("#", "¶", "§", "🔗"))])
            return [Block("Heading", inside, level=level)] if inline_text(inside).strip() or inside else []
        if tag == "p":
            return self.blocks(node.children)
        if tag == "pre":
            return [self.code(node)] if node.raw_text().strip() else []
        if tag == "blockquote":
            inside = self.blocks(node.children)
            return [Block("BlockQuote", inside)] if inside else []
        if tag in ("ul", "ol", "menu") or "list" in node.tokens("role"):
            return self.list(node)
        if tag == "table":
            return self.table(node)
        if tag == "hr":
            return [Block("ThematicBreak")]
        if tag == "figure":
            caption = next((x for x in node.children if x.tag == "figcaption"), None)
            inside = self.blocks([x for x in node.children if x is not caption])
            if caption is not None and (words := tidy(self.inline(caption.children))):
                inside.append(Block("Figcaption", words))
            return [Block("Figure", inside)] if inside else []
        if tag == "details":
            summary = next((x for x in node.children if x.tag == "summary"), None)
            inside = self.blocks([x for x in node.children if x is not summary])
            head = [Block("Summary", tidy(self.inline(summary.children)))] if summary is not None else []
            return [Block("Details", head + inside)] if head or inside else []
        if tag == "dl":
            inside: list[Block] = []
            for x in [y for c in node.children for y in (c.children if c.tag == "div" else [c])]:
                if x.tag in ("dt", "dd"):
                    inside.append(Block("DefinitionTerm", tidy(self.inline(x.children))) if x.tag == "dt" else Block("DefinitionDescription", self.blocks(x.children)))
            return [Block("DefinitionList", inside)] if inside else []
        if tag in ("iframe", "video", "audio"):
            source = T.resolve(self.base, node.get("src") or next((x.get("src") for x in node.elements("source")), ""), ("http", "https"))
            if source and (tag != "iframe" or VIDEO.search(source)):
                source = re.sub(r"//(?:www\.)?youtube(?:-nocookie)?\.com/embed/([\w\-]+).*", r"//www.youtube.com/watch?v=\1", source)
                return [Block("Media", kind="video" if tag == "iframe" else tag, src=source, title=T.squeeze(node.get("title"))[:200] or None)]
            return []
        if node.get("role") == "note" or re.search(r"\b(admonition|callout|alert)\b", cls):
            kind = next((k for k in CALLOUTS if re.search(rf"\b{k}\b|-{k}\b", cls)), "note")
            title = next((x for x in node.elements() if re.search(r"title", x.get("class"))), None)
            words = T.squeeze(title.raw_text()) if title is not None else None
            inside = self.blocks([x for x in node.children if x is not title])
            return [Block("Callout", inside, kind=kind, title=words)] if inside else []
        if tag == "math" or node.get("data-latex"):
            return [self.math(node)]
        return self.blocks(node.children)

    def code(self, node: Node) -> Block:
        language = None
        for x in [node, *node.elements("code"), *list(node.ancestors())[:2]]:
            found = _LANGUAGE.search(x.get("class")) or _LANGUAGE.search("language-" + x.get("data-lang") if x.get("data-lang") else "")
            language = language or (found[1].lower() if found else x.get("data-language").lower() or None)
        parts = []
        for x in node.walk():
            if x.tag == "#text":
                parts.append(x.text)
            elif x.tag == "br":
                parts.append("\n")
        return Block("CodeBlock", text="".join(parts).strip("\n").rstrip(), language=language)

    def list(self, node: Node) -> list[Block]:
        items, ordered = [], node.tag == "ol"
        start = _number(node.get("start")) if ordered else None
        if node.tag not in ("ul", "ol") and (markers := ordered_markers(role_items(node))):
            ordered, start = True, markers[0][0]  # numbers that the texts show become the list's own
            for _, text, rest in markers:
                text.text = rest
        for x in node.children:
            if x.tag == "li" or "listitem" in x.tokens("role"):
                inside = self.blocks(x.children)
                marker = next((b for p in inside[:1] for b in p.inside if b.op == "TaskMarker"), None)
                if marker is not None:
                    inside[0].inside = tidy([b for b in inside[0].inside if b is not marker])
                if inside:
                    items.append(Block("ListItem", inside, checked=marker.attrs["checked"] if marker else None))
            elif x.tag in ("ul", "ol") and items:
                items[-1].inside += self.list(x)
            elif x.tag[0] != "#" and x.tag not in ("script", "style"):
                inside = self.blocks([x])
                if inside:
                    items.append(Block("ListItem", inside, checked=None))
        return [Block("List", items, ordered=ordered, start=1 if start is None else start)] if items else []

    def table(self, node: Node) -> list[Block]:
        rows: list[list[Node]] = []
        for x in node.elements("tr"):
            if next((a for a in x.ancestors() if a.tag == "table"), None) is node:
                rows.append([c for c in x.children if c.tag in ("td", "th")])
        rows = [r for r in rows if any(T.squeeze(c.raw_text()) or c.elements("img") for c in r)]
        if not rows:
            return self.blocks([x for x in node.children if x.tag == "caption"])
        cells = [c for r in rows for c in r]
        declared = any(c.tag == "th" for c in cells) or any(x.tag in ("caption", "thead", "col") for x in node.children) or node.get("summary") or node.get("role") in ("table", "grid")
        layout = node.get("role") in ("presentation", "none") or node.get("datatable") == "0" or node.elements("table")
        if layout or not declared and (len(rows) == 1 or max(map(len, rows)) == 1):
            self.flattened += 1
            return [b for c in cells for b in self.blocks(c.children)]
        if (listing := self.listing(rows)) is not None:
            return listing
        out: list[Block] = []
        caption = next((x for x in node.children if x.tag == "caption"), None)
        if caption is not None and (words := tidy(self.inline(caption.children))):
            out.append(Block("TableCaption", words))
        for r in rows:
            made = []
            for c in r:
                align = re.search(r"text-align:\s*(left|center|right)", c.get("style")) or re.fullmatch(r"(left|center|right)", c.get("align").lower())
                made.append(Block("TableCell", self.blocks(c.children), header=c.tag == "th", colspan=_number(c.get("colspan")) or 1, rowspan=_number(c.get("rowspan")) or 1, align=align[1] if align else None))
            out.append(Block("TableRow", made))
        return [Block("Table", out)]

    def listing(self, rows: list[list[Node]]) -> list[Block] | None:
        """A ranked list laid out as a table (rows that count up, linked, with rows about them between) as an ordered list."""
        if len(rows) < 6:
            return None
        ranks = [int(m[1]) if r and (m := re.fullmatch(r"\s*(\d+)[.)]?\s*", r[0].raw_text())) and any(c.elements("a") for c in r) else None for r in rows]
        own = [x for x in ranks if x is not None]
        if len(own) < 3 or own != list(range(own[0], own[0] + len(own))) or 4 * len(own) < len(rows) or len(rows) - len(own) < len(own) - 1:
            return None
        items, rest = [], []
        for r, k in zip(rows, ranks, strict=True):
            inside = tidy([b for c in (r[1:] if k is not None else r) for b in [*self.inline(c.children), Block("Text", text=" ")]])
            if not inside:
                continue
            if k is not None:
                items.append(Block("ListItem", [Block("Paragraph", inside)], checked=None))
            elif items and len(items[-1].inside[0].inside) and not any(b.op == "HardBreak" for b in items[-1].inside[0].inside):
                items[-1].inside[0].inside += [Block("HardBreak"), *inside]
            else:
                rest.append(Block("Paragraph", inside))
        return [Block("List", items, ordered=True, start=own[0]), *rest]

    def collect_notes(self, root: Node) -> None:
        """Footnote definitions that a reference points to, taken out of the tree."""
        wanted = {a.get("href")[1:] for a in root.elements("a") if a.get("href").startswith("#")}
        for node in root.elements("li", "p", "div", "aside"):
            name = node.get("id")
            if name in wanted and re.match(r"(fn|footnote|cite_note|note)[-_:]?\w", name, re.I) and node.get("role") != "doc-backlink":
                self.notes[name] = str(len(self.notes) + 1)
        for node in [x for x in root.elements() if x.get("id") in self.notes]:
            for a in node.elements("a"):
                if a.get("role") == "doc-backlink" or "backref" in a.get("class") or T.squeeze(a.raw_text()) in ("↩", "↩︎", "^", "↑", "⏎"):
                    a.detach()
            label = self.notes[node.get("id")]
            inside = Compiler(self.base).blocks(node.children)
            parent = node.parent
            node.detach()
            while parent is not None and parent is not root and not T.squeeze(parent.raw_text()) and not parent.elements("img"):
                parent.detach() if (up := parent.parent) is not None else None
                parent = up
            self.definitions.append(Block("FootnoteDefinition", inside, label=label))


def tex_of(node: Node) -> str:
    """MathML as TeX; what has no rule here is put one after the other."""
    if node.tag == "#text":
        return T.squeeze(node.text)
    inside = [x for x in node.children if x.tag[0] != "#" or x.tag == "#text" and x.text.strip()]
    part = [tex_of(x) for x in inside if x.tag not in ("annotation", "annotation-xml")]
    tag = node.tag
    if tag == "mtext":
        return f"\\text{{{''.join(part)}}}"
    if tag in ("msup", "msub", "mover", "munder") and len(part) == 2:
        return f"{part[0]}{'^' if tag in ('msup', 'mover') else '_'}{{{part[1]}}}"
    if tag in ("msubsup", "munderover") and len(part) == 3:
        return f"{part[0]}_{{{part[1]}}}^{{{part[2]}}}"
    if tag == "mfrac" and len(part) == 2:
        return f"\\frac{{{part[0]}}}{{{part[1]}}}"
    if tag == "mroot" and len(part) == 2:
        return f"\\sqrt[{part[1]}]{{{part[0]}}}"
    if tag == "msqrt":
        return f"\\sqrt{{{''.join(part)}}}"
    if tag == "mfenced":
        return f"{node.get('open') or '('}{(node.get('separators') or ',')[0].join(part)}{node.get('close') or ')'}"
    if tag == "mtable":
        return "\\begin{aligned}" + " \\\\ ".join(part) + "\\end{aligned}"
    if tag == "mtr":
        return " & ".join(part)
    return "".join(part)


def _number(value: str) -> int | None:
    found = re.match(r"\s*(-?\d+)", value or "")
    return int(found[1]) if found else None


def tidy(blocks: list[Block]) -> list[Block]:
    """Join texts, leave one space at each seam and none at the ends, drop breaks at the ends."""
    state = {"space": True}
    last: list[Block] = []

    def visit(found: list[Block]) -> list[Block]:
        out: list[Block] = []
        for b in found:
            if b.op == "Text":
                value = T.collapse(b.attrs["text"])
                if state["space"]:
                    value = value.lstrip(" ")
                if not value:
                    continue
                state["space"] = value.endswith(" ")
                if out and out[-1].op == "Text":
                    out[-1].attrs["text"] += value
                else:
                    out.append(Block("Text", text=value))
                last[:] = [out[-1]]
            elif b.op == "HardBreak":
                if last and last[0].op == "Text":
                    last[0].attrs["text"] = last[0].attrs["text"].rstrip(" ")
                state["space"] = True
                out.append(b)
            else:
                if b.inside:
                    b.inside = visit(b.inside)
                    if not b.inside:
                        continue
                else:
                    state["space"] = False
                    last[:] = [b]
                out.append(b)
        return out

    out = visit(blocks)
    while out and out[-1].op == "HardBreak":
        out.pop()
    while out and out[0].op == "HardBreak":
        out.pop(0)
    tail = out
    while tail:
        b = tail[-1]
        if b.op == "HardBreak":
            tail.pop()
            continue
        if b.op == "Text":
            b.attrs["text"] = b.attrs["text"].rstrip(" ")
            if not b.attrs["text"]:
                tail.pop()
                continue
        if b.op in ("Text", "Image") or not b.inside:
            break
        tail = b.inside
    return out


def compile_content(root: Node, base: str | None) -> list[Block]:
    """The blocks of a cleaned root; footnotes come last."""
    return compile_counted(root, base)[0]


def compile_counted(root: Node, base: str | None) -> tuple[list[Block], int]:
    """``compile_content``, and the number of tables that were taken for layout."""
    c = Compiler(base)
    c.collect_notes(root)
    blocks = c.blocks(root.children if root.tag not in ("pre", "table", "ul", "ol", "dl", "figure", "blockquote") else [root]) + c.definitions
    return blocks, c.flattened


def tape(blocks: list[Block]) -> list[dict]:
    """Blocks as one flat array of opening and closing operations, leaves once; each knows the item and the list around it, and whether a figure is."""
    out: list[dict] = []
    stack: list[tuple[Block, bool, int | None, int | None, bool]] = [(b, False, None, None, False) for b in reversed(blocks)]
    while stack:
        b, closing, item, within, figure = stack.pop()
        around = {"item_ord": item, "list_ord": within, "in_figure": figure}
        if closing:
            out.append({"op": b.op, "close": True, "leaf": False, **around})
            continue
        at = len(out)
        if b.op == "ListItem":
            item = around["item_ord"] = at
        out.append({"op": b.op, "close": False, "leaf": not b.inside, **around, **{k: v for k, v in b.attrs.items() if v is not None}})
        if b.inside:
            stack.append((b, True, item, within, figure))
            within, item = (at, None) if b.op == "List" else (within, item)
            figure = figure or b.op == "Figure"
            stack.extend((x, False, item, within, figure) for x in reversed(b.inside))
    return out
