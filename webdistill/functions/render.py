"""Blocks as Markdown, canonical HTML and plain text, and their metrics."""

from __future__ import annotations

import html
import re

from webdistill.functions import text as T
from webdistill.functions.compile import INLINE, Block, inline_text

_ALWAYS = re.compile(r"([\\`*_\[\]<>|])")
_START = re.compile(r"^(#{1,6}(?=\s|$)|[+\-](?=\s|$)|=+\s*$|~{3,}|\d+[.)](?=\s|$))")


class Markdown:
    def __init__(self, links: bool = True, images: bool = True, width: int = 0):
        self.links, self.images, self.width = links, images, width

    def escape(self, value: str) -> str:
        return _ALWAYS.sub(r"\\\1", value)

    def inline(self, blocks: list[Block]) -> str:
        out = []
        for b in blocks:
            a = b.attrs
            if b.op == "Text":
                out.append(self.escape(a["text"]))
            elif b.op in ("Strong", "Emphasis", "Strikethrough"):
                mark = {"Strong": "**", "Emphasis": "*", "Strikethrough": "~~"}[b.op]
                inside = self.inline(b.inside)
                lead, tail = inside[: len(inside) - len(inside.lstrip())], inside[len(inside.rstrip()) :]
                out.append(f"{lead}{mark}{inside.strip()}{mark}{tail}" if inside.strip() else inside)
            elif b.op == "InlineCode":
                fence = "`" * (max([0, *map(len, re.findall("`+", a["text"]))]) + 1)
                pad = " " if a["text"][:1] == "`" or a["text"][-1:] == "`" else ""
                out.append(f"{fence}{pad}{a['text']}{pad}{fence}")
            elif b.op == "Link":
                inside = self.inline(b.inside)
                out.append(f"[{inside}]({self.target(a['href'], a.get('title'))})" if self.links else inside)
            elif b.op == "Image":
                if self.images:
                    out.append(f"![{self.escape(a['alt'])}]({self.target(a['src'], a.get('title'))})")
            elif b.op == "HardBreak":
                out.append("  \n")
            elif b.op == "FootnoteReference":
                out.append(f"[^{a['label']}]")
            elif b.op == "InlineMath":
                out.append("$" + html.escape(a["text"], quote=False).replace("$", "\\$") + "$")
            elif b.op == "TaskMarker":
                out.append("[x] " if a["checked"] else "[ ] ")
            else:
                out.append(self.inline(b.inside))
        return "".join(out)

    @staticmethod
    def target(href: str, title: str | None) -> str:
        href = re.sub(r"[ <>\n]", lambda m: f"%{ord(m[0]):02X}", href).replace("(", "\\(").replace(")", "\\)")
        return f'{href} "{title.replace(chr(34), chr(92) + chr(34))}"' if title else href

    def paragraph(self, blocks: list[Block]) -> str:
        value = "\n".join(_START.sub(lambda m: "\\" + m[0] if not m[0][0].isdigit() else m[0][:-1] + "\\" + m[0][-1], x) for x in self.inline(blocks).split("\n"))
        return self.wrap(value) if self.width else value

    def wrap(self, value: str) -> str:
        out = []
        for line in value.split("\n"):
            row = ""
            for word in re.findall(r"!?\[(?:[^\]\\]|\\.)*\]\([^)]*\)\S*|`+[^`]*`+\S*|\S+", line):
                if row and len(row) + 1 + len(word) > self.width:
                    out.append(row)
                    row = word
                else:
                    row = f"{row} {word}" if row else word
            out.append(row + ("  " if line.endswith("  ") else ""))
        return "\n".join(out)

    def blocks(self, blocks: list[Block]) -> str:
        return "\n\n".join(x for x in map(self.block, blocks) if x)

    def block(self, b: Block) -> str:
        a = b.attrs
        if b.op == "Heading":
            return f"{'#' * a['level']} {self.inline(b.inside)}".replace("\n", " ")
        if b.op in ("Paragraph", "Figcaption", "DefinitionTerm", "TableCaption", "Summary"):
            return self.paragraph(b.inside)
        if b.op == "CodeBlock":
            fence = "`" * max(3, max([0, *map(len, re.findall("`+", a["text"]))]) + 1)
            return f"{fence}{a.get('language') or ''}\n{a['text']}\n{fence}"
        if b.op in ("BlockQuote", "Callout"):
            inside = self.blocks(b.inside)
            if b.op == "Callout" and a.get("title"):
                inside = f"**{self.escape(a['title'])}**\n\n{inside}"
            return "\n".join(f"> {x}".rstrip() for x in inside.split("\n"))
        if b.op == "List":
            out = []
            for i, item in enumerate(b.inside):
                mark = f"{a['start'] if i == 0 else 1}. " if a["ordered"] else "- "
                task = "" if item.attrs.get("checked") is None else "[x] " if item.attrs["checked"] else "[ ] "
                tight = all(x.op in ("Paragraph", "List") for x in item.inside) and sum(x.op == "Paragraph" for x in item.inside) <= 1
                inside = ("\n" if tight else "\n\n").join(map(self.block, item.inside))
                pad = " " * (len(mark))
                out.append(mark + task + inside.replace("\n", "\n" + pad).replace("\n" + pad + "\n", "\n\n"))
            return "\n".join(out)
        if b.op == "Table":
            return self.table(b)
        if b.op == "ThematicBreak":
            return "---"
        if b.op == "DefinitionDescription":
            return ": " + self.blocks(b.inside).replace("\n", "\n  ")
        if b.op == "FootnoteDefinition":
            return f"[^{a['label']}]: " + self.blocks(b.inside).replace("\n", "\n    ")
        if b.op == "DisplayMath":
            return "$$\n" + html.escape(a["text"], quote=False) + "\n$$"
        if b.op == "Media":
            return f"[{self.escape(a.get('title') or a['src'])}]({self.target(a['src'], None)})" if self.links else self.escape(a.get("title") or "")
        if b.op in INLINE:
            return self.inline([b])
        return self.blocks(b.inside)

    def table(self, b: Block) -> str:
        caption = "\n\n".join(self.block(x) for x in b.inside if x.op == "TableCaption")
        rows = [x for x in b.inside if x.op == "TableRow"]
        cell = lambda c: " ".join(x.replace("\n", " ") for x in map(self.block, c.inside)).strip()
        if any(c.attrs["colspan"] > 1 or c.attrs["rowspan"] > 1 for r in rows for c in r.inside):
            body = "\n\n".join(x for r in rows for x in [" ".join(filter(None, map(cell, r.inside)))] if x)
        else:
            n = max(len(r.inside) for r in rows)
            line = lambda xs: "| " + " | ".join([*xs, *[""] * (n - len(xs))]) + " |"
            marks = {"left": ":---", "center": ":---:", "right": "---:", None: "---"}
            head = rows[0].inside
            align = [marks[c.attrs.get("align")] for c in head] + ["---"] * (n - len(head))
            body = "\n".join([line(list(map(cell, head))), "| " + " | ".join(align) + " |", *(line(list(map(cell, r.inside))) for r in rows[1:])])
        return f"{caption}\n\n{body}" if caption else body


def markdown(blocks: list[Block], links: bool = True, images: bool = True, width: int = 0) -> str:
    return Markdown(links, images, width).blocks(blocks)


_TAGS = {
    "Paragraph": "p", "BlockQuote": "blockquote", "ListItem": "li", "Table": "table", "TableCaption": "caption", "TableRow": "tr", "Figure": "figure", "Figcaption": "figcaption",
    "Details": "details", "Summary": "summary", "DefinitionList": "dl", "DefinitionTerm": "dt", "DefinitionDescription": "dd", "Emphasis": "em", "Strong": "strong", "Strikethrough": "del",
    "BlockGroup": "div",
}


def canonical_html(blocks: list[Block]) -> str:
    """Fixed tags and the few attributes that carry meaning."""
    out = []
    attr = lambda **k: "".join(f' {n.rstrip("_")}="{html.escape(str(v))}"' for n, v in k.items() if v not in (None, ""))
    for b in blocks:
        a, inside = b.attrs, canonical_html(b.inside)
        if b.op == "Text":
            out.append(html.escape(a["text"], quote=False))
        elif b.op == "Heading":
            out.append(f"<h{a['level']}>{inside}</h{a['level']}>")
        elif b.op == "CodeBlock":
            out.append(f"<pre><code{attr(class_=f'language-{a["language"]}' if a.get('language') else None)}>{html.escape(a['text'], quote=False)}</code></pre>")
        elif b.op == "InlineCode":
            out.append(f"<code>{html.escape(a['text'], quote=False)}</code>")
        elif b.op == "List":
            out.append(f"<ol{attr(start=a['start'] if a['start'] != 1 else None)}>{inside}</ol>" if a["ordered"] else f"<ul>{inside}</ul>")
        elif b.op == "TableCell":
            tag = "th" if a["header"] else "td"
            out.append(f"<{tag}{attr(colspan=a['colspan'] if a['colspan'] > 1 else None, rowspan=a['rowspan'] if a['rowspan'] > 1 else None, align=a.get('align'))}>{inside}</{tag}>")
        elif b.op == "Link":
            out.append(f"<a{attr(href=a['href'], title=a.get('title'))}>{inside}</a>")
        elif b.op == "Image":
            out.append(f"<img{attr(src=a['src'])} alt=\"{html.escape(a['alt'])}\"{attr(title=a.get('title'), width=a.get('width'), height=a.get('height'))}>")
        elif b.op in ("HardBreak", "ThematicBreak"):
            out.append("<br>" if b.op == "HardBreak" else "<hr>")
        elif b.op == "FootnoteReference":
            out.append(f'<sup><a href="#footnote-{a["label"]}">{a["label"]}</a></sup>')
        elif b.op == "FootnoteDefinition":
            out.append(f'<aside id="footnote-{a["label"]}" role="doc-footnote">{inside}</aside>')
        elif b.op == "Callout":
            out.append(f'<aside role="note" class="{a["kind"]}">{inside}</aside>')
        elif b.op in ("InlineMath", "DisplayMath"):
            out.append(f"<code class=\"math\">{html.escape(a['text'], quote=False)}</code>")
        elif b.op == "Media":
            out.append(f"<a{attr(href=a['src'])}>{html.escape(a.get('title') or a['src'])}</a>")
        elif b.op in _TAGS:
            out.append(f"<{_TAGS[b.op]}>{inside}</{_TAGS[b.op]}>")
        else:
            out.append(inside)
    return "".join(out)


def plain_text(blocks: list[Block]) -> str:
    """A line for each block of words; images, references and breaks say nothing."""
    out: list[str] = []
    for b in blocks:
        if b.op == "CodeBlock" or b.op == "DisplayMath":
            out.append(b.attrs["text"])
        elif b.op == "Media":
            out.append(b.attrs.get("title") or "")
        elif b.inside and all(x.op in INLINE for x in b.inside):
            out.append(T.squeeze(inline_text(b.inside).replace("\n", " ")))
        elif b.op in INLINE:
            out.append(T.squeeze(inline_text([b])))
        else:
            out.append(plain_text(b.inside))
    return "\n".join(x for x in out if x)


def metrics(blocks: list[Block]) -> dict:
    """Counts over the blocks (not the source), and the share of the text that is linked: links within a page count for 0.3."""
    text = plain_text(blocks)
    every = [x for b in blocks for x in b.walk()]
    count = lambda *ops: sum(x.op in ops for x in every)
    linked = sum(len(T.squeeze(inline_text(x.inside))) * (0.3 if x.attrs["fragment_only"] else 1.0) for x in every if x.op == "Link")
    squeezed = T.squeeze(text)
    return {
        "text_chars": len(squeezed), "word_count": len(squeezed.split()), "paragraph_count": count("Paragraph"), "heading_count": count("Heading"),
        "list_count": count("List"), "list_item_count": count("ListItem"), "code_block_count": count("CodeBlock"), "table_count": count("Table"),
        "table_cell_count": count("TableCell"), "figure_count": count("Figure"), "image_count": count("Image"), "link_count": count("Link"),
        "blockquote_count": count("BlockQuote"), "footnote_count": count("FootnoteDefinition"), "math_count": count("InlineMath", "DisplayMath"), "media_count": count("Media"),
        "link_density": linked / len(squeezed) if squeezed else 0.0, "has_alphanumeric_text": any(c.isalnum() for c in squeezed),
        "has_contextual_structure": count("Heading", "List", "Table", "CodeBlock", "Figure") > 0,
    }


def front_matter(metadata: dict, source: str | None) -> str:
    """Metadata as YAML; empty fields are left out."""
    import json

    rows = []
    for key, value in {**metadata, "source": source}.items():
        if isinstance(value, list) and value:
            rows += [f"{key}:", *(f"  - {json.dumps(x, ensure_ascii=False)}" for x in value)]
        elif isinstance(value, str) and value:
            rows.append(f"{key}: {json.dumps(value, ensure_ascii=False)}")
    return "---\n" + "\n".join(rows) + "\n---\n"
