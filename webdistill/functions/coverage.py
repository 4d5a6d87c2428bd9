"""How much of a source's structure a result keeps, by kinds and as multisets."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from webdistill.functions import text as T
from webdistill.functions.compile import Block

#: Categories, and from how many items in the source on they count. Fixed values.
LEAST = {"CodeBlocks": 1, "DataTables": 1, "SubstantialListItems": 1, "Visuals": 1, "Headings": 3, "FootnoteDefinitions": 1, "MathExpressions": 1}
SUBSTANTIAL = 3


@dataclass
class Structure:
    """Counts of a document's structure; list items by what they say, without the lists in them."""

    code_blocks: int = 0
    tables: int = 0
    visuals: int = 0
    headings: int = 0
    math: int = 0
    items: Counter = field(default_factory=Counter)
    substantial: Counter = field(default_factory=Counter)
    notes: set[str] = field(default_factory=set)


def _says(b: Block) -> str | None:
    a = b.attrs
    if b.op in ("Text", "InlineCode", "CodeBlock", "InlineMath", "DisplayMath"):
        return a["text"]
    return (a.get("alt") or a["src"]) if b.op == "Image" else (a.get("title") or a["src"]) if b.op == "Media" else None


def signature(item: Block) -> str:
    """What a list item says, part by part, without the lists in it."""
    out: list[str] = []
    stack = list(reversed(item.inside))
    while stack:
        b = stack.pop()
        if b.op == "List":
            continue
        if (text := T.squeeze(_says(b) or "")):
            out.append(text)
        stack.extend(reversed(b.inside))
    return " ".join(out)


def measure(blocks: list[Block]) -> Structure:
    s = Structure()
    defined = {b.attrs["label"] for x in blocks for b in x.walk() if b.op == "FootnoteDefinition"}
    stack = [(b, False) for b in reversed(blocks)]
    while stack:
        b, pictured = stack.pop()
        s.code_blocks += b.op == "CodeBlock"
        s.tables += b.op == "Table"
        s.headings += b.op == "Heading"
        s.math += b.op in ("InlineMath", "DisplayMath")
        s.visuals += b.op == "Figure" or b.op == "Image" and not pictured
        if b.op == "FootnoteReference" and b.attrs["label"] in defined:
            s.notes.add(b.attrs["label"])
        if b.op == "List":
            own = [signature(x) for x in b.inside if x.op == "ListItem"]
            s.items.update(own)
            if len(own) >= SUBSTANTIAL:
                s.substantial.update(own)
        stack.extend((x, pictured or b.op == "Figure") for x in reversed(b.inside))
    return s


def coverage(source: Structure, result: Structure) -> list[dict]:
    """For each category that the source has enough of: how many items it has, how many of them (or as many) the result, and the share."""
    pairs = {
        "CodeBlocks": (source.code_blocks, result.code_blocks), "DataTables": (source.tables, result.tables),
        "SubstantialListItems": (source.substantial.total(), (source.substantial & result.items).total()), "Visuals": (source.visuals, result.visuals),
        "Headings": (source.headings, result.headings), "FootnoteDefinitions": (len(source.notes), len(source.notes & result.notes)), "MathExpressions": (source.math, result.math),
    }
    return [{"category": k, "source_count": a, "result_count": b, "coverage": min(b / a, 1.0)} for k, (a, b) in pairs.items() if a >= LEAST[k]]


def score(found: list[dict]) -> float | None:
    """The mean share of the categories; None where the source has too little structure."""
    return sum(x["coverage"] for x in found) / len(found) if found else None


def normalization(blocks: list[Block], flattened_tables: int) -> dict[str, int]:
    """How many structures of each kind were brought into the document's own form."""
    count = Counter(b.op for x in blocks for b in x.walk())
    return {
        "code_blocks": count["CodeBlock"], "footnote_references": count["FootnoteReference"], "footnote_definitions": count["FootnoteDefinition"],
        "math_expressions": count["InlineMath"] + count["DisplayMath"], "images": count["Image"], "tables": count["Table"], "flattened_layout_tables": flattened_tables,
    }
