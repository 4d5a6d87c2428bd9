"""Lists that are numbered in their texts."""

from __future__ import annotations

import re

from webdistill.functions.dom import Node

_MARKER = re.compile(r"\s*([0-9]+)[.)](?:\s+|$)")


def ordered_markers(items: list[Node]) -> list[tuple[int, Node, str]] | None:
    """Number, text and what the text says after the number, of two or more items that count up by one; None otherwise."""
    if len(items) < 2:
        return None
    out: list[tuple[int, Node, str]] = []
    for item in items:
        text = next((x for x in item.walk() if x.tag == "#text" and x.text.strip()), None)
        found = _MARKER.match(text.text) if text is not None else None
        if found is None or out and int(found[1]) != out[-1][0] + 1:
            return None
        out.append((int(found[1]), text, text.text[found.end() :]))
    return out


def role_items(node: Node) -> list[Node]:
    """The items of an element whose role is a list."""
    return [x for x in node.children if "listitem" in x.tokens("role")] if "list" in node.tokens("role") else []
