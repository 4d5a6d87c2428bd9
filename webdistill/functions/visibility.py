"""Whether an element is shown, as far as its own attributes tell."""

from __future__ import annotations

import re

from webdistill.functions.dom import Node

HIDDEN_CLASSES = frozenset(("hidden", "d-none", "display-none", "u-hidden", "invisible", "visually-hidden", "sr-only"))


def hidden_style(style: str) -> bool:
    """Whether declarations hide; later ones win unless an earlier one is important."""
    state: dict[str, tuple[bool, bool]] = {}
    for part in style.lower().split(";"):
        name, _, value = part.partition(":")
        important, value = "!important" in value, value.replace("!important", "").strip()
        name = name.strip()
        if name in ("display", "visibility", "opacity") and (important or not state.get(name, (False, False))[1]):
            state[name] = value == {"display": "none", "visibility": "hidden"}.get(name, "0"), important
    return any(h for h, _ in state.values())


def hidden(node: Node) -> bool:
    if "hidden" in node.attrs or node.get("style") and hidden_style(node.get("style")):
        return True
    if node.get("aria-hidden").lower() == "true" and "fallback-image" not in node.get("class") and node.tag not in ("math", "svg", "img"):
        return True
    tokens = set(node.tokens("class"))
    return bool(tokens & HIDDEN_CLASSES) and not any(re.match(r"(?:sm|md|lg|xl|2xl|d-(?:sm|md|lg|xl|xxl))[:\-]?(?:block|table|flex|grid|inline)", t) for t in tokens)
