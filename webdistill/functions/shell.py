"""Pages of programs: parts that were sent later go to their places, hidden copies of the content are shown where nothing else is."""

from __future__ import annotations

import re
from collections.abc import Callable

from webdistill.functions.dom import Node
from webdistill.functions.parser import parse_fragment

_ID = re.compile(r"(.*)([BPS]):([0-9a-fA-F]+)", re.S)
_LOADING = re.compile(r"(?:loading|please wait|chargement|wird geladen|cargando)[\s.…]*", re.I)
_NOTICE = re.compile(r"enable|disabled|required|requires|turn on|turned off|support|activate", re.I)
#: Ids of the elements that programs put pages into. Fixed values.
MOUNTS = frozenset(("root", "app", "app-root", "application", "__next", "__nuxt", "___gatsby", "svelte", "react-root"))
_MEDIA = ("img", "picture", "video", "audio", "iframe", "canvas", "object", "embed")
_CONTROLS = ("button", "input", "select", "textarea")


def streamed_id(node: Node) -> tuple[str, str] | None:
    """Kind (B or P: a place, S: a part) and key of an id such as ``B:0``; places and parts that belong together share the key."""
    found = _ID.fullmatch(node.get("id")) if "id" in node.attrs else None
    return (found[2], f"{found[1]}{found[3]}") if found else None


def complete(parts: dict[str, Node]) -> set[str]:
    """Keys of the parts whose own places can all be filled, by parts that are complete themselves; none in a circle is."""
    needs: dict[str, set[str] | None] = {}
    users: dict[str, list[str]] = {}
    for key, part in parts.items():
        wanted: set[str] | None = set()
        for x in part.walk():
            found = streamed_id(x) if x.tag == "template" else None
            if found and found[0] in "BP":
                if x.raw_text().strip() or found[1] not in parts:
                    wanted = None
                    break
                wanted.add(found[1])
        needs[key] = wanted
        for w in wanted or ():
            users.setdefault(w, []).append(key)
    ready = [k for k, w in needs.items() if w is not None and not w]
    done: set[str] = set()
    while ready:  # parts that wait for nothing, then those that wait for these
        key = ready.pop()
        done.add(key)
        for user in users.get(key, ()):
            if needs[user]:
                needs[user].discard(key)
                if not needs[user]:
                    ready.append(user)
    return done


def _drop_fallback(place: Node) -> None:
    """What is shown until the part comes: all up to the comment that ends the place, nothing if there is none."""
    rest = place.parent.children[place.index() + 1 :]
    depth = 0
    for k, x in enumerate(rest):
        if x.tag != "#comment":
            continue
        if x.text == "/$" and not depth:
            for y in rest[:k]:
                y.detach()
            return
        depth += -1 if x.text == "/$" else 1 if x.text.startswith("$") else 0


def splice(body: Node) -> int:
    """Put streamed parts (``hidden``, id ``S:``) in the places (``template``, id ``B:`` or ``P:``) of their key; returns how many.

    A place that shows something until then (``B:``) is filled only by a complete part. The first part of a key counts,
    and a part never goes into itself. Places without a part stay as they are.
    """
    places: list[tuple[str, str, Node]] = []
    parts: dict[str, Node] = {}
    for x in body.walk():
        found = streamed_id(x) if x.tag[0] != "#" else None
        if found and x.tag == "template" and found[0] in "BP":
            places.append((*found, x))
        elif found and found[0] == "S" and "hidden" in x.attrs:
            parts.setdefault(found[1], x)
    if not places or not parts:
        return 0
    whole, n = complete(parts), 0
    for kind, key, place in places:
        part = parts.get(key)
        if part is None or part.parent is None or place.parent is None or place.raw_text().strip() or any(x is part for x in place.ancestors()):
            continue
        if kind == "B":
            if key not in whole:
                continue
            _drop_fallback(place)
        part.detach()
        place.replace(*list(part.children))
        n += 1
    return n


# -- shells
def _progress(node: Node) -> bool:
    return node.tag == "progress" or "progressbar" in node.tokens("role") or node.get("aria-busy").lower() == "true" or bool(re.search(r"spinner|loader|loading|skeleton", node.name(), re.I))


def _mount(node: Node) -> bool:
    name = node.get("id").lower()
    tokens = [*node.tokens("class"), name]
    parts = re.split(r"[-_]", name) if node.tag in ("div", "main", "section") else []
    return name in MOUNTS or any("app-shell" in t or "application-shell" in t for t in tokens) or "ember-application" in tokens or "app" in parts or "mount" in parts


def _small_svg(node: Node) -> bool:
    named = node.get("aria-label").strip() or node.get("aria-labelledby").strip() or "img" in node.tokens("role") or any(x.tag in ("title", "desc") and x.raw_text().strip() for x in node.children)
    return not named and all((v := node.get(k).strip().removesuffix("px")).isdigit() and int(v) <= 32 for k in ("width", "height"))


def is_shell(body: Node, hidden: Callable[[Node], bool]) -> bool:
    """Whether a page shows no text and no media of its own, but signs of a program that will.

    Controls, signs of progress, page headers, footers and navigation are set aside; media in them count still.
    """
    progress = place = control = mount = False
    stack: list[tuple[Node, bool]] = [(x, False) for x in reversed(body.children)]
    while stack:
        node, aside = stack.pop()
        if node.tag == "#text":
            text = node.text.strip()
            if aside or not text:
                continue
            if not _LOADING.fullmatch(text):
                return False
            place = True
            continue
        if node.tag[0] == "#" or node.tag in ("script", "style", "noscript", "template") or hidden(node) or node.tag in ("header", "nav", "footer") and not aside:
            continue
        if node.tag in _MEDIA or node.tag == "svg" and not _small_svg(node):
            return False
        if node.tag == "svg":
            continue
        if not aside:
            mount |= _mount(node)
            if node.tag in _CONTROLS or "button" in node.tokens("role"):
                control = aside = True
            elif _progress(node):
                progress = True
                aside = len(" ".join(node.raw_text().split())) <= 8
        stack.extend((x, aside) for x in reversed(node.children))
    return progress or place and control or mount


def prose(nodes: list[Node]) -> int | None:
    """Characters of text that reads like an article: enough of it in several runs, with a heading or more runs, few links; else None."""
    chars = linked = runs = headings = 0
    stack = [(x, False) for x in reversed(nodes)]
    words: list[str] = []
    while stack:
        node, link = stack.pop()
        if node.tag == "#text":
            n = len(" ".join(node.text.split()))
            chars, linked, runs = chars + n, linked + n * link, runs + (n >= 25)
            if chars < 1000:
                words.append(node.text)
        elif node.tag[0] != "#" and node.tag not in ("script", "style"):
            headings += bool(re.fullmatch("h[1-6]", node.tag))
            stack.extend((x, link or node.tag == "a") for x in reversed(node.children))
    if chars < 150 or runs < 2 or not (headings or runs >= 3) or 2 * linked >= chars:
        return None
    notice = " ".join(words).lower()
    return None if chars < 1000 and "javascript" in notice and _NOTICE.search(notice) else chars


def reveal(body: Node, hidden: Callable[[Node], bool]) -> str | None:
    """Show the longest hidden copy of the content (``noscript`` or ``template``) of a shell; the kind of element, or None.

    Nothing is shown on pages with text or media of their own. At most one copy is shown, so none doubles another.
    """
    best: tuple[int, Node, list[Node]] | None = None
    for x in body.walk():
        if x.tag not in ("noscript", "template") or streamed_id(x) or x.has_ancestor("noscript", "template"):
            continue
        inside = list(x.children)
        if x.tag == "noscript" and all(c.tag == "#text" for c in inside):
            inside = parse_fragment(x.raw_text()) if "<" in x.raw_text() else inside
        n = prose(inside)
        if n is not None and (best is None or n > best[0]):
            best = n, x, inside
    if best is None or not is_shell(body, hidden):
        return None
    _, node, inside = best
    for x in [y for top in inside for y in top.walk() if y.tag in ("script", "style")]:
        x.detach() if x.parent is not None else inside.remove(x)
    node.replace(*inside)
    return node.tag
