"""Dates written in words, and whether a page was published or changed then."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from webdistill.functions.dom import Node

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: Months by number in further languages (German, French, Spanish), with short English forms.
NAMES = {
    **{m.lower(): k for k, m in enumerate(MONTHS, 1)}, **{m[:3].lower(): k for k, m in enumerate(MONTHS, 1)}, "sept": 9,
    **dict(zip("januar februar märz april mai juni juli august september oktober november dezember".split(), range(1, 13), strict=True)), "jänner": 1,
    **dict(zip("janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(), range(1, 13), strict=True)),
    **dict(zip("enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(), range(1, 13), strict=True)),
}
CHANGED = "updated|update|modified|revised|edited|aktualisiert|geändert|überarbeitet|bearbeitet|mise à jour|mis à jour|modifiée?|actualizado|actualizada|modificado|modificada"
PUBLISHED = "published|posted|veröffentlicht|erschienen|publiée?|paru|publicado|publicada"
_MONTH = "|".join(sorted(NAMES, key=len, reverse=True))
#: A date in words: month, day and year, or day, month and year.
DATE = rf"(?:(?P<m1>{_MONTH})\.?\s+(?P<d1>[0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y1>[0-9]{{4}})|(?P<d2>[0-9]{{1,2}})(?:\.|er|st|nd|rd|th)?\s+(?:de\s+|of\s+)?(?P<m2>{_MONTH})\.?,?\s+(?:de\s+|del\s+)?(?P<y2>[0-9]{{4}}))(?![0-9])"
_DATE = re.compile(rf"(?<![\w-]){DATE}", re.I)
_YEAR = re.compile("(?:1[6-9]|2[01])[0-9]{2}")
_CALENDAR = re.compile(r"[0-9]{4}(?:$|-)")
_CHANGED, _PUBLISHED = (re.compile(rf"(?<!\w)(?:{x})(?!\w)(?!\s+(?:by|von|par|por)(?!\w))", re.I) for x in (CHANGED, PUBLISHED))
_SEPARATOR = re.compile(r"[·|•;\n]|\s[–—]\s")
#: What may stand between a label and its date.
_LINK = re.compile(r"\W*(?:(?:on|as of|last|first|zuletzt|erstmals|am|vom|le|el|en|at|pour la dernière fois)\W*)*", re.I)
# Parts of classes and ids that name a date's role.
_PUBLISHED_PARTS = frozenset(("datepublished", "pubdate", "publicationdate", "publishdate", "published"))
_CHANGED_PARTS = frozenset(("datemodified", "dateupdated", "edited", "lastmod", "lastmodified", "lastupdated", "modified", "revised", "updated"))
_GENERIC = frozenset(("entry-date", "entry_date", "post-date", "post_date", "postdate"))
#: Confidence of a date by the evidence of its role.
SURE = {"property": 82, "label": 66, "class": 62, "generic": 58, "none": 48}
#: A line of dates has at most so many characters, and so many between it and the heading.
LINE, REACH = 120, 300


def written(text: str) -> str | None:
    """The first valid date of a text as ``Month D, YYYY``; None without one."""
    return next((d for _, _, d in all_written(text)), None)


def all_written(text: str) -> Iterator[tuple[int, int, str]]:
    for found in _DATE.finditer(text):
        month, day, year = (found["m1"], found["d1"], found["y1"]) if found["m1"] else (found["m2"], found["d2"], found["y2"])
        if 1 <= int(day) <= 31:
            yield found.start(), found.end(), f"{MONTHS[NAMES[month.lower()] - 1]} {int(day)}, {year}"


def label(text: str) -> str | None:
    """``modified_time`` or ``published_time`` by the label in a text, None without; who edited something is no label."""
    return "modified_time" if _CHANGED.search(text) else "published_time" if _PUBLISHED.search(text) else None


def marked(node: Node, tier: str) -> str | None:
    """The role that an element's property or names state; ``other`` for properties of other dates."""
    if tier == "property":
        props = node.tokens("itemprop")
        if "datePublished" in props:
            return "published_time"
        if "dateModified" in props:
            return "modified_time"
        return "other" if any("date" in p.lower() or "time" in p.lower() or p.lower() in ("validfrom", "validthrough", "expires") for p in props) else None
    if "class" not in node.attrs and "id" not in node.attrs:
        return None
    name = node.name().lower()
    if tier == "class":
        parts = set(re.split(r"[^a-z0-9]", name))
        return "published_time" if parts & _PUBLISHED_PARTS else "modified_time" if parts & _CHANGED_PARTS else None
    return "published_time" if set(name.split()) & _GENERIC else None


def before(node: Node, top: Node, hidden: Callable[[Node], bool]) -> str:
    """The visible words right before an element, back to a separator or an earlier date, within ``top``."""
    out = ""
    while node is not top and node.parent is not None:
        at = node.index()
        for x in reversed(node.parent.children[:at]):
            if x.tag[0] != "#" and hidden(x):
                continue
            if x.tag == "time" or x.tag[0] != "#" and x.first("time") is not None:
                return out
            out = f"{x.raw_text()} {out}"
            if _SEPARATOR.search(out) or len(out) > 48:
                return _SEPARATOR.split(out)[-1][-48:]
        node = node.parent
    return out


def role(node: Node, top: Node, hidden: Callable[[Node], bool]) -> tuple[str, str]:
    """Role and evidence of a date element: a property, a label on or before it, or names; nearest first, up to ``top``."""
    around = [node]
    for x in node.ancestors():
        around.append(x)
        if x is top:
            break
    nearest = lambda tier: next((r for x in around if (r := marked(x, tier))), None)
    if found := nearest("property"):
        return found, "property"
    own = re.match(r"\W*(?:(?:last|first)\W+)?(\w+)", node.raw_text())
    if own and (found := label(own[1])) or (found := label(before(node, top, hidden))):
        return found, "label"
    if found := nearest("class"):
        return found, "class"
    found = nearest("generic")
    return (found, "generic") if found else ("published_time", "none")


def line_dates(text: str, marker: str | None) -> list[tuple[str, str]]:
    """Roles and dates of a line such as ``Published March 3, 2021 · Updated May 1, 2022``.

    A date counts if its label stands right before it, or if the line has a ``marker`` and no label; little may follow.
    """
    out: list[tuple[str, str]] = []
    for part in _SEPARATOR.split(text):
        last = 0
        for start, end, date in all_written(part):
            lead, last = part[last:start], end
            found = label(lead)
            if found:
                words = max((m.end() for m in (_CHANGED if found == "modified_time" else _PUBLISHED).finditer(lead)), default=0)
                if not _LINK.fullmatch(lead[words:]):
                    continue
            elif marker and not lead.strip(" :,-–"):
                found = marker
            if found and len(part) - end <= 24 + 40 * bool(_DATE.search(part, end)):
                out.append((found, date))
    return out


def candidates(body: Node, heading: Node | None, hidden: Callable[[Node], bool]) -> list[tuple[str, str, str, int]]:
    """``field, value, source, confidence`` of the dates that a page shows: ``time`` elements, and lines near the heading.

    Dates of other things (an event's start, say) don't count.
    """
    if not any(x.tag == "time" or x.tag == "#text" and _YEAR.search(x.text) for x in body.walk()):
        return []
    out: list[tuple[str, str, str, int]] = []
    place: dict[int, tuple[int, int]] = {}
    order: list[Node] = []
    stack: list[tuple[Node, bool]] = [(body, False)]
    chars = 0
    while stack:
        node, leaving = stack.pop()
        if leaving:
            place[id(node)] = place[id(node)][0], chars
            continue
        place[id(node)] = chars, chars
        if node.tag == "#text":
            chars += len(" ".join(node.text.split()))
        elif node.tag[0] != "#" and node.tag not in ("script", "style", "template") and not hidden(node):
            order.append(node)
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children))
    head = place.get(id(heading)) if heading is not None else None
    taken: set[int] = set()
    for node in order:
        if node.tag == "time":
            value = node.get("datetime")
            value = value if _CALENDAR.match(value) else written(node.raw_text())
            if not value or not node.has_ancestor("article", "main", "header") and not marked(node, "class") and not marked(node, "property"):
                continue
            top = next((x for x in node.ancestors() if x.tag in ("article", "main", "header", "body")), body)
            found, evidence = role(node, top, hidden)
            if found != "other" and not (evidence == "property" and "itemprop" in node.attrs):
                out.append((found, value, "html_element" if evidence == "property" else "inferred", SURE[evidence]))
            continue
        if node.tag not in ("p", "div", "span", "small", "address", "li", "time") or id(node.parent) in taken:
            if id(node.parent) in taken:
                taken.add(id(node))
            continue
        start, end = place[id(node)]
        if not head or not 0 < end - start <= LINE or start < head[0] - REACH or end > head[1] + REACH + LINE or node.first("time") is not None:
            continue
        around = [node]
        for x in node.ancestors():
            if x is body or place[id(x)][0] <= head[0] and place[id(x)][1] >= head[1]:
                break
            around.append(x)
        markers = [r for tier in ("property", "class", "generic") for x in around if (r := marked(x, tier))]
        if "other" in markers:
            continue
        text = " ".join(" ".join(c.text.split()) for c in node.walk() if c.tag == "#text")
        found = line_dates(text, markers[0] if markers else None)
        if found:
            taken.add(id(node))
            out += [(field, value, "inferred", SURE["label"] - 4) for field, value in found]
    return out
