"""Metadata candidates of a page, with their sources and confidences, and their resolution."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass, replace
from typing import Any

from webdistill.functions import dates, people
from webdistill.functions import structured as D
from webdistill.functions import text as T
from webdistill.functions.dom import Node
from webdistill.functions.visibility import hidden

SINGLE = ("title", "description", "site_name", "canonical_url", "image", "favicon", "published_time", "modified_time", "language", "direction", "section")
MANY = ("authors", "tags")
FIELDS = (*SINGLE, *MANY)
#: name or property -> (field, source, confidence). Fixed values.
META = {
    "dc.title": ("title", "dublin_core", 100), "dcterms.title": ("title", "dublin_core", 98), "og:title": ("title", "open_graph", 95),
    "article:title": ("title", "open_graph", 94), "parsely-title": ("title", "html_meta", 92), "citation_title": ("title", "citation", 90),
    "twitter:title": ("title", "twitter", 86), "title": ("title", "html_meta", 76),
    "dc.description": ("description", "dublin_core", 100), "dcterms.description": ("description", "dublin_core", 98),
    "og:description": ("description", "open_graph", 95), "twitter:description": ("description", "twitter", 86), "description": ("description", "html_meta", 76),
    "dc.creator": ("authors", "dublin_core", 96), "dcterms.creator": ("authors", "dublin_core", 96), "citation_author": ("authors", "citation", 88),
    "parsely-author": ("authors", "html_meta", 88), "article:author": ("authors", "open_graph", 82), "author": ("authors", "html_meta", 76),
    "og:site_name": ("site_name", "open_graph", 90), "application-name": ("site_name", "html_meta", 76), "og:url": ("canonical_url", "open_graph", 88),
    "og:image": ("image", "open_graph", 90), "og:image:url": ("image", "open_graph", 90), "twitter:image": ("image", "twitter", 82), "twitter:image:src": ("image", "twitter", 82),
    "article:published_time": ("published_time", "open_graph", 90), "citation_publication_date": ("published_time", "citation", 88),
    "citation_date": ("published_time", "citation", 88), "parsely-pub-date": ("published_time", "html_meta", 88), "date": ("published_time", "html_meta", 76),
    "dc.date": ("published_time", "html_meta", 76), "pubdate": ("published_time", "html_meta", 76),
    "article:modified_time": ("modified_time", "open_graph", 90), "og:updated_time": ("modified_time", "open_graph", 90), "last-modified": ("modified_time", "html_meta", 76),
    "og:locale": ("language", "open_graph", 90), "content-language": ("language", "html_meta", 76),
    "article:section": ("section", "open_graph", 90), "article:tag": ("tags", "open_graph", 90), "citation_keywords": ("tags", "citation", 88), "keywords": ("tags", "html_meta", 76),
}
#: Types of structured data that are articles. Fixed values.
ARTICLES = frozenset(
    "Article AdvertiserContentArticle NewsArticle AnalysisNewsArticle AskPublicNewsArticle BackgroundNewsArticle OpinionNewsArticle ReportageNewsArticle "
    "ReviewNewsArticle Report SatiricalArticle ScholarlyArticle MedicalScholarlyArticle SocialMediaPosting BlogPosting LiveBlogPosting DiscussionForumPosting TechArticle APIReference".split()
)
_BYLINE = re.compile(r"byline|author|dateline|writtenby|p-author", re.I)


@dataclass(frozen=True)
class Candidate:
    field: str
    value: str
    source: str
    confidence: int
    order: int

    @property
    def key(self) -> str:
        """What equal values have in common, whatever their case."""
        return T.folded(self.value)


class Collector:
    def __init__(self):
        self.found: list[Candidate] = []

    def add(self, field: str, value: str | None, source: str, confidence: int) -> None:
        if (value := _normal(field, value)) is not None:
            self.found.append(Candidate(field, value, source, confidence, len(self.found)))


def _normal(field: str, value: str | None) -> str | None:
    value = T.meaningful(value)
    if value is None:
        return None
    if field == "authors":
        value = re.sub(r"^(?:by|von|par|por)\s+", "", value, flags=re.I)
        if "://" in value or len(value) > 120:
            return None
    if field == "language":
        value = value.replace("_", "-")
    if field == "direction":
        value = value.lower()
        return value if value in ("ltr", "rtl", "auto") else None
    return value


def json_items(document: Node, max_bytes: int = 0, max_items: int = 0, max_depth: int = 0) -> list[dict[str, Any]]:
    """Typed objects of the page's JSON-LD in order; texts that aren't JSON or too deep are skipped. Limits of 0 are none (of depth: 128)."""
    out: list[dict[str, Any]] = []
    max_depth = max_depth or 128

    def visit(value: Any, depth: int) -> None:
        if depth > max_depth or max_items and len(out) >= max_items:
            return
        if isinstance(value, list):
            for x in value:
                visit(x, depth + 1)
        elif isinstance(value, dict):
            visit(value.get("@graph", []), depth + 1)
            if value.get("@type"):
                out.append(value)
            for k, x in value.items():
                if k != "@graph" and isinstance(x, (dict, list)):
                    visit(x, depth + 1)

    for script in document.elements("script"):
        if script.get("type").split(";")[0].strip().lower() == "application/ld+json":
            body = re.sub(r"^\s*(?://)?\s*<!\[CDATA\[|(?://)?\s*\]\]>\s*$", "", script.raw_text())
            if not max_bytes or len(body) <= max_bytes:
                try:
                    visit(json.loads(body), 0)
                except (ValueError, RecursionError):
                    continue
    return out


def _types(item: dict[str, Any]) -> set[str]:
    kinds = item.get("@type")
    return {str(x).rsplit("/", 1)[-1] for x in (kinds if isinstance(kinds, list) else [kinds])}


def _names(value: Any) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        return _names(value.get("name", ""))
    return [n for x in value for n in _names(x)] if isinstance(value, list) else []


def described(document: Node, url: str | None, items: list[dict[str, Any]]) -> tuple[dict[str, Any] | None, bool]:
    """The item of the structured data that describes the page itself, and whether it is an article."""
    if not items:
        return None, False
    raw = next((x for x in document.walk() if x.tag == "title" and x.ns == "html"), None)
    title = D.identity_title(document, T.page_title(raw.raw_text(), None) if raw is not None else "")
    kinds = [(x, _types(x)) for x in items]
    return D.primary([x for x, k in kinds if k & ARTICLES], [x for x, k in kinds if k & D.GENERAL and not k & ARTICLES], title, url)


def _item_titles(item: dict[str, Any], article: bool, title: str) -> list[tuple[str, int]]:
    """``headline`` and ``name`` with their confidences; where they differ the one like the page's title counts more."""
    headline, name = (next(iter(_names(item.get(k))), None) for k in ("headline", "name"))
    if headline and name and headline != name:
        like = [T.similarity(x, title) > 0.75 for x in (headline, name)]
        name_first = like == [False, True]
        high, low = (98, 91) if article else (90 if name_first else 94, 88)
        return [(name, high), (headline, low)] if name_first else [(headline, high), (name, low)]
    return [(headline, 98 if article else 94)] if headline else [(name, 98 if article else 90)] if name else []


def split_authors(c: Collector) -> None:
    """Author lists of general meta fields become one candidate a person.

    A list of two that may be one name is split only where another candidate names one of the two. Another source's
    equal text is split alike.
    """
    authors = [x for x in c.found if x.field == "authors"]
    parts: dict[str, list[str]] = {}
    for x in authors:
        names, sure = people.people(x.value) if x.source in ("html_meta", "open_graph") else ([], False)
        keys = {T.folded(n) for n in names}
        if names and (sure or any(y.order != x.order and y.key in keys for y in authors)):
            parts[x.key] = names
    if not parts:
        return
    found, c.found = c.found, []
    for x in found:
        values = parts.get(x.key, [x.value]) if x.field == "authors" else [x.value]
        c.found += [Candidate(x.field, v, x.source, x.confidence, 0) for v in values]
    c.found = [replace(x, order=i) for i, x in enumerate(c.found)]


def candidates(document: Node, url: str | None, base: str | None, items: list[dict[str, Any]]) -> list[Candidate]:
    """All candidates in the order of the page: structured data, meta and link elements, visible elements, what the address says."""
    c = Collector()
    item, article = described(document, url, items)
    if item is not None:
        high = lambda a, b: a if article else b
        raw = next((x for x in document.walk() if x.tag == "title" and x.ns == "html"), None)
        for value, confidence in _item_titles(item, article, D.identity_title(document, raw.raw_text() if raw is not None else "")):
            c.add("title", value, "json_ld", confidence)
        c.add("description", next(iter(_names(item.get("description"))), None), "json_ld", high(92, 88))
        for n in _names(item.get("author")):
            c.add("authors", n, "json_ld", high(96, 90))
        for key, confidence in (("publisher", high(94, 88)), ("sourceOrganization", high(90, 86)), ("isPartOf", high(88, 84))):
            for n in _names(item.get(key)):
                c.add("site_name", n, "json_ld", confidence)
        c.add("published_time", next(iter(_names(item.get("datePublished"))), None), "json_ld", high(98, 92))
        c.add("modified_time", next(iter(_names(item.get("dateModified"))), None), "json_ld", high(98, 92))
        c.add("language", next(iter(_names(item.get("inLanguage"))), None), "json_ld", high(90, 86))
        if article:
            c.add("section", next(iter(_names(item.get("articleSection"))), None), "json_ld", 92)
        c.add("image", T.resolve(base, D.address_of(item.get("image")) or "", ("http", "https")), "json_ld", high(88, 84))
        c.add("canonical_url", T.resolve(base, D.address_of(item.get("url")) or "", ("http", "https")), "json_ld", high(82, 80))
        if article:
            c.add("canonical_url", T.resolve(base, D.address_of(item.get("mainEntityOfPage")) or "", ("http", "https")), "json_ld", 90)
        for k in _names(item.get("keywords")):
            for tag in k.split(","):
                c.add("tags", tag, "json_ld", 88)
    for site in items:
        if "WebSite" in _types(site):
            for n in _names(site.get("name")):
                c.add("site_name", n, "json_ld", 86)
    for node in document.walk():
        tag = node.tag
        if tag == "meta" and node.get("content"):
            for name in (node.get("property") or node.get("name") or node.get("itemprop") or node.get("http-equiv")).lower().split():
                field, source, confidence = META.get(name, (None, None, 0))
                value = node.get("content")
                if field in ("image", "canonical_url"):
                    value = T.resolve(base, value, ("http", "https"))
                if field == "tags" and source == "html_meta" or name == "citation_keywords":
                    for part in re.split(r"[,;]", value):
                        c.add("tags", part, source, confidence)
                elif field:
                    c.add(field, value, source, confidence)
        elif tag == "link" and node.get("href"):
            rel = node.get("rel").lower().split()
            if "canonical" in rel:
                c.add("canonical_url", T.resolve(base, node.get("href"), ("http", "https")), "link_element", 100)
            elif "icon" in rel or "apple-touch-icon" in rel:
                c.add("favicon", T.resolve(base, node.get("href"), ("http", "https")), "link_element", 90)
    body = document.first("body") or document
    headings = [x for x in body.elements("h1") if T.squeeze(x.raw_text())]
    only = T.squeeze(headings[0].raw_text()) if len(headings) == 1 else None
    raw = next((x for x in document.walk() if x.tag == "title" and x.ns == "html"), None)
    if raw is not None and T.squeeze(raw.raw_text()):
        c.add("title", T.page_title(raw.raw_text(), only), "html_element", 84)
    best: tuple[int, str, Node] | None = None
    for h in headings:
        if any(x.tag in ("nav", "footer", "aside") for x in h.ancestors()):
            continue
        value = D.heading_text(h)
        if not value:
            continue
        confidence = 82 if h.has_ancestor("article") else 80 if h.has_ancestor("main") else 78
        confidence += 2 * (len(value.split()) >= 4) + 4 * ("p-name" in h.tokens("class"))
        if best is None or confidence > best[0]:
            best = confidence, value, h
    if best:
        c.add("title", best[1], "html_element", best[0])
    for node in body.walk():
        if node.tag[0] == "#":
            continue
        prop = node.get("itemprop").lower().split()
        if "author" in prop:
            c.add("authors", node.get("content") or node.raw_text(), "html_element", 84)
        elif node.tag == "a" and "author" in node.get("rel").lower().split():
            c.add("authors", node.raw_text(), "html_element", 82)
        elif node.tag == "a" and "/author/" in node.get("href"):
            c.add("authors", node.raw_text(), "html_element", 68)
        elif _BYLINE.search(node.name()) and 0 < len(T.squeeze(node.raw_text())) < 100 and not node.elements("a", "time", "p"):
            c.add("authors", node.raw_text(), "inferred", 62)
        if "datepublished" in prop:
            c.add("published_time", node.get("datetime") or node.get("content") or node.raw_text(), "html_element", 82)
        elif "datemodified" in prop:
            c.add("modified_time", node.get("datetime") or node.get("content") or node.raw_text(), "html_element", 82)
    for field, value, source, confidence in dates.candidates(body, best[2] if best else None, hidden):
        c.add(field, value, source, confidence)
    split_authors(c)
    root = document.first("html")
    if root is not None:
        c.add("language", root.get("lang") or root.get("xml:lang"), "html_element", 100)
        c.add("direction", root.get("dir"), "html_element", 100)
    c.add("canonical_url", url, "inferred", 10)
    c.add("site_name", T.host_of(url), "inferred", 10)
    return c.found


def scored(found: list[Candidate]) -> list[tuple[int, Candidate]]:
    """Each candidate's score: its confidence and 5 for each other source's equal value, three at most."""
    every = Counter((x.field, x.key) for x in found)
    of_source = Counter((x.field, x.key, x.source) for x in found)
    return [(x.confidence + 5 * min(every[x.field, x.key] - of_source[x.field, x.key, x.source], 3), x) for x in found]


def resolved(found: list[Candidate]) -> dict[str, Any]:
    """The best value of each field (the earliest, of equal scores); lists keep the order of the page."""
    out: dict[str, Any] = dict.fromkeys(SINGLE)
    ranked = scored(found)
    for field in SINGLE:
        own = [(s, -x.order, x.value) for s, x in ranked if x.field == field]
        if own:
            out[field] = max(own)[2]
    site = out["site_name"]
    if out["title"] and site:
        kept = re.sub(rf"\s+[|\-–—·»]\s+{re.escape(site)}$|^{re.escape(site)}\s+[|\-–—·»]\s+", "", out["title"], flags=re.I)
        out["title"] = kept or out["title"]
    for field in MANY:
        own = [(s, x) for s, x in ranked if x.field == field]
        if field == "authors" and own:
            top = max(x.confidence for _, x in own)
            own = [(s, x) for s, x in own if x.confidence >= top - 8]
        seen: dict[str, str] = {}
        for _, x in own:
            seen.setdefault(T.folded(x.value), x.value)
        out[field] = list(seen.values())[:10] if field == "authors" else list(seen.values())
    compact = lambda v: "".join(ch for ch in T.folded(v) if ch.isalnum())
    if site:
        out["tags"] = [x for x in out["tags"] if compact(x) != compact(site)]
    return out


def provenance(found: list[Candidate]) -> list[dict[str, Any]]:
    """Selected and other candidates of each field."""
    best: dict[str, tuple[int, int]] = {}
    ranked = scored(found)
    for s, x in ranked:
        best[x.field] = max(best.get(x.field, (-1, 0)), (s, -x.order))
    return [{"field": x.field, "value": x.value, "source": x.source, "confidence": x.confidence, "score": s, "ord": x.order, "selected": best[x.field] == (s, -x.order)} for s, x in ranked]
