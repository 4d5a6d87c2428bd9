"""Kernels as Spark columns: each takes Arrow batches of pages and returns one typed value a page. None throws."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from webdistill.functions import extract as X
from webdistill.functions import metadata as M
from webdistill.functions import structured as D
from webdistill.functions import text as T
from webdistill.functions.compile import tape
from webdistill.functions.parser import Budget, LimitError, parse
from webdistill.operators import schemas as S
from webdistill.sources.decode import decode_html

#: Pages, and characters of pages, whose values lie in a worker as Python objects at a time.
BATCH_ROWS, BATCH_CHARS = 64, 1 << 20


def page(html: str | None, url: str | None, options: X.Options) -> dict[str, Any]:
    """A page as a row; what goes wrong is its ``error``."""
    empty = dict.fromkeys(("metadata", "markdown", "html", "text", "metrics", "kind", "diagnostics", "metadata_diagnostics", "structured_data", "error"))
    try:
        found = X.extract(html, url, options)
    except X.PageError as e:
        return empty | {"error": {"kind": e.kind, "message": e.message, "resource": e.resource, "limit": e.limit}}
    except (RecursionError, ValueError, KeyError, IndexError, AttributeError, TypeError, StopIteration) as e:  # a page may not fail a task
        return empty | {"error": {"kind": "Parse", "message": f"{type(e).__name__}: {e}"[:500], "resource": None, "limit": None}}
    attempts = found["diagnostics"]
    if attempts is not None:
        found["diagnostics"] = [dict.fromkeys(("source", "rejection", "coverage", "categories", "normalization")) | x for x in attempts]
    return empty | {k: v for k, v in found.items() if k in empty}


def _column(schema: str, function: Callable[..., Any], *columns: Column | str, once: bool = False) -> Column:
    """An Arrow UDF that calls ``function`` for each row; with ``once`` the plan may not repeat it where its fields are used.

    Values go to Spark as soon as ``BATCH_ROWS`` pages or ``BATCH_CHARS`` characters of them are read, so what a worker
    holds as Python objects doesn't grow with Spark's batches.
    """
    kind = to_arrow_type(_parse_datatype_string(schema))

    def pieces(batch: tuple[pa.Array, ...]) -> Iterator[pa.Array]:
        made, size = [], 0
        for row in zip(*batch, strict=True):
            row = [x.as_py() for x in row]
            made.append(function(*row))
            size += len(row[0] or "")
            if len(made) >= BATCH_ROWS or size >= BATCH_CHARS:
                yield pa.array(made, kind)
                made, size = [], 0
        if made:
            yield pa.array(made, kind)

    if len(columns) == 1:

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for a in batches:
                yield from pieces((a,))
    else:

        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for batch in batches:
                yield from pieces(batch)

    made = F.arrow_udf(run, schema)
    return (made.asNondeterministic() if once else made)(*columns)


def extract_page(html: Column | str, url: Column | str, options: X.Options | None = None) -> Column:
    """Column ``page``: metadata, Markdown, canonical HTML, text, metrics and, where asked for, diagnostics; or an error."""
    o = options or X.Options()
    return _column(S.PAGE, lambda h, u: page(h, u, o), html, url, once=True)


def decode(body: Column | str, content_type: Column | str) -> Column:
    """Column of the text of raw bytes; null stays null."""
    return _column("string", lambda b, c: None if b is None else decode_html(bytes(b), c), body, content_type)


def blocks_of(html: str | None, url: str | None, options: X.Options) -> list[dict[str, Any]]:
    try:
        found = tape(X.extract(html, url, options)["blocks"])
    except X.PageError:
        return []
    names = [f.split(" ")[0] for f in S.BLOCK[7:-1].split(", ")]
    return [{n: b.get(n) for n in names} for b in found]


def page_blocks(html: Column | str, url: Column | str, options: X.Options | None = None) -> Column:
    """Column of the content's operations in order."""
    o = options or X.Options()
    return _column(f"array<{S.BLOCK}>", lambda h, u: blocks_of(h, u, o), html, url)


def nodes_of(html: str | None, budget: Budget) -> list[dict[str, Any]]:
    """The tree as nested sets: each node's place and where its subtree ends."""
    try:
        document = parse(html or "", budget)
    except LimitError:
        return []
    out: list[dict[str, Any]] = []
    stack: list[tuple[Any, int, int]] = [(document, -1, 0)]
    body, chars = None, 0
    while stack:
        node, parent, depth = stack.pop()
        if depth < 0:
            out[parent] |= {"subtree_end": len(out), "text_to": chars}
            continue
        at = len(out)
        if node.tag == "body" and body is None:
            body = at
        kind = {"#document": "document", "#text": "text", "#comment": "comment"}.get(node.tag, "element")
        out.append({"node_id": at, "parent_id": parent if parent >= 0 else None, "pre": at, "subtree_end": at + 1, "depth": depth, "kind": kind, "tag": node.tag if kind == "element" else None, "attrs": node.attrs, "text": node.text if kind == "text" else None, "text_from": chars})
        if kind == "text":
            chars += len(T.squeeze(node.text))
        stack.append((node, at, -1))
        stack.extend((c, at, depth + 1) for c in reversed(node.children))
    found = out[body] if body is not None else dict.fromkeys(("pre", "subtree_end", "text_from", "text_to"))
    around = {"body_pre": found["pre"], "body_end": found["subtree_end"], "body_from": found["text_from"], "body_to": found["text_to"]}
    for x in out:
        x |= around
    return out


def page_nodes(html: Column | str, budget: Budget | None = None) -> Column:
    """Column of the document's nodes."""
    b = budget or Budget()
    return _column(f"array<{S.NODE}>", lambda h: nodes_of(h, b), html)


def links_of(html: str | None, url: str | None) -> list[dict[str, Any]]:
    document = parse(html or "")
    base_node = next((x for x in document.elements("base") if x.get("href")), None)
    base = T.resolve(url, base_node.get("href"), ("http", "https")) if base_node is not None else url
    out = []
    for a in document.elements("a"):
        href = T.resolve(base, a.get("href")) if "href" in a.attrs else None
        if href:
            out.append({"ord": len(out), "href": href, "text": T.squeeze(a.raw_text()), "rel": a.get("rel") or None})
    return out


def page_links(html: Column | str, url: Column | str) -> Column:
    """Column of the page's links, resolved; those that the address policy rejects are left out."""
    return _column(f"array<{S.LINK}>", links_of, html, url)


def candidates_of(html: str | None, url: str | None) -> list[dict[str, Any]]:
    document = parse(html or "")
    base_node = next((x for x in document.elements("base") if x.get("href")), None)
    base = T.resolve(url, base_node.get("href"), ("http", "https")) if base_node is not None else url
    return [{"field": c.field, "value": c.value, "source": c.source, "confidence": c.confidence, "ord": c.order, "key": c.key} for c in M.candidates(document, url, base, M.json_items(document))]


def meta_candidates(html: Column | str, url: Column | str) -> Column:
    """Column of the page's metadata candidates, for native resolution."""
    return _column(f"array<{S.CANDIDATE}>", candidates_of, html, url)


def located_of(html: str | None, url: str | None) -> dict[str, Any]:
    """Where the text of the structured data that describes a page stands; nulls if nowhere."""
    none = {"tag": None, "name": None, "agreement": None}
    try:
        document = parse(html or "")
    except LimitError:
        return none
    body = document.first("body")
    item, _ = M.described(document, url, M.json_items(document))
    found = D.locate(body, D.texts_of(item), X.hidden) if body is not None else None
    return {"tag": found[0].tag, "name": found[0].get("class") or None, "agreement": found[1]} if found else none


def structured_root(html: Column | str, url: Column | str) -> Column:
    """Column of the element that shows the text of the page's structured data: tag, class and how well it agrees."""
    return _column(S.LOCATED, located_of, html, url, once=True)


def ranked_of(html: str | None) -> list[dict[str, Any]]:
    document = parse(html or "")
    body = document.first("body")
    X.prepare(body)
    X.strip_hidden(body, False)
    stats = X.Stats(body)
    return [
        {"pre": c.order, "tag": c.node.tag, "sources": sorted(c.sources), "prior": c.prior, "readability": c.readability, **{k: float(v) for k, v in c.features.items()}, "score": X.rank(c.readability, c.prior, c.features)}
        for c in X.discover(body, stats, True, None)
    ]


def rank_features(html: Column | str) -> Column:
    """Column of the best candidates' features, for native ranking."""
    return _column(f"array<{S.RANKED}>", ranked_of, html)
