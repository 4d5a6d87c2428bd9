"""Pages of known shapes: discussions and listings."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from webdistill.functions import discussion
from webdistill.functions import text as T
from webdistill.functions.dom import Node

_SHARES = {"chatgpt.com": "/share/", "chat.openai.com": "/share/", "claude.ai": "/share/", "gemini.google.com": "/share/", "grok.com": "/share/"}


def _element(tag: str, *children: Node | str, **attrs: str) -> Node:
    out = Node(tag, dict(attrs))
    for c in children:
        out.append(Node("#text", text=c) if isinstance(c, str) else c)
    return out


def build(title: str | None, first: Node | None, replies: list[tuple[int, str, Node]]) -> Node | None:
    """A discussion: its opening and the replies (depth, author, body), each quoted under its nearest parent that is left."""
    out = _element("div")
    if first is not None:
        out.append(first)
    if replies:
        out.append(_element("h2", "Comments"))
    open_at: list[tuple[int, Node]] = []
    for depth, author, body in replies:
        while open_at and open_at[-1][0] >= depth:
            open_at.pop()
        quote = _element("blockquote", _element("p", _element("strong", author or "anonymous")))
        for c in list(body.children):
            quote.append(c)
        (open_at[-1][1] if open_at else out).append(quote)
        if len(open_at) < 4096:
            open_at.append((depth, quote))
    return out if first is not None or replies else None


def _all(root: Node, cls: str) -> list[Node]:
    return [x for x in root.walk() if cls in x.tokens("class")]


def _one(root: Node, cls: str) -> Node | None:
    return next(iter(_all(root, cls)), None)


def find(document: Node, url: str | None) -> tuple[str | None, Node | None]:
    """Page kind and content of the first shape that fits; nothing for ordinary pages."""
    try:
        parts = urlsplit(url or "")
    except ValueError:
        return None, None
    host = (parts.hostname or "").removeprefix("www.")
    body = document.first("body") or document
    if host == "news.ycombinator.com":
        rows = _all(body, "athing")
        if "item" in parts.path:
            replies = []
            for x in rows:
                text = _one(x, "commtext")
                if text is None:
                    continue
                indent = _one(x, "ind")
                depth = int(re.sub(r"\D", "", (indent.get("indent") if indent is not None else "") or "0") or 0)
                user = _one(x, "hnuser")
                replies.append((depth, T.squeeze(user.raw_text()) if user is not None else "", text.copy()))
            top = _one(body, "toptext")
            return "Discussion", build(None, top.copy() if top is not None else None, replies)
        lines = [_one(x, "titleline") for x in rows]
        if len([x for x in lines if x is not None]) >= 2:
            return "Listing", _element("div", _element("ol", *[_element("li", *[c.copy() for c in x.children]) for x in lines if x is not None]))
    if host == "github.com" and re.search(r"/(issues|pull)/\d+", parts.path):
        bodies = _all(body, "comment-body") or _all(body, "markdown-body")
        if bodies:
            users = [T.squeeze(x.raw_text()) for x in _all(body, "author")]
            return "Discussion", build(None, bodies[0].copy(), [(0, users[i + 1] if i + 1 < len(users) else "", b.copy()) for i, b in enumerate(bodies[1:])])
    posts = _all(body, "topic-post") or (_all(body, "crawler-post") if _one(body, "crawler-post") is not None else [])
    if posts:
        made = []
        for p in posts:
            cooked = _one(p, "cooked") or _one(p, "post")
            user = _one(p, "username") or _one(p, "creator")
            if cooked is not None:
                made.append((0, T.squeeze(user.raw_text()) if user is not None else "", cooked.copy()))
        if made:
            return "Discussion", build(None, made[0][2], made[1:])
    if host.endswith("reddit.com") and _one(body, "commentarea") is not None:
        replies = []
        for x in _all(_one(body, "commentarea"), "comment"):
            if "deleted" in x.tokens("class"):
                continue
            md = _one(x, "md")
            user = _one(x, "author")
            depth = sum("comment" in a.tokens("class") for a in x.ancestors())
            if md is not None:
                replies.append((depth, T.squeeze(user.raw_text()) if user is not None else "", md.copy()))
        first = _one(body, "expando")
        first = _one(first, "md") if first is not None else None
        return "Discussion", build(None, first.copy() if first is not None else None, replies)
    if any(host == h and parts.path.startswith(p) for h, p in _SHARES.items()):
        turns = [x for x in body.elements() if x.get("data-message-author-role")]
        if turns:
            return "Discussion", build(None, None, [(0, x.get("data-message-author-role"), x.copy()) for x in turns])
    if (found := discussion.thread(body)) is not None:
        _, opening, replies = found
        return "Discussion", build(None, opening.copy(), [(depth, author, said.copy()) for depth, author, said in replies])
    return None, None


#: Labels of a job's summary and where its structured data has them. Fixed values.
JOB_FIELDS = (("Role", "title"), ("Company", "hiringOrganization"), ("Location", "jobLocation"), ("Employment", "employmentType"), ("Salary", "baseSalary"), ("Workplace", "jobLocationType"))


def _said(value) -> str:
    if isinstance(value, list):
        return ", ".join(filter(None, map(_said, value)))
    if not isinstance(value, dict):
        return "" if value is None else T.squeeze(str(value))
    if "address" in value:
        return _said(value["address"])
    if "addressLocality" in value or "addressRegion" in value or "addressCountry" in value:
        return ", ".join(filter(None, (_said(value.get(k)) for k in ("addressLocality", "addressRegion", "addressCountry"))))
    if "minValue" in value or "maxValue" in value:
        low, high = _said(value.get("minValue")), _said(value.get("maxValue"))
        return (f"{low}–{high}" if low and high and low != high else low or high) + (f" per {_said(value['unitText']).lower()}" if value.get("unitText") else "")
    if "currency" in value:
        return T.squeeze(f"{_said(value['currency'])} {_said(value.get('value'))}")
    return _said(value.get("name") or value.get("value"))


def job_summary(items: list[dict]) -> list[tuple[str, str]]:
    """Labels and values of the only job that the structured data describes."""
    jobs = [x for x in items if "JobPosting" in str(x.get("@type"))]
    return [(label, v) for label, key in JOB_FIELDS if (v := _said(jobs[0].get(key)))] if len(jobs) == 1 else []
