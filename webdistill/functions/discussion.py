"""Discussions of sites that no rule knows, by the marks that their posts share."""

from __future__ import annotations

import re

from webdistill.functions import text as T
from webdistill.functions.dom import Node, intervals

#: Marks of posts, their bodies and authors: fixed values of the vocabularies that sites use.
_POSTING, _REPLY = re.compile(r"/(?:DiscussionForumPosting|Question)$"), re.compile(r"/(?:Comment|Answer)$")
_BODY = ("e-content", "story_text", "comment_text", "comment-body", "comment-content", "post-body", "message-body")
_AUTHOR = ("p-author", "h-card", "u-author", "comment-author", "author", "username")
_IDS = ("data-shortid", "data-comment-id", "data-id", "id")


def _own(node: Node, posts: set[int]) -> list[Node]:
    """The elements of a post without those of posts within it."""
    out, stack = [], list(reversed(node.children))
    while stack:
        x = stack.pop()
        if x.tag[0] == "#" or id(x) in posts:
            continue
        out.append(x)
        stack.extend(reversed(x.children))
    return out


def _part(own: list[Node], classes: tuple[str, ...], props: tuple[str, ...]) -> Node | None:
    return next((x for x in own if set(x.tokens("class")) & set(classes) or set(x.tokens("itemprop")) & set(props)), None)


def identity(node: Node) -> str | None:
    return next((node.get(k) for k in _IDS if node.get(k)), None)


def thread(body: Node) -> tuple[Node | None, Node, list[tuple[int, str, Node]]] | None:
    """Title, opening and replies (depth, author, body) of a page that marks its opening post and two or more replies; else None.

    Replies are elements of one mark (class ``comment`` with an id, or a comment's or answer's type); those around give
    the depth. A reply that stands twice, by its id, counts once. Replies that all say the same are no discussion.
    """
    order, place, end = intervals(body)
    opening = next((x for x in order if x.tag[0] != "#" and ("h-entry" in x.tokens("class") and "comment" not in x.tokens("class") or _POSTING.search(x.get("itemtype")))), None)
    if opening is None:
        return None
    replies = [x for x in order if x.tag[0] != "#" and ("comment" in x.tokens("class") and identity(x) or _REPLY.search(x.get("itemtype")))]
    posts = {id(x) for x in replies}
    own = _own(opening, posts)
    title = next((x for x in own if re.fullmatch("h[1-3]", x.tag) or "u-url" in x.tokens("class") or {"headline", "name"} & set(x.tokens("itemprop"))), None)
    text = _part(own, _BODY, ("articleBody", "text"))
    if text is None:  # beside the opening, as far as the replies
        until = min((place[id(x)] for x in replies), default=len(order))
        text = next((x for x in order[end[id(opening)] : until] if x.tag[0] != "#" and set(x.tokens("class")) & set(_BODY)), None)
    if title is None or text is None:
        return None
    found: list[tuple[int, str, Node]] = []
    seen: set[str] = set()
    around: list[Node] = []
    for x in replies:
        while around and end[id(around[-1])] <= place[id(x)]:
            around.pop()
        depth = len(around)
        around.append(x)
        mine = _own(x, posts)
        said = _part(mine, _BODY, ("text",))
        key = identity(x)
        if said is None or key is not None and key in seen:
            continue
        seen |= {key} if key is not None else set()
        author = _part(mine, _AUTHOR, ("author",))
        found.append((depth, T.squeeze(author.raw_text()) if author is not None else "", said))
    if len({T.squeeze(x.raw_text()) for _, _, x in found}) < 2:
        return None
    return title, text, found
