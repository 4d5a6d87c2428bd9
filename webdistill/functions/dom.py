"""A document tree: nodes with ordered children."""

from __future__ import annotations

from collections.abc import Callable, Iterator


class Node:
    """An element, a text (``#text``), a comment (``#comment``) or the document (``#document``)."""

    __slots__ = ("tag", "attrs", "children", "parent", "text", "ns")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = "", ns: str = "html"):
        self.tag, self.attrs, self.text, self.ns = tag, attrs or {}, text, ns
        self.children: list[Node] = []
        self.parent: Node | None = None

    def __repr__(self) -> str:
        return f"<{self.tag} {self.attrs}>" if self.tag != "#text" else repr(self.text)

    def append(self, child: Node) -> None:
        child.detach()
        child.parent = self
        self.children.append(child)

    def insert(self, at: int, child: Node) -> None:
        child.detach()
        child.parent = self
        self.children.insert(at, child)

    def detach(self) -> None:
        if self.parent is not None:
            siblings = self.parent.children
            for i in range(len(siblings) - 1, -1, -1):
                if siblings[i] is self:
                    del siblings[i]
                    break
            self.parent = None

    def index(self) -> int:
        return next(i for i, x in enumerate(self.parent.children) if x is self)

    def replace(self, *others: Node) -> None:
        parent, at = self.parent, self.index()
        self.detach()
        for k, x in enumerate(others):
            parent.insert(at + k, x)

    def unwrap(self) -> None:
        self.replace(*list(self.children))

    def walk(self) -> Iterator[Node]:
        """This node and all below it in document order; the tree may not change meanwhile."""
        stack = [self]
        pop, extend = stack.pop, stack.extend
        while stack:
            node = pop()
            yield node
            if node.children:
                extend(node.children[::-1])

    def elements(self, *tags: str) -> list[Node]:
        if tags:
            return [x for x in self.walk() if x.tag in tags and x is not self]
        return [x for x in self.walk() if x.tag[0] != "#" and x is not self]

    def first(self, *tags: str) -> Node | None:
        return next((x for x in self.walk() if x.tag in tags), None)

    def find(self, test: Callable[[Node], bool]) -> Node | None:
        return next((x for x in self.walk() if x.tag[0] != "#" and test(x)), None)

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None and node.tag != "#document":
            yield node
            node = node.parent

    def has_ancestor(self, *tags: str) -> bool:
        return any(x.tag in tags for x in self.ancestors())

    def raw_text(self) -> str:
        return "".join(x.text for x in self.walk() if x.tag == "#text")

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def tokens(self, name: str) -> list[str]:
        return self.attrs.get(name, "").split()

    def name(self) -> str:
        """Class and id, for tests by name."""
        return f"{self.get('class')} {self.get('id')}"

    def copy(self) -> Node:
        top = Node(self.tag, dict(self.attrs), self.text, self.ns)
        stack = [(self, top)]
        while stack:
            old, new = stack.pop()
            for child in old.children:
                made = Node(child.tag, dict(child.attrs), child.text, child.ns)
                made.parent = new
                new.children.append(made)
                if child.children:
                    stack.append((child, made))
        return top


def intervals(root: Node) -> tuple[list[Node], dict[int, int], dict[int, int]]:
    """All nodes in document order, and by identity each one's place and where its subtree ends."""
    order = list(root.walk())
    place = {id(x): i for i, x in enumerate(order)}
    end: dict[int, int] = {}
    for i in range(len(order) - 1, -1, -1):
        node = order[i]
        end[id(node)] = end[id(node.children[-1])] if node.children else i + 1
    return order, place, end


def shallow(root: Node, most: int, blocks: frozenset[str], hidden: Callable[[Node], bool]) -> int:
    """Bring a tree to at most about ``most`` levels without losing text; returns how many elements went.

    Elements on paths that are too deep are kept in the upper half of the levels; below it their content takes their
    place, bare inline content of a block within a ``div``. Elements beside those paths stay whole. What a hidden element
    holds there goes with it.
    """
    order, _, _ = intervals(root)
    height: dict[int, int] = {}
    for node in reversed(order):
        height[id(node)] = 1 + max((height[id(c)] for c in node.children), default=0)
    if height[id(root)] <= most:
        return 0
    gone = 0
    stack: list[tuple[Node, int]] = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if depth < most // 2 or node.tag in ("table", "thead", "tbody", "tfoot", "tr", "ul", "ol", "menu", "dl"):  # parts of a table or list hold no text themselves
            stack.extend((c, depth + 1) for c in node.children if depth + 1 + height[id(c)] > most)
            continue
        kept: list[Node] = []
        run: list[Node] = []  # inline content of a block that went

        def flush() -> None:
            if any(x.tag != "#text" or x.text.strip() for x in run):  # noqa: B023
                holder = Node("div")
                for x in run:  # noqa: B023
                    x.parent = holder
                holder.children = list(run)  # noqa: B023
                kept.append(holder)  # noqa: B023
            run.clear()  # noqa: B023

        inner: list[Node | None] = list(reversed(node.children))  # None: a block's bounds
        while inner:
            x = inner.pop()
            if x is None:
                flush()
            elif height[id(x)] <= most // 2:
                if x.tag in blocks:
                    flush()
                    kept.append(x)
                else:
                    run.append(x)
            else:
                gone += 1
                if hidden(x):
                    continue
                bounds = [None] if x.tag in blocks else []
                inner.extend([*bounds, *reversed(x.children), *bounds])
        flush()
        for x in kept:
            x.parent = node
        node.children = kept
    return gone
