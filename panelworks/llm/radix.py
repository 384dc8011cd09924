"""An adaptive radix tree over byte strings whose nodes add up weights."""

from __future__ import annotations

from collections.abc import Iterator

SMALL, MEDIUM, LARGE = 4, 16, 48  # children that a layout holds before it grows; the last one holds all 256


class Node:
    """The bytes that lead here from the parent, children in one of four layouts, sums over all keys below.

    With up to 16 children ``index`` lists their first bytes beside ``kids``; with up to 48 it maps all
    256 bytes to places in ``kids``; beyond, ``kids`` has a place for every byte.
    """

    __slots__ = ("path", "limit", "index", "kids", "sums", "least", "row")

    def __init__(self, path: bytes, sums: list[int], least: int, row: int) -> None:
        self.path, self.sums, self.least, self.row = path, sums, least, row
        self.limit, self.index, self.kids = SMALL, bytearray(), []

    def find(self, first: int) -> Node | None:
        if self.limit <= MEDIUM:
            at = self.index.find(first)
            return self.kids[at] if at >= 0 else None
        if self.limit == LARGE:
            at = self.index[first]
            return self.kids[at - 1] if at else None
        return self.kids[first]

    def add(self, first: int, kid: Node) -> None:
        if self.limit < 256 and len(self.kids) == self.limit:
            self._grow()
        if self.limit <= MEDIUM:
            self.index.append(first)
            self.kids.append(kid)
        elif self.limit == LARGE:
            self.kids.append(kid)
            self.index[first] = len(self.kids)
        else:
            self.kids[first] = kid

    def _grow(self) -> None:
        old, at = self.kids, self.index
        if self.limit == SMALL:
            self.limit = MEDIUM
        elif self.limit == MEDIUM:
            self.limit, self.index = LARGE, bytearray(256)
            for place, first in enumerate(at):
                self.index[first] = place + 1
        else:
            self.limit, self.kids, self.index = 256, [None] * 256, bytearray()
            for first in range(256):
                if at[first]:
                    self.kids[first] = old[at[first] - 1]

    def children(self) -> Iterator[Node]:
        return (kid for kid in self.kids if kid is not None)

    def split(self, size: int) -> None:
        """Keep the first ``size`` bytes here; the rest, with all children, becomes the only child."""
        lower = Node(self.path[size:], list(self.sums), self.least, self.row)
        lower.limit, lower.index, lower.kids = self.limit, self.index, self.kids
        self.path, self.limit = self.path[:size], SMALL
        self.index, self.kids = bytearray(lower.path[:1]), [lower]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings that differ."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        half = (low + high + 1) // 2
        if a[:half] == b[:half]:
            low = half
        else:
            high = half - 1
    return low


class RadixTree:
    """Keys with weights, a number (of which nodes keep the least) and a row (nodes keep one below them)."""

    def __init__(self, weights: int) -> None:
        self.root = Node(b"", [0] * weights, 1 << 63, -1)

    def insert(self, key: bytes, weights: list[int], number: int, row: int) -> None:
        node, at = self.root, 0
        while True:
            path = node.path
            if key[at : at + len(path)] != path:
                node.split(_common(key[at:], path))
            node.sums = [s + w for s, w in zip(node.sums, weights)]
            if number < node.least:
                node.least = number
            at += len(node.path)
            if at == len(key):
                return
            kid = node.find(key[at])
            if kid is None:
                node.add(key[at], Node(key[at:], list(weights), number, row))
                return
            node = kid

    def aligned(self, width: int, after: int) -> Iterator[tuple[int, Node]]:
        """(depth in units of ``width`` bytes, node) for every such depth beyond ``after`` units.

        Depths inside a compressed path count as well: they have the sums of the node below.
        """
        stack = [(self.root, 0)]
        while stack:
            node, at = stack.pop()
            end = at + len(node.path)
            for depth in range(max(at // width, after) + 1, end // width + 1):
                yield depth, node
            stack.extend((kid, end) for kid in node.children())
