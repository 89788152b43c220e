"""An adaptive radix tree over byte strings: node layouts that grow, compressed paths.

Inner nodes hold up to 4, 16, 48 or 256 children in layouts of that size and move
to the next one when full.  Bytes that all keys below a node share are kept once in
the node.  A key may end at an inner node, so keys of different length, one the
beginning of another, live together.
"""

from __future__ import annotations


class Few:
    """Up to ``most`` children: their bytes side by side, searched."""

    __slots__ = ("bytes", "below", "most")

    def __init__(self, most: int = 4):
        self.bytes, self.below, self.most = bytearray(), [], most

    def get(self, b: int):
        at = self.bytes.find(b)
        return self.below[at] if at >= 0 else None

    def put(self, b: int, node):
        at = self.bytes.find(b)
        if at >= 0:
            self.below[at] = node
            return self
        if len(self.below) == self.most:
            bigger = Few(16) if self.most == 4 else Indexed()
            for x, n in self.items():
                bigger.put(x, n)
            return bigger.put(b, node)
        self.bytes.append(b)
        self.below.append(node)
        return self

    def items(self):
        return zip(self.bytes, self.below)


class Indexed:
    """Up to 48 children behind a table of 256 places."""

    __slots__ = ("place", "below")

    def __init__(self):
        self.place, self.below = bytearray(256), []

    def get(self, b: int):
        at = self.place[b]
        return self.below[at - 1] if at else None

    def put(self, b: int, node):
        if self.place[b]:
            self.below[self.place[b] - 1] = node
            return self
        if len(self.below) == 48:
            bigger = Full()
            for x, n in self.items():
                bigger.put(x, n)
            return bigger.put(b, node)
        self.below.append(node)
        self.place[b] = len(self.below)
        return self

    def items(self):
        return ((b, self.below[at - 1]) for b, at in enumerate(self.place) if at)


class Full:
    """A child for every byte."""

    __slots__ = ("below",)

    def __init__(self):
        self.below = [None] * 256

    def get(self, b: int):
        return self.below[b]

    def put(self, b: int, node):
        self.below[b] = node
        return self

    def items(self):
        return ((b, n) for b, n in enumerate(self.below) if n is not None)


class Node:
    """Shared bytes, children and what ends here (``value``)."""

    __slots__ = ("path", "children", "value")

    def __init__(self, path: bytes, value=None):
        self.path, self.children, self.value = path, Few(), value


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:   # the first different byte lies in low..n
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


class Tree:
    def __init__(self):
        self.root = Node(b"")

    def at(self, key: bytes) -> Node:
        """The node at which ``key`` ends, made if it is not there."""
        node, pos = self.root, 0
        while pos < len(key):
            child = node.children.get(key[pos])
            if child is None:
                new = Node(key[pos:])
                node.children = node.children.put(key[pos], new)
                return new
            rest = key[pos:pos + len(child.path)]
            same = _shared(child.path, rest)
            if same < len(child.path):
                upper = Node(child.path[:same])
                child.path = child.path[same:]
                upper.children = upper.children.put(child.path[0], child)
                node.children = node.children.put(key[pos], upper)
                child = upper
            node, pos = child, pos + same
        return node

    def walk(self):
        """``(node, key length above it, going down?)`` in depth-first order, each node before and after its children."""
        stack = [(self.root, 0, True)]
        while stack:
            node, start, down = stack.pop()
            yield node, start, down
            if down:
                stack.append((node, start, False))
                stack += [(n, start + len(node.path), True) for _, n in node.children.items()]
