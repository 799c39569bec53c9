"""A compressed trie over byte strings that keeps the smallest id of each."""

from __future__ import annotations

from collections.abc import Iterator


def shared(a: bytes, b: bytes) -> int:
    """How many bytes two strings have in common from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is common, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class _Node:
    __slots__ = ("label", "children", "terminal", "least")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, _Node] = {}
        #: Number of the string that ends here, -1 for none.
        self.terminal = -1
        self.least: int | None = None


class RadixTrie:
    """Strings are numbered in the order in which they are first inserted."""

    def __init__(self) -> None:
        self.root = _Node(b"")
        self.size = 0

    def insert(self, text: bytes, number: int | None) -> int:
        """Insert a string; its terminal keeps the smallest of the ids that are no ``None``. Returns the string's number."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = _Node(text[at:])
                node, at = child, len(text)
                break
            label = child.label
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            # The edge is split where the string leaves it.
            k = shared(label, text[at : at + len(label)])
            middle = _Node(label[:k])
            child.label = label[k:]
            middle.children[label[k]] = child
            node.children[text[at]] = middle
            node, at = middle, at + k
        if node.terminal < 0:
            node.terminal, node.least = self.size, number
            self.size += 1
        elif number is not None and (node.least is None or number < node.least):
            node.least = number
        return node.terminal

    def terminals(self) -> Iterator[tuple[int, bytes, int | None]]:
        """``number, string, smallest id`` of every string, in byte order."""
        stack = [(self.root, b"")]
        while stack:
            node, before = stack.pop()
            text = before + node.label
            if node.terminal >= 0:
                yield node.terminal, text, node.least
            for first in sorted(node.children, reverse=True):
                stack.append((node.children[first], text))

    def least(self) -> list[int | None]:
        """The smallest id of each string by its number."""
        out: list[int | None] = [None] * self.size
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.terminal >= 0:
                out[node.terminal] = node.least
            stack.extend(node.children.values())
        return out
