"""Compressed radix trie over byte strings, for exact equality of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

# Rough memory of a node and of its value beside the bytes of its label.
_NODE = 300


class _Node:
    __slots__ = ("children", "label", "value")

    def __init__(self, label: bytes, value=None):
        self.label = label
        self.children: dict[int, _Node] | None = None
        self.value = value


def _shared(label: bytes, key: bytes, start: int) -> int:
    """Length of the common prefix of ``label`` and ``key[start:]``."""
    low, high = 0, min(len(label), len(key) - start)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == key[start + low : start + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """Keys are byte strings; every key has one value, kept at its terminal node."""

    def __init__(self):
        self.root = _Node(b"")
        self.bytes = 0

    def find_or_add(self, key: bytes, new):
        """The value stored for ``key``; ``new`` is stored and returned if there was none."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at]) if node.children else None
            if child is None:
                child = _Node(key[at:], new)
                if node.children is None:
                    node.children = {}
                node.children[key[at]] = child
                self.bytes += _NODE + len(child.label)
                return new
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            length = _shared(child.label, key, at)
            fork = _Node(child.label[:length])
            child.label = child.label[length:]
            fork.children = {child.label[0]: child}
            node.children[key[at]] = fork
            self.bytes += _NODE
            node, at = fork, at + length
        if node.value is None:
            node.value = new
        return node.value

    def values(self) -> Iterator:
        return (node.value for node in _below(self.root) if node.value is not None)

    def take_all(self) -> Iterator:
        """Remove the whole trie and give its values."""
        root, self.root, self.bytes = self.root, _Node(b""), 0
        yield from (node.value for node in _below(root) if node.value is not None)

    def take_before(self, key: bytes) -> Iterator:
        """Remove every subtree that lies wholly before ``key`` and give its values."""
        node, at = self.root, 0
        while node.children and at < len(key):
            for first in [x for x in node.children if x < key[at]]:
                for gone in _below(node.children.pop(first)):
                    self.bytes -= _NODE + len(gone.label)
                    if gone.value is not None:
                        yield gone.value
            child = node.children.get(key[at])
            if child is None or not key.startswith(child.label, at):
                if child is not None and child.label < key[at : at + len(child.label)]:
                    node.children.pop(key[at])
                    for gone in _below(child):
                        self.bytes -= _NODE + len(gone.label)
                        if gone.value is not None:
                            yield gone.value
                return
            node, at = child, at + len(child.label)


def _below(node: _Node) -> Iterator[_Node]:
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        if node.children:
            stack.extend(node.children.values())
