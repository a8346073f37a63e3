"""Trees of labels and the bags of their subtrees' digests."""

from __future__ import annotations

from collections import Counter

#: Fixed values of FNV-1a with 64 bits.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
MASK = (1 << 64) - 1

#: (label, children)
Node = tuple[str, list]


def leaf(label: str) -> Node:
    return (label, [])


def branch(label: str, children: list[Node]) -> Node:
    return (label, children)


def fnv1a(data: bytes, state: int = FNV_OFFSET) -> int:
    for b in data:
        state = ((state ^ b) * FNV_PRIME) & MASK
    return state


_LABELS: dict[str, int] = {}


def hash_subtree(label: str, children: list[int]) -> int:
    """FNV-1a over the label's bytes, a zero byte and the children's digests, little-endian."""
    state = _LABELS.get(label)
    if state is None:
        if len(_LABELS) > 100_000:
            _LABELS.clear()
        state = _LABELS[label] = fnv1a(label.encode() + b"\0")
    for d in children:
        state = fnv1a(d.to_bytes(8, "little"), state)
    return state


def fingerprint(root: Node) -> tuple[Counter[int], int]:
    """(digest -> how often, count of nodes) of all subtrees. It keeps its own stack, so depth doesn't matter."""
    bag: Counter[int] = Counter()
    stack: list[tuple[Node, int, list[int]]] = [(root, 0, [])]
    nodes = 0
    while stack:
        node, at, done = stack.pop()
        if at < len(node[1]):
            stack.append((node, at + 1, done))
            stack.append((node[1][at], 0, []))
            continue
        digest = hash_subtree(node[0], done)
        bag[digest] += 1
        nodes += 1
        if stack:
            stack[-1][2].append(digest)
    return bag, nodes


def signed(digest: int) -> int:
    """The same 64 bits as BIGINT has them."""
    return digest - (1 << 64) if digest >> 63 else digest


class Placeholders:
    """Names become id0, id1, ... in order of first sight, within one form; the trace keeps their spelling."""

    def __init__(self) -> None:
        self.by_name: dict[str, str] = {}
        self.trace: list[str] = []

    def __call__(self, name: str) -> str:
        self.trace.append(name)
        return self.by_name.setdefault(name, f"id{len(self.by_name)}")
