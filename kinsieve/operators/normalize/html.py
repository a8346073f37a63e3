"""HTML pages: one form a page, its tree of elements."""

from __future__ import annotations

from html.parser import HTMLParser

from ...schema import PRODUCTION
from .common import Collector, Form
from .tree import Node, leaf

#: Fixed list: elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Builder(HTMLParser):
    """A tree whatever the input: unknown ends are ignored, open elements end with the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: Node = ("page", [])
        self.open = [self.root]
        self.trace: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node: Node = (tag, [leaf(f"@{k}") for k, _ in attrs])
        self.trace += [v or "" for _, v in attrs]
        self.open[-1][1].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.open[-1][1].append(leaf("text"))
            self.trace.append(" ".join(data.split()))


def page_tree(html: str) -> tuple[Node, list[str]]:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root, b.trace


def normalize(path: str, source: str, marker: str, min_nodes: int, min_lines: int) -> list[Form]:
    out = Collector(source, marker, min_nodes, min_lines)
    tree, trace = page_tree(source)
    if out.wants(1, len(out.suppress.lines)):
        out.add(path.split("/")[-1], 1, len(out.suppress.lines), PRODUCTION, tree, trace)
    return out.forms
