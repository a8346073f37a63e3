"""What normalizers share."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from ...functions.predicates import HEAD_LINES, directive_pattern
from ...schema import PRODUCTION, TEST
from .tree import Node, fingerprint, signed


class ParseError(ValueError):
    """The file can't be parsed; all of its forms are dropped."""


@dataclass
class Form:
    name: str
    start_line: int
    end_line: int
    kind: str
    node_count: int
    fps: list[int]
    cnts: list[int]
    ident_trace: list[str] = field(default_factory=list)


def _python_pattern(marker: str) -> re.Pattern[str]:
    return re.compile(directive_pattern(marker).removeprefix("(?U)"))


class Suppress:
    """Directive lines of one file."""

    def __init__(self, source: str, marker: str):
        self.lines = re.split(r"\r?\n", source)
        rx = _python_pattern(marker)
        self.at = [k + 1 for k, x in enumerate(self.lines) if marker in x and rx.match(x)]

    def span(self, start: int, end: int) -> bool:
        return any(start <= k <= end for k in self.at)


def file_ignored(source: str, marker: str) -> bool:
    rx = _python_pattern(f"{marker}-file")
    return any(rx.match(x) for x in re.split(r"\r?\n", source)[:HEAD_LINES])


class Collector:
    """Applies directives and size gates, and keeps what passes."""

    def __init__(self, source: str, marker: str, min_nodes: int, min_lines: int):
        self.suppress = Suppress(source, marker)
        self.min_nodes, self.min_lines = min_nodes, min_lines
        self.forms: list[Form] = []

    def wants(self, start: int, end: int) -> bool:
        return not self.suppress.span(start, end)

    def add(self, name: str, start: int, end: int, kind: str, tree: Node, trace: list[str]) -> None:
        bag, nodes = fingerprint(tree)
        if nodes >= self.min_nodes and max(end - start, 0) + 1 >= self.min_lines:
            fps = sorted(bag)
            self.forms.append(Form(name, start, end, kind, nodes, [signed(f) for f in fps], [bag[f] for f in fps], trace))


def kind_from_path(path: str, lang: str) -> str:
    """The rules of ``predicates.kind_of`` for one path."""
    parts = path.split("/")
    name = parts[-1]
    if lang == "go":
        test = name.endswith("_test.go")
    elif lang == "ts":
        test = ".test." in name or ".spec." in name or "__tests__" in parts
    elif lang == "py":
        test = (name.startswith("test_") and name.endswith(".py")) or name.endswith("_test.py") or "tests" in parts or "test" in parts
    else:
        test = False
    return TEST if test else PRODUCTION


def qualified(owner: str | None, name: str) -> str:
    return f"{owner}::{name}" if owner else name


__all__ = ["Collector", "Form", "Iterator", "ParseError", "Suppress", "file_ignored", "kind_from_path", "qualified"]
