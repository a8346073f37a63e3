"""Row predicates: suppress directives, size gates, kinds and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PRODUCTION, TEST

#: Leading lines in which a whole file may be ignored.
HEAD_LINES = 40


def directive_pattern(marker: str) -> str:
    """A whole-line comment (``//``, ``///``, ``//!``, ``#`` or a closed block) that starts with the marker, nothing of a longer token behind it."""
    m = re.escape(marker) + "(?![A-Za-z0-9_-])"
    return rf"(?U)^\s*(?:(?://[/!]?|#)\s*{m}|/\*\*?\s*{m}.*\*/\s*$)"


def lines_of(text: Column) -> Column:
    return F.split(text, "\r?\n")


def directive_matches(line: Column, marker: str) -> Column:
    return line.rlike(directive_pattern(marker))


def file_is_ignored(text: Column, marker: str) -> Column:
    """A ``{marker}-file`` directive stands in the first 40 lines."""
    return F.exists(F.slice(lines_of(text), 1, HEAD_LINES), lambda x: directive_matches(x, f"{marker}-file"))


def span_is_ignored(text: Column, start_line: Column, end_line: Column, marker: str) -> Column:
    """A directive stands on a line from start_line to end_line (from 1, inclusive)."""
    lines = lines_of(text)
    part = F.slice(lines, F.greatest(start_line, F.lit(1)), F.greatest(end_line - F.greatest(start_line, F.lit(1)) + 1, F.lit(0)))
    return F.exists(part, lambda x: directive_matches(x, marker))


def line_count(start_line: Column, end_line: Column) -> Column:
    return F.greatest(end_line - start_line, F.lit(0)) + 1


def below_size(nodes: Column, lines: Column, min_nodes: int, min_lines: int) -> Column:
    return (nodes < min_nodes) | (lines < min_lines)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def has_extension(path: Column, extensions: list[str]) -> Column:
    """ASCII case doesn't matter; a dot at the start of a name begins no extension."""
    ext = F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))
    return ext.isin([e.lower() for e in extensions]) & (ext != "")


def is_excluded(relative: Column, excludes: list[str]) -> Column:
    """A component of the path below the root equals an exclude."""
    return (relative != "") & F.arrays_overlap(F.split(relative, "/"), F.array(*map(F.lit, excludes)).cast("array<string>"))


def relativize(path: Column, roots: list[str]) -> Column:
    """The path below the longest root that holds it; itself if none does; its file name if it is a root."""
    out = path
    for root in sorted((r.rstrip("/") for r in roots), key=len):
        out = F.when(path == root, file_name(path)).when(path.startswith(root + "/"), path.substr(F.lit(len(root) + 2), F.length(path))).otherwise(out)
    return out


def kind_of(path: Column, lang: str) -> Column:
    """production or test by the path's name, as each language has it; Rust tells by attributes instead."""
    name, parts = file_name(path), F.split(path, "/")
    if lang == "go":
        test = name.endswith("_test.go")
    elif lang == "ts":
        test = name.contains(".test.") | name.contains(".spec.") | F.array_contains(parts, "__tests__")
    elif lang == "py":
        test = name.rlike(r"^test_.*\.py$|_test\.py$") | F.array_contains(parts, "tests") | F.array_contains(parts, "test")
    else:
        test = F.lit(False)
    return F.when(test, TEST).otherwise(PRODUCTION)


def is_declaration_file(path: Column) -> Column:
    return file_name(path).rlike(r"\.d\.(ts|mts|cts|tsx)$")


def is_stub_file(path: Column) -> Column:
    return path.endswith(".pyi")
