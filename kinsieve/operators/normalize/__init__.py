"""Normalizers: source text to forms, by language. Each is a generator of rows (a table function)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import braced, html, python
from .common import Form, ParseError, file_ignored

Normalizer = Callable[[str, str, str, int, int], list[Form]]
REGISTRY: dict[str, Normalizer] = {"py": python.normalize, "html": html.normalize, "rs": partial(braced.normalize, "rs"), "go": partial(braced.normalize, "go"), "ts": partial(braced.normalize, "ts")}
#: Directive that leaves a function out; with -file, a whole file.
MARKER = "kinsieve-{lang}:ignore"
NORMALIZED = "file_seq bigint, seq int, path string, warning string, name string, start_line int, end_line int, kind string, node_count int, fps array<bigint>, cnts array<bigint>, ident_trace array<string>"


def register(lang: str, normalizer: Normalizer) -> None:
    """Adds a language. Executors need the module that defines it."""
    REGISTRY[lang] = normalizer


def rows_of(file_seq: int | None, path: str, source: str, lang: str, marker: str, min_nodes: int, min_lines: int) -> Iterator[tuple]:
    """A row for each form of a file, or one with a warning; a parse error drops all of its forms."""
    if file_ignored(source, marker):
        return
    try:
        forms = REGISTRY[lang](path, source, marker, min_nodes, min_lines)
    except ParseError as e:
        yield (file_seq, 0, path, f"{path}: {e}", None, None, None, None, None, None, None, None)
        return
    for k, f in enumerate(forms):
        yield (file_seq, k, path, None, f.name, f.start_line, f.end_line, f.kind, f.node_count, f.fps, f.cnts, f.ident_trace)


def normalize_files(files: DataFrame, lang: str, min_nodes: int, min_lines: int, marker: str | None = None) -> DataFrame:
    """NORMALIZED rows of files (file_seq, path, source); files without a source have none."""
    marker = marker or MARKER.format(lang=lang)
    names = [x.split(" ")[0] for x in NORMALIZED.split(", ")]
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
    make = REGISTRY[lang]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        REGISTRY.setdefault(lang, make)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                rows = [r for f in zip(*(c.to_pylist() for c in b.slice(at, 64).columns), strict=True) for r in rows_of(*f, lang, marker, min_nodes, min_lines)]
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return files.where(F.col("source").isNotNull()).select("file_seq", "path", "source").mapInArrow(run, NORMALIZED)


def forms_and_bag(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forms, bag) of normalized rows; ids follow the order of files and of forms in them."""
    rows = normalized.where("warning is null").withColumn("id", F.col("file_seq") * (1 << 24) + F.col("seq"))
    forms = rows.select("id", "path", "name", "start_line", "end_line", "kind", "node_count", "ident_trace")
    bag = rows.select(F.col("id").alias("form_id"), F.explode(F.arrays_zip("fps", "cnts")).alias("e")).select("form_id", F.col("e.fps").alias("fp"), F.col("e.cnts").alias("cnt"))
    return forms, bag


def register_udtf(spark: SparkSession, name: str = "normalize") -> None:
    """SQL: FROM files, LATERAL normalize(file_seq, path, source, lang, min_nodes, min_lines)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=NORMALIZED)
    class Normalize:
        def eval(self, file_seq: int, path: str, source: str, lang: str, min_nodes: int, min_lines: int):  # noqa: ANN202
            yield from rows_of(file_seq, path, source, lang, MARKER.format(lang=lang), min_nodes, min_lines)

    spark.udtf.register(name, Normalize)
