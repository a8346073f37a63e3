"""Source files: which ones there are, and their text as a DataFrame."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import has_extension, is_excluded, relativize


class WalkError(OSError):
    """A root or folder that can't be walked."""


def matches_extension(path: str, extensions: tuple[str, ...]) -> bool:
    ext = os.path.splitext(os.path.basename(path))[1][1:]
    return bool(ext) and ext.lower() in {e.lower() for e in extensions}


def path_order(path: str) -> list[str]:
    """Component by component: a/b stands before a-b/c."""
    return path.split("/")


def _walk(path: str, root: str, extensions: tuple[str, ...], excludes: frozenset[str]) -> Iterator[str]:
    below = os.path.relpath(path, root)
    if below != "." and not excludes.isdisjoint(below.split(os.sep)):
        return
    try:
        mode = os.lstat(path).st_mode
        if stat.S_ISLNK(mode):
            if path == root:
                raise WalkError(f"root is a symbolic link: {path}")
        elif stat.S_ISDIR(mode):
            for name in sorted(os.listdir(path)):
                yield from _walk(os.path.join(path, name), root, extensions, excludes)
        elif stat.S_ISREG(mode) and matches_extension(path, extensions):
            yield path
    except WalkError:
        raise
    except OSError as e:
        raise WalkError(f"cannot walk {path}: {e}") from e


def absolutize(roots: list[str], cwd: str | None = None) -> list[str]:
    return [os.path.join(cwd or os.getcwd(), r).rstrip("/") or "/" for r in roots]


def collect_source_files(roots: list[str], extensions: tuple[str, ...], excludes: tuple[str, ...]) -> list[str]:
    """Regular files below the roots with one of the extensions, in path order, each once. Links are not followed; a root must not be one."""
    found = {p for r in roots for p in _walk(r, r, extensions, frozenset(excludes))}
    return sorted(found, key=path_order)


def relative_path(path: str, roots: list[str]) -> str:
    """The path below the longest root that holds it; the file's name if it is a root itself."""
    for root in sorted(roots, key=len, reverse=True):
        if path == root:
            return os.path.basename(path)
        if path.startswith(root.rstrip("/") + "/"):
            return path[len(root.rstrip("/")) + 1 :]
    return path


FILES = "file_seq bigint, path string, source string, warning string"


def local_files(spark: SparkSession, roots: list[str], extensions: tuple[str, ...], excludes: tuple[str, ...], max_bytes: int) -> DataFrame:
    """(file_seq, path, source, warning) of local source trees, for folders that all workers see.

    Only names reach the driver. Executors read the files; those that are too large, no
    regular files any more, or not UTF-8 have a warning instead of a source.
    """
    roots = absolutize(roots)
    names = [(k, p, relative_path(p, roots)) for k, p in enumerate(collect_source_files(roots, extensions, excludes))]
    rows = spark.createDataFrame(names, "file_seq bigint, full string, path string")

    def read(full: str, shown: str) -> tuple[str | None, str | None]:
        try:
            info = os.lstat(full)
            if not stat.S_ISREG(info.st_mode):
                return None, f"{shown}: not a regular file"
            if info.st_size > max_bytes:
                return None, f"{shown}: {info.st_size} bytes exceed the limit of {max_bytes}"
            with open(full, "rb") as f:
                return f.read().decode("utf-8"), None
        except (OSError, UnicodeDecodeError) as e:
            return None, f"{shown}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                got = [read(f, p) for f, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["file_seq", "path", "source", "warning"])

    return rows.repartition(max(1, min(len(names) // 16 + 1, spark.sparkContext.defaultParallelism * 4))).mapInArrow(run, FILES)


def store_files(spark: SparkSession, roots: list[str], extensions: tuple[str, ...], excludes: tuple[str, ...], max_bytes: int) -> DataFrame:
    """The same for any store that Spark reads, by its own file source: sizes and names are filtered before contents are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    clean = [r.rstrip("/") for r in roots]
    shown = relativize(F.col("full"), clean)
    rows = found.select(F.regexp_replace("path", "^file:(//)?(?=/)", "").alias("full"), "length", "content").withColumn("path", shown)
    rows = rows.where(has_extension(F.col("path"), list(extensions)) & ~is_excluded(F.col("path"), list(excludes)))
    fits = F.col("length") <= max_bytes
    text = F.try_validate_utf8(F.col("content").cast("string"))
    warning = F.when(~fits, F.concat("path", F.lit(": "), F.col("length").cast("string"), F.lit(f" bytes exceed the limit of {max_bytes}"))).when(text.isNull(), F.concat("path", F.lit(": not valid UTF-8")))
    return rows.select(F.xxhash64("full").alias("file_seq"), "path", F.when(fits, text).alias("source"), warning.alias("warning"))
