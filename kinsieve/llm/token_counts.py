"""Exact token counts at every prefix, without re-encoding.

The prefix table of ``bpe`` holds the token count of every prefix of a word; a text's table is made of
its words'. Stored with a document it answers "how many tokens are in the first k characters", "where do I
cut to stay within a budget" and "is it over the limit" by look-ups. Counts of the query are those that the
tables end with, kept for words and chunks, and added up to counts at all chunks' ends; those tell whether the
text is over the limit and which chunk holds the cut, and that chunk's own prefix table the cut itself.

Defined results for odd input: a null text counts as the empty one, with 0 tokens; strings
of special tokens inside texts become those tokens, as the library's default has it;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from ._common import text_of

LIMIT = 2048


class PrefixCounts:
    """The counts of one text's prefixes: ``counts[k]`` tokens in the first k characters."""

    def __init__(self, counts: list[int]):
        self.counts = counts

    def total(self) -> int:
        return self.counts[-1]

    def within(self, budget: int) -> int:
        """The most characters whose tokens fit the budget, with all shorter prefixes fitting as well."""
        if self.counts[-1] <= budget and max(self.counts) <= budget:
            return len(self.counts) - 1
        reached, most = [], 0
        for c in self.counts:  # counts may dip by a token where a merge completes
            most = max(most, c)
            reached.append(most)
        return max(0, bisect_right(reached, budget) - 1)


def prefix_counts(text: str, vocabulary: str | None = None) -> PrefixCounts:
    return PrefixCounts(bpe.model(vocabulary or bpe.default_vocabulary()).prefix_counts(text))


#: vocabulary -> chunk -> tokens
_KEPT: dict[str, bpe.Recent] = {}


class Counter:
    """Counts of texts, from the prefix tables of their words."""

    def __init__(self, vocabulary: str, limit: int):
        self.model, self.limit = bpe.model(vocabulary), limit
        self.count = _KEPT.setdefault(vocabulary, bpe.Recent(self.model.chunk_count, bpe.CACHED_CHUNKS)).__getitem__

    def __call__(self, text: str) -> tuple[int, bool, int]:
        """(tokens, whether they are over the limit, characters of the longest prefix that isn't)."""
        ends = list(accumulate(map(self.count, bpe.CHUNK.findall(text))))
        if not ends or ends[-1] <= self.limit:
            return (ends[-1] if ends else 0), self.limit < 0, len(text)
        return ends[-1], True, self.cut(text, ends)

    def cut(self, text: str, ends: list[int]) -> int:
        """The longest prefix within the limit: up to the chunk that passes it, and what fits of that."""
        k = bisect_right(ends, self.limit)
        at = next(islice(bpe.CHUNK.finditer(text), k, None))
        room = self.limit - (ends[k - 1] if k else 0)
        fits = [n for n, c in enumerate(self.model.chunk_prefixes(at.group()), 1) if c <= room]
        return at.start() + (fits[-1] if fits else 0)


def token_counts(docs: DataFrame, limit: int = LIMIT, vocabulary: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit, and fit_chars, the characters of its longest prefix of at most ``limit`` tokens."""
    vocabulary = vocabulary or bpe.default_vocabulary()
    more = (("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()), ("fit_chars", T.LongType()))
    schema = T.StructType([docs.select("doc_id").schema[0], *(T.StructField(n, t) for n, t in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = Counter(vocabulary, limit)
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            found = [counted(x) for x in b.column(1).to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int64()), strict=True))], names=schema.names)

    return docs.select("doc_id", text_of().alias("text"), F.octet_length(text_of()).cast("bigint").alias("n_bytes")).mapInArrow(run, schema)


def with_prefix_counts(docs: DataFrame, step: int = 1, vocabulary: str | None = None) -> DataFrame:
    """doc_id and counts, the token counts of the prefixes of 0, step, 2*step, ... characters."""
    vocabulary = vocabulary or bpe.default_vocabulary()
    schema = T.StructType([docs.select("doc_id").schema[0], T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bpe.model(vocabulary)
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.prefix_counts(x)[::step] for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=schema.names)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)
