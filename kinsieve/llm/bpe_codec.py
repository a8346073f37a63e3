"""BPE encoding and decoding: exact ids by the prefix tables of ``bpe``, and back to text.

Defined results for odd input: a null text is the empty one, with no ids; strings of
special tokens inside texts become those tokens; repeated rows give repeated results; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bpe
from ._common import text_of

#: A word or chunk: its count of tokens, their ids with a blank before each, their texts likewise.
Coded = tuple[int, str, str]
#: vocabulary -> chunk -> Coded
_KEPT: dict[str, bpe.Recent] = {}


def _coder(vocabulary: str):
    m = bpe.model(vocabulary)

    def of_ids(ids: tuple[int, ...]) -> Coded:
        return len(ids), "".join([f" {i}" for i in ids]), " " + m.decode(ids) if ids else ""

    words = bpe.Recent(lambda word: of_ids(m.word_ids(word)), bpe.CACHED_WORDS)

    def of(chunk: str) -> Coded:
        if m.special_split and "<|" in chunk and m.special_split.search(chunk):
            return of_ids(m.chunk_ids(chunk))
        parts = [words[w] for w in m.words(chunk)]
        if len(parts) == 1:
            return parts[0]
        return sum([p[0] for p in parts]), "".join([p[1] for p in parts]), "".join([p[2] for p in parts])

    if vocabulary not in _KEPT:
        _KEPT[vocabulary] = bpe.Recent(of, bpe.CACHED_CHUNKS)
    coded, chunks = _KEPT[vocabulary].__getitem__, bpe.CHUNK.findall

    def code(text: str) -> Coded:
        got = list(map(coded, chunks(text)))
        if not got:
            return 0, "", ""
        n, ids, texts = zip(*got, strict=True)
        return sum(n), "".join(ids)[1:], "".join(texts)[1:]

    return code


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids, the token ids of each text."""
    vocabulary = vocabulary or bpe.default_vocabulary()
    schema = T.StructType([docs.select("doc_id").schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bpe.model(vocabulary)
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.encode(x) for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=schema.names)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give the empty text."""
    vocabulary = vocabulary or bpe.default_vocabulary()
    schema = T.StructType([encoded.select("doc_id").schema[0], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bpe.model(vocabulary)
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=schema.names)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    vocabulary = vocabulary or bpe.default_vocabulary()
    schema = T.StructType([docs.select("doc_id").schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _coder(vocabulary)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            n, ids, texts = [], [], []
            for x in b.column(1).to_pylist():
                k, i, t = code(x)
                n.append(k)
                ids.append(sha(i))
                texts.append(sha(t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=schema.names)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)
