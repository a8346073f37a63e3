"""Exact duplicates over a stream of texts.

New rows are digested as they come. The state is one row for each distinct digest: how often it was
seen, and the least id. It lives in Spark's state store, dealt by digest, so it grows with
distinct texts and no batch reads old ones again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bags import trace_digest
from ..sources.tables import ascii_tokens


def bag_key(text_column: str = "text") -> Column:
    """A key of a text's bag of lower-case tokens: a row's own work, no aggregation."""
    return trace_digest(F.array_sort(F.transform(ascii_tokens(F.col(text_column)), F.lower)))


def exact_groups_stream(rows: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(bag_key, forms, first_id) of a streaming DataFrame; texts without tokens are left out."""
    keyed = rows.where(F.size(ascii_tokens(F.col(text_column))) > 0).select(bag_key(text_column).alias("bag_key"), F.col(id_column).alias("id"))
    return keyed.groupBy("bag_key").agg(F.count("*").alias("forms"), F.min("id").alias("first_id"))


def start(rows: DataFrame, table: str, checkpoint: str, id_column: str = "doc_id", text_column: str = "text") -> StreamingQuery:
    """Groups of two or more in an in-memory table for inspection; other sinks take ``exact_groups_stream`` in update mode."""
    groups = exact_groups_stream(rows, id_column, text_column)
    return groups.writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
