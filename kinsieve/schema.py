"""Schemas and column names of the clone model."""

from __future__ import annotations

from pyspark.sql import types as T

FORMS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("node_count", T.IntegerType()),
        T.StructField("ident_trace", T.ArrayType(T.StringType())),
    ]
)
#: fp may also be a string: whatever identifies a structural part.
BAG = T.StructType([T.StructField("form_id", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("cnt", T.LongType())])
WARNINGS = T.StructType([T.StructField("file_seq", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("message", T.StringType())])

PRODUCTION, TEST = "production", "test"
TYPE_1, TYPE_2, TYPE_3 = "type_1", "type_2", "type_3"
AUTO_REFACTOR, REVIEW_FIRST, ADVISORY = "auto_refactor", "review_first", "advisory"
TIERS = (AUTO_REFACTOR, REVIEW_FIRST, ADVISORY)
