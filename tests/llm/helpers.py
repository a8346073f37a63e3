"""Fixtures that the tests of this folder share."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark, texts, extra=False, parts=2):
    """Documents 0, 1, ...; a text may be (doc_id, text)."""
    rows = []
    for k, t in enumerate(texts):
        i, t = t if isinstance(t, tuple) else (k, t)
        rows.append((i, t, ["en", "de", None][k % 3], ["a", None][k % 2], None if t is None else len(t)))
    df = spark.createDataFrame(rows, DOCS).repartition(parts)
    if extra:  # names that the operators use themselves
        from pyspark.sql import functions as F

        clash = ("n_words", "kept", "score", "key", "hash", "spans", "part", "rank", "length", "start", "class_id", "node", "bands", "row", "w", "g", "label", "ids", "runs", "f", "y", "toxic", "rects", "term")
        df = df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(clash)))
    return df


ODD = [None, "", " \n\t ", "one", "one two three four", "é" * 3, "日本語 テスト 😀", "a\x00b \x1c c d", "x" * 3000, "word " * 700, "same text here twice " * 9, "same text here twice " * 9]
