"""Forms and bags from tables: documents, event histories, orders, conversations, pages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.bags import bag_of_array, build_bag
from ..schema import PRODUCTION

TOKEN = "[A-Za-z0-9]+"


def ascii_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, as they are spelled; none for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def text_forms(rows: DataFrame, id_column: str, text_column: str, folder: str, kind: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(forms, bag) of texts, a row each: fingerprints are lower-case tokens, the trace is the tokens as spelled."""
    tokens = rows.select(F.col(id_column).cast("bigint").alias("id"), ascii_tokens(F.col(text_column)).alias("ident_trace"), F.size(F.split(F.coalesce(F.col(text_column), F.lit("")), "\n")).alias("end_line"), (kind if kind is not None else F.lit(PRODUCTION)).alias("kind"))
    forms = tokens.select("id", F.concat(F.lit(f"{folder}/"), F.col("id").cast("string")).alias("path"), F.col("id").cast("string").alias("name"), F.lit(1).alias("start_line"), "end_line", "kind", F.size("ident_trace").alias("node_count"), "ident_trace")
    bag = bag_of_array(tokens.select("id", F.transform("ident_trace", F.lower).alias("fps")), "id", "fps")
    return forms, bag


def text_counts(rows: DataFrame, id_column: str, text_column: str, ids: DataFrame) -> DataFrame:
    """(fp, df): in how many of the texts of ``ids`` a lower-case token is. Texts are counted inside their task, without bags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = re.compile(TOKEN)
        n: Counter[str] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(n)
            for lo in range(0, len(words), 20_000):
                part = words[lo : lo + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([n[x] for x in part], pa.int64())], names=["fp", "n"])
            n.clear()

        for b in batches:
            for text in b.column(0):
                n.update({x.lower() for x in token.findall(text.as_py() or "")})
                if len(n) > 500_000:
                    yield from out()
        yield from out()

    own = rows.select(F.col(id_column).cast("bigint").alias("form_id"), F.col(text_column).cast("string").alias("text")).join(ids.select("form_id"), "form_id", "left_semi")
    return own.select("text").mapInArrow(run, "fp string, n bigint").groupBy("fp").agg(F.sum("n").alias("df"))


def history_forms(rows: DataFrame, id_column: str, fp_column: str, order: list[str], trace: list[str], folder: str, kind: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(forms, bag) of grouped rows: a form for each id, its rows' values as fingerprints, their sequence as the trace."""
    item = F.struct(*order, *(F.col(c).cast("string").alias(f"_t{k}") for k, c in enumerate(trace)))
    said = F.flatten(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.array(*(x[f"_t{k}"] for k in range(len(trace))))))
    forms = rows.groupBy(F.col(id_column).cast("bigint").alias("id")).agg(said.alias("ident_trace"), F.count("*").cast("int").alias("node_count"), *((F.min(kind).alias("kind"),) if kind is not None else ()))
    forms = forms if kind is not None else forms.withColumn("kind", F.lit(PRODUCTION))
    forms = forms.select("id", F.concat(F.lit(f"{folder}/"), F.col("id").cast("string")).alias("path"), F.col("id").cast("string").alias("name"), F.lit(1).alias("start_line"), F.col("node_count").alias("end_line"), "kind", "node_count", "ident_trace")
    return forms, build_bag(rows.select(F.col(id_column).cast("bigint").alias("form_id"), F.col(fp_column).alias("fp")))
