from pyspark.sql import functions as F

from kinsieve.functions import predicates as P
from kinsieve.functions.labels import classify, tier_for
from kinsieve.operators.normalize.common import Suppress, file_ignored

M = "tool:ignore"
YES = ["// tool:ignore", "  /// tool:ignore reason", "//! tool:ignore.", "# tool:ignore", "/* tool:ignore */", "/** tool:ignore why */"]
NO = ["// tool:ignored", "// tool:ignore-file", "x = 1 // tool:ignore", "//// tool:ignore", "/* tool:ignore", "// a tool:ignore", "tool:ignore", "# tool:ignore_x"]


def test_directives(spark):
    df = spark.createDataFrame([(x,) for x in YES + NO], "line string")
    got = [r[0] for r in df.select(P.directive_matches(F.col("line"), M)).collect()]
    assert got == [True] * len(YES) + [False] * len(NO)
    assert [bool(Suppress(x, M).at) for x in YES + NO] == got


def test_file_directive_within_forty_lines(spark):
    texts = ["\n" * 39 + f"# {M}-file", "\n" * 40 + f"# {M}-file", f"a\r\n// {M}-file\r\nb", f"# {M}"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = [r[0] for r in df.select(P.file_is_ignored(F.col("t"), M)).collect()]
    assert got == [True, False, True, False] == [file_ignored(x, M) for x in texts]


def test_span_directive(spark):
    df = spark.createDataFrame([(f"a\n# {M}\nb\nc",)], "t string")
    row = df.select(*(P.span_is_ignored(F.col("t"), F.lit(a), F.lit(b), M) for a, b in ((1, 2), (2, 2), (3, 4), (1, 1), (0, 9)))).first()
    assert tuple(row) == (True, True, False, False, True)


def test_sizes(spark):
    row = spark.range(1).select(P.below_size(F.lit(9), F.lit(3), 10, 3), P.below_size(F.lit(10), F.lit(3), 10, 3), P.line_count(F.lit(4), F.lit(6)), P.line_count(F.lit(6), F.lit(4))).first()
    assert tuple(row) == (True, False, 3, 1)


def test_paths(spark):
    df = spark.createDataFrame([("a/x_test.go",), ("a/b.test.ts",), ("__tests__/b.ts",), ("tests/m.py",), ("test_m.py",), ("contest_x.py",), (".rs",), ("a.RS",), ("b/target/c.rs",), ("a.d.ts",), ("m.pyi",)], "p string")
    col = F.col("p")
    kinds = [tuple(r) for r in df.select(*(P.kind_of(col, x) for x in ("go", "ts", "py"))).collect()]
    assert [k[0] for k in kinds].index("test") == 0 and sum(k[0] == "test" for k in kinds) == 1
    assert [i for i, k in enumerate(kinds) if k[1] == "test"] == [1, 2]
    assert [i for i, k in enumerate(kinds) if k[2] == "test"] == [3, 4]
    assert [i for i, r in enumerate(df.select(P.has_extension(col, ["rs"])).collect()) if r[0]] == [7, 8]
    assert [i for i, r in enumerate(df.select(P.is_excluded(col, ["target"])).collect()) if r[0]] == [8]
    assert [i for i, r in enumerate(df.select(P.is_declaration_file(col) | P.is_stub_file(col)).collect()) if r[0]] == [9, 10]


def test_relativize_longest_root(spark):
    df = spark.createDataFrame([("/r/a/b.rs",), ("/r/c.rs",), ("/x/d.rs",), ("/r/a",)], "p string")
    assert [r[0] for r in df.select(P.relativize(F.col("p"), ["/r", "/r/a/"])).collect()] == ["b.rs", "c.rs", "/x/d.rs", "a"]


def test_labels(spark):
    row = spark.range(1).select(classify(F.lit(1.0), F.lit(True)), classify(F.lit(1.0), F.lit(False)), classify(F.lit(0.9), F.lit(True)), tier_for(F.lit(0.95)), tier_for(F.lit(0.85)), tier_for(F.lit(0.84))).first()
    assert tuple(row) == ("type_1", "type_2", "type_3", "auto_refactor", "review_first", "advisory")
