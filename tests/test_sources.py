from pyspark.sql import functions as F

from kinsieve.sources.files import local_files, store_files
from kinsieve.sources.tables import history_forms, text_forms


def test_both_readers_agree(spark, tmp_path):
    for p, text in {"a/m.py": b"x = 1\n", "a/big.py": b"#" * 300, "b/bad.py": b"\xff", "b/t.txt": b"no", "target/z.py": b"y"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(text)
    args = (spark, [str(tmp_path)], ("py",), ("target",), 200)
    a, b = ({r.path: (r.source, r.warning is not None) for r in f(*args).collect()} for f in (local_files, store_files))
    assert a == b == {"a/m.py": ("x = 1\n", False), "a/big.py": (None, True), "b/bad.py": (None, True)}


def test_no_files(spark, tmp_path):
    assert local_files(spark, [str(tmp_path)], ("py",), (), 200).count() == 0


def test_text_forms_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "Aa bb AA"), (2, None), (3, ""), (4, "é")], "id bigint, t string")
    forms, bag = text_forms(rows, "id", "t", "texts")
    assert sorted(map(tuple, bag.collect())) == [(1, "aa", 2), (1, "bb", 1)]
    assert {r.id: (r.ident_trace, r.end_line) for r in forms.collect()} == {1: (["Aa", "bb", "AA"], 1), 2: ([], 1), 3: ([], 1), 4: ([], 1)}


def test_history_forms_in_order(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, None), (1, 3, "a")], "u bigint, at int, e string")
    forms, bag = history_forms(rows, "u", "e", ["at"], ["e"], "users")
    assert {r.id: r.ident_trace for r in forms.collect()} == {1: ["a", "b", "a"], 2: [None]}
    assert {(r.form_id, r.fp): r.cnt for r in bag.where(F.col("form_id") == 1).collect()} == {(1, "a"): 2, (1, "b"): 1}
