"""Registered queries of what works on source trees, configurations and arguments.

Their inputs are small literals, as no table holds source code; the oracles are the rows that the documented
semantics give, written down by hand.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cli import CliError, parse_args
from .config import DEFAULT_EXCLUDES, ConfigError, discover_config, load_config, merge_excludes, parse_config
from .functions import predicates as P
from .operators.normalize import normalize_files
from .operators.normalize.tree import branch, fingerprint, leaf
from .plans.report import Report, findings_text, render_json, render_text, total_findings
from .plans.compare import findings
from .plans.session import shared_dir
from .queries import DOC_FINDINGS, MEMBER_SEQ, TIER, members_of, query, table
from .sources.files import WalkError, collect_source_files, local_files


def values(names: str, rows: list[tuple]) -> str:
    """SQL of literal rows; ``names`` are columns with their types, those of strings without."""

    def literal(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return str(x).lower() if isinstance(x, bool) else repr(x)

    columns = [(c.split(" ") + ["VARCHAR"])[:2] for c in names.split(", ")]
    body = ", ".join(f"({', '.join(map(literal, r))})" for r in rows)
    return f"SELECT {', '.join(f'{c}::{t} AS {c}' for c, t in columns)} FROM (VALUES {body}) AS v({', '.join(c for c, _ in columns)})"


# -- trees of files


#: path -> content; None: a link to the first file.
TREE: dict[str, bytes | None] = {
    "a/one.rs": b"fn f() {}", "a/TWO.RS": b"fn g() {}\n", "a/b/three.rs": b"// three", "a-b/four.rs": b"", "a/target/five.rs": b"fn h() {}", "target.rs": b"fn i() {}", "a/.rs": b"fn j() {}",
    "a/notes.txt": b"x", "a/bad.rs": b"fn \xff() {}", "a/large.rs": b"x" * 200, "a/link.rs": None, "a/node_modules/deep/six.rs": b"fn k() {}", "a/seven.rs.bak": b"",
}


def write_tree(spark: SparkSession, tree: dict[str, bytes | None]) -> str:
    """A local tree of files in the shared folder."""
    top = f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/kinsieve/tree-{uuid.uuid4().hex}"
    for name, content in tree.items():
        path = f"{top}/{name}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        if content is None:
            os.symlink(f"{top}/{next(iter(tree))}", path)
        else:
            with open(path, "wb") as f:
                f.write(content)
    return top


WALKED = [
    (0, "one.rs", 9, "read"), (1, "TWO.RS", 10, "read"), (2, "b/three.rs", 8, "read"), (3, "four.rs", 0, "read"), (4, "target.rs", 9, "read"), (5, "bad.rs", None, "utf-8"), (6, "large.rs", None, "too large"),
]


@query(values("path, bytes INTEGER, outcome", [r[1:] for r in WALKED]))
def walk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below three roots, one inside another: read, or refused with a warning."""
    top = write_tree(spark, TREE)
    roots = [f"{top}/a", f"{top}/a-b/", f"{top}/a/b/..", f"{top}/target.rs"]
    got = local_files(spark, [os.path.normpath(r) for r in roots], ("rs",), ("target", "node_modules"), 100)
    outcome = F.when(F.col("warning").isNull(), "read").when(F.col("warning").contains("exceed"), "too large").otherwise("utf-8")
    return got.select("path", F.octet_length("source").cast("int").alias("bytes"), outcome.alias("outcome"))


@query(values("place INTEGER, path", list(enumerate(["a/TWO.RS", "a/b/three.rs", "a/bad.rs", "a/large.rs", "a/one.rs", "a/target/five.rs", "a-b/four.rs", "target.rs"]))))
def walk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of files: component by component."""
    top = write_tree(spark, TREE)
    names = [os.path.relpath(p, top) for p in collect_source_files([top, f"{top}/a"], ("rs",), ("node_modules",))]
    return spark.createDataFrame(list(enumerate(names)), "place int, path string")


@query(values("root, outcome", [("link", "refused"), ("gone", "refused"), ("a/one.rs", "1 files"), ("a/notes.txt", "0 files"), ("a/b", "1 files")]))
def walk_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots that can't be walked are errors; a root may be a file."""
    top = write_tree(spark, TREE)
    os.symlink(f"{top}/a", f"{top}/link")

    def outcome(root: str) -> str:
        try:
            return f"{len(collect_source_files([f'{top}/{root}'], ('rs',), ()))} files"
        except WalkError:
            return "refused"

    return spark.createDataFrame([(r, outcome(r)) for r in ("link", "gone", "a/one.rs", "a/notes.txt", "a/b")], "root string, outcome string")


# -- configurations and arguments


FULL = "[gate]\nthreshold = 1\nfail_on_findings = true\n[output]\nformat = 'json'\n[walk]\nextensions = ['go']\nexclude = ['out', 'dist']\nexclude_replace = true\nmin_nodes = 4\nmin_lines = 2\nmax_file_bytes = 9\nunknown = 0"
CONFIGS = {
    "empty": "", "full": FULL, "joined": "[walk]\nexclude = ['out', 'dist', 'out']", "high": "[gate]\nthreshold = 1.01", "nan": "[gate]\nthreshold = nan", "zero": "[walk]\nmin_lines = 0", "format": "[output]\nformat = 'xml'",
    "type": "[walk]\nmin_nodes = true", "list": "[walk]\nexclude = 'x'", "toml": "[gate", "table": "gate = 1",
}
SHOWN = "ok BOOLEAN, threshold DOUBLE, fail BOOLEAN, format, extensions, exclude, min_nodes INTEGER, min_lines INTEGER, max_file_bytes INTEGER"
SHOWN_SPARK = "ok boolean, threshold double, fail boolean, format string, extensions string, exclude string, min_nodes int, min_lines int, max_file_bytes int"
STANDARD = "target,.git,fixtures,node_modules,vendor,.venv,venv,dist,__pycache__"
REFUSED = (False, *[None] * 8)


def shown_config(config) -> tuple:  # noqa: ANN001
    g, w = asdict(config.gate), asdict(config.walk)
    return (True, g["threshold"], g["fail_on_findings"], config.output.format, ",".join(w["extensions"]), ",".join(w["exclude"]), w["min_nodes"], w["min_lines"], w["max_file_bytes"])


@query(
    values(
        f"name, {SHOWN}",
        [
            ("empty", True, 0.85, False, "text", "rs", STANDARD, 10, 3, 2097152), ("full", True, 1.0, True, "json", "go", "out,dist", 4, 2, 9), ("joined", True, 0.85, False, "text", "rs", STANDARD + ",out", 10, 3, 2097152),
            *((n, *REFUSED) for n in ("high", "nan", "zero", "format", "type", "list", "toml", "table")),
        ],
    )
)
def config_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations as they are read, or refused."""

    def read(text: str) -> tuple:
        try:
            return shown_config(parse_config(text))
        except ConfigError:
            return REFUSED

    return spark.createDataFrame([(n, *read(t)) for n, t in CONFIGS.items()], f"name string, {SHOWN_SPARK}")


@query(values("name, found", [("a/b/c", "a/b/kinsieve.toml"), ("a/b", "a/b/kinsieve.toml"), ("a", "kinsieve.toml"), ("a/d", "kinsieve.toml"), ("load a/b", "0.5"), ("load a/d", "refused"), ("load a/b/c", "refused")]))
def config_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest file at or above a folder; links are passed over, and refused when named."""
    top = write_tree(spark, {"kinsieve.toml": b"", "a/b/kinsieve.toml": b"[gate]\nthreshold = 0.5", "a/b/c/x": b"", "a/d/kinsieve.toml": None})

    def load(where: str) -> str:
        try:
            return str(load_config(f"{top}/{where}/kinsieve.toml").gate.threshold)
        except ConfigError:
            return "refused"

    rows = [(n, os.path.relpath(str(discover_config(f"{top}/{n}")), top)) for n in ("a/b/c", "a/b", "a", "a/d")]
    return spark.createDataFrame([*rows, *((f"load {n}", load(n)) for n in ("a/b", "a/d", "a/b/c"))], "name string, found string")


@query(values("base, extra, merged", [("a,b", "b,c,a,c", "a,b,c"), ("", "x,x", "x"), ("a,a", "", "a,a"), ("b", "a", "b,a")]))
def merge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of excluded names joined in order."""
    split = lambda x: tuple(filter(None, x.split(",")))
    return spark.createDataFrame([(b, e, ",".join(merge_excludes(split(b), split(e)))) for b, e in (("a,b", "b,c,a,c"), ("", "x,x"), ("a,a", ""), ("b", "a"))], "base string, extra string, merged string")


#: language, arguments; a folder in its own has a config with a threshold of 0.5.
ARGUMENTS = (
    ("rs", ""), ("rs", "x y"), ("rs", "--threshold 0.7 --min-nodes 4 --min-lines 2 --max-file-bytes 8 --format json"), ("rs", "--extensions rs,,go --exclude out,dist"), ("rs", "--exclude-only out"),
    ("rs", "--fail-on-findings"), ("rs", "--fail-on-findings --no-fail-on-findings"), ("rs", "--threshold 0.1 --threshold 0.2"), ("py", ""), ("ts", "z"), ("go", "--extensions go"), ("rs", "--threshold 1.5"), ("rs", "--threshold"),
    ("rs", "--format xml"), ("rs", "--format both"), ("rs", "--format both --json-out r.json"), ("rs", "--what"), ("rs", "--help"), ("go", "-h"), ("rs", "--min-lines 0"), ("rs", "--min-nodes -3"), ("rs", "--min-nodes x"),
    ("rs", "--config sub/kinsieve.toml"), ("rs", "--config sub/kinsieve.toml --threshold 0.6"), ("rs", "--config none.toml"), ("rs", "sub"),
)
PLAIN = (True, 0.85, False, "text", "rs", STANDARD, 10, 3, 2097152)


def _but(**changes: object) -> tuple:
    names = ["ok", "threshold", "fail", "format", "extensions", "exclude", "min_nodes", "min_lines", "max_file_bytes"]
    return tuple(changes.get(n, v) for n, v in zip(names, PLAIN, strict=True))


EXPECTED_ARGUMENTS = [
    (".", 0, *PLAIN), ("x,y", 0, *PLAIN), (".", 0, *_but(threshold=0.7, min_nodes=4, min_lines=2, max_file_bytes=8, format="json")), (".", 0, *_but(extensions="rs,go", exclude=STANDARD + ",out")), (".", 0, *_but(exclude="out")),
    (".", 0, *_but(fail=True)), (".", 0, *PLAIN), (".", 0, *_but(threshold=0.2)), (".", 0, *_but(extensions="py")), ("z", 0, *_but(extensions="ts,tsx,mts,cts")), (None, 2, *REFUSED), (None, 2, *REFUSED), (None, 2, *REFUSED),
    (None, 2, *REFUSED), (None, 2, *REFUSED), (".", 0, *_but(format="both")), (None, 2, *REFUSED), (None, 0, *REFUSED), (None, 0, *REFUSED), (None, 2, *REFUSED), (None, 2, *REFUSED), (None, 2, *REFUSED),
    (".", 0, *_but(threshold=0.5)), (".", 0, *_but(threshold=0.6)), (None, 2, *REFUSED), ("sub", 0, *_but(threshold=0.5)),
]


@query(values(f"lang, arguments, paths, code INTEGER, {SHOWN}", [(*a, *e) for a, e in zip(ARGUMENTS, EXPECTED_ARGUMENTS, strict=True)]))
def argument_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments laid over the configuration, or the code that the program ends with."""
    top = write_tree(spark, {"sub/kinsieve.toml": b"[gate]\nthreshold = 0.5"})

    def read(lang: str, arguments: str) -> tuple:
        try:
            args = parse_args(arguments.split(), lang, top)
        except CliError as e:
            return (None, e.code, *REFUSED)
        return (",".join(args.paths), 0, *shown_config(args.config))

    return spark.createDataFrame([(*a, *read(*a)) for a in ARGUMENTS], f"lang string, arguments string, paths string, code int, {SHOWN_SPARK}")


# -- reports


@query(
    f"""WITH RECURSIVE {DOC_FINDINGS}, seq AS (SELECT *, {MEMBER_SEQ} AS member_seq FROM flat)
SELECT '- ' || clone_type || ' score=' || printf('%.4f', score) || ' ' || {TIER} || chr(10) || string_agg('    ' || path || ':1-' || end_line || ' ' || form_id, chr(10) ORDER BY member_seq) AS text FROM seq GROUP BY clone_type, score, g"""
)
def report_text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every finding in a text report, made by executors."""
    return findings_text(findings(members_of(spark, sf_dir)))


@query(f"WITH RECURSIVE {DOC_FINDINGS} SELECT count(DISTINCT (clone_type, g))::BIGINT AS total FROM flat")
def total_findings_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.report import summary

    counts = summary(members_of(spark, sf_dir).select("finding_key", "clone_type", "tier").distinct())
    return counts.select(total_findings({c: F.col(c) for c in counts.columns}).cast("bigint").alias("total"))


def _report(empty: bool) -> Report:
    member = lambda p, n: {"path": p, "start_line": 2, "end_line": 9, "name": n}
    zero = {"files_scanned": 0, "forms_compared": 0, "parse_warnings": 0, "auto_refactor": 0, "review_first": 0, "advisory": 0, "type_1": 0, "type_2": 0, "type_3": 0}
    if empty:
        return Report("tool", 0.85, [], zero, [])
    found = [
        {"clone_type": "type_1", "tier": "auto_refactor", "score": 1.0, "members": [member("a.rs", "f"), member("b.rs", "A::g")]},
        {"clone_type": "type_3", "tier": "advisory", "score": 2 / 3, "members": [member("c.rs", "h"), member("d.rs", "i")]},
    ]
    return Report("tool", 0.5, found, zero | {"files_scanned": 4, "forms_compared": 5, "parse_warnings": 1, "auto_refactor": 1, "advisory": 1, "type_1": 1, "type_3": 1}, ["e.rs: parse error"])


RENDERED = [
    "tool report (threshold 0.50)", "scanned=4 forms=5 findings=2 warnings=1", "", "## auto_refactor", "- type_1 score=1.0000 auto_refactor", "    a.rs:2-9 f", "    b.rs:2-9 A::g", "",
    "## advisory", "- type_3 score=0.6667 advisory", "    c.rs:2-9 h", "    d.rs:2-9 i", "", "## warnings", "- e.rs: parse error",
]
RENDERED_EMPTY = ["tool report (threshold 0.85)", "scanned=0 forms=0 findings=0 warnings=0"]


@query(values("name, line INTEGER, text", [*(("full", i, x) for i, x in enumerate(RENDERED)), *(("empty", i, x) for i, x in enumerate(RENDERED_EMPTY))]))
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text report: header, tiers in order, findings, warnings."""
    rows = [(n, i, x) for n, empty in (("full", False), ("empty", True)) for i, x in enumerate(render_text(_report(empty)).rstrip("\n").split("\n"))]
    return spark.createDataFrame(rows, "name string, line int, text string")


@query(
    values(
        "name, value",
        [
            ("version", "0.1"), ("tool", "tool"), ("threshold", "0.5"), ("findings.0.clone_type", "type_1"), ("findings.0.members.1.name", "A::g"), ("findings.0.members.1.start_line", "2"), ("findings.1.tier", "advisory"),
            ("findings.1.score", "0.6666666666666666"), ("summary.files_scanned", "4"), ("summary.type_3", "1"), ("parse_warnings.0", "e.rs: parse error"),
        ],
    )
)
def report_json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a JSON report, by their paths."""
    text = spark.createDataFrame([(render_json(_report(False)),)], "json string")
    paths = ["version", "tool", "threshold", "findings.0.clone_type", "findings.0.members.1.name", "findings.0.members.1.start_line", "findings.1.tier", "findings.1.score", "summary.files_scanned", "summary.type_3", "parse_warnings.0"]
    path = lambda p: "$" + "".join(f"[{x}]" if x.isdigit() else f".{x}" for x in p.split("."))
    return text.select(F.explode(F.array(*(F.struct(F.lit(p).alias("name"), F.get_json_object("json", path(p)).alias("value")) for p in paths))).alias("e")).select("e.name", "e.value")


@query(
    "SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\\r?\\n')[2:4], lambda x: regexp_matches(x, '^\\s*(//[/!]?|#)\\s*Released([^A-Za-z0-9_-]|$)') OR regexp_matches(x, '^\\s*/\\*\\*?\\s*Released([^A-Za-z0-9_-].*)?\\*/\\s*$'))) > 0 AS ignored FROM documents"
)
def span_ignored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a directive stands on lines 2 to 4."""
    return table(spark, sf_dir, "documents").select("doc_id", P.span_is_ignored(F.coalesce("text", F.lit("")), F.lit(2), F.lit(4), "Released").alias("ignored"))


LINES = ["x = 1\n// m:ignore\ny", "x\n# m:ignore why\ny", "x\n/* m:ignore */\ny", "x\n/* m:ignore\ny */", "x\n// m:ignored\ny", "x // m:ignore\ny", "x\n//! m:ignore\r\ny", "// m:ignore\nx\ny", "x\ny\n\n// m:ignore", "// m:ignore-file\nx"]


@query(values("id INTEGER, span BOOLEAN, file BOOLEAN", list(zip(range(10), [True, True, True, False, False, False, True, False, False, False], [False] * 9 + [True], strict=True))))
def ignored_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directives on lines 2 and 3, and for a whole file."""
    rows = spark.createDataFrame(list(enumerate(LINES)), "id int, text string")
    return rows.select("id", P.span_is_ignored(F.col("text"), F.lit(2), F.lit(3), "m:ignore").alias("span"), P.file_is_ignored(F.col("text"), "m:ignore").alias("file"))


# -- normalizers


@query(values("digest, cnt INTEGER, nodes INTEGER", [("9f823fc549e84070", 1, 3), ("9f85a5c549eb2399", 1, 3), ("6d215d421f397d61", 1, 3)]))
def tree_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all subtrees of a sum of two names."""
    bag, nodes = fingerprint(branch("binary:add", [leaf("id0"), leaf("id1")]))
    return spark.createDataFrame([(f"{d:016x}", c, nodes) for d, c in bag.items()], "digest string, cnt int, nodes int")


SOURCES = {
    "py": {
        "m.py": "class A:\n    def f(self):\n        g = lambda x: x + 1\n        return g\n    @staticmethod\n    def h():\n        return {'k': lambda: 0}\n\ndef top(a,\n        b):\n    return map(lambda q: q, a)\n",
        "tests/t.py": "def test_x():\n    assert 1\n", "s.pyi": "def f(): ...\n", "bad.py": "def f(:\n", "ign.py": "# kinsieve-py:ignore-file\ndef f():\n    return 1\n", "part.py": "def a():\n    x = 1\n    # kinsieve-py:ignore\n    return x\ndef b():\n    @c\n    def d():\n        return 1\n    return d\n",
    },
    "rs": {
        "m.rs": "fn a() {\n  let c = |x| x + 1;\n  fn inner() { }\n}\nimpl<T> Tr for p::B<T> {\n  const N: u8 = 1;\n  fn f(&self) -> u8 {\n    1\n  }\n}\ntrait Q {\n  fn g(&self);\n  fn h(&self) { 1 }\n}\n",
        "t.rs": "#[test]\nfn one() {\n  run(|| 2)\n}\n#[cfg(test)]\nmod tests {\n  fn two() {}\n}\n#[cfg(not(test))]\nfn three() {}\n#[cfg(all(unix, test))]\nfn four() {}\n#[tokio::test]\nasync fn five() {}\n", "bad.rs": "fn f() { (]\n",
    },
    "go": {
        "m.go": "package p\nfunc (r *T) M() int {\n\tf := func(x int) int { return x }\n\treturn f(1)\n}\nfunc F(\n\ta int,\n) {\n\tgo func() { x() }()\n}\nfunc Ext()\n", "m_test.go": "package p\nfunc TestF() {\n}\n", "bad.go": "func f() {\n",
    },
    "ts": {
        "m.ts": "class C {\n  m(a: number): number {\n    return a;\n  }\n}\nconst f = (x: number) => x + 1;\nfunction g() {\n  return xs.map((y) => y * 2);\n}\nfunction* gen() { yield 1 }\nconst h = function () { return 1 };\n",
        "a.spec.ts": "function s() {}\n", "d.d.ts": "function s() {}\n", "__tests__/u.ts": "const k = () => 1;\n", "bad.ts": "function f() {\n",
    },
}
FORMS: dict[str, list[tuple]] = {
    "py": [
        ("m.py", "A::f", "production", 3, 4, None), ("m.py", "g", "production", 3, 3, None), ("m.py", "A::h", "production", 7, 7, None), ("m.py", "'k'", "production", 7, 7, None), ("m.py", "top", "production", 11, 11, None), ("m.py", "top", "production", 11, 11, None),
        ("tests/t.py", "test_x", "test", 2, 2, None), ("part.py", "b", "production", 6, 9, None), ("part.py", "d", "production", 8, 8, None), ("bad.py", None, None, None, None, "parse error"),
    ],
    "rs": [
        ("m.rs", "a", "production", 1, 4, None), ("m.rs", "a.$closure:L2", "production", 2, 2, None), ("m.rs", "inner", "production", 3, 3, None), ("m.rs", "B::f", "production", 7, 9, None), ("m.rs", "Q::h", "production", 13, 13, None),
        ("t.rs", "one", "test", 2, 4, None), ("t.rs", "one.$closure:L3", "test", 3, 3, None), ("t.rs", "two", "test", 7, 7, None), ("t.rs", "three", "production", 10, 10, None), ("t.rs", "four", "test", 12, 12, None), ("t.rs", "five", "test", 14, 14, None),
        ("bad.rs", None, None, None, None, "parse error"),
    ],
    "go": [
        ("m.go", "T::M", "production", 2, 5, None), ("m.go", "T::M.$literal:L3", "production", 3, 3, None), ("m.go", "F", "production", 8, 10, None), ("m.go", "F.$literal:L9", "production", 9, 9, None),
        ("m_test.go", "TestF", "test", 2, 3, None), ("bad.go", None, None, None, None, "parse error"),
    ],
    "ts": [
        ("m.ts", "C::m", "production", 2, 4, None), ("m.ts", "f", "production", 6, 6, None), ("m.ts", "g", "production", 7, 9, None), ("m.ts", "$arrow:L8", "production", 8, 8, None), ("m.ts", "gen", "production", 10, 10, None), ("m.ts", "h", "production", 11, 11, None),
        ("a.spec.ts", "s", "test", 1, 1, None), ("__tests__/u.ts", "k", "test", 1, 1, None), ("bad.ts", None, None, None, None, "parse error"),
    ],
}


def _forms(lang: str) -> None:
    def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = spark.createDataFrame([(k, p, s) for k, (p, s) in enumerate(SOURCES[lang].items())], "file_seq bigint, path string, source string")
        got = normalize_files(files, lang, 1, 1)
        return got.select("path", "name", "kind", "start_line", "end_line", F.when(F.col("warning").contains("parse error"), "parse error").otherwise(F.col("warning")).alias("warning"))

    forms.__name__ = f"forms_{lang}"
    forms.__doc__ = f"Forms of small {lang} sources: names, kinds and lines; a file with an error has none."
    query(values("path, name, kind, start_line INTEGER, end_line INTEGER, warning", FORMS[lang]))(forms)


for _lang in SOURCES:
    _forms(_lang)

#: What a Rust body may differ in: name of the case, two bodies, whether they count as equal.
BODIES = (
    ("label", "'a: loop { break 'a; }", "loop { break; }", True), ("turbofish", "v.collect::<Vec<_>>()", "v.collect()", True), ("turbofish of a path", "Vec::<u8>::new()", "Vec::new()", True),
    ("type of a cast", "(x as u8) + 1", "(x as Vec<u16>) + 1", True), ("cast before a comparison", "x as usize < y", "x as u8 < y", True), ("cast", "x as u8", "x", False),
    ("type of let", "let a: u8 = 1; a", "let a: Vec<Vec<u8>> = 1; a", True), ("let with a type", "let a: u8 = 1; a", "let a = 1; a", False), ("let else", "let Some(a) = f(x) else { return 0 }; a", "let Some(a) = f(x) else { panic() }; a", True),
    ("guard", "match x { Some(y) if y > 3 => y, _ => 0 }", "match x { Some(y) => y, _ => 0 }", True), ("guard behind a block", "match x { 1 => { 2 } y if y > 3 => y, _ => 0 }", "match x { 1 => { 2 } y => y, _ => 0 }", True),
    ("if of an arm", "match x { 1 => if y { 2 } else { 3 }, _ => 0 }", "match x { 1 => y, _ => 0 }", False), ("if", "let a = if x { 1 } else { 2 }; a", "let a = x; a", False), ("value of a literal", 'f("a")', 'f("b")', True),
    ("kind of a literal", 'f("a")', "f(1)", False), ("name", "a + a", "b + b", True), ("names", "a + b", "b + b", False), ("operator", "a + b", "a - b", False),
)


@query(values("name, equal BOOLEAN", [(n, e) for n, _, _, e in BODIES]))
def equal_bodies_rs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which differences between two Rust bodies count."""
    rows = [(2 * k + side, f"{n}/{side}", f"fn f() {{ {body} }}") for k, (n, a, b, _) in enumerate(BODIES) for side, body in enumerate((a, b))]
    bags = normalize_files(spark.createDataFrame(rows, "file_seq bigint, path string, source string"), "rs", 1, 1).where("seq = 0")
    name = F.substring_index("path", "/", 1).alias("name")
    return bags.groupBy(name).agg((F.count_distinct("fps", "cnts") == 1).alias("equal"))


assert DEFAULT_EXCLUDES == tuple(STANDARD.split(","))
