"""Small source corpora in each language: the first finding's type and the range of its score."""

import pytest

from kinsieve.operators.normalize import REGISTRY, forms_and_bag, normalize_files, register_udtf, rows_of
from kinsieve.operators.normalize.common import ParseError
from kinsieve.operators.normalize.html import page_tree
from kinsieve.operators.normalize.tree import branch, fingerprint, leaf, signed
from kinsieve.plans.compare import compare, findings, ordered

PY = '''
def {name}(items):
    {acc} = 0
    for item in items:
        if item > limit:
            {acc} += item * 2
{extra}    return {acc}
'''
RS = '''
fn {name}(items: &[u32]) -> u32 {{
    let mut {acc} = 0;
    for item in items.iter() {{
        if *item > LIMIT {{
            {acc} += item * 2;
        }}
    }}
{extra}    {acc}
}}
'''
GO = '''
func {name}(items []int) int {{
	{acc} := 0
	for _, item := range items {{
		if item > limit {{
			{acc} += item * 2
		}}
	}}
{extra}	return {acc}
}}
'''
TS = '''
function {name}(items: number[]): number {{
  let {acc} = 0;
  for (const item of items) {{
    if (item > limit) {{
      {acc} += item * 2;
    }}
  }}
{extra}  return {acc};
}}
'''
TEMPLATES = {
    "py": (PY, "m.py", "    log(item)\n", "def {name}(q):\n    while q:\n        q = step(q, 1)\n        try:\n            yield q.value\n        except KeyError:\n            return None\n"),
    "rs": (RS, "m.rs", "    log(item);\n", "fn {name}(q: Q) -> Option<u8> {{\n    while let Some(x) = q.pop() {{\n        match x {{\n            0 => return None,\n            _ => continue,\n        }}\n    }}\n    None\n}}\n"),
    "go": (GO, "m.go", "\tlog(item)\n", "func {name}(q *Q) error {{\n\tswitch q.Kind {{\n\tcase 1:\n\t\treturn nil\n\tdefault:\n\t\tgo q.Run(\"x\")\n\t}}\n\treturn fail(q)\n}}\n"),
    "ts": (TS, "m.ts", "  log(item);\n", "function {name}(q: Q) {{\n  try {{\n    return q.map((x) => x.y)[0] ?? null;\n  }} catch (e) {{\n    throw new Error(`bad ${{e}}`);\n  }}\n}}\n"),
}


def run(spark, lang, files, t=0.85, nodes=8, lines=3):
    rows = spark.createDataFrame([(k, p, s) for k, (p, s) in enumerate(files)], "file_seq bigint, path string, source string")
    normalized = normalize_files(rows, lang, nodes, lines).cache()
    forms, bag = forms_and_bag(normalized)
    return [(f.clone_type, round(f.score, 4), [m.name for m in f.members]) for f in ordered(findings(compare(forms, bag, t))).collect()], normalized


@pytest.mark.parametrize("lang", TEMPLATES)
def test_clone_types(spark, lang):
    body, path, extra, other = TEMPLATES[lang]
    one = body.format(name="alpha", acc="total", extra="")
    same, renamed, near = body.format(name="beta", acc="total", extra=""), body.format(name="beta", acc="sum_", extra=""), body.format(name="beta", acc="total", extra=extra)
    assert run(spark, lang, [(path, one + same)])[0] == [("type_1", 1.0, ["alpha", "beta"])]
    assert run(spark, lang, [(path, one + renamed)])[0] == [("type_2", 1.0, ["alpha", "beta"])]
    got = run(spark, lang, [(path, one + near)], t=0.5)[0]
    assert len(got) == 1 and got[0][0] == "type_3" and 0.5 <= got[0][1] < 1
    assert run(spark, lang, [(path, one + other.format(name="beta"))])[0] == []
    assert run(spark, lang, [(path, one), (f"x/{path}", same)])[0] == [("type_1", 1.0, ["alpha", "beta"])]


@pytest.mark.parametrize(("lang", "other"), [("py", "tests/m.py"), ("go", "m_test.go"), ("ts", "m.test.ts")])
def test_kinds_by_path(spark, lang, other):
    body, path, _, _ = TEMPLATES[lang]
    one = body.format(name="alpha", acc="total", extra="")
    assert run(spark, lang, [(path, one), (other, one)])[0] == []


def test_rust_kinds(spark):
    one = RS.format(name="alpha", acc="total", extra="")
    for around in ("#[cfg(test)]\nmod tests {{\n{0}\n}}\n", "#[test]\n{0}", "#[tokio::test]\n{0}", "#[cfg(any(test, feature = \"x\"))]\nmod m {{\n{0}\n}}\n"):
        assert run(spark, "rs", [("m.rs", one + around.format(one))])[0] == []
    for around in ("#[cfg(not(test))]\nmod m {{\n{0}\n}}\n", "#[cfg(feature = \"test\")]\n{0}"):
        assert [f[0] for f in run(spark, "rs", [("m.rs", one + around.format(one))])[0]] == ["type_1"]


def names(lang, path, source, **kw):
    return [f.name for f in REGISTRY[lang](path, source, "m:ignore", kw.get("nodes", 1), kw.get("lines", 1))]


def test_names():
    assert names("py", "m.py", "class A:\n    def f(self):\n        g = lambda x: x + 1\n        return {'k': lambda: 0}, (lambda: 1)\n    y = lambda: 2\n") == ["A::f", "g", "'k'", "f", "y"]
    assert names("rs", "m.rs", "impl<T> Tr for a::B<T> { fn f(&self) -> u8 { let c = |x| x + 1; c(1) } }\ntrait Q { fn g(&self); fn h(&self) { 1 } }") == ["B::f", "B::f.$closure:L1", "Q::h"]
    assert names("go", "m.go", "package p\nfunc (r *T) M() int { f := func(x int) int { return x }; return f(1) }\nfunc F() { go func() { x() }() }") == ["T::M", "T::M.$literal:L2", "F", "F.$literal:L3"]
    assert names("ts", "m.ts", "class C { m(a: number): number { return a } }\nconst f = (x: number) => x + 1;\nxs.map((y) => y * 2); function g() {} const h = function () { return 1 }") == ["C::m", "f", "$arrow:L3", "g", "h"]


@pytest.mark.parametrize("lang", TEMPLATES)
def test_nested_functions_are_stubs(lang):
    small = {"py": "def f(a):\n    return list(map(lambda x: {0}, a))\n", "rs": "fn f(a: V) -> V {{ a.map(|x| {0}) }}", "go": "func f(a V) V {{ return a.Map(func(x int) int {{ return {0} }}) }}", "ts": "function f(a: V) {{ return a.map((x) => {0}) }}"}[lang]
    a, b = (REGISTRY[lang](f"m.{lang}", small.format(e), "m:ignore", 1, 1) for e in ("x", "x * 3 + 1"))
    first = lambda forms: next(f for f in forms if f.name == "f")
    assert first(a).fps == first(b).fps and len(a) == len(b) == 2


@pytest.mark.parametrize("lang", TEMPLATES)
def test_directives_and_gates(lang):
    body, path, _, _ = TEMPLATES[lang]
    one = body.format(name="alpha", acc="total", extra="")
    mark = "#" if lang == "py" else "//"
    assert names(lang, path, one, nodes=8, lines=3) == ["alpha"]
    assert names(lang, path, one, nodes=500) == [] == names(lang, path, one, lines=50)
    inside = one.split("\n")
    inside.insert(4, f"{mark} m:ignore because")
    assert names(lang, path, "\n".join(inside)) == []
    assert list(rows_of(0, path, f"{mark} m:ignore-file\n{one}", lang, "m:ignore", 1, 1)) == []


@pytest.mark.parametrize(("lang", "source"), [("py", "def f(:"), ("rs", "fn f() { ( }"), ("rs", 'fn f() { "x }'), ("go", "func f() {"), ("ts", "function f() { `x ${ }"), ("ts", "f())"), ("rs", "/* /* */ x")])
def test_parse_errors_drop_the_file(lang, source):
    with pytest.raises(ParseError):
        REGISTRY[lang](f"m.{lang}", source, "m:ignore", 1, 1)
    rows = list(rows_of(7, "p", source, lang, "m:ignore", 1, 1))
    assert len(rows) == 1 and rows[0][3].startswith("p: parse error")


def test_declarations_and_stubs_have_no_forms():
    assert names("ts", "a.d.ts", "function f() {}") == [] == names("py", "a.pyi", "def f(): ...")


def test_golden_digests():
    bag, nodes = fingerprint(branch("binary:add", [leaf("id0"), leaf("id1")]))
    assert sorted(f"{d:016x}" for d in bag) == sorted(["9f823fc549e84070", "9f85a5c549eb2399", "6d215d421f397d61"]) and nodes == 3
    assert signed(1 << 63) == -(1 << 63)


def test_deep_trees():
    node = leaf("x")
    for _ in range(20_000):
        node = branch("y", [node])
    assert fingerprint(node)[1] == 20_001


def test_html_trees():
    tree, trace = page_tree("<html><body><p class=a>x<br>y</p></div><p>z")
    assert tree == ("page", [("html", [("body", [("p", [("@class", []), ("text", []), ("br", []), ("text", [])]), ("p", [("text", [])])])])])
    assert trace == ["a", "x", "y", "z"]
    assert page_tree("")[0] == ("page", [])


def test_udtf(spark):
    register_udtf(spark, "normalize_test")
    spark.createDataFrame([(0, "m.py", PY.format(name="alpha", acc="t", extra=""))], "s bigint, p string, src string").createOrReplaceTempView("udtf_files")
    rows = spark.sql("SELECT n.name, n.kind FROM udtf_files, LATERAL normalize_test(s, p, src, 'py', 8, 3) n").collect()
    assert [tuple(r) for r in rows] == [("alpha", "production")]
