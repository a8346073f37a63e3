import pytest

from kinsieve.cli import CliError, help_text, main, parse_args, parse_csv_list
from kinsieve.config import CONFIG_NAME, DEFAULT_EXCLUDES, Config, ConfigError, discover_config, load_config, merge_excludes, parse_config
from kinsieve.sources.files import WalkError, collect_source_files, matches_extension, relative_path


def test_defaults():
    c = parse_config("")
    assert c == Config() and c.gate.threshold == 0.85 and c.walk.min_nodes == 10 and c.walk.max_file_bytes == 2_097_152


def test_merging_excludes():
    c = parse_config('[walk]\nexclude = ["gen", "target"]\nunknown = 1\n')
    assert c.walk.exclude == (*DEFAULT_EXCLUDES, "gen")
    assert parse_config('[walk]\nexclude = ["gen"]\nexclude_replace = true').walk.exclude == ("gen",)
    assert merge_excludes(("a",), ("a", "b", "b")) == ("a", "b")


@pytest.mark.parametrize("text", ["[gate]\nthreshold = 1.5", "[gate]\nthreshold = nan", "[walk]\nmin_nodes = 0", "[output]\nformat = 'xml'", "[walk]\nextensions = 'rs'", "x = ["])
def test_bad_configs(text):
    with pytest.raises(ConfigError):
        parse_config(text)


def test_discovery(tmp_path):
    (tmp_path / CONFIG_NAME).write_text("[gate]\nthreshold = 0.5\n")
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    assert discover_config(deep) == tmp_path / CONFIG_NAME
    link = tmp_path / "a" / CONFIG_NAME
    link.symlink_to(tmp_path / CONFIG_NAME)
    assert discover_config(deep) == tmp_path / CONFIG_NAME
    with pytest.raises(ConfigError):
        load_config(link)


def test_flags(tmp_path):
    a = parse_args(["x", "--threshold", "0.6", "--threshold", "0.7", "--exclude", "a, b,", "--fail-on-findings", "--no-fail-on-findings"], "rs", str(tmp_path))
    assert a.paths == ["x"] and a.config.gate.threshold == 0.7 and a.config.walk.exclude == (*DEFAULT_EXCLUDES, "a", "b") and not a.config.gate.fail_on_findings
    assert parse_args(["--exclude", "a", "--exclude-only", "z"], "py", str(tmp_path)).config.walk.exclude == ("z",)
    assert parse_args([], "py", str(tmp_path)).config.walk.extensions == ("py",)
    assert parse_args([], "rs", str(tmp_path)).paths == ["."]
    assert parse_args(["--extensions", "rs,txt"], "rs", str(tmp_path)).config.walk.extensions == ("rs", "txt")
    assert parse_csv_list(" a ,, b") == ("a", "b")


@pytest.mark.parametrize(("argv", "lang", "code"), [(["--help"], "py", 0), (["--nope"], "py", 2), (["--threshold"], "py", 2), (["--threshold", "2"], "py", 2), (["--format", "both"], "py", 2), (["--extensions", "rs"], "py", 2), (["--min-nodes", "0"], "py", 2), (["--min-lines", "x"], "py", 2)])
def test_errors(tmp_path, argv, lang, code):
    with pytest.raises(CliError) as e:
        parse_args(argv, lang, str(tmp_path))
    assert e.value.code == code


def test_help_names_forced_extensions():
    assert "end in py" in help_text("k", ("py",)) and "--extensions" not in help_text("k", ("py",)) and "--extensions EXT" in help_text("k", None)


def test_config_precedence(tmp_path):
    here, there = tmp_path / "here", tmp_path / "there"
    here.mkdir()
    there.mkdir()
    (there / CONFIG_NAME).write_text("[gate]\nthreshold = 0.4\n")
    assert parse_args([str(there)], "py", str(here)).config.gate.threshold == 0.4
    (here / CONFIG_NAME).write_text("[gate]\nthreshold = 0.3\n")
    assert parse_args([str(there)], "py", str(here)).config.gate.threshold == 0.3
    assert parse_args(["--config", str(there / CONFIG_NAME)], "py", str(here)).config.gate.threshold == 0.4


def test_walk(tmp_path):
    for p in ("a/b.rs", "a-b/c.rs", "a/B.RS", "target/x.rs", "a/.rs", "a/t.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    (tmp_path / "l.rs").symlink_to(tmp_path / "a/b.rs")
    root = str(tmp_path)
    got = [relative_path(p, [root]) for p in collect_source_files([root, root], ("rs",), ("target",))]
    assert got == ["a/B.RS", "a/b.rs", "a-b/c.rs"]
    assert collect_source_files([f"{root}/target"], ("rs",), ("target",))  # only names below the root count
    assert relative_path(f"{root}/a/b.rs", [f"{root}/a/b.rs"]) == "b.rs"
    assert not matches_extension(".rs", ("rs",))
    for bad in (f"{root}/l.rs", f"{root}/none"):
        with pytest.raises(WalkError):
            collect_source_files([bad], ("rs",), ())


SOURCE = """
def first(values):
    total = 0
    for v in values:
        if v > 3:
            total += v * 2
    return total


def second(values):
    total = 0
    for v in values:
        if v > 3:
            total += v * 2
    return total
"""


def test_main(tmp_path, capsys, spark, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "m.py").write_text(SOURCE)
    (tmp_path / "bad.py").write_text("def f(:\n")
    (tmp_path / "latin.py").write_bytes(b"x = '\xff'\n")
    (tmp_path / "large.py").write_text("#" * 5000)
    out = tmp_path / "r.json"
    code = main(["py", ".", "--format", "both", "--json-out", str(out), "--fail-on-findings", "--max-file-bytes", "4000"])
    text = capsys.readouterr().out
    assert code == 1 and "kinsieve-py report (threshold 0.85)" in text and "- type_1 score=1.0000 auto_refactor" in text and "m.py:3-7 first" in text
    assert "findings=1 warnings=3" in text and "## warnings" in text and "bad.py" in text
    import json

    report = json.loads(out.read_text())
    assert report["version"] == "0.1" and report["summary"]["type_1"] == 1 and report["findings"][0]["members"][1]["name"] == "second"
    assert main(["py", str(tmp_path / "none")]) == 2
    assert main(["cobol"]) == 2
