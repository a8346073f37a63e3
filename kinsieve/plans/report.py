"""Summary, text and JSON of findings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TIERS, TYPE_1, TYPE_2, TYPE_3
from .compare import ordered

VERSION = "0.1"


def summary(found: DataFrame, files_scanned: int = 0, forms: int = 0, parse_warnings: int = 0) -> DataFrame:
    """One row of nine counters. ``found`` has a row for each finding."""
    count = lambda c, v: F.count_if(F.col(c) == v).cast("bigint").alias(v)
    counts = found.agg(*(count("tier", t) for t in TIERS), *(count("clone_type", t) for t in (TYPE_1, TYPE_2, TYPE_3)))
    return counts.select(
        F.lit(files_scanned).cast("bigint").alias("files_scanned"), F.lit(forms).cast("bigint").alias("forms_compared"), F.lit(parse_warnings).cast("bigint").alias("parse_warnings"),
        "*",
    )


def total_findings(counts: dict[str, int]) -> int:
    return sum(counts[t] for t in TIERS)


@dataclass
class Report:
    """What a run reports; findings are in order."""

    tool: str
    threshold: float
    findings: list[dict] = field(default_factory=list)
    summary: dict[str, int] = field(default_factory=dict)
    parse_warnings: list[str] = field(default_factory=list)
    version: str = VERSION


def build_report(tool: str, threshold: float, found: DataFrame, files_scanned: int, forms: int, warnings: list[str]) -> Report:
    """A report in the driver: it is meant for people, and as long as its findings. For large results write ``findings`` instead."""
    rows = [
        {"clone_type": r["clone_type"], "tier": r["tier"], "score": r["score"], "members": [{k: m[k] for k in ("path", "start_line", "end_line", "name")} for m in r["members"]]}
        for r in ordered(found).toLocalIterator()
    ]
    counts = summary(found, files_scanned, forms, len(warnings)).first().asDict()
    return Report(tool, threshold, rows, counts, warnings)


def render_json(report: Report) -> str:
    d = asdict(report)
    return json.dumps({k: d[k] for k in ("version", "tool", "threshold", "findings", "summary", "parse_warnings")}, indent=2, ensure_ascii=False)


def render_text(report: Report) -> str:
    s = report.summary
    out = [f"{report.tool} report (threshold {report.threshold:.2f})", f"scanned={s['files_scanned']} forms={s['forms_compared']} findings={total_findings(s)} warnings={s['parse_warnings']}", ""]
    for tier in TIERS:
        rows = [f for f in report.findings if f["tier"] == tier]
        if rows:
            out.append(f"## {tier}")
            for f in rows:
                out.append(f"- {f['clone_type']} score={f['score']:.4f} {f['tier']}")
                out += [f"    {m['path']}:{m['start_line']}-{m['end_line']} {m['name']}" for m in f["members"]]
            out.append("")
    if report.parse_warnings:
        out += ["## warnings", *(f"- {w}" for w in report.parse_warnings)]
    return "\n".join(out) + "\n" * (out[-1] != "")


def findings_json(found: DataFrame) -> DataFrame:
    """A JSON line for each finding, made by executors."""
    return found.select(F.to_json(F.struct("clone_type", "tier", "score", F.transform("members", lambda m: F.struct(m["path"].alias("path"), m["start_line"].alias("start_line"), m["end_line"].alias("end_line"), m["name"].alias("name"))).alias("members"))).alias("finding"))


def findings_text(found: DataFrame) -> DataFrame:
    """The lines of each finding in a text report, made by executors."""
    member = lambda m: F.format_string("    %s:%d-%d %s", m["path"], m["start_line"], m["end_line"], m["name"])
    head = F.format_string("- %s score=%.4f %s", "clone_type", "score", "tier")
    return found.select(F.array_join(F.concat(F.array(head), F.transform("members", member)), "\n").alias("text"))
