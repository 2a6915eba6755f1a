"""Release gates, run reports and suites from aggregated rows; identity of artifacts by digest."""

from __future__ import annotations

import hashlib
import html
from collections.abc import Mapping, Sequence
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigrade.operators.sinks import canonical_json


def digest(value: object) -> str:
    """sha256 of the canonical JSON of a value."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def identity(payload: Mapping, leave_out: Sequence[str]) -> str:
    """sha256:<digest> of an artifact without the fields that its identity doesn't cover."""
    return "sha256:" + digest({k: v for k, v in payload.items() if k not in leave_out})


def evaluate_gates(rows: DataFrame, gates: Mapping[str, tuple[str, str, float, bool]], key: str) -> DataFrame:
    """(key, gate, measured, passed, blocking): each gate's column held against its bound; a missing measure fails.

    gates: name -> (column, ">=" or "<=", bound, blocking).
    """
    parts = []
    for name, (column, op, bound, blocking) in gates.items():
        measured = F.col(column).cast("double")
        ok = measured >= bound if op == ">=" else measured <= bound
        parts.append(F.struct(F.lit(name).alias("gate"), measured.alias("measured"), F.coalesce(ok, F.lit(False)).alias("passed"), F.lit(blocking).alias("blocking")))
    return rows.select(key, F.explode(F.array(*parts)).alias("x")).select(key, "x.*")


def roll_up(gates: DataFrame, key: str) -> DataFrame:
    """(key, passed, n_failed): whether every blocking gate holds."""
    failed = ~F.col("passed")
    return gates.groupBy(key).agg((~F.coalesce(F.bool_or(failed & F.col("blocking")), F.lit(False))).alias("passed"), F.count_if(failed).alias("n_failed"))


def regression_gate(compare: DataFrame, max_p: float = 0.05, min_delta: float = 0.0, min_h: float = 0.0) -> DataFrame:
    """compare with `passed`: it fails only if the candidate is worse, significantly, and by enough on both scales."""
    worse = (F.col("delta") < 0) & (F.col("p_value") <= max_p) & (F.abs(F.col("delta")) >= min_delta) & (F.abs(F.col("cohens_h")) >= min_h)
    return compare.withColumn("passed", ~worse)


def missing_references(rows: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """(column): names that a manifest uses and nothing declares; it must be empty."""
    return rows.select(column).where(F.col(column).isNotNull()).distinct().join(known.select(F.col(known_column).alias(column)), column, "left_anti")


def suite_digest(members: Sequence[Mapping], metrics: Mapping[str, str]) -> str:
    """Identity of a suite: its members' digests in order of name, and what they are measured by."""
    return digest({"members": sorted(m["digest"] for m in members), "metrics": dict(sorted(metrics.items()))})


def report_json(name: str, sections: Mapping[str, DataFrame], order: Mapping[str, Sequence[str]]) -> dict:
    """A report of aggregated sections, each ordered by its columns; the rows must be few."""
    out: dict = {"name": name, "schema_version": "1.0"}
    for section, df in sections.items():
        out[section] = [r.asDict(recursive=True) for r in df.orderBy(*order[section]).collect()]
    out["digest"] = identity(out, ["digest"])
    return out


def report_html(report: Mapping) -> str:
    """The report as one self-contained page; all text is escaped."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(str(report['name']))}</title><h1>{html.escape(str(report['name']))}</h1>"]
    for section, rows in report.items():
        if isinstance(rows, list) and rows:
            head = list(rows[0])
            parts.append(f"<h2>{html.escape(section)}</h2><table><tr>" + "".join(f"<th>{html.escape(h)}</th>" for h in head) + "</tr>")
            parts += ["<tr>" + "".join(f"<td>{html.escape('' if r[h] is None else str(r[h]))}</td>" for h in head) + "</tr>" for r in rows]
            parts.append("</table>")
    return "\n".join(parts) + "\n"


def report_junit(name: str, gates: Sequence[Mapping]) -> str:
    """Gate rows as a JUnit suite."""
    bad = [g for g in gates if not g["passed"]]
    lines = [f"<testsuite name={quoteattr(name)} tests=\"{len(gates)}\" failures=\"{len(bad)}\">"]
    for g in gates:
        case = f"  <testcase name={quoteattr(str(g['gate']))}"
        lines.append(f"{case}/>" if g["passed"] else f"{case}><failure message={quoteattr('measured ' + str(g['measured']))}/></testcase>")
    return "\n".join([*lines, "</testsuite>"]) + "\n"
