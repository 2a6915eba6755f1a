"""Queries of problem 1 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigrade.operators.references import Reference, orphan_references, orphan_report
from verdigrade.session import table

REFERENCES = (
    Reference("judgments", "judgment_id", "generation_id", "judged_at", "candidates_calibration", "generation_id"),
    Reference("mock_judge_responses_calibration", "response_id", "generation_id", "responded_at", "candidates_calibration", "generation_id"),
    Reference("labels_dev", "label_id", "case_id", "labeled_at", "eval_cases", "case_id"),
)


def _tables(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    return (
        {r.child: table(spark, sf_dir, r.child) for r in REFERENCES},
        {r.parent: table(spark, sf_dir, r.parent) for r in REFERENCES},
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(*_tables(spark, sf_dir), REFERENCES).select("ref_table", "ref_id")


def p1_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(*_tables(spark, sf_dir), REFERENCES)


QUERIES = {"p1_found": p1_found, "p1_orphans_by_month": p1_orphans_by_month}

_KEY = r"nullif(lower(trim({}, E' \t\n\r\x0b\x0c')), '')"


def _orphans_of(r: Reference) -> str:
    """Every row of a child table with the reason why its reference does not hold, by subqueries on the parent."""
    rows = f"(SELECT {_KEY.format(r.parent_key)} AS k, loaded_at, deleted_at FROM {r.parent})"
    return f"""SELECT '{r.child}' AS ref_table, '{r.ref_key}' AS ref_key, c.ref_id, CASE WHEN c.ref_id IS NULL THEN c.pos END AS pos, c.k, c.t,
 CASE WHEN p.k IS NULL THEN 1 WHEN p.born > c.t THEN 2 WHEN p.gone <= c.t THEN 3 END AS why
FROM (SELECT {r.ref_id} AS ref_id, row_number() OVER () AS pos, {_KEY.format(r.ref_key)} AS k, {r.made_at} AS t FROM {r.child}) c
LEFT JOIN (SELECT k, min(loaded_at) AS born, min(deleted_at) AS gone FROM {rows} WHERE k IS NOT NULL GROUP BY k) p ON p.k = c.k WHERE c.k IS NOT NULL"""


_ROWS = "WITH refs AS (" + " UNION ALL ".join(map(_orphans_of, REFERENCES)) + ")"

ORACLE = {
    "p1_found": _ROWS + " SELECT ref_table, ref_id FROM refs GROUP BY ref_table, ref_key, ref_id, pos HAVING count(why) > 0",
    "p1_orphans_by_month": _ROWS
    + """, ranked AS (SELECT *, min(t) OVER w AS since, row_number() OVER (PARTITION BY ref_table, ref_key, ref_id, pos ORDER BY why IS NULL, t NULLS LAST, why, k) AS place
 FROM refs WINDOW w AS (PARTITION BY ref_table, ref_key, ref_id, pos))
SELECT ref_table, ref_key, strftime(since AT TIME ZONE 'UTC', '%Y-%m') AS period, count(*) AS n_references, count(why) AS n_orphans,
 count(*) FILTER (why = 1) AS n_missing, count(*) FILTER (why = 2) AS n_late, count(*) FILTER (why = 3) AS n_deleted
FROM ranked WHERE place = 1 GROUP BY 1, 2, 3""",
}
