"""What is left to do, and which records to draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remaining(cases: DataFrame, repeats: int, done: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, repeat_idx): every case times its repeats that `done` lacks; the repeats come from each row, not from a join."""
    plan = cases.select(case, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat_idx"))
    return plan.join(done.select(case, "repeat_idx").distinct(), [case, "repeat_idx"], "left_anti")


def seeded_sample(records: DataFrame, record_id: str, seed: int, size: int) -> DataFrame:
    """`size` records drawn by the hash of seed and id, the same on every cluster; in order of id. A null id is never drawn."""
    drawn = records.where(F.col(record_id).isNotNull()).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(record_id).cast("string")), 256), record_id).limit(size)
    return drawn.orderBy(record_id)
