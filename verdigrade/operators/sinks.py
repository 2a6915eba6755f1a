"""Writers with a rule for keys that exist already; Parquet has no MERGE, so both are joins before an append or overwrite."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The incoming rows whose key is new, one a key; null keys equal each other."""
    a, b = incoming.dropDuplicates(list(keys)).alias("a"), existing.select(*keys).distinct().alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, on, "left_anti")


def first_wins(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after an insert that leaves existing keys alone."""
    return existing.unionByName(new_rows(existing, incoming, keys))


def last_wins(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after an upsert: incoming rows replace those of their key."""
    return new_rows(incoming, existing, keys).unionByName(incoming)


def without(existing: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The table without the listed keys."""
    return existing.join(keys.select(*on).distinct(), list(on), "left_anti")


#: Partitions of a batch up to which they are named to the reader of a table.
MOST_PARTITIONS = 1000


def append_first_wins(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Appends the rows with new keys to a Parquet table. One writer a table at a time.

    A partitioned table's keys hold its partition columns, so only the partitions that the incoming rows touch
    are read; a batch that touches more than MOST_PARTITIONS is held against the whole table.
    """
    if _exists(spark, path):
        existing = spark.read.parquet(path)
        for column in partition_by if set(partition_by) <= set(keys) else ():
            touched = [r[0] for r in incoming.select(column).distinct().limit(MOST_PARTITIONS + 1).collect()]
            if len(touched) <= MOST_PARTITIONS:
                known = F.col(column).isin(*[x for x in touched if x is not None])
                existing = existing.where(known | F.col(column).isNull() if None in touched else known)
        incoming = new_rows(existing, incoming, keys)
    else:
        incoming = incoming.dropDuplicates(list(keys))
    writer = incoming.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def upsert_partitions(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], partition: str) -> None:
    """Replaces rows by key in a Parquet table, rewriting only the partitions that incoming rows touch."""
    out = incoming
    if _exists(spark, path):
        touched = spark.read.parquet(path).join(incoming.select(partition).distinct(), partition, "left_semi")
        out = last_wins(touched.select(*incoming.columns), incoming, keys)
        staged = f"{path}.staged"
        out.write.mode("overwrite").partitionBy(partition).parquet(staged)
        out = spark.read.parquet(staged)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def get_or_create(spark: SparkSession, path: str, row: dict, key: Sequence[str], content: str) -> dict:
    """The stored row of a key, or the given one, which is then stored.

    A row that is there already must have the same content (a digest column); another content is an error, so
    that a name and version never mean two things. Tables of this kind (datasets, templates, model versions)
    are small; one writer a table at a time.
    """
    if _exists(spark, path):
        stored = spark.read.parquet(path).where(F.lit(True))
        for k in key:
            stored = stored.where(F.col(k).eqNullSafe(F.lit(row[k])))
        found = stored.limit(1).collect()
        if found:
            if found[0][content] != row[content]:
                raise ValueError(f"{'@'.join(str(row[k]) for k in key)} exists already with another {content}")
            return found[0].asDict(recursive=True)
    spark.createDataFrame([row]).write.mode("append").parquet(path)
    return row


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_atomic(files: dict[str | Path, str]) -> None:
    """Small artifacts put in place together: all are written beside their targets before any is renamed."""
    staged = []
    try:
        for target, body in files.items():
            target = Path(target)
            target.parent.mkdir(parents=True, exist_ok=True)
            fd, tmp = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
            staged.append((tmp, target))
            with os.fdopen(fd, "w", encoding="utf-8") as f:
                f.write(body)
        for tmp, target in staged:
            os.replace(tmp, target)
    finally:
        for tmp, _ in staged:
            if os.path.exists(tmp):
                os.unlink(tmp)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
