"""Live views of a run's events, ingestion that can be resumed, and the replay of a circuit breaker."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigrade.operators.sinks import append_first_wins

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_a_batch: int = 64) -> DataFrame:
    """Events as they arrive in a folder; how many files a batch takes bounds what is in flight."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, length: str = "1 hour", late: str | None = "30 minutes") -> DataFrame:
    """(event_type, start, n, total) by window; with a watermark, rows later than `late` are dropped and their windows closed."""
    e = events.withWatermark("ts", late) if late and events.isStreaming else events
    w = e.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select("event_type", F.col("window.start").alias("start"), "n", "total")


def sliding_counts(events: DataFrame, length: str = "1 hour", step: str = "15 minutes", late: str | None = "30 minutes") -> DataFrame:
    e = events.withWatermark("ts", late) if late and events.isStreaming else events
    return e.groupBy(F.window("ts", length, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): stretches of a user's events without a pause of `gap`; end is the last event plus the gap."""
    e = events.withWatermark("ts", late) if late and events.isStreaming else events
    s = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that a stream has now to Parquet and stops; the checkpoint makes the next call go on from there."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path)
    writer.trigger(availableNow=True).start().awaitTermination()


def ingest_once(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str]) -> None:
    """Appends rows whose key isn't there yet, batch by batch; a batch that is repeated after a failure adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        append_first_wins(df.sparkSession, path, df, keys)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def update_into(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Each batch's changed aggregates as a file set of its own, marked with the batch; the latest a key is current."""

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def breaker_replay(events: DataFrame, key: str = "user_id", failed: str = "event_type = 'error'", limit: int = 5, cooldown: float = 30.0) -> DataFrame:
    """(key, n_calls, n_rejected, n_opened): what a breaker per key would have done over an event log.

    It opens after `limit` failures in a row, rejects calls for `cooldown` seconds, then lets one through that
    closes it or opens it again. The rows of a key are sorted into one task and pass through it one by one;
    only the breaker's few numbers are held, so a key of any size fits.
    """
    rows = events.select(F.col(key).alias("key"), F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.expr(failed).alias("failed")).where(F.col("key").isNotNull() & F.col("us").isNotNull())
    ordered = rows.repartition("key").sortWithinPartitions("key", "us", "event_id")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, calls, rejected, opened, run, since = None, 0, 0, 0, 0, None
        for f in frames:
            done = []
            for k, us, bad in zip(f["key"].tolist(), f["us"].tolist(), f["failed"].tolist()):
                if k != now:
                    if now is not None:
                        done.append((now, calls, rejected, opened))
                    now, calls, rejected, opened, run, since = k, 0, 0, 0, 0, None
                calls += 1
                if since is not None and us - since < cooldown * 1e6:
                    rejected += 1
                elif bad:
                    run += 1
                    if since is not None or run >= limit:
                        since, opened = us, opened + 1
                else:
                    run, since = 0, None
            yield pd.DataFrame(done, columns=["key", "n_calls", "n_rejected", "n_opened"])
        if now is not None:
            yield pd.DataFrame([(now, calls, rejected, opened)], columns=["key", "n_calls", "n_rejected", "n_opened"])

    return ordered.mapInPandas(each, "key bigint, n_calls long, n_rejected long, n_opened long").withColumnRenamed("key", key)
