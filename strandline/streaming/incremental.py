"""Bounded-memory and incremental work (G1-G6, G8): resumable partitions, idempotent column additions, event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The keys that no finished chunk has."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def write_partitions(df: DataFrame, path: str, key: str) -> None:
    """One folder a key; only the keys that df holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def resume(spark: SparkSession, work: DataFrame, path: str, key: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Transform what isn't there yet, then read all."""
    try:
        there = spark.read.schema(work.select(key).schema).parquet(path)
        left = pending(work, there, key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        left = work
    write_partitions(transform(left), path, key)
    return spark.read.parquet(path)


def augment(df: DataFrame, name: str, columns: list[str], transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add a modality's columns once: nothing to do if all are there, a partial set is dropped and made anew."""
    if all(c in df.columns for c in columns):
        return df
    out = transform(df.drop(*columns))
    lacking = [c for c in columns if c not in out.columns]
    if lacking:
        raise ValueError(f"{name} didn't make {lacking}")
    return out


def refresh(df: DataFrame, columns: list[str], transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Drop and make anew."""
    return transform(df.drop(*columns))


def event_windows(events: DataFrame, length: str, slide: str | None = None, late: str | None = None, time="ts", by=("event_type",), value="value") -> DataFrame:
    """Counts and sums in tumbling or sliding windows; with `late`, a watermark (needed for streams)."""
    df = events.withWatermark(time, late) if late else events
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return df.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None, time="ts", by=("user_id",)) -> DataFrame:
    """Sessions that a gap ends."""
    df = events.withWatermark(time, late) if late else events
    return df.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream; the sink's checkpoint remembers what is done."""
    return spark.readStream.schema(schema).parquet(path)


def run_available(df: DataFrame, path: str, checkpoint: str, mode="append") -> None:
    """Process what is there, commit, stop; a rerun goes on from the checkpoint."""
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merge_counters(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """G1: running counters of an accumulator and a batch's."""
    sums = [c for c in old.columns if c not in keys]
    return old.unionByName(new).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
