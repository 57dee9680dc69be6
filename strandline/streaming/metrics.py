"""G1: metrics of a stream of scored positions, as state that outlives the run.

Positions of a gene come whenever they come, a gene at a time or in pieces, late or out of order. Each position is a row for each class; rows are keyed by (class, shard), the shard
from a hash of the gene, so that the class that nearly all positions have is as many keys as there are shards. A key's state is counters and two histograms of scores of fixed
length, whatever the number of positions. Every batch writes the counters of the keys that it touched into a folder of its own: a batch that is run again after a failure
overwrites its folder, so nothing counts twice, and a new run goes on from the checkpoint.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.evaluation import argmax_class, with_rates

#: Scores from 0 to 1 in so many bins; a score of 1 is in the last.
BINS, SHARDS = 100, 32
STATE = "n_true bigint, tp bigint, fp bigint, fn bigint, n_rows bigint, positive array<bigint>, negative array<bigint>"
OUT = f"class_index int, shard int, {STATE}"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class ClassCounters(StatefulProcessor):
    """A key's rows (is_true, is_called, bin) added to its counters; the new counters go out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.counters.get()
        n_true, tp, fp, fn, n = held[:5] if held else (0,) * 5
        positive, negative = (np.array(x, np.int64) for x in held[5:7]) if held else (np.zeros(BINS, np.int64), np.zeros(BINS, np.int64))
        for part in rows:
            true, called, at = part["is_true"].to_numpy(bool), part["is_called"].to_numpy(bool), part["bin"].to_numpy(np.int64)
            n_true, tp, fp, fn, n = n_true + int(true.sum()), tp + int((true & called).sum()), fp + int((~true & called).sum()), fn + int((true & ~called).sum()), n + len(part)
            positive += np.bincount(at[true], minlength=BINS)
            negative += np.bincount(at[~true], minlength=BINS)
        now = (n_true, tp, fp, fn, n, positive.tolist(), negative.tolist())
        self.counters.update(now)
        yield pd.DataFrame([(int(key[0]), int(key[1]), *now)], columns=[f.split()[0] for f in OUT.split(", ")])

    def close(self) -> None:
        pass


def class_rows(scored: DataFrame, label: str, classes: list[str], gene: str, shards: int = SHARDS) -> DataFrame:
    """(class_index, shard, is_true, is_called, bin): a row for each class of each position with a label. A position without a score of every class stays out."""
    some = scored.where(F.col(label).isNotNull()).dropna(subset=classes)
    called = argmax_class(classes)
    bin_of = lambda c: F.least(F.greatest(F.floor(F.col(c) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("class_index"), (F.col(label) == i).alias("is_true"), (called == i).alias("is_called"), bin_of(c).alias("bin")) for i, c in enumerate(classes))))
    shard = F.pmod(F.xxhash64(gene), F.lit(shards)).cast("int")
    return some.select(shard.alias("shard"), each.alias("c")).select("c.class_index", "shard", "c.is_true", "c.is_called", "c.bin")


def accumulate(stream: DataFrame, folder: str, checkpoint: str, label: str, classes: list[str], gene: str, shards: int = SHARDS) -> None:
    """Process what the stream has now, commit, stop. The counters after each batch are in folder/batch=<number>.

    The state store that keeps state by key in files is set for the session while it runs. `shards` must not change between runs of one checkpoint.
    """
    spark = stream.sparkSession
    keyed = class_rows(stream, label, classes, gene, shards).groupBy("class_index", "shard")
    counters = keyed.transformWithStateInPandas(ClassCounters(), outputStructType=OUT, outputMode="Update", timeMode="None")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        counters.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """(class_index, counters) of all batches so far: each key's newest counters, summed over shards."""
    batches = spark.read.schema(f"{OUT}, batch bigint").parquet(folder)
    newest = batches.groupBy("class_index", "shard").agg(F.max_by(F.struct(*(f.split()[0] for f in STATE.split(", "))), "batch").alias("s")).select("class_index", "s.*")
    add = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c]).alias(c)
    bins = newest.select("class_index", F.posexplode(F.arrays_zip("positive", "negative")).alias("at", "x")).groupBy("class_index", "at").agg(F.sum("x.positive").alias("positive"), F.sum("x.negative").alias("negative"))
    lists = bins.groupBy("class_index").agg(add("positive"), add("negative"))
    return newest.groupBy("class_index").agg(*(F.sum(c).alias(c) for c in ("n_true", "tp", "fp", "fn", "n_rows"))).join(lists, "class_index")


def class_metrics(counters: DataFrame, digits: int = 4) -> DataFrame:
    """Precision, recall and F1 of each class."""
    return with_rates(counters.drop("positive", "negative"), digits)


def swept(counters: DataFrame, digits: int = 4) -> DataFrame:
    """Counts and rates of each class at the thresholds 0, 1 / BINS, 2 / BINS...: sums of the histograms from a bin on."""
    rows = counters.select("class_index", F.posexplode(F.arrays_zip("positive", "negative")).alias("at", "x")).select("class_index", "at", "x.*")
    w = Window.partitionBy("class_index").orderBy("at")  # a class has BINS rows
    from_here = w.rowsBetween(0, Window.unboundedFollowing)
    tp, whole = F.sum("positive").over(from_here), F.sum("positive").over(Window.partitionBy("class_index"))
    return with_rates(rows.select("class_index", (F.col("at") / BINS).alias("threshold"), tp.alias("tp"), F.sum("negative").over(from_here).alias("fp"), (whole - tp).alias("fn")), digits)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (local mode)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp(prefix="strandline-") if spark.sparkContext.master.startswith("local") else None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
