"""Principal components from mergeable moments, so that a fit can go on with new batches.

A batch's moments are the number of its vectors, their sum and the sum of their cross products, all less a fixed shift (the mean of the first batch, so that nothing large cancels).
They add up: over tasks, batches and runs, in any order. Each batch is a folder of its own with one row, which a rerun of the batch overwrites; the components come from the
sum of all rows, by an eigendecomposition of one d x d matrix on the driver (d is a vector's length, not the table's).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import as_double, valid_vector

MOMENTS = "n bigint, shift array<double>, sums array<double>, crosses array<double>"


def usable(df: DataFrame, vector: str, length: int | None = None) -> DataFrame:
    """(x) of the vectors that are whole numbers of one length: `length`, or the most frequent one (the smaller, on ties)."""
    some = df.where(valid_vector(F.col(vector)) & (F.size(vector) > 0)).select(as_double(F.col(vector)).alias("x"))
    some = some.where(~F.exists("x", lambda v: F.abs(v) == float("inf")))
    if length is None:
        found = some.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).agg(F.min_by("d", F.struct(-F.col("n"), F.col("d")))).first()
        length = found[0]
    return some.where(F.size("x") == (length or 0))


def pairs(d: int) -> tuple[np.ndarray, np.ndarray]:
    """The places (i, j), i <= j, of cross products in their array."""
    return np.triu_indices(d)


def batch_moments(vectors: DataFrame, shift: list[float] | None = None) -> DataFrame:
    """One row (n, shift, sums, crosses) of a table (x), none of an empty one. Each task adds up its own vectors; the tasks' arrays are added up place by place."""
    if shift is None:
        mean = vectors.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).collect()  # a row a component
        shift = [r["m"] for r in sorted(mean, key=lambda r: r["i"])]
    d, off = len(shift), np.array(shift)
    if not d:
        return vectors.sparkSession.createDataFrame([], MOMENTS)
    upper = pairs(d)

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, crosses = 0, np.zeros(d), np.zeros((d, d))
        for part in parts:
            if len(part):
                x = np.stack(part["x"].to_numpy()) - off
                n, sums, crosses = n + len(x), sums + x.sum(0), crosses + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "all": [np.concatenate([sums, crosses[upper]])]})

    return added(vectors.mapInPandas(add, "n bigint, all array<double>"), shift)


def added(parts: DataFrame, shift: list[float]) -> DataFrame:
    """One row (n, shift, sums, crosses) from rows (n, all) of one shift."""
    d, size = len(shift), len(shift) + len(shift) * (len(shift) + 1) // 2
    each = parts.select("n", F.posexplode("all").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    whole = each.agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda p: p["v"]).alias("all")).where("n IS NOT NULL")
    held = F.array(*map(F.lit, shift))
    return whole.select("n", held.alias("shift"), F.slice("all", 1, d).alias("sums"), F.slice("all", d + 1, size).alias("crosses"))


def merged(moments: DataFrame) -> DataFrame:
    """One row of many: rows of one shift. None of an empty table."""
    first = moments.select("shift").first()
    return added(moments.select("n", F.concat("sums", "crosses").alias("all")), first[0]) if first else moments.limit(0)


def held_moments(spark: SparkSession, folder: str) -> DataFrame | None:
    """The batches' moments of a folder; nothing where it isn't there."""
    try:
        return spark.read.schema(f"{MOMENTS}, batch string").parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def partial_fit(df: DataFrame, folder: str, batch: str, vector: str = "embedding") -> None:
    """Add a batch's moments to a folder. The first batch fixes length and shift; the same batch again takes the place of itself."""
    held = held_moments(df.sparkSession, folder)
    first = held.orderBy("batch").first() if held is not None else None
    shift = first["shift"] if first else None
    batch_moments(usable(df, vector, len(shift) if shift else None), shift).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def explained(one: DataFrame) -> DataFrame:
    """(i, j, n, mean_i, mean_j, covariance), i <= j from 0, of a row of moments; population covariance."""
    d = F.size("sums")
    ij = F.flatten(F.transform(F.sequence(F.lit(0), d - 1), lambda i: F.transform(F.sequence(i, d - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    rows = one.select("n", "shift", "sums", F.inline(F.arrays_zip(ij.alias("ij"), F.col("crosses").alias("c"))).alias("ij", "c"))
    off = lambda k: F.get("sums", F.col(f"ij.{k}")) / F.col("n")
    mean = lambda k: (F.get("shift", F.col(f"ij.{k}")) + off(k)).alias(f"mean_{k}")
    return rows.select("ij.i", "ij.j", "n", mean("i"), mean("j"), (F.col("c") / F.col("n") - off("i") * off("j")).alias("covariance"))


def components(one: DataFrame, k: int) -> tuple[list[float], list[list[float]], list[float]]:
    """(mean, axes, variances) of a row of moments: the k directions of most variance (sample variance), each with its largest loading positive. Empty lists of no row."""
    row = one.first()
    if row is None:
        return [], [], []
    n, d = row["n"], len(row["sums"])
    off, cross = np.array(row["sums"]) / n, np.zeros((d, d))
    cross[pairs(d)] = row["crosses"]
    cross = cross + np.triu(cross, 1).T
    values, vectors = np.linalg.eigh((cross - n * np.outer(off, off)) / max(1, n - 1))
    axes = vectors.T[::-1][:k]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return (np.array(row["shift"]) + off).tolist(), axes.tolist(), np.maximum(values[::-1][:k], 0).tolist()
