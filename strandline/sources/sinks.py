"""Sinks (K1-K11): Spark's writers commit whole results; manifests are small JSON files written through the same file system."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """K1, K5, K6: csv, tsv, parquet or json."""
    if fmt not in ("csv", "tsv", "parquet", "json"):
        raise ValueError(f"unknown format {fmt}")
    writer = df.write.mode(mode)
    if fmt in ("csv", "tsv"):
        writer.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    else:
        getattr(writer, fmt)(path)


def by_chromosome(df: DataFrame, path: str, chrom="chrom", rows_a_file: int = 5_000_000) -> None:
    """K2, K3, K8: a folder a chromosome, large ones in several files."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_a_file).partitionBy(chrom).parquet(path)


def write_json(spark: SparkSession, path: str, content: dict) -> None:
    """K4: one small JSON document."""
    spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def bed(df: DataFrame, threshold=0.5) -> DataFrame:
    """K7: calls over the threshold as 2-base intervals: in the intron's direction at a donor, before the exon at an acceptor, mirrored on the minus strand."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(f"{k}_prob").alias("score")) for k in ("donor", "acceptor")))).alias("_c")
    got = df.select("chrom", "position", "strand", each).select("*", "_c.*").where(F.col("score") > threshold)
    after = ((F.col("name") == "donor") & (F.col("strand") == "+")) | ((F.col("name") == "acceptor") & (F.col("strand") == "-"))
    start = F.when(after, F.col("position")).otherwise(F.col("position") - 3)
    return got.select("chrom", start.alias("start"), (start + 2).alias("end"), "name", "score", "strand")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of every file, each hashed as a stream by the task that has it, through the file system of its path; files of any size."""

    def hashed(batches):
        import hashlib
        import re

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            digests = []
            for name in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name).replace(" ", "%20"))
                with system.open_input_stream(at, compression=None) as stream:
                    digest = hashlib.sha256()
                    while piece := stream.read(1 << 22):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests)], names=["path", "size", "sha256"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size")).mapInArrow(hashed, "path string, size long, sha256 string")


def stale(now: DataFrame, then: DataFrame) -> DataFrame:
    """Files that are new, changed or gone since a manifest."""
    old = then.select("path", F.col("sha256").alias("was"))
    got = now.select("path", "sha256").join(old, "path", "full")
    status = F.when(F.col("was").isNull(), "new").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("was"), "changed")
    return got.select("path", status.alias("status")).where("status IS NOT NULL")
