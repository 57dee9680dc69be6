"""Pieces that several operators share: the shared folder, written tables, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (local mode)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
            base = spark.sparkContext.getCheckpointDir()
    return base if "://" in base or base.startswith("file:") else f"file://{base}"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(uri: str):
    """pyarrow's file system of a path that Spark gave, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


#: Folders that written() made, of each scope() that is open.
_SCOPES: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def save(df: DataFrame, name: str) -> DataFrame:
    """written(), outside of any scope()."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*paths: str) -> None:
    """Delete folders of the shared folder."""
    for path in paths:
        fs, at = file_system(path)
        fs.delete_dir(at)


@contextmanager
def scope():
    """Tables that written() makes inside are deleted when it ends (save() keeps its own)."""
    _SCOPES.append([])
    try:
        yield
    finally:
        forget(*_SCOPES.pop())


def text_batches(spark: SparkSession, rows: int = 512) -> None:
    """Texts are long: hand them to Python in small Arrow batches (a session setting), so that a worker holds a few MB of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name = f"_{name}"
    return name


def row_keys(df: DataFrame) -> list:
    """128 bits over all columns as two longs: equal in equal rows, and in no others. Columns with maps or variants, which have no hash, take part as JSON."""
    text = lambda c: F.to_json(F.struct(c), {"ignoreNullFields": "false"})
    of = [text(F.col(f"`{c}`")) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in df.dtypes]
    return [F.xxhash64(F.lit(k), *of) for k in (1, 2)]


def let(value, body):
    """Bind a column expression to a name inside a higher-order function, so that it is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text):
    """A-Z lower-cased and nothing else: lower() does that to a text of ASCII, translate(), slower, to others."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, capitals, capitals.lower()))


def components(edges: DataFrame, name: str = "components", max_rounds: int = 64) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    edges: (src, dst) of a type that has an order, any direction, repeats and loops allowed, no nulls. Alternating large-star and
    small-star steps; each round is a written table, so the lineage stays short and no vertex's neighbours are ever
    gathered in one place: minima are aggregated, written, and joined back. A join with a table that was just aggregated keeps that table's
    partitions, and adaptive execution can't split a hub there; with a written one it can (or Spark broadcasts it, under its own size bound).
    """
    pair = lambda df: df.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct()

    def mark(df):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst")), F.bit_xor(F.xxhash64(F.lit(1), "src", "dst"))).first())

    now = written(pair(edges), name)
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = written(both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m")), f"{name}-least")
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        now = written(small.unionByName(least.withColumnRenamed("m", "dst")).where("src <> dst").distinct(), name)
        last, seen = seen, mark(now)
        if last == seen:
            break
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
