"""Data checks (V1-V12, A31, A37): one wide aggregate each, a row a check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column_profile(df: DataFrame) -> DataFrame:
    """Per column its kind, null share, and for numbers minimum and maximum, else distinct values."""
    aggs, rows = [F.count("*").alias("_n")], []
    for i, f in enumerate(df.schema.fields):
        number, c = isinstance(f.dataType, T.NumericType), F.col(f"`{f.name}`")
        aggs += [F.count(c).alias(f"_c{i}"), *([F.min(c.cast("double")).alias(f"_a{i}"), F.max(c.cast("double")).alias(f"_b{i}")] if number else [F.countDistinct(c).alias(f"_d{i}")])]
        rows.append(F.struct(F.lit(f.name).alias("column_name"), F.lit("number" if number else "other").alias("kind"), (1 - F.col(f"_c{i}") / F.col("_n")).alias("null_share"), (F.col(f"_a{i}") if number else F.lit(None).cast("double")).alias("min_value"), (F.col(f"_b{i}") if number else F.lit(None).cast("double")).alias("max_value"), (F.lit(None).cast("bigint") if number else F.col(f"_d{i}")).alias("n_distinct")))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def report(df: DataFrame, keys: list[str], position: str, probabilities=(), binary=(), non_negative=(), allowed_null=0.01) -> DataFrame:
    """V1, V4, V5: violations of each check and whether it passes."""
    bad = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    checks = {"position_null": bad(F.col(position).isNull()), "position_negative": bad(F.col(position) < 0)}
    checks |= {f"{c}_range": bad((F.col(c) < -0.001) | (F.col(c) > 1.001)) for c in probabilities} | {f"{c}_binary": bad(~F.col(c).isin(0, 1)) for c in binary} | {f"{c}_negative": bad(F.col(c) < 0) for c in non_negative}
    nulls = {f"{c}_nulls": bad(F.col(c).isNull()) for c in dict.fromkeys([*probabilities, *binary, *non_negative])}
    wide = df.agg(F.count("*").alias("_n"), *(v.alias(k) for k, v in (checks | nulls).items()))
    rows = [F.struct(F.lit(k).alias("check_name"), F.coalesce(k, F.lit(0)).alias("violations"), (F.coalesce(F.col(k), F.lit(0)) <= (F.col("_n") * allowed_null if k in nulls else F.lit(0))).alias("passed")) for k in checks | nulls]
    many = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("v"))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*").unionByName(many.select(F.lit("duplicate_keys").alias("check_name"), F.col("v").alias("violations"), (F.col("v") == 0).alias("passed")))


def label_alignment(df: DataFrame, kind: str, donor: str, acceptor: str) -> DataFrame:
    """V3: mean scores at each kind of site, and whether the own class leads."""
    got = df.groupBy(kind).agg(F.avg(donor).alias("mean_donor"), F.avg(acceptor).alias("mean_acceptor"))
    return got.withColumn("aligned", F.when(F.col(kind) == "donor", F.col("mean_donor") >= F.col("mean_acceptor")).when(F.col(kind) == "acceptor", F.col("mean_acceptor") >= F.col("mean_donor")))


def missing_columns(df: DataFrame, contract: dict[str, list[str]]) -> dict[str, list[str]]:
    """What each modality's contract asks for and the table lacks."""
    return {name: [c for c in columns if c not in df.columns] for name, columns in contract.items() if any(c not in df.columns for c in columns)}


def same_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """V6: rows before and after a join, and whether they agree."""
    return before.agg(F.count("*").alias("n_before")).join(after.agg(F.count("*").alias("n_after"))).withColumn("preserved", F.col("n_before") == F.col("n_after"))


def motif_share(df: DataFrame, flag: str, least: float) -> DataFrame:
    """The share of canonical motifs; the job fails where it is under `least`."""
    share = F.avg(F.col(flag).cast("double"))
    return df.agg(F.when(share >= least, share).otherwise(F.raise_error(F.concat(F.lit(f"canonical share under {least}: "), share.cast("string"))).cast("double")).alias("canonical_share"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both."""
    return a.select(key).intersect(b.select(key))
