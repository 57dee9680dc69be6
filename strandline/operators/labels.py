"""Labels, splits and samples (L1-L7, L9-L13, O5-O8, O10): hashes decide, so that reruns and both engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import with_halo

#: Fixed value: multiplier of the arithmetic hash that Spark and plain SQL share.
MULTIPLIER = 2654435761


def key_hash(key, modulus: int = 1000, seed: int = 0) -> Column:
    """An arithmetic hash of a whole number (a column or its name), 0 to modulus - 1."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod((key.cast("bigint") % 1000003 + seed) * F.lit(MULTIPLIER), F.lit(1 << 32)).cast("bigint") % modulus


def three_class(positions: DataFrame, sites: DataFrame, on: list[str], kind="splice_type") -> DataFrame:
    """L1: 0 none, 1 acceptor, 2 donor; a position that is both takes donor."""
    per = sites.groupBy(*on).agg(F.max(F.when(F.col(kind) == "donor", 2).when(F.col(kind) == "acceptor", 1).otherwise(0)).alias("label"))
    return positions.join(per, on, "left").fillna(0, subset=["label"])


def layered(positions: DataFrame, annotated: DataFrame, positives: DataFrame, on: list[str], confirmed="confirmed") -> DataFrame:
    """L2: positives (label and weight 2 where confirmed) over annotated (255, ignored) over neither (2)."""
    got = positions.join(annotated.select(*on).distinct().withColumn("_known", F.lit(1)), on, "left").join(positives.select(*on, F.col("label").alias("_p"), F.col(confirmed).alias("_c")), on, "left")
    return got.withColumn("label", F.when(F.col("_p").isNotNull(), F.col("_p")).when(F.col("_known").isNotNull(), 255).otherwise(2)).withColumn("weight", F.when(F.col("_p").isNotNull() & F.coalesce("_c", F.lit(False)), 2.0).otherwise(1.0)).drop("_known", "_p", "_c")


def preset_split(df: DataFrame, chrom="chrom", test=("1", "3", "5", "7", "9")) -> DataFrame:
    """Chromosomes of the preset are test, all others train."""
    return df.withColumn("split", F.when(F.regexp_replace(chrom, "^chr", "").isin(list(test)), "test").otherwise("train"))


def balanced_split(df: DataFrame, key: str, train_share=0.8) -> DataFrame:
    """L4: keys from the largest on go to train until those before reach the share; the table has a row a key (chromosomes)."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), key)  # a row a key: few rows
    before = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    total = F.sum("n").over(Window.partitionBy())
    return n.select(key, "n", F.when(before < total * train_share, "train").otherwise("test").alias("split"))


def length_split(df: DataFrame, key: str, length: str, test_share=0.2, seed=42) -> DataFrame:
    """Keys in the order of their hash go to test until those before reach the share of all lengths; the table has a row a key (chromosomes)."""
    w = Window.orderBy(key_hash(key, 1 << 31, seed), key)  # a row a key: few rows
    before = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(length)
    total = F.sum(length).over(Window.partitionBy())
    return df.withColumn("split", F.when(before < total * test_share, "test").otherwise("train"))


def holdout(df: DataFrame, key: str, by: str, share: float, seed=42) -> DataFrame:
    """In each group the max(1, floor(n * share)) rows of least hash are val."""
    w = Window.partitionBy(by)
    rank = F.row_number().over(w.orderBy(key_hash(key, 1 << 31, seed), key))
    return df.withColumn("is_val", rank <= F.greatest(F.lit(1), F.floor(F.count("*").over(w) * share)))


def without_shared_families(test: DataFrame, train: DataFrame, family: str) -> DataFrame:
    """Test rows whose family isn't in train; a null family is in none."""
    return test.join(train.where(F.col(family).isNotNull()).select(family).distinct(), family, "left_anti")


def shared_families(val: DataFrame, test: DataFrame, family: str) -> DataFrame:
    """The rows that move back to train."""
    return val.join(test.where(F.col(family).isNotNull()).select(family).distinct(), family, "left_semi")


def family_sizes(df: DataFrame, family: Column, least=2) -> DataFrame:
    """Each row's family where it has `least` members or more, else null."""
    got = df.withColumn("family", family)
    n = got.where("family IS NOT NULL").groupBy("family").agg(F.count("*").alias("family_size")).where(F.col("family_size") >= least)
    return got.join(n, "family", "left").withColumn("family", F.when(F.col("family_size").isNotNull(), F.col("family")))


def tiers(df: DataFrame, score: str, by: list[str], position: str, key: str, threshold=0.01, width=0, background=0.005, seed=42) -> DataFrame:
    """Sites over the threshold, rows within `width` of one, and a hashed share of the rest; the tier of each row kept."""
    w = Window.partitionBy(*by, "_bin").orderBy(position).rangeBetween(-width, width)
    site = F.col(score) > threshold
    got = with_halo(df, position, width).withColumn("_near", F.max(site.cast("int")).over(w) == 1).where("_core").drop("_bin", "_core")
    drawn = key_hash(key, 100_000, seed) < round(background * 100_000)
    return got.withColumn("tier", F.when(site, "splice").when(F.col("_near"), "proximity").when(drawn, "background")).where("tier IS NOT NULL").drop("_near")


def least_hashes(df: DataFrame, by: list[str], key: str, n: Column, seed=42, bits: int = 15) -> DataFrame:
    """The n rows of least hash of each group (of all, if `by` is empty), ties by key. n may depend on the group's columns, as _by0 on.

    Rows are counted by ranges of 2**bits hashes first (at most 2**(31 - bits) ranges a group). Ranges under the one that holds the cut are
    kept whole, and only the rows of that one are ranked, so no task sees a group.
    """
    names = [f"_by{i}" for i in range(len(by))]
    h = key_hash(key, 1 << 31, seed)
    cut = df.withColumn("_range", F.coalesce(F.shiftright(h, bits), F.lit(-1).cast("bigint")))  # a null key is first, as in an ascending order
    counts = cut.groupBy(*(F.col(c).alias(name) for c, name in zip(by, names)), "_range").agg(F.count("*").alias("_rows"))
    upto = F.sum("_rows").over(Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    ranges = counts.withColumn("_left", n - (upto - F.col("_rows"))).where("_left > 0").withColumnRenamed("_range", "_of")
    same = F.col("_range") == F.col("_of")
    for c, name in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(name))
    held = cut.join(ranges, same).drop(*names, "_of")
    w = Window.partitionBy(*by).orderBy(h, key)
    last = held.where("_rows > _left").withColumn("_k", F.row_number().over(w)).where("_k <= _left")
    return held.where("_rows <= _left").select(*df.columns).unionByName(last.select(*df.columns))


def downsample(df: DataFrame, keep: Column, key: str, ratio: float, seed=42) -> DataFrame:
    """All rows of `keep`, and floor(ratio * their number) of the others by least hash."""
    n = int(df.where(keep).count() * ratio)
    return df.where(keep).unionByName(least_hashes(df.where(~keep), [], key, F.lit(n), seed))


def balance(df: DataFrame, label: str, key: str, seed=42) -> DataFrame:
    """As many rows of each class as the smallest has, by least hash. Classes are few, so the counts are broadcast."""
    n = df.groupBy(label).agg(F.count("*").alias("_n")).agg(F.min("_n")).first()[0]
    return least_hashes(df, [label], key, F.lit(n or 0), seed)


def drawn_positions(genes: DataFrame, per: int, start="start", end="end", margin=100, shortest=400, seed=42) -> DataFrame:
    """Positions inside genes in proportion to length: one draw for each `per` bases of a gene longer than `shortest`, by hash, off the outer `margin`."""
    size = F.col(end) - F.col(start)
    draws = genes.where(size > shortest).withColumn("_draw", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(size / per).cast("int") - 1))))
    hashed = key_hash(F.col(start) + F.col("_draw"), size - 2 * margin, seed)
    return draws.where(F.col("_draw") < F.floor(size / per)).withColumn("position", F.col(start) + margin + hashed).drop("_draw").distinct()


def stratified_negatives(candidates: DataFrame, real: DataFrame, on: list[str], kind: str, key: str, quota: dict[str, int], seed=42) -> DataFrame:
    """Candidates that aren't real, the quota of each kind by least hash; only the range of hashes that holds a kind's cut is ranked."""
    left = candidates.join(real.select(*on).distinct(), on, "left_anti").where(F.col(kind).isin(list(quota)))
    most = F.element_at(F.create_map(*(F.lit(x) for k, v in quota.items() for x in (k, v))), F.col("_by0"))
    return least_hashes(left, [kind], key, most, seed)


def leaking(df: DataFrame, features: list[str], label: str, threshold=0.95) -> DataFrame:
    """Features whose correlation with the label reaches the threshold in size."""
    wide = df.agg(*(F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in features))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation")) for c in features))).alias("r")).select("r.*").where(F.abs("correlation") >= threshold)


def dead_channels(df: DataFrame, channels: list[str]) -> DataFrame:
    """Whether any value of each channel is not zero."""
    wide = df.agg(*(F.max(F.abs(F.col(c).cast("double"))).alias(c) for c in channels))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), (F.coalesce(F.col(c), F.lit(0.0)) == 0).alias("is_dead")) for c in channels))).alias("r")).select("r.*")
