"""Junction evidence (A2-A8, S8): both ends of each junction as positions, then one- or two-level aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melt(junctions: DataFrame, donor="donor_pos", acceptor="acceptor_pos") -> DataFrame:
    """A2: a row for each end, with the other end as partner, in one scan."""
    side = lambda at, of, kind: F.struct(F.col(at).alias("position"), F.col(of).alias("partner"), F.lit(kind).alias("side"))
    rest = [c for c in junctions.columns if c not in (donor, acceptor)]
    return junctions.withColumn("_e", F.explode(F.array(side(donor, acceptor, "donor"), side(acceptor, donor, "acceptor")))).select(*rest, "_e.*")


def read_sums(reads) -> list[Column]:
    """What psi() and entropy() need of a group's reads: four plain sums, so that no list of reads is gathered."""
    x = F.coalesce(F.col(reads), F.lit(0)).cast("double")
    return [F.count(reads).alias("_n"), F.sum(x).alias("_sum"), F.max(x).alias("_max"), F.sum(F.when(x > 0, x * F.log2(x)).otherwise(0.0)).alias("_xlogx")]


def psi() -> Column:
    """The largest share of reads; null for one junction or none."""
    return F.when((F.col("_n") > 1) & (F.col("_sum") > 0), F.col("_max") / F.col("_sum"))


def entropy() -> Column:
    """A5: Shannon entropy in bits of the reads' shares: log2(S) - sum(r log2 r) / S; 0 for one junction or no reads."""
    return F.when((F.col("_n") > 1) & (F.col("_sum") > 0), F.greatest(F.lit(0.0), F.log2("_sum") - F.col("_xlogx") / F.col("_sum"))).otherwise(0.0)


def single_index(ends: DataFrame, by: list[str], reads="reads", partner="partner", annotated: str | None = None) -> DataFrame:
    """A3: a row a position of one sample: reads, partners, entropy in bits, PSI."""
    got = ends.groupBy(*by).agg(
        F.sum(F.col(reads).cast("double")).alias("total_reads"), F.max(F.col(reads).cast("double")).alias("max_reads"), F.countDistinct(partner).alias("n_partners"),
        (F.max(annotated) if annotated else F.lit(0)).alias("is_annotated"), *read_sums(reads),
    )
    return got.select(*by, "total_reads", "max_reads", "n_partners", "is_annotated", F.log1p("total_reads").alias("log1p_reads"), entropy().alias("entropy"), psi().alias("psi"))


def tissue_index(ends: DataFrame, by: list[str], tissue="tissue", reads="reads", partner="partner", least_reads: float = 3) -> DataFrame:
    """A4: per (position, tissue), then per position. Tissue variance is the sample's (0 for one tissue), PSI variance the population's (null for one)."""
    first = ends.groupBy(*by, tissue).agg(F.sum(F.col(reads).cast("double")).alias("t_reads"), F.countDistinct(partner).alias("t_partners"), *read_sums(reads)).withColumn("t_psi", psi())
    return first.groupBy(*by).agg(
        F.sum("t_reads").alias("total_reads"), F.max("t_reads").alias("tissue_max"), F.avg("t_reads").alias("tissue_mean"), F.coalesce(F.var_samp("t_reads"), F.lit(0.0)).alias("tissue_variance"),
        F.sum((F.col("t_reads") >= least_reads).cast("int")).alias("tissue_breadth"), F.max("t_partners").alias("n_partners"), F.avg("t_psi").alias("psi"), F.when(F.count("t_psi") > 1, F.var_pop("t_psi")).alias("psi_variance"),
    )


def tissue_summary(junctions: DataFrame, by: list[str], tissue="tissue", reads="total_reads", samples: str | None = None) -> DataFrame:
    """Maximum, sum, tissues, the tissue of the maximum (the later name, on ties), and the share of all tissues."""
    per = junctions.groupBy(*by, tissue).agg(F.sum(F.col(reads).cast("double")).alias("r"), *([F.sum(samples).alias("s")] if samples else []))
    n_all = junctions.select(tissue).distinct().agg(F.count("*").alias("n_all"))
    got = per.groupBy(*by).agg(F.max("r").alias("max_reads"), F.sum("r").alias("sum_reads"), F.count("*").alias("n_tissues"), F.max_by(tissue, F.struct("r", tissue)).alias("max_tissue"), *([F.avg("s").alias("mean_samples_per_tissue")] if samples else []))
    return got.join(F.broadcast(n_all)).withColumn("tissue_breadth", F.col("n_tissues") / F.col("n_all")).drop("n_all")  # one row is broadcast


def tissue_matrix(counts: DataFrame, sample_tissues: DataFrame, junction: str, sample="sample", reads="reads") -> DataFrame:
    """Sums and counts of non-zero samples of each junction in each tissue; junctions without reads there go.

    A sample's rows are of nearly as many junctions, so sums made next to the join would be as many as the rows. Rows are dealt by their junction's hash first: a task then has few
    junctions, whole but for hot ones, which adaptive execution may split. Samples are the small side of the join, which is hashed in parts, without a sort.
    """
    rows = counts.join(sample_tissues.hint("shuffle_hash"), sample).select(junction, "tissue", reads).withColumn("_deal", F.pmod(F.hash(junction), F.lit(1 << 16))).hint("rebalance", "_deal")
    return rows.groupBy(junction, "tissue").agg(F.sum(reads).alias("total_reads"), F.sum((F.col(reads) > 0).cast("int")).alias("n_samples")).where("total_reads > 0")


def join_features(df: DataFrame, index: DataFrame, on: list[str], counts: list[str]) -> DataFrame:
    """A left join in which missing counts are 0 and shares stay null. index has a row a key, so no row multiplies (V6)."""
    return df.join(index, on, "left").fillna(0, subset=counts)
