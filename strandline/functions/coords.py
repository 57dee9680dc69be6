"""Coordinates and chromosome names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The standard chromosomes.
AUTOSOMES = [str(i) for i in range(1, 23)]
SEX, MITO = ["X", "Y"], ["M", "MT"]


def bare(chrom) -> Column:
    """The name without a chr prefix."""
    return F.regexp_replace(chrom, "^chr", "")


def for_build(chrom, prefixed: bool) -> Column:
    """P5: the name as a build writes it, with a chr prefix or bare."""
    return F.when(F.col(chrom).startswith("chr"), F.col(chrom)).otherwise(F.concat(F.lit("chr"), F.col(chrom))) if prefixed else bare(F.col(chrom))


def on_chromosomes(chrom, names: list[str]) -> Column:
    """On one of the chromosomes, whichever way either side is written."""
    return bare(F.col(chrom)).isin([n.removeprefix("chr") for n in names])


def standard(chrom, mito: bool = True) -> Column:
    """On a standard chromosome."""
    return bare(F.col(chrom)).isin(AUTOSOMES + SEX + (MITO if mito else []))


def natural_order(chrom) -> Column:
    """O2: 1 to 22, then X, Y, M; anything else comes last."""
    b = bare(F.col(chrom))
    return F.when(b == "X", 23).when(b == "Y", 24).when(b.isin(MITO), 25).otherwise(F.coalesce(b.try_cast("int"), F.lit(1000)))


def to_relative(position, start, end, strand) -> Column:
    """1-based position in the gene, in the direction of its strand."""
    return F.when(F.col(strand) == "-", F.col(end) - F.col(position) + 1).otherwise(F.col(position) - F.col(start) + 1)


def to_absolute(relative, start, end, strand) -> Column:
    """The inverse of to_relative."""
    return F.when(F.col(strand) == "-", F.col(end) - F.col(relative) + 1).otherwise(F.col(start) + F.col(relative) - 1)


def gene_position(position="position", start="gene_start", end="gene_end", strand="strand") -> dict[str, Column]:
    """The share of the gene before the position (from the 5' side), and plain distances to both ends."""
    p, s, e = F.col(position), F.col(start), F.col(end)
    share = (p - s) / F.greatest((e - s).cast("double"), F.lit(1.0))
    return {"relative_gene_position": F.when(F.col(strand) == "-", 1 - share).otherwise(share), "distance_to_gene_start": p - s, "distance_to_gene_end": e - p}


def position_kind(df: DataFrame, position="position", start="gene_start", end="gene_end") -> DataFrame:
    """Shares of positions that fit absolute and relative coordinates, and which kind they are (the median decides a tie)."""
    p, s, e = F.col(position), F.col(start), F.col(end)
    seen = df.agg(
        F.avg(p.between(s, e).cast("double")).alias("absolute_share"),
        F.avg(p.between(F.lit(1), e - s + 1).cast("double")).alias("relative_share"),
        F.expr(f"percentile({position}, 0.5)").alias("median_position"), F.expr(f"percentile({start}, 0.5)").alias("median_start"),
    )
    a, r = F.col("absolute_share"), F.col("relative_share")
    return seen.withColumn("kind", F.when(a > r, "absolute").when(r > a, "relative").when(F.col("median_position") >= F.col("median_start"), "absolute").otherwise("relative"))
