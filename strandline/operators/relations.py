"""Joins, sets and aggregates with fixed tie rules (J1-J4, J13-J18, U1-U8, A1, A9-A17, A19-A22, A25-A30; the others are in selection.py)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import binned


def label_join(df: DataFrame, sites: DataFrame, on: list[str]) -> DataFrame:
    """Each row with its site's type and first transcript and the number of transcripts; '' and 0 where there is none."""
    per = sites.groupBy(*on).agg(F.min("splice_type").alias("splice_type"), F.min("transcript_id").alias("transcript_id"), F.countDistinct("transcript_id").alias("transcript_count"))
    return df.join(per, on, "left").fillna("", subset=["splice_type", "transcript_id"]).fillna(0, subset=["transcript_count"])


def membership(df: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """Whether the row's key is among the keys."""
    return df.join(keys.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def novel(observed: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """J15, J16, U4."""
    return observed.join(known, on, "left_anti")


def confirmed(observed: DataFrame, evidence: DataFrame, on: list[str]) -> DataFrame:
    """J17."""
    return observed.join(evidence, on, "left_semi")


def merge_sources(a: DataFrame, b: DataFrame, on: list[str], names=("a", "b")) -> DataFrame:
    """A full outer join with keys in one, and where each row comes from."""
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), on, "full")
    tag = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), names[0]).otherwise(names[1])
    return both.withColumn("sources", tag).drop("_a", "_b")


def coverage(sites: DataFrame, support: DataFrame, on: list[str], by: list[str], reads="reads") -> DataFrame:
    """Sites, the share with support, and the median support where there is some."""
    per = support.groupBy(*on).agg(F.sum(reads).alias("_r"))
    got = sites.join(per, on, "left")
    return got.groupBy(*by).agg(F.count("*").alias("n_sites"), F.avg(F.col("_r").isNotNull().cast("double")).alias("covered_share"), F.expr("percentile(CAST(_r AS DOUBLE), 0.5)").alias("median_support"))


def common_columns(*frames: DataFrame) -> DataFrame:
    """Rows of all frames over the columns that all have, in the first one's order."""
    shared = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return reduce(DataFrame.unionByName, (f.select(*shared) for f in frames))


def joined_set(column, sep="+") -> Column:
    """Distinct values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(column)), sep)


def canonical_by_sites(sites: DataFrame, gene="gene_id", transcript="transcript_id", position="position") -> DataFrame:
    """The transcript with most distinct sites (the smaller id, on ties)."""
    n = sites.groupBy(gene, transcript).agg(F.countDistinct(position).alias("n_sites"))
    best = n.groupBy(gene).agg(F.max("n_sites").alias("n_sites"))
    return n.join(best, [gene, "n_sites"]).groupBy(gene, "n_sites").agg(F.min(transcript).alias(transcript))


def canonical_by_length(exons: DataFrame, gene="gene_id", transcript="transcript_id", start="start", end="end", preferred: Column | None = None) -> DataFrame:
    """The longest summed exons among preferred transcripts, else among all (the smaller id, on ties)."""
    n = exons.groupBy(gene, transcript).agg(F.sum(F.col(end) - F.col(start)).alias("exon_length"), F.max((preferred if preferred is not None else F.lit(True)).cast("int")).alias("_p"))
    order = F.struct("_p", "exon_length")
    best = n.groupBy(gene).agg(F.max(order).alias("_o"))
    return n.join(best, gene).where(order == F.col("_o")).groupBy(gene, "exon_length").agg(F.min(transcript).alias(transcript))


def canonical_by_span(transcripts: DataFrame, gene="gene_id", transcript="transcript_id", start="start", end="end") -> DataFrame:
    """The longest genomic span (the smaller id, on ties)."""
    n = transcripts.groupBy(gene, transcript).agg((F.max(end) - F.min(start)).alias("span"))
    best = n.groupBy(gene).agg(F.max("span").alias("span"))
    return n.join(best, [gene, "span"]).groupBy(gene, "span").agg(F.min(transcript).alias(transcript))


def shared_positions(sites: DataFrame, by: list[str], transcript="transcript_id", least=2) -> DataFrame:
    """A14."""
    return sites.groupBy(*by).agg(F.countDistinct(transcript).alias("n_transcripts")).where(F.col("n_transcripts") >= least)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys met more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def gene_bounds(transcripts: DataFrame, gene="gene_id", start="start", end="end", attributes=()) -> DataFrame:
    """Span of all transcripts; attributes by their smallest value."""
    return transcripts.groupBy(gene).agg(F.min(start).alias(start), F.max(end).alias(end), *(F.min(a).alias(a) for a in attributes))


def class_weights(df: DataFrame, label: str, classes: list) -> DataFrame:
    """Total / (classes * count); 1 for a class without rows."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    every = df.sparkSession.createDataFrame([(c,) for c in classes], f"{label} {dict(df.dtypes)[label]}")
    return every.join(n, label, "left").join(F.broadcast(total)).select(label, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, F.col("total") / (len(classes) * F.col("n"))).otherwise(F.lit(1.0)).alias("weight"))


def norm_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a column: mean and sample deviation (1 where it is nearly 0)."""
    wide = df.agg(*(f(c).alias(f"{c}__{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}__mean").alias("mean"), F.when(F.col(f"{c}__std") > 1e-8, F.col(f"{c}__std")).otherwise(F.lit(1.0)).alias("std")) for c in columns))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def peak_features(hits: DataFrame, by: list[str], regulators=(), sr=(), hnrnp=(), rbp="rbp", cell="cell_line", signal="signal_value", p="neg_log10_pvalue") -> DataFrame:
    """What binds at a position: distinct proteins, signals, families, cell lines."""
    among = lambda names: F.countDistinct(F.when(F.col(rbp).isin(list(names)), F.col(rbp))) if names else F.lit(0).cast("long")
    return hits.groupBy(*by).agg(
        F.countDistinct(rbp).alias("n_bound"), F.max(signal).alias("max_signal"), F.avg(signal).alias("mean_signal"), F.max(p).alias("max_neg_log10_pvalue"),
        F.max(F.col(rbp).isin(list(regulators)).cast("int") if regulators else F.lit(0)).alias("has_splice_regulator"), among(sr).alias("n_sr_proteins"), among(hnrnp).alias("n_hnrnps"), F.countDistinct(cell).alias("cell_line_breadth"),
    )


def peak_features_at(points: DataFrame, peaks: DataFrame, on: list[str], regulators=(), sr=(), hnrnp=(), position="position", start="start", end="end", width=10_000, closed=True, rbp="rbp", cell="cell_line", signal="signal_value", p="neg_log10_pvalue") -> DataFrame:
    """peak_features() of points_in_intervals(), for each distinct point in a peak, without a row a hit.

    Peaks are cut at the borders of bins, and equal pieces of a cell line are one row before points meet them. Of each protein's pieces in a bin only what no earlier one covers is
    kept, so at any position a protein is in at most one of them; then these are one row a piece too, with the number of proteins.
    """
    among = lambda names: F.coalesce(F.sum(F.col(rbp).isin(list(names)).cast("long")), F.lit(0)) if names else F.lit(0).cast("long")
    low, high = F.col("_bin") * width, (F.col("_bin") + 1) * width
    cut = binned(peaks.dropna(subset=on), start, end, width).select(*on, "_bin", F.greatest(F.col(start), low).alias("_from"), F.least(F.col(end), high).alias("_to"), rbp, cell, signal, p)
    cut = cut if closed else cut.where("_from < _to")
    piece = [*on, "_bin", "_from", "_to"]
    signals = cut.groupBy(*piece, cell).agg(F.max(signal).alias("_max"), F.sum(F.col(signal).cast("double")).alias("_sum"), F.count(signal).alias("_n"), F.max(p).alias("_p"))
    earlier = Window.partitionBy(*on, "_bin", rbp).orderBy("_from", "_to").rowsBetween(Window.unboundedPreceding, -1)
    fresh = cut.where(F.col(rbp).isNotNull()).select(*piece, rbp).withColumn("_before", F.max("_to").over(earlier)).where("_before IS NULL OR _to > _before")
    after = F.coalesce(F.col("_before") >= F.col("_from"), F.lit(False)) if closed else F.lit(False)  # a closed piece that another covers up to _before, itself included
    fresh = fresh.withColumns({"_after": after, "_from": F.greatest("_from", "_before")})
    proteins = fresh.groupBy(*piece, "_after").agg(F.count("*").alias("_bound"), (F.max(F.col(rbp).isin(list(regulators)).cast("int")) if regulators else F.lit(0)).alias("_reg"), among(sr).alias("_sr"), among(hnrnp).alias("_hnrnp"))
    at = points.select(*on, position).distinct().withColumn("_bin", F.floor(F.col(position) / width))
    x = F.col(position)
    inside = (x >= F.col("_from")) & ((x <= F.col("_to")) if closed else (x < F.col("_to")))
    by = [*on, position]
    a = at.join(signals, [*on, "_bin"]).where(inside).groupBy(*by).agg(F.max("_max").alias("max_signal"), F.try_divide(F.sum("_sum"), F.sum("_n")).alias("mean_signal"), F.max("_p").alias("max_neg_log10_pvalue"), F.countDistinct(cell).alias("cell_line_breadth"))
    b = at.join(proteins, [*on, "_bin"]).where(inside & ~(F.col("_after") & (x == F.col("_from")))).groupBy(*by).agg(F.sum("_bound").alias("n_bound"), F.max("_reg").alias("has_splice_regulator"), F.sum("_sr").alias("n_sr_proteins"), F.sum("_hnrnp").alias("n_hnrnps"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    has = F.col("has_splice_regulator") if regulators else none("has_splice_regulator")
    return a.join(b, by, "left").select(*by, none("n_bound"), "max_signal", "mean_signal", "max_neg_log10_pvalue", has, none("n_sr_proteins"), none("n_hnrnps"), "cell_line_breadth")


def cross_source_summary(tracks: DataFrame, by: list[str], value="value", breadth=1.5, peak: float | None = None) -> DataFrame:
    """Maximum, mean, population variance, how many exceed `breadth`, and whether any exceeds `peak`."""
    return tracks.groupBy(*by).agg(F.max(value).alias("max_value"), F.avg(value).alias("mean_value"), F.var_pop(value).alias("variance"), F.sum(F.coalesce((F.col(value) > breadth).cast("int"), F.lit(0))).alias("breadth"), *([(F.max(value) > peak).cast("int").alias("has_peak")] if peak is not None else []))


def ensemble(scores: DataFrame, by: list[str], model: str, columns: list[str]) -> DataFrame:
    """The mean over models of each chunk's value, then the mean over overlapping chunks of a position."""
    return scores.groupBy(*by).agg(*(F.avg(c).alias(c) for c in columns))
