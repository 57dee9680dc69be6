"""Transcript coordinates, liftover, motif snapping, sequence windows and exon labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import points_in_intervals


def coding_to_genomic(cds: DataFrame, wanted: DataFrame, transcript="transcript_id", start="start", end="end", strand="strand", coding="coding_position", offset="intron_offset") -> DataFrame:
    """Genomic positions of coding positions (1-based), plus their intron offset, in the direction of the strand.

    A running sum of lengths in the transcript's order gives each coding interval its range; a position lies in one of them.
    """
    minus = F.col(strand) == "-"
    w = Window.partitionBy(transcript).orderBy(F.when(minus, -F.col(start)).otherwise(F.col(start)))
    done = F.sum(F.col(end) - F.col(start) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ranges = cds.select(transcript, F.col(start).alias("_s"), F.col(end).alias("_e"), minus.alias("_minus"), done.alias("_last"), (done - (F.col(end) - F.col(start))).alias("_first"))
    got = wanted.join(ranges, transcript).where(F.col(coding).between(F.col("_first"), F.col("_last")))
    step = F.col(coding) - F.col("_first")
    at = F.when(F.col("_minus"), F.col("_e") - step - F.col(offset)).otherwise(F.col("_s") + step + F.col(offset))
    return got.select(*wanted.columns, at.alias("position"))


def liftover(points: DataFrame, chain: DataFrame, chrom="chrom", position="position", width=1 << 16) -> DataFrame:
    """Points in another build by a chain's blocks (chrom, start, end, new_chrom, new_start, new_strand), closed and 1-based; points in no block go.

    On a minus block the order turns round.
    """
    hits = points_in_intervals(points, chain, [chrom], position=position, width=width)
    at = F.when(F.col("new_strand") == "-", F.col("new_start") + F.col("end") - F.col(position)).otherwise(F.col("new_start") + F.col(position) - F.col("start"))
    return hits.select(*points.columns, "new_chrom", at.alias("new_position"), "new_strand")


def snap_to_motif(sites: DataFrame, motifs: DataFrame, on: list[str], within=2, position="position") -> DataFrame:
    """Each site's nearest position with its motif within `within` bases (the smaller, on ties); null where there is none."""
    probe = sites.withColumn("_o", F.explode(F.sequence(F.lit(-within), F.lit(within)))).withColumn("_at", F.col(position) + F.col("_o"))
    near = motifs.select(*on, F.col(position).alias("_at")).distinct()
    best = probe.join(near, [*on, "_at"]).groupBy(*on, position).agg(F.min_by("_o", F.struct(F.abs("_o"), F.col("_o"))).alias("snap_offset"))
    return sites.join(best, [*on, position], "left").withColumn("snapped", F.col(position) + F.col("snap_offset"))


def motif_rate_by_offset(sites: DataFrame, motifs: DataFrame, on: list[str], by: list[str], lowest=-4, highest=4, position="position") -> DataFrame:
    """The offset at which most of each group's sites meet their motif, and that share (the smallest shift, on ties)."""
    probe = sites.withColumn("_o", F.explode(F.sequence(F.lit(lowest), F.lit(highest)))).withColumn("_at", F.col(position) + F.col("_o"))
    near = motifs.select(*on, F.col(position).alias("_at")).distinct().withColumn("_hit", F.lit(1))
    rate = probe.join(near, [*on, "_at"], "left").groupBy(*by, "_o").agg(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("rate"))
    return rate.groupBy(*by).agg(F.max_by("_o", F.struct("rate", -F.abs("_o"), -F.col("_o"))).alias("best_offset"), F.max("rate").alias("best_rate"))


def sliding_windows(df: DataFrame, length: str, size: int, step: int, keys: list[str]) -> DataFrame:
    """(keys, window_start, window_end) of windows of `size` every `step`, 0-based and half-open; the last one ends with the sequence."""
    n = F.col(length)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0))
    got = df.where(n > 0).select(*keys, n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_k"))
    start = F.least(F.col("_k") * step, F.greatest(F.col("_n") - size, F.lit(0)))
    return got.select(*keys, start.alias("window_start"), F.least(start + size, F.col("_n")).alias("window_end")).distinct()


def grid_windows_with_exons(exons: DataFrame, keys: list[str], size: int, step: int, last: int, least: float) -> DataFrame:
    """Windows of `size` that start every `step` from 0 to `last`, of which exons (0-based, half-open, disjoint) cover a share of `least` (over 0) or more.

    An exon names the windows that it touches, so no window is made that has none.
    """
    lo = F.greatest(F.floor((F.col("start") - size) / step) + 1, F.lit(0))
    hi = F.least(F.ceil(F.col("end") / step) - 1, F.lit(last // step))
    each = exons.where((F.col("start") < F.col("end")) & (lo <= hi)).select(*keys, "start", "end", F.explode(F.sequence(lo, hi)).alias("_k"))
    each = each.withColumn("window_start", F.col("_k") * step).withColumn("window_end", F.col("window_start") + size)
    inside = F.least("window_end", "end") - F.greatest("window_start", "start")
    return each.groupBy(*keys, "window_start", "window_end").agg((F.sum(inside) / size).alias("exon_share")).where(F.col("exon_share") >= least)


def windows_with_exons(windows: DataFrame, exons: DataFrame, keys: list[str], least: float, width=1024) -> DataFrame:
    """Windows of which exons (0-based, half-open, disjoint) cover a share of `least` or more.

    Catalyst doesn't see that exploded windows are many, and would broadcast them for their small source; hence the hint.
    """
    cut = exons.where(F.col("start") < F.col("end")).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    probe = windows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("window_start") / width), F.floor((F.col("window_end") - 1) / width))))
    lo, hi = F.greatest("window_start", "start", F.col("_bin") * width), F.least("window_end", "end", (F.col("_bin") + 1) * width)
    inside = probe.hint("merge").join(cut, [*keys, "_bin"]).where(hi > lo).groupBy(*keys, "window_start", "window_end").agg((F.sum(hi - lo) / F.first(F.col("window_end") - F.col("window_start"))).alias("exon_share"))
    return inside.where(F.col("exon_share") >= least)


def exon_bases(sites: DataFrame, gene="gene_id", transcript="transcript_id", rank="exon_rank", position="position") -> DataFrame:
    """X11: distinct bases of exons given by pairs of sites with one rank; a site without its pair gives none. Bases are rows, not gathered."""
    pairs = sites.groupBy(gene, transcript, rank).agg(F.min(position).alias("_s"), F.max(position).alias("_e"), F.count("*").alias("_n")).where("_n >= 2")
    return pairs.select(gene, F.explode(F.sequence("_s", "_e")).alias(position)).distinct()


def with_prior(positions: DataFrame, scores: DataFrame, on: list[str], channels=("donor", "acceptor", "neither")) -> DataFrame:
    """Scores where there are some, else the same share for every class."""
    got = positions.join(scores.select(*on, *channels), on, "left")
    return got.withColumns({c: F.coalesce(c, F.lit(1.0 / len(channels))) for c in channels})


def similar_sequences(genes: DataFrame, key: str, sequence: str, k=15, distance=0.8) -> DataFrame:
    """All pairs of genes whose sets of k-letter words are within a Jaccard distance (a < b), and that distance.

    Genes with equal sets are one class. With a least share t = 1 - distance, two sets of that share have a word in common among the
    first n - ceil(t * n) + 1 words of each, in any one order of the words; the rarest words come first, and classes are joined on these alone.
    Each candidate is then verified on the whole sets, so no pair is lost; members of classes are paired at the end.
    """
    least = 1 - distance
    words = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(sequence) - k + 1), lambda i: F.substring(F.col(sequence), i, F.lit(k)))))
    members = genes.where((F.length(sequence) >= k) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), words.alias("_words"))
    members = members.withColumn("_class", F.sha2(F.array_join("_words", ""), 256))  # words of one length: no two sets are joined to one text
    classes = members.groupBy("_class", "_words").agg(F.count("*").alias("_members"))
    posted = classes.select("_class", F.size("_words").alias("_n"), F.explode("_words").alias("_word"))
    ranked = posted.join(posted.groupBy("_word").agg(F.count("*").alias("_in")), "_word")
    ranked = ranked.withColumn("_at", F.row_number().over(Window.partitionBy("_class").orderBy("_in", "_word")))
    prefix = ranked.where(F.col("_at") <= F.col("_n") - F.ceil(F.col("_n") * least - 1e-9) + 1).select("_word", "_class", "_n", "_at")
    side = lambda df, s: df.select(*(F.col(c).alias(f"{c}_{s}") if c != "_word" else F.col(c) for c in df.columns))
    # A first word in common leaves room for as many more as come after it in both.
    room = 1 + F.least(F.col("_n_a") - F.col("_at_a"), F.col("_n_b") - F.col("_at_b"))
    enough = (room * (1 + least) >= (F.col("_n_a") + F.col("_n_b")) * least - 1e-9) & (F.least("_n_a", "_n_b") >= F.greatest("_n_a", "_n_b") * least - 1e-9)
    candidates = side(prefix, "a").join(side(prefix, "b"), "_word").where((F.col("_class_a") < F.col("_class_b")) & enough).select("_class_a", "_class_b").distinct()
    sets = classes.select("_class", "_words")
    both = candidates.join(side(sets, "a"), "_class_a").join(side(sets, "b"), "_class_b")
    common = F.size(F.array_intersect("_words_a", "_words_b"))
    share = both.select("_class_a", "_class_b", (common / (F.size("_words_a") + F.size("_words_b") - common)).alias("_share"))
    near = share.where(F.col("_share") >= least - 1e-9).select("_class_a", "_class_b", (1 - F.col("_share")).alias("distance"))
    of = members.select("_key", "_class")
    across = near.join(side(of, "a"), "_class_a").join(side(of, "b"), "_class_b").where("_key_a <> _key_b").select(F.least("_key_a", "_key_b").alias("a"), F.greatest("_key_a", "_key_b").alias("b"), "distance")
    shared = of.join(classes.where("_members > 1").select("_class"), "_class")
    within = side(shared, "a").join(shared.select(F.col("_class").alias("_class_a"), F.col("_key").alias("_key_b")), "_class_a").where("_key_a < _key_b").select(F.col("_key_a").alias("a"), F.col("_key_b").alias("b"), F.lit(0.0).alias("distance"))
    return across.unionByName(within)
