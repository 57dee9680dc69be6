"""Ordered operators (W1-W14, J7): windows by gene, ordered by position and a unique tiebreak."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scans import ranges, scan


def context_scores(df: DataFrame, score: str, width: int = 2, by=("gene_id",), order=("position",)) -> DataFrame:
    """The score of the `width` rows before (m1...) and after (p1...), 0 beyond the gene. A neighbour is the adjacent row."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select("*", *(F.lag(score, i, 0.0).over(w).alias(f"{score}_m{i}") for i in range(1, width + 1)), *(F.lead(score, i, 0.0).over(w).alias(f"{score}_p{i}") for i in range(1, width + 1)))


def next_exon(exons: DataFrame, transcript="transcript_id", start="start", tiebreak=()) -> DataFrame:
    """Each exon with the start of the next of its transcript; the last has none and goes."""
    w = Window.partitionBy(transcript).orderBy(start, *tiebreak)
    return exons.withColumn("next_start", F.lead(start).over(w)).where("next_start IS NOT NULL")


def splice_sites(exons: DataFrame, transcript="transcript_id", start="start", end="end", strand="strand", order=None) -> DataFrame:
    """Donor and acceptor of each exon of transcripts with two or more; the first has no acceptor and the last no donor (by strand)."""
    w = Window.partitionBy(transcript).orderBy(*(order or [start, end]))
    n = F.count("*").over(Window.partitionBy(transcript))
    got = exons.withColumn("_k", F.row_number().over(w)).withColumn("_n", n).where("_n > 1")
    minus = F.col(strand) == "-"
    first, last = F.when(minus, F.col("_k") == F.col("_n")).otherwise(F.col("_k") == 1), F.when(minus, F.col("_k") == 1).otherwise(F.col("_k") == F.col("_n"))
    donor = F.struct(F.lit("donor").alias("splice_type"), F.when(minus, F.col(start)).otherwise(F.col(end)).alias("position"), (~last).alias("_is"))
    acceptor = F.struct(F.lit("acceptor").alias("splice_type"), F.when(minus, F.col(end)).otherwise(F.col(start)).alias("position"), (~first).alias("_is"))
    return got.withColumn("_s", F.explode(F.array(donor, acceptor))).where("_s._is").select(*exons.columns, "_s.splice_type", "_s.position")


def with_halo(df: DataFrame, position: str, width: int, bin_size: int | None = None) -> DataFrame:
    """Rows with `_bin` and `_core`: a row is the core of its own bin of positions and, within `width` of a border, also a halo row of the bin beyond.

    A window of `width` positions over (key, _bin) sees for core rows what one over the whole key sees, so a chromosome is as many tasks as it has bins.
    """
    size = max(bin_size or 100_000, 2 * width + 1)
    bins = [F.floor((F.col(position) + d) / size) for d in (0, -width, width)]
    return df.withColumn("_bin", F.explode(F.array_distinct(F.array(*bins)))).withColumn("_core", F.col("_bin").eqNullSafe(bins[0]))


def track_context(df: DataFrame, value: str, width: int, by=("chrom",), position="position") -> DataFrame:
    """Mean, maximum and population deviation of the values within `width` positions."""
    w = Window.partitionBy(*by, "_bin").orderBy(position).rangeBetween(-width, width)
    got = with_halo(df, position, width).select("*", F.avg(value).over(w).alias(f"{value}_context_mean"), F.max(value).over(w).alias(f"{value}_context_max"), F.stddev_pop(value).over(w).alias(f"{value}_context_std"))
    return got.where("_core").drop("_bin", "_core")


def directional_ratio(df: DataFrame, value: str, width: int, by=("chrom",), position="position", strand="strand") -> DataFrame:
    """log2 of the mean before, plus 1, less log2 of the mean after, plus 1; the other way round on the minus strand."""
    w = Window.partitionBy(*by, "_bin").orderBy(position)
    up, down = (F.log2(F.coalesce(F.avg(value).over(w.rangeBetween(a, b)), F.lit(0.0)) + 1) for a, b in ((-width, -1), (1, width)))
    return with_halo(df, position, width).withColumn(f"{value}_ratio", F.when(F.col(strand) == "-", down - up).otherwise(up - down)).where("_core").drop("_bin", "_core")


def gradient_norm(df: DataFrame, vector: str, by=("gene_id",), order=("position",)) -> DataFrame:
    """The length of a vector less the mean of its two neighbours; null at the ends or where one is missing."""
    w = Window.partitionBy(*by).orderBy(*order)
    got = df.withColumn("_a", F.lag(vector).over(w)).withColumn("_b", F.lead(vector).over(w))
    mid = F.zip_with("_a", "_b", lambda x, y: (x.cast("double") + y.cast("double")) / 2)
    off = F.aggregate(F.zip_with(F.col(vector), mid, lambda x, m: (x.cast("double") - m) * (x.cast("double") - m)), F.lit(0.0), lambda s, x: s + x)
    return got.withColumn("local_gradient", F.sqrt(off)).drop("_a", "_b")


def merge_intervals(df: DataFrame, start: str, end: str, by: list[str]) -> DataFrame:
    """Closed intervals that touch or overlap as one; the number merged. Rows without a start or an end go; a null key is a key.

    Equal intervals are one row first; then a running maximum of the ends says where an island begins, and a running sum numbers the islands.
    """
    one = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(*by, start, end).agg(F.count("*").alias("_n"))
    at = ranges(one, [start, end])
    got = scan(one, by, [start, end], at, _before=("max_before", end))
    new = F.when(F.col("_before").isNull() | (F.col(start) > F.col("_before")), 1).otherwise(0)
    island = scan(got.withColumn("_new", new), by, [start, end], at, _island=("sum", "_new"))
    return island.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("_n").alias("n_merged")).drop("_island")


def roll(df: DataFrame, value: str, shift: int, by: list[str], order: list[str], edge=0.0) -> DataFrame:
    """The value `shift` rows before (after, if negative), `edge` beyond the ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(f"{value}_rolled", F.lag(value, shift, edge).over(w) if shift >= 0 else F.lead(value, -shift, edge).over(w))


def chunk_numbers(df: DataFrame, size: int, by: list[str], order: list[str]) -> DataFrame:
    """Ordered rows in chunks of `size`, counted within each key by ranges of the order, so that no task takes all rows of a key."""
    return scan(df, by, order, _place=("sum", F.lit(1))).withColumn("chunk", F.floor((F.col("_place") - 1) / size).cast("long")).drop("_place")


def exon_numbers(exons: DataFrame, transcript="transcript_id", start="start", strand="strand") -> DataFrame:
    """Exon numbers in the transcript's direction."""
    key = F.when(F.col(strand) == "-", -F.col(start)).otherwise(F.col(start))
    return exons.withColumn("exon_number", F.row_number().over(Window.partitionBy(transcript).orderBy(key)))


def nearest_flagged(df: DataFrame, flag: str, position: str, by: list[str], order: list[str]) -> DataFrame:
    """Distance to the nearest flagged row of the group, itself included; null where there is none. `order` must rise with the position."""
    at = F.when(F.col(flag), F.col(position))
    got = scan(df, by, order, _before=("last", at), _after=("next", at))
    return got.withColumn("nearest_distance", F.least(F.col(position) - F.col("_before"), F.col("_after") - F.col(position))).drop("_before", "_after")


def running_totals(df: DataFrame, order: str, values: list[str], by: list[str] = (), descending: bool = False, parts: int = 64) -> DataFrame:
    """Running sums (`<value>_upto`, the row included) and whole sums (`<value>_all`) in the order of a number that is unique within `by`.

    A window without keys would put all rows into one task. Rows are cut into ranges at approximate quantiles instead; the ranges'
    sums are few and are run up first, then each range runs up its own rows.
    """
    bounds = sorted({b for b in df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.005) if b is not None})
    at = F.col(order)
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: (x > at) if descending else (x < at))) if bounds else F.lit(0)
    cut = df.withColumn("_range", bucket)
    sums = cut.groupBy(*by, "_range").agg(*(F.sum(v).alias(v) for v in values))
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_range", *(F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(f"_{v}_before") for v in values), *(F.sum(v).over(Window.partitionBy(*by)).alias(f"{v}_all") for v in values))
    w = Window.partitionBy(*by, "_range").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select(*(F.col(c).alias(f"_of_{c}") for c in by), F.col("_range").alias("_of_range"), *(c for c in sums.columns if c not in (*by, "_range")))
    on = F.col("_range") == F.col("_of_range")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))  # a null key is a group
    got = cut.join(sums, on)
    return got.select(*df.columns, *(f"{v}_all" for v in values), *((F.col(f"_{v}_before") + F.sum(v).over(w)).alias(f"{v}_upto") for v in values))
