"""Named filters, picks and small aggregates of the pipelines: which rows, genes, transcripts and columns take part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .labels import least_hashes

#: What a column's name holds if it tells the label or only names the row.
LEAKING = ("label", "splice_type", "is_correct", "error_type", "truth", "target")
NAMING = ("gene_id", "gene_name", "transcript_id", "chrom", "strand", "position", "start", "end")
#: Stars of ClinVar's review status, from none to four.
STARS = {"no assertion criteria provided": 0, "criteria provided, single submitter": 1, "criteria provided, multiple submitters, no conflicts": 2, "reviewed by expert panel": 3, "practice guideline": 4}


def genes(df: DataFrame, wanted: list[str], columns: list[str]) -> DataFrame:
    """Rows that name a wanted gene in any of the columns, in any case."""
    upper = [x.upper() for x in wanted]
    return df.where(reduce(Column.__or__, (F.coalesce(F.upper(c).isin(upper), F.lit(False)) for c in columns)))


def values(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns hold one of the listed values each; a column without a list takes all."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]).isin(list(kv[1]))), ((k, v) for k, v in wanted.items() if v is not None), df)


def peaks(df: DataFrame, least_signal: float = 0.0, least_p: float = 0.0, width: tuple[int, int] | None = None, proteins: list[str] | None = None) -> DataFrame:
    """P10: peaks of enough signal and -log10 p, of a width within bounds, of listed proteins."""
    got = df.where((F.col("signal_value") >= least_signal) & (F.col("neg_log10_pvalue") >= least_p))
    if width:
        got = got.where((F.col("end") - F.col("start")).between(*width))
    return got if proteins is None else got.where(F.col("rbp").isin(proteins))


def deep_and_broad(df: DataFrame, depth: str, breadth: str, least_depth: float, least_breadth: int) -> DataFrame:
    """Enough reads in enough tissues; nulls go."""
    return df.where((F.col(depth) >= least_depth) & (F.col(breadth) >= least_breadth))


def matching(df: DataFrame, column: str, pattern: str, drop: bool = False) -> DataFrame:
    """Rows whose column matches a regular expression (or doesn't, with drop; a null doesn't match)."""
    hit = F.coalesce(F.col(column).rlike(pattern), F.lit(False))
    return df.where(~hit if drop else hit)


def feature_columns(df: DataFrame, leaking=LEAKING, naming=NAMING) -> list[str]:
    """Numeric columns that neither tell the label nor name the row, in their order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and not any(x in f.name.lower() for x in leaking) and f.name.lower() not in naming]


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles, null, NaN and infinite values as 0."""
    x = lambda c: F.col(c).cast("double")
    return df.withColumns({c: F.when(x(c).isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf")), 0.0).otherwise(x(c)) for c in columns})


def variants(df: DataFrame, significance: list[str] | None = None, least_stars: int | None = None, snv_only: bool = False, consequence: str | None = None) -> DataFrame:
    """Variants of listed significances, of enough review stars, single bases only, of a consequence that matches."""
    got = df
    if significance:
        got = got.where(F.col("clinical_significance").isin(significance))
    if least_stars is not None:
        stars = F.create_map(*(F.lit(x) for kv in STARS.items() for x in kv))
        got = got.where(F.coalesce(F.try_element_at(stars, F.lower("review_status")), F.lit(0)) >= least_stars)
    if snv_only:
        got = got.where((F.length("ref_allele") == 1) & (F.length("alt_allele") == 1))
    return got if consequence is None else matching(got, "consequence", consequence)


def with_sequence(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Rows that have a sequence."""
    return df.where(F.coalesce(F.length(F.trim(sequence)) > 0, F.lit(False)))


def of_transcripts(sites: DataFrame, mode: str, canonical: DataFrame | None = None, shared: DataFrame | None = None, custom: list[str] | None = None, transcript="transcript_id", position=("chrom", "strand", "position", "splice_type")) -> DataFrame:
    """Sites by transcript: all; those of the canonical transcripts; those at positions that several transcripts share; or of listed transcripts."""
    if mode == "all":
        return sites
    if mode == "canonical":
        return sites.join(canonical.select(transcript).distinct(), transcript, "left_semi")
    if mode == "shared":
        on = [c for c in position if c in sites.columns]
        return sites.join(shared.select(*on).distinct(), on, "left_semi")
    if mode == "custom":
        return values(sites, **{transcript: custom or []})
    raise ValueError(f"no transcript filter {mode!r}: all, canonical, shared or custom")


def with_counts(df: DataFrame, rows: DataFrame, key: str, name: str) -> DataFrame:
    """How many rows each key has, 0 for none."""
    return df.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def recover_strand(df: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows without strand with that of a known site of the same key; keys with both strands, and rows without a known site, go."""
    one = known.groupBy(*on).agg(F.min("strand").alias("strand"), F.countDistinct("strand").alias("_n")).where("_n = 1").drop("_n")
    return df.drop("strand").join(one, on)


def align_exact(df: DataFrame, vectors: DataFrame, on: list[str], value: str) -> DataFrame:
    """Vectors at exactly the same coordinates, the first by value where there are several; a flag says whether there is one."""
    one = vectors.groupBy(*on).agg(F.min(value).alias(value))
    return df.join(one, on, "left").withColumn("has_" + value, F.col(value).isNotNull())


def names_at(sites: DataFrame, by: list[str], name: str = "gene_name", most: int = 10) -> DataFrame:
    """How many names a position has, and the first `most` of them in order, joined by commas; only positions with several."""
    each = sites.select(*by, name).distinct()
    ranked = each.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(name)))
    kept = F.array_sort(F.collect_list(F.when(F.col("_k") <= most, F.col(name))))
    return ranked.groupBy(*by).agg(F.count(name).alias("n_names"), F.array_join(kept, ",").alias("names")).where("n_names > 1")


def strongest(df: DataFrame, by: list[str], value: str, source: str) -> DataFrame:
    """The value of the largest magnitude of each key (the larger value, on ties), and all its sources in order."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(F.abs(value), value)).alias(value), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"), F.count("*").alias("n_rows"))


def most_frequent(df: DataFrame, by: list[str], freq: str, keep: str) -> DataFrame:
    """The greatest frequency of each site, and what it belongs to (the smallest, on ties)."""
    top = df.groupBy(*by).agg(F.max(freq).alias("_top"))
    return df.join(top, by).where(F.col(freq) == F.col("_top")).groupBy(*by).agg(F.max("_top").alias(freq), F.min(keep).alias(keep))


def variant_statistics(df: DataFrame, group: str) -> DataFrame:
    """Variants by group: how many, of how many chromosomes, single bases, mean length change."""
    change = F.length("alt_allele") - F.length("ref_allele")
    return df.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct("chrom").alias("n_chroms"), F.sum(((change == 0) & (F.length("ref_allele") == 1)).cast("int")).alias("n_snv"), F.avg(change).alias("mean_change"))


def subsample(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """About a share of the rows by a hash of the key, the same in every run."""
    return df.where((F.pmod(F.col(key) * 7919 + seed, F.lit(10_007)) / 10_007.0) < share)


def subsample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows (all, if there are fewer) by least hash of the key, ties by the key; only the range of hashes that holds the cut is ranked."""
    return least_hashes(df, [], key, F.lit(n), seed)


def by_magnitude(events: DataFrame, delta: str, n: int, *tiebreak: str) -> DataFrame:
    """The n events of the largest magnitude."""
    return events.orderBy(F.abs(delta).desc(), *tiebreak).limit(n)


def gene_chromosomes(df: DataFrame, gene: str, chrom: str, order: str) -> DataFrame:
    """Each gene's chromosome: that of its first row."""
    return df.groupBy(gene).agg(F.min_by(chrom, F.struct(order, chrom)).alias(chrom))


def flatten(df: DataFrame, column: str, into: str) -> DataFrame:
    """A row for each item of lists of lists, in order; rows without items go."""
    return df.withColumn(into, F.explode(F.flatten(F.filter(column, lambda x: x.isNotNull())))).drop(column)


def calibration_change(df: DataFrame, label: str, before: str, after: str, bins: int = 10) -> DataFrame:
    """Expected and largest calibration error and Brier score before and after, and which is better."""
    both = df.select(F.col(label).cast("double").alias("_y"), F.explode(F.array(*(F.struct(F.lit(n).alias("scores"), F.col(c).cast("double").alias("p")) for n, c in (("before", before), ("after", after))))).alias("_s")).select("_y", "_s.*")
    per = both.withColumn("_bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))).groupBy("scores", "_bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("_y").alias("mean_y"), F.sum((F.col("p") - F.col("_y")) ** 2).alias("square"))
    gap = F.abs(F.col("mean_p") - F.col("mean_y"))
    return per.groupBy("scores").agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"), (F.sum("square") / F.sum("n")).alias("brier"))


def top_l(df: DataFrame, by: list[str], score: str, label: str, ratios=(0.5, 1.0, 2.0, 4.0), tiebreak: str = "position") -> DataFrame:
    """Among the ratio x L best rows of each group (L: its true rows), the share of L that is found, and the score of the last of them."""
    w, all_ = Window.partitionBy(*by).orderBy(F.desc(score), tiebreak), Window.partitionBy(*by)
    ranked = df.withColumn("_k", F.row_number().over(w)).withColumn("_l", F.sum(F.col(label).cast("int")).over(all_)).where("_l > 0")
    each = ranked.withColumn("ratio", F.explode(F.array(*map(F.lit, ratios)))).where(F.col("_k") <= F.floor(F.col("ratio") * F.col("_l")))
    return each.groupBy(*by, "ratio").agg((F.sum(F.col(label).cast("int")) / F.max("_l")).alias("found"), F.min(score).alias("threshold"))


def directory_report(paths_and_columns: DataFrame, required: list[str]) -> DataFrame:
    """V7: of files with their columns (path, columns), what each lacks, and whether it passes."""
    lacks = F.array_except(F.array(*map(F.lit, required)), F.transform("columns", F.lower))
    return paths_and_columns.select("path", lacks.alias("missing"), (F.size(lacks) == 0).alias("passes"))


def artifact_report(tables: dict[str, DataFrame], required: list[str], keys: list[str]) -> DataFrame:
    """V7: a row a table: its rows, those with a null in a key, those that repeat a key, the required columns it lacks, and whether it passes. Names are compared without case.

    Each table is read once, its keys alone. Without its keys a table's rows are only counted; an empty table doesn't pass.
    """
    out = []
    for name, df in tables.items():
        there = {c.lower(): c for c in df.columns}
        lacks = [c for c in required if c.lower() not in there]
        held = [F.col(f"`{there[k.lower()]}`") for k in keys if k.lower() in there]
        if len(held) == len(keys) and keys:
            blank = reduce(lambda a, b: a | b, (k.isNull() for k in held))
            per = df.groupBy(*(k.alias(f"k{i}") for i, k in enumerate(held))).agg(F.count("*").alias("n"), F.max(blank).alias("blank"))
            row = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("blank"), F.col("n"))), F.lit(0)).alias("n_null_keys"), F.coalesce(F.sum(F.when(~F.col("blank"), F.col("n") - 1)), F.lit(0)).alias("n_repeated"))
        else:
            row = df.agg(F.count("*").alias("n_rows"), F.lit(None).cast("bigint").alias("n_null_keys"), F.lit(None).cast("bigint").alias("n_repeated"))
        fine = F.lit(not lacks) & (F.col("n_rows") > 0) & (F.coalesce(F.col("n_null_keys") + F.col("n_repeated"), F.lit(0)) == 0)
        out.append(row.select(F.lit(name).alias("artifact"), "n_rows", "n_null_keys", "n_repeated", F.lit(",".join(lacks)).alias("missing"), fine.alias("passes")))
    return reduce(DataFrame.unionByName, out)


def gene_problems(genes: DataFrame) -> DataFrame:
    """V8: genes with a null or empty id, an unknown strand, a null coordinate, an end before the start, or a repeated id; a row a problem."""
    twice = F.count("*").over(Window.partitionBy("gene_id"))
    checks = {"no_id": F.coalesce(F.trim("gene_id") == "", F.lit(True)), "strand": ~F.coalesce(F.col("strand").isin("+", "-"), F.lit(False)), "no_coordinate": F.col("start").isNull() | F.col("end").isNull(), "end_before_start": F.coalesce(F.col("end") < F.col("start"), F.lit(False)), "repeated": F.coalesce(F.col("_n") > 1, F.lit(False))}
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())))
    return genes.withColumn("_n", twice).select("gene_id", F.explode(found).alias("problem"))


def record_deltas(records: DataFrame, scores: DataFrame, distance: int = 50, mask: DataFrame | None = None) -> DataFrame:
    """Delta scores of variant records by position: gains and losses of donor and acceptor, their largest values and where.

    records: variant, chrom, position, ref_allele, alt_allele. scores: variant, allele (ref or alt), offset in that allele's sequence from the variant,
    donor, acceptor. Positions after the variant are shifted so that both alleles meet: with an insertion the inserted positions take
    their largest score, and with a deletion the lost positions score 0. Records that are neither base change, insertion nor deletion, those with a symbolic allele (<DEL>, *, .), and records
    whose reference is longer than twice the distance, are skipped. mask: (chrom, position, splice_type) of annotated sites: gains at
    them and losses elsewhere are 0. Ties go to the smaller offset.
    """
    ref, alt = F.length("ref_allele"), F.length("alt_allele")
    bases = F.col("ref_allele").rlike("^[A-Za-z]+$") & F.col("alt_allele").rlike("^[A-Za-z]+$")
    ok = bases & ((ref == 1) | (alt == 1)) & (ref <= 2 * distance) & (F.col("ref_allele") != F.col("alt_allele"))
    told = records.where(ok).select("variant", "chrom", "position", ref.alias("_ref"), alt.alias("_alt"))
    if mask is not None:
        told = told.hint("merge").join(sites_around(told, mask, distance), ["chrom", "position"], "left")
    got = scores.hint("merge").join(told, "variant")  # exploded rows look few to Catalyst, which would broadcast them
    at, inserted = F.col("offset"), F.col("_alt") - F.col("_ref")
    shifted = F.when((F.col("allele") == "ref") | (at <= 0), at).when(inserted > 0, F.greatest(F.lit(0), at - inserted)).otherwise(at - inserted)
    got = got.withColumn("at", shifted).where(F.abs("at") <= distance)
    known = lambda s: F.coalesce(F.array_contains(f"_{s}s", F.col("position") + F.col("at")), F.lit(False))
    marks = [] if mask is None else [F.max(known(s)).alias(f"_{s}_known") for s in ("donor", "acceptor")]
    one = got.groupBy("variant", "chrom", "position", "at").agg(*(F.max(F.when(F.col("allele") == a, F.col(s))).alias(f"{a}_{s}") for a in ("ref", "alt") for s in ("donor", "acceptor")), *marks)
    change = lambda s: F.coalesce(f"alt_{s}", F.lit(0.0)) - F.coalesce(f"ref_{s}", F.lit(0.0))
    one = one.withColumns({f"_{s}": change(s) for s in ("donor", "acceptor")})
    if mask is not None:
        hidden = lambda s: F.when(F.col(f"_{s}_known"), F.col(f"_{s}") > 0).otherwise(F.col(f"_{s}") < 0)
        one = one.withColumns({f"_{s}": F.when(hidden(s), 0.0).otherwise(F.col(f"_{s}")) for s in ("donor", "acceptor")})
    out = []
    for name, s, sign in (("acceptor_gain", "acceptor", 1), ("acceptor_loss", "acceptor", -1), ("donor_gain", "donor", 1), ("donor_loss", "donor", -1)):
        size = F.greatest(F.lit(0.0), sign * F.col(f"_{s}"))
        out += [F.max(size).alias(name), F.max_by("at", F.struct(size, -F.col("at"))).alias(f"{name}_at")]
    return one.groupBy("variant").agg(*out)


def sites_around(records: DataFrame, mask: DataFrame, distance: int) -> DataFrame:
    """(chrom, position, _donors, _acceptors) of records with annotated sites within the distance or a little more: the sites' positions as two arrays, from bins of 2 * distance + 1 positions."""
    size = 2 * distance + 1
    of = lambda s: F.collect_set(F.when(F.col("splice_type") == s, F.col("position"))).alias(f"_{s}s")
    cut = mask.groupBy("chrom", F.floor(F.col("position") / size).alias("_bin")).agg(of("donor"), of("acceptor"))
    low, high = (F.floor((F.col("position") + d) / size) for d in (-distance, distance))
    asked = records.where(F.col("position").isNotNull()).select("chrom", "position").distinct().withColumn("_bin", F.explode(F.sequence(low, high)))
    return asked.hint("merge").join(cut, ["chrom", "_bin"]).groupBy("chrom", "position").agg(*(F.flatten(F.collect_list(f"_{s}s")).alias(f"_{s}s") for s in ("donor", "acceptor")))
