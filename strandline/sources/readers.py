"""Scans (S1-S33): files to DataFrames with fixed schemas; nothing is inferred where a name could be taken for a number."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

GTF = "seqname string, source string, feature string, start bigint, end bigint, score string, strand string, frame string, attributes string"
STAR = "chrom string, intron_start bigint, intron_end bigint, strand int, intron_motif int, annotated int, unique_reads bigint, multi_reads bigint, max_overhang int"
PEAKS = "chrom string, start bigint, end bigint, name string, score bigint, strand string, signal_value double, p_value double, q_value double, peak_offset bigint"
VCF = "chrom string, position bigint, id string, ref_allele string, alts string, qual string, filter string, info string"

#: Other names for a column, tried where the standard one is absent.
SYNONYMS = {
    "splice_type": ["site_type", "type"], "chrom": ["seqname", "chromosome", "chr"], "gene_biotype": ["gene_type", "biotype"],
    "reads": ["unique_reads", "score", "count", "support_count"], "position": ["pos"],
}


def standardise(df: DataFrame, synonyms=None) -> DataFrame:
    """Rename the first synonym of each standard name that is absent; chrom is a string."""
    for name, others in (synonyms or SYNONYMS).items():
        found = [c for c in others if c in df.columns]
        if name not in df.columns and found:
            df = df.withColumnRenamed(found[0], name)
    return df.withColumn("chrom", F.col("chrom").cast("string")) if "chrom" in df.columns else df


def separator(path: str, first_line: str | None = None) -> str:
    """By suffix, else the most frequent of comma, tab, semicolon and bar in the first line (comma, if none)."""
    name = path.removesuffix(".gz").removesuffix(".bz2")
    if name.endswith((".tsv", ".tab")):
        return "\t"
    if name.endswith(".csv") or not first_line:
        return ","
    counts = {s: first_line.count(s) for s in (",", "\t", ";", "|")}
    return max(counts, key=counts.get) if max(counts.values()) else ","


def delimited(spark: SparkSession, path: str, schema: str | None = None, sep: str | None = None, all_text=False) -> DataFrame:
    """A delimited file or folder with a header. Without a schema, types are inferred, or all are text."""
    if sep is None:
        head = None if path.endswith((".csv", ".tsv", ".tab", ".gz")) else spark.read.text(path).limit(1).collect()
        sep = separator(path, head[0][0] if head else None)
    reader = spark.read.option("header", True).option("sep", sep)
    return (reader.schema(schema) if schema else reader.option("inferSchema", not all_text)).csv(path)


def gtf(spark: SparkSession, path: str, features: list[str] | None = None, chroms: list[str] | None = None) -> DataFrame:
    """Annotation records; comments and lines of fewer than 9 fields go; .gz is read as it is."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(parts) >= 9))
    names = [f.split()[0] for f in GTF.split(", ")]
    df = lines.select(*(parts[i].cast("bigint").alias(n) if n in ("start", "end") else parts[i].alias(n) for i, n in enumerate(names)))
    if features:
        df = df.where(F.col("feature").isin(features))
    if chroms:
        df = df.where(F.regexp_replace("seqname", "^chr", "").isin([c.removeprefix("chr") for c in chroms]))
    return df


def genes(records: DataFrame) -> DataFrame:
    """A row a gene; where there are no gene records, the span of its transcripts."""
    a = F.col("attributes")
    named = records.select(F.col("seqname").alias("chrom"), "feature", "start", "end", "strand", text.first_attribute(a, "gene_id", "ID").alias("gene_id"), text.first_attribute(a, "gene_name", "gene", "Name").alias("gene_name"), text.first_attribute(a, "gene_type", "gene_biotype").alias("gene_type"))
    named = named.where("gene_id IS NOT NULL AND feature IN ('gene', 'transcript', 'mRNA')")
    is_gene = F.col("feature") == "gene"
    pick = lambda f, c: F.coalesce(f(F.when(is_gene, F.col(c))), f(F.col(c))).alias(c)
    return named.groupBy("gene_id").agg(F.min("chrom").alias("chrom"), pick(F.min, "start"), pick(F.max, "end"), F.min("strand").alias("strand"), F.min("gene_name").alias("gene_name"), F.min("gene_type").alias("gene_type"))


def exon_table(records: DataFrame) -> DataFrame:
    """Exons with ids and numbers; a missing id is made of transcript and span, a missing number is 0."""
    a = F.col("attributes")
    df = records.where("feature = 'exon'").select(
        F.col("seqname").alias("chrom"), "start", "end", "strand", text.first_attribute(a, "gene_id", "ID").alias("gene_id"), text.first_attribute(a, "gene_name", "gene", "Name").alias("gene_name"),
        text.first_attribute(a, "gene_type", "gene_biotype").alias("gene_biotype"), text.first_attribute(a, "transcript_id", "Parent").alias("transcript_id"), text.attribute(a, "exon_id").alias("exon_id"), text.digits_or(F.coalesce(text.attribute(a, "exon_number"), F.lit("")), 0).alias("exon_number"),
    )
    return df.withColumn("exon_id", F.coalesce("exon_id", text.exon_id("transcript_id", "start", "end")))


def gene_table_with_exons(exons: DataFrame) -> DataFrame:
    """A row a gene with its comma-joined exon starts and ends, in order."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("start", "end"))), lambda s: s[c].cast("string")), ",")
    return exons.groupBy("gene_id", "chrom", "strand").agg(F.min("start").alias("tx_start"), F.max("end").alias("tx_end"), joined("start").alias("exon_start"), joined("end").alias("exon_end"))


def star_junctions(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """Donor is the base before the intron and acceptor the base after it; strand codes 0, 1, 2 are ., +, -."""
    df = spark.read.option("sep", "\t").schema(STAR).csv(path).where(F.col("unique_reads") >= least)
    strand = F.when(F.col("strand") == 1, "+").when(F.col("strand") == 2, "-").otherwise(".")
    return df.select("chrom", (F.col("intron_start") - 1).alias("donor_pos"), (F.col("intron_end") + 1).alias("acceptor_pos"), strand.alias("strand"), F.col("unique_reads").alias("reads"), "annotated")


def aggregated_junctions(df: DataFrame, shift: bool, least: int = 0) -> DataFrame:
    """An aggregated table of either form; `shift` says that start and end are the intron's and not the exons'. reads default to 1."""
    df = standardise(df, SYNONYMS)
    if "donor_pos" not in df.columns:
        df = df.withColumn("donor_pos", F.col("start") - int(shift)).withColumn("acceptor_pos", F.col("end") + int(shift))
    if "reads" not in df.columns:
        df = df.withColumn("reads", F.lit(1).cast("bigint"))
    return df.where(F.col("reads") >= least)


def gct(spark: SparkSession, path: str) -> DataFrame:
    """A matrix of samples as long rows (junction, sample, reads). The samples' names are a table that its header line is exploded into, joined by column."""
    lines = spark.read.text(path)
    parts = F.split("value", "\t")
    head = lines.where(F.col("value").startswith("Name\t"))
    names = head.select(F.posexplode(F.slice(parts, 3, 1 << 30)).alias("i", "sample")).distinct()
    width = head.agg(F.max(F.size(parts)).alias("width"))
    body = lines.join(F.broadcast(width), (F.size(parts) == F.col("width")) & ~F.col("value").startswith("Name\t"))  # one row is broadcast
    got = body.select(parts[0].alias("junction"), F.posexplode(F.slice(parts, 3, 1 << 30)).alias("i", "n"))
    return got.join(names, "i").select("junction", "sample", F.col("n").cast("bigint").alias("reads"))


def narrow_peaks(spark: SparkSession, path: str) -> DataFrame:
    """Peaks, with protein and cell line from the file's name (PROTEIN_CELL_...)."""
    df = spark.read.option("sep", "\t").schema(PEAKS).csv(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return df.select("chrom", "start", "end", F.regexp_extract("file", r"^([^_]+)_", 1).alias("rbp"), F.regexp_extract("file", r"^[^_]+_([^_.]+)", 1).alias("cell_line"), "signal_value", F.col("p_value").alias("neg_log10_pvalue"), "strand")


def fasta(spark: SparkSession, path: str, block: int = 1 << 16) -> DataFrame:
    """(chrom, block_start, sequence) in blocks of `block` upper-case bases. A contig's name stands once in all files; a second one raises an error, as its blocks could not be told apart.

    Files are read as lines in Spark's splits, so a genome is as many tasks as it has splits, of any size. A line's place is its split and its number
    there; what a split's leading lines continue (contig and bases so far) comes from the splits before it, of which there is a row each.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    head = F.col("value").startswith(">")
    lines = lines.select("file", "split", "row", F.when(head, F.regexp_extract("value", r"^>\s*(\S*)", 1)).alias("name"), F.when(head, F.lit("")).otherwise(F.upper(F.trim("value"))).alias("bases"))
    within = Window.partitionBy("file", "split").orderBy("row")
    lines = lines.withColumn("contig", F.count("name").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("name", F.last("name", True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    here = Window.partitionBy("file", "split", "contig").orderBy("row")
    lines = lines.withColumn("at", F.sum(F.length("bases")).over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.length("bases"))
    ends = lines.groupBy("file", "split", "contig", "name").agg(F.sum(F.length("bases")).alias("size"))
    tail = ends.groupBy("file", "split").agg(F.max_by("name", "contig").alias("last_name"), F.max_by("size", "contig").alias("last_size"), F.max("contig").alias("contigs"))
    before = Window.partitionBy("file").orderBy("split")
    tail = tail.withColumn("run", F.sum((F.col("contigs") > 0).cast("int")).over(before))  # splits since a header: one contig goes on
    ahead = Window.partitionBy("file", "run").orderBy("split")
    tail = tail.withColumn("run_name", F.first("last_name", True).over(ahead)).withColumn("run_size", F.sum("last_size").over(ahead))
    carried = tail.select("file", "split", F.lag("run_name").over(before).alias("before_name"), F.lag("run_size").over(before).alias("before_size"))
    placed = lines.join(carried, ["file", "split"])
    first = F.col("contig") == 0
    placed = placed.select(F.when(first, F.col("before_name")).otherwise(F.col("name")).alias("chrom"), (F.col("at") + F.when(first, F.coalesce("before_size", F.lit(0))).otherwise(0)).alias("at"), "bases").where("bases <> '' AND chrom IS NOT NULL")
    cut = placed.withColumn("k", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.length("bases") - 1) / block))))
    start = F.greatest(F.lit(0), F.col("k") * block - F.col("at")).cast("int")
    end = F.least(F.length("bases"), (F.col("k") + 1) * block - F.col("at")).cast("int")
    piece = F.struct(F.greatest("at", F.col("k") * block).alias("at"), F.col("bases").substr(start + 1, end - start).alias("bases"))
    got = cut.select("chrom", "k", piece.alias("piece")).groupBy("chrom", "k").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    x = F.col("pieces")
    size = F.aggregate(x, F.lit(0).cast("bigint"), lambda n, y: n + F.length(y["bases"]))
    once = size == F.element_at(x, -1)["at"] + F.length(F.element_at(x, -1)["bases"]) - F.element_at(x, 1)["at"]  # the bases of a second contig would lie over the first's
    whole = F.when(once, F.array_join(F.transform(x, lambda y: y["bases"]), "")).otherwise(F.raise_error(F.concat(F.lit("two contigs have the name "), "chrom")))
    return got.select("chrom", (F.col("k") * block + 1).alias("block_start"), whole.alias("sequence"))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """A row an alternative allele, INFO as a map."""
    parts = F.split("value", "\t")
    names = [f.split()[0] for f in VCF.split(", ")]
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(parts) >= 8))
    df = lines.select(*(parts[i].cast("bigint").alias(n) if n == "position" else parts[i].alias(n) for i, n in enumerate(names)))
    return df.withColumn("alt_allele", F.explode(F.split("alts", ","))).withColumn("info", F.str_to_map("info", F.lit(";"), F.lit("="))).drop("alts").withColumn("variant_type", text.variant_type(F.col("ref_allele"), F.col("alt_allele")))


def variant_strings(df: DataFrame, column: str) -> DataFrame:
    """Chrom-position-ref-alt strings as columns."""
    return df.select("*", *(v.alias(k) for k, v in text.variant_parts(F.col(column)).items()))


def effect_table(df: DataFrame, locus="locus", effect="effect") -> DataFrame:
    """Loci with their midpoint and effects by name."""
    parts = text.locus_parts(F.col(locus))
    return df.select("*", parts["chrom"].alias("chrom"), F.floor((parts["start"] + parts["end"]) / 2).alias("position"), text.effect(F.col(effect)).alias("effect_type"))


def distinct_events(df: DataFrame, keys: list[str], events: str, least_pct: float = 0.0) -> DataFrame:
    """One row a key, its event list as rows, skips and rare events gone."""
    return text.top_events(df.dropDuplicates(keys), events).where((F.col("kind") != "ES") & (F.col("freq_pct") >= least_pct))


def splicing_tables(spark: SparkSession, path: str, fdr=0.01, change=0.1) -> DataFrame:
    """Significant rows of many tables, the protein from each file's name."""
    df = delimited(spark, path, sep="\t").withColumn("rbp", F.regexp_extract(F.input_file_name(), r"([^/_]+)_[^/]*$", 1))
    return df.where((F.col("FDR") < fdr) & (F.abs("IncLevelDifference") >= change))


def artifacts(spark: SparkSession, path: str, columns: list[str] | None = None, chroms: list[str] | None = None) -> DataFrame:
    """Feature tables of a folder, the columns and chromosomes asked for (both reach the scan)."""
    df = spark.read.parquet(path)
    df = df.where(F.col("chrom").isin(chroms)) if chroms else df
    return df.select(*columns) if columns else df


def metric_runs(spark: SparkSession, path: str) -> DataFrame:
    """Metrics.json of every run below a folder, with the run's name."""
    df = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "metrics.json").json(path)
    return df.withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/metrics\.json$", 1))


def prediction_files(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of a folder: Parquet files by chromosome if there are any, else predictions.tsv, else the chunks (TSV)."""
    for pattern in ("predictions_{chr*,[^c]*}.parquet", "predictions.tsv", "predictions_chunk_*.tsv"):
        try:
            path = f"{folder.rstrip('/')}/{pattern}"
            return standardise(spark.read.parquet(path) if pattern.endswith("parquet") else delimited(spark, path, sep="\t"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"no predictions in {folder}")


def sample_tissues(spark: SparkSession, path: str, sample="SAMPID", tissue="SMTSD") -> DataFrame:
    """(sample, tissue) of a metadata table, without samples that have no tissue."""
    return delimited(spark, path, sep="\t").select(F.col(sample).alias("sample"), F.col(tissue).alias("tissue")).where("tissue IS NOT NULL").distinct()


def union_files(*frames: DataFrame) -> DataFrame:
    """Files of one schema, in any order of columns."""
    return reduce(DataFrame.unionByName, frames)
