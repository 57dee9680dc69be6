"""Sequences and annotation strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attribute(attributes, key: str) -> Column:
    """A GTF (key "value") or GFF3 (key=value) attribute; null where it is absent."""
    gtf = F.regexp_extract(attributes, rf'(?:^|[;\s]){key}\s+"([^"]*)"', 1)
    gff = F.regexp_extract(attributes, rf"(?:^|;)\s*{key}=([^;]*)", 1)
    return F.coalesce(F.nullif(gtf, F.lit("")), F.nullif(gff, F.lit("")))


def first_attribute(attributes, *keys: str) -> Column:
    """The first of the keys that is there."""
    return F.coalesce(*(attribute(attributes, k) for k in keys))


def exon_id(transcript, start, end) -> Column:
    """Transcript:start-end."""
    return F.concat(F.col(transcript), F.lit(":"), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"))


def digits_or(value, default: int) -> Column:
    """T4: an integer where the string is digits only, else the default."""
    return F.when(value.rlike("^[0-9]+$"), value.try_cast("int")).otherwise(F.lit(default))


def reverse_complement(sequence) -> Column:
    """T5."""
    return F.reverse(F.translate(sequence, "ACGTNacgtn", "TGCANtgcan"))


def allele_on_plus(allele, strand) -> Column:
    """An allele given on the gene's strand, on the plus strand."""
    return F.when(strand == "-", reverse_complement(allele)).otherwise(allele)


def window(sequence, position, width: int, start=None) -> Column:
    """Upper-case [position - width, position + width) of a sequence whose first base is at `start` (1), padded with N."""
    at = position - (F.lit(1) if start is None else start) - width  # 0-based first base of the window
    padded = F.concat(F.repeat(F.lit("N"), F.greatest(-at, F.lit(0)).cast("int")), F.upper(F.substring(sequence, F.greatest(at + 1, F.lit(1)).cast("int"), (2 * width + F.least(at, F.lit(0))).cast("int"))))
    return F.rpad(padded, 2 * width, "N")


def share_of(sequence, letters: str) -> Column:
    """The share of a sequence's characters that are among the letters; 0 where it is empty."""
    n = F.length(sequence)
    return F.when(n > 0, F.length(F.regexp_replace(sequence, f"[^{letters}]", "")) / n).otherwise(F.lit(0.0))


def cpg_density(sequence) -> Column:
    """CG pairs a step."""
    n = F.length(sequence)
    return F.when(n > 1, (n - F.length(F.replace(sequence, F.lit("CG"), F.lit("")))) / 2 / (n - 1)).otherwise(F.lit(0.0))


def intron_dinucleotide(sequence, position, site_type, strand) -> Column:
    """The two intron bases beside a site, in the direction of the strand. sequence is the plus strand, 1-based."""
    after = F.substring(sequence, (position + 1).cast("int"), F.lit(2))
    before = F.when(position > 2, F.substring(sequence, (position - 2).cast("int"), F.lit(2)))
    plus = strand == "+"
    return F.upper(F.when(plus & (site_type == "donor"), after).when(plus, before).when(site_type == "donor", reverse_complement(before)).otherwise(reverse_complement(after)))


def canonical_motif(site_type, dinucleotide) -> Column:
    """GT at a donor, AG at an acceptor."""
    return ((site_type == "donor") & (dinucleotide == "GT")) | ((site_type == "acceptor") & (dinucleotide == "AG"))


def one_hot(sequence) -> Column:
    """Four channels a base, in the order ACGT; all zero for others."""
    return F.transform(F.split(F.upper(sequence), ""), lambda b: F.array(*((b == x).cast("int") for x in "ACGT")))


def base_codes(sequence) -> Column:
    """A 0, C 1, G 2, T 3, anything else 4."""
    return F.transform(F.split(F.upper(sequence), ""), lambda b: F.when(F.instr(F.lit("ACGT"), b) > 0, F.instr(F.lit("ACGT"), b) - 1).otherwise(4))


def junction_parts(junction) -> dict[str, Column]:
    """chrom_start_end; the chromosome may hold underscores."""
    return {"chrom": F.regexp_extract(junction, r"^(.*)_(\d+)_(\d+)$", 1), "start": F.regexp_extract(junction, r"^(.*)_(\d+)_(\d+)$", 2).try_cast("bigint"), "end": F.regexp_extract(junction, r"^(.*)_(\d+)_(\d+)$", 3).try_cast("bigint")}


def variant_parts(variant) -> dict[str, Column]:
    """Chrom-pos-ref-alt, with or without quotes."""
    part = F.split(F.regexp_replace(F.trim(variant), '^"|"$', ""), "-")
    return {"chrom": F.get(part, F.lit(0)), "position": F.get(part, F.lit(1)).try_cast("bigint"), "ref_allele": F.get(part, F.lit(2)), "alt_allele": F.get(part, F.lit(3))}


def hgvs_alleles(hgvs) -> dict[str, Column]:
    """Position, intron offset and alleles of a coding substitution such as c.100+2A>G."""
    pattern = r"c\.(-?\d+)([+-]\d+)?([ACGT]+)>([ACGT]+)"
    return {"coding_position": F.regexp_extract(hgvs, pattern, 1).try_cast("bigint"), "intron_offset": F.coalesce(F.regexp_extract(hgvs, pattern, 2).try_cast("bigint"), F.lit(0)), "ref_allele": F.nullif(F.regexp_extract(hgvs, pattern, 3), F.lit("")), "alt_allele": F.nullif(F.regexp_extract(hgvs, pattern, 4), F.lit(""))}


def top_events(df: DataFrame, events: str) -> DataFrame:
    """A row an event of a list such as Top1:CD;-12;35%|Top2:ES;..., with its kind, offset and frequency."""
    pattern = r"Top\d+:(CD|CA|ES);([^;|]*);([\d.]+)%"
    each = F.explode(F.regexp_extract_all(F.col(events), F.lit(rf"(Top\d+:(?:CD|CA|ES);[^;|]*;[\d.]+%)"), F.lit(1))).alias("_e")
    got = df.select("*", each)
    return got.select(*df.columns, F.regexp_extract("_e", pattern, 1).alias("kind"), F.regexp_extract("_e", pattern, 2).alias("offset"), F.regexp_extract("_e", pattern, 3).cast("double").alias("freq_pct"))


def locus_parts(locus) -> dict[str, Column]:
    """Chr:start-end."""
    pattern = r"^([^:]+):(\d+)-(\d+)$"
    return {"chrom": F.nullif(F.regexp_extract(locus, pattern, 1), F.lit("")), "start": F.regexp_extract(locus, pattern, 2).try_cast("bigint"), "end": F.regexp_extract(locus, pattern, 3).try_cast("bigint")}


def significance(raw) -> Column:
    """The first of several significances, by prefix."""
    first = F.lower(F.get(F.split(raw, r"[|,/]"), F.lit(0)))
    return F.when(first.startswith("pathogenic"), "Pathogenic").when(first.startswith("likely_pathogenic"), "Likely_pathogenic").when(first.startswith("likely_benign"), "Likely_benign").when(first.startswith("benign"), "Benign").when(first.startswith("uncertain"), "VUS").otherwise("Other")


def variant_type(ref, alt) -> Column:
    """SNV, insertion, deletion or other by the alleles' lengths."""
    return F.when((F.length(ref) == 1) & (F.length(alt) == 1), "SNV").when(F.length(ref) < F.length(alt), "insertion").when(F.length(ref) > F.length(alt), "deletion").otherwise("MNV")


def family(name, patterns: list[tuple[str, str]]) -> Column:
    """The first pattern that matches names the family; else the name without trailing digits; null if nothing is left."""
    out = None
    for pattern, label in patterns:
        out = F.when(name.rlike(pattern), label) if out is None else out.when(name.rlike(pattern), label)
    stem = F.nullif(F.regexp_extract(name, r"^(.*?)\d+$", 1), F.lit(""))
    return out.otherwise(stem) if out is not None else stem


def mutate(sequence, offset, ref, alt) -> Column:
    """The sequence with alt in place of ref at a 1-based offset; null where ref isn't there."""
    there = F.substring(sequence, offset, F.length(ref)) == ref
    return F.when(there, F.overlay(sequence, alt, offset, F.length(ref)))


def effect(textual) -> Column:
    """A free-text effect as one of a few names."""
    t = F.lower(textual)
    return F.when(t.contains("skip"), "exon_skipping").when(t.contains("retention"), "intron_retention").when(t.contains("cryptic"), "cryptic_site").when(t.contains("loss"), "site_loss").when(t.contains("gain"), "site_gain").otherwise("other")


def motif_counts(df: DataFrame, sequence: str, position: str, site_type: str) -> DataFrame:
    """How often each two-base motif starts at labelled sites."""
    return df.groupBy(F.col(site_type), F.upper(F.substring(F.col(sequence), F.col(position).cast("int"), F.lit(2))).alias("motif")).agg(F.count("*").alias("n"))


def chunks(df: DataFrame, sequence: str, size: int, overlap: int) -> DataFrame:
    """A row a chunk of `size` with `overlap` shared bases, and the range that this chunk keeps when stitched (0-based, half-open)."""
    step, n = size - overlap, F.length(sequence)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0))
    got = df.select("*", n.alias("_n"), last.alias("_last"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    start = F.col("chunk") * step
    end = F.least(start + size, F.col("_n"))
    return got.select(*df.columns, "chunk", start.alias("chunk_start"), end.alias("chunk_end"), F.when(F.col("chunk") == 0, 0).otherwise(start + overlap // 2).alias("keep_start"), F.when(F.col("chunk") == F.col("_last"), F.col("_n")).otherwise(start + step + overlap // 2).alias("keep_end"), F.substring(F.col(sequence), (start + 1).cast("int"), F.lit(size)).alias("chunk_sequence")).drop("_n", "_last")


def blocks(df: DataFrame, sequence: str, size: int = 5000, flank: int = 5000) -> DataFrame:
    """Blocks of `size` with `flank` bases of context on both sides, padded with N."""
    padded = F.concat(F.repeat(F.lit("N"), flank), F.upper(F.col(sequence)), F.repeat(F.lit("N"), flank + size))
    count = F.ceil(F.length(sequence) / size)
    got = df.where(F.length(sequence) > 0).select("*", padded.alias("_p"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block"))
    return got.select(*df.columns, "block", F.substring(F.col("_p"), (F.col("block") * size + 1).cast("int"), F.lit(size + 2 * flank)).alias("block_sequence"))
