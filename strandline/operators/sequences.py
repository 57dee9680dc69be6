"""Random access to sequences (S14, S15) and sequences with a label a base.

A sequence is a table of blocks (chrom, block_start, sequence), 1-based, of one size but the last: what readers.fasta gives, or blocks() of a table of whole texts. A
span is exploded into the blocks it touches, an equi-join on (chrom, block) fetches them, each cut to what the span needs, and the pieces are joined in order. Equal spans are fetched once. A popular
block is a skewed key of a plain join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import reverse_complement

BLOCK = 1 << 16
#: What a donor is followed by and an acceptor preceded by.
MOTIFS = (("GT", "AG"), ("GC", "AG"), ("AT", "AC"))


def blocks(df: DataFrame, chrom: str, sequence: str, size: int = BLOCK) -> DataFrame:
    """(chrom, block_start, sequence) of whole sequences, a row each; null ones have no block, and an empty one has one without bases. chrom is unique, but for equal sequences."""
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.floor((F.length(sequence) - 1) / size), F.lit(0))))
    cut = df.where(F.col(sequence).isNotNull()).select(F.col(chrom).cast("string").alias("chrom"), F.col(sequence).alias("_whole"), at.alias("_k"))
    return cut.select("chrom", (F.col("_k") * size + 1).alias("block_start"), F.substring("_whole", (F.col("_k") * size + 1).cast("int"), F.lit(size)).alias("sequence"))


def last_base() -> Column:
    return F.max(F.col("block_start") + F.length("sequence") - 1)


def index(held: DataFrame) -> DataFrame:
    """(chrom, length, n_blocks, n_missing) of each sequence with bases; n_missing: bases up to the last one that no block holds."""
    return held.groupBy("chrom").agg(last_base().alias("length"), F.count("*").alias("n_blocks"), (last_base() - F.sum(F.length("sequence"))).alias("n_missing")).where("length > 0")


def other_name(chrom: Column) -> Column:
    return F.when(chrom.startswith("chr"), F.substring(chrom, 4, 1 << 30)).otherwise(F.concat(F.lit("chr"), chrom))


def names_held(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(chrom, held, _length): each wanted name, the name that the blocks have for it (the same, else with or without `chr`) and its length. A row a name; the blocks are read once."""
    there = held.groupBy(F.col("chrom").alias("held")).agg(last_base().alias("_length"))
    tried = wanted.select("chrom").distinct().select("chrom", F.posexplode(F.array("chrom", other_name(F.col("chrom")))).alias("_try", "held"))
    return tried.join(there, "held").groupBy("chrom").agg(F.min_by(F.struct("held", "_length"), "_try").alias("_is")).select("chrom", "_is.*")


def fetch(spans: DataFrame, held: DataFrame, start="start", end="end", strand: str | None = None, size: int = BLOCK, name="sequence") -> DataFrame:
    """spans (chrom, start, end; 1-based, closed) with their sequence; a span over the ends of its sequence is cut there.

    With a strand column, rows with '-' get the reverse complement. Null where the name is unknown or a column is null; empty where no base lies in the span. Equal blocks of one place count once. size: the blocks' size.
    """
    key = spans.select("chrom", F.col(start).cast("bigint").alias("_start"), F.col(end).cast("bigint").alias("_end")).distinct()
    inside = key.join(names_held(key, held), "chrom").where(F.col("_start").isNotNull() & F.col("_end").isNotNull())
    touched = F.sequence(F.greatest(F.floor((F.col("_start") - 1) / size), F.lit(0)), F.floor((F.least("_end", "_length") - 1) / size))
    some = (F.greatest("_start", F.lit(1)) <= F.least("_end", "_length"))
    asked = inside.where(some).select("chrom", "held", "_start", "_end", F.explode(touched).alias("_k"))
    from_blocks = held.select(F.col("chrom").alias("held"), F.floor((F.col("block_start") - 1) / size).alias("_k"), "block_start", F.col("sequence").alias("_block"))
    first = F.greatest(F.col("_start"), F.col("block_start"))
    stop = F.least(F.col("_end"), F.col("block_start") + F.length("_block") - 1)
    piece = F.struct(F.col("_k"), F.substring("_block", (first - F.col("block_start") + 1).cast("int"), (stop - first + 1).cast("int")).alias("bases"))
    pieces = asked.join(from_blocks, ["held", "_k"]).select("chrom", "_start", "_end", piece.alias("_piece"))
    whole = pieces.groupBy("chrom", "_start", "_end").agg(F.array_join(F.transform(F.array_sort(F.collect_set("_piece")), lambda x: x["bases"]), "").alias("_found"))
    nothing = inside.where(~some).select("chrom", "_start", "_end", F.lit("").alias("_found"))
    fetched = whole.unionByName(nothing).withColumnRenamed("chrom", "_chrom")
    got = spans.join(fetched, (F.col("chrom") == F.col("_chrom")) & (F.col(start) == F.col("_start")) & (F.col(end) == F.col("_end")), "left")
    bases = F.col("_found") if strand is None else F.when(F.col(strand) == "-", reverse_complement(F.col("_found"))).otherwise(F.col("_found"))
    return got.withColumn(name, bases).drop("_chrom", "_start", "_end", "_found")


#: Bases of a piece: a letter of a long text is found by counting from its start.
PIECE = 256


def pieces(sequence: Column) -> Column:
    """A text in pieces of PIECE letters, each with the first letter of the next."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(sequence) - 1) / PIECE), F.lit(0)).cast("int")), lambda i: F.substring(sequence, i * PIECE + 1, F.lit(PIECE + 1)))


def two_letters(cut: Column, at: Column) -> Column:
    """The two letters at a 0-based place, not negative, of a text in pieces."""
    return F.substring(F.get(cut, F.floor(at / PIECE).cast("int")), (F.pmod(at, F.lit(PIECE)) + 1).cast("int"), F.lit(2))


def site_offsets(genes: DataFrame, exons: DataFrame, checked: bool = True, gene="gene_id", transcript="transcript_id", sequence="sequence") -> DataFrame:
    """(gene, offset, label) of the sites of a gene's transcripts in its sequence (0-based, in the gene's direction): 2 a donor, 1 an acceptor.

    genes: gene, start, end, strand and sequence (fetched by the strand). exons: gene, transcript, start, end, of the transcripts that count. A donor is the last base of an exon and an acceptor the first of the next, turned round on
    the minus strand. With `checked`, only introns that begin and end with a known pair of motifs count. Of two labels of one base that of the later transcript, then exon, stays (by transcript start and id);
    in one intron, the acceptor's.
    """
    w = Window.partitionBy(gene, transcript).orderBy("start", "end")
    introns = exons.select(gene, transcript, "start", "end", F.min("start").over(Window.partitionBy(gene, transcript)).alias("_from"), F.lead("start").over(w).alias("_next"), F.row_number().over(w).alias("_nth")).where("_next IS NOT NULL")
    listed = introns.groupBy(gene).agg(F.collect_list(F.struct(F.col("_from"), F.col(transcript).alias("_transcript"), F.col("_nth"), F.col("end"), F.col("_next"))).alias("_introns"))
    placed = genes.select(gene, F.col("start").alias("_at"), F.col("strand").alias("_strand"), F.length(sequence).alias("_size"), pieces(F.col(sequence)).alias("_pieces")).join(listed, gene)
    size, minus = F.col("_size"), F.col("_strand") == "-"

    def ends(x: Column) -> Column:
        one, two = x["end"] - F.col("_at"), x["_next"] - F.col("_at")
        turn = F.struct(x["_from"].alias("_from"), x["_transcript"].alias("_transcript"), x["_nth"].alias("_nth"))
        return F.struct(F.when(minus, size - two - 1).otherwise(one).alias("donor"), F.when(minus, size - one - 1).otherwise(two).alias("acceptor"), turn.alias("turn"))

    def known(x: Column) -> Column:
        after, before = (F.upper(two_letters(F.col("_pieces"), at)) for at in (x["donor"] + 1, x["acceptor"] - 2))
        return (x["acceptor"] >= 2) & (x["donor"] >= 0) & F.concat(after, before).isin(*("".join(m) for m in MOTIFS))

    # The bases stay in the gene's row: with the introns as rows each would carry them all.
    found = F.filter(F.transform("_introns", ends), known) if checked else F.transform("_introns", ends)
    site = lambda x, at, label: F.struct(x[at].alias("offset"), F.lit(label).alias("label"), F.struct(x["turn"].alias("t"), F.lit(2 - label).alias("i")).alias("turn"))
    each = F.flatten(F.transform(found, lambda x: F.array(site(x, "donor", 2), site(x, "acceptor", 1))))
    rows = placed.select(gene, "_size", F.explode(each).alias("s")).select(gene, "_size", "s.*")
    return rows.where((F.col("offset") >= 0) & (F.col("offset") < F.col("_size"))).groupBy(gene, "offset").agg(F.max_by("label", "turn").alias("label"))


def base_labels(genes: DataFrame, sites: DataFrame, gene="gene_id", sequence="sequence", name="labels") -> DataFrame:
    """Genes with a text of one digit a base, 0 where no site is. A gene's sites are in one row, as its sequence is; null without a sequence."""
    listed = sites.groupBy(F.col(gene).alias("_gene")).agg(F.array_sort(F.collect_list(F.struct("offset", "label"))).alias("_sites"))
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("_sites", i - 1)["offset"])
    zeros = lambda n: F.repeat(F.lit("0"), n.cast("int"))
    upto = F.array_join(F.transform("_sites", lambda x, i: F.concat(zeros(x["offset"] - before(i) - 1), x["label"].cast("string"))), "")
    last = F.coalesce(F.element_at("_sites", -1)["offset"], F.lit(-1))
    made = F.concat(F.coalesce(upto, F.lit("")), zeros(F.length(sequence) - last - 1))
    return genes.join(listed, F.col(gene) == F.col("_gene"), "left").withColumn(name, F.when(F.col(sequence).isNotNull(), made)).drop("_gene", "_sites")


def canonical_transcripts(exons: DataFrame, gene="gene_id", transcript="transcript_id") -> DataFrame:
    """The exons of each gene's longest transcript by span (the one that starts first, then the smaller id, on ties)."""
    spans = exons.groupBy(gene, transcript).agg(F.min("start").alias("_s"), F.max("end").alias("_e"))
    best = spans.groupBy(gene).agg(F.min_by(transcript, F.struct(F.col("_s") - F.col("_e"), F.col("_s"), F.col(transcript))).alias(transcript))
    return exons.join(best, [gene, transcript], "left_semi")


def genes_with_labels(genes: DataFrame, exons: DataFrame, held: DataFrame, canonical: bool = True, checked: bool = True, gene="gene_id", size: int = BLOCK) -> DataFrame:
    """Genes (gene, chrom, start, end, strand) with their sequence and labels, of the canonical transcript or of all."""
    read = fetch(genes, held, strand="strand", size=size)
    return base_labels(read, site_offsets(read, canonical_transcripts(exons, gene) if canonical else exons, checked, gene), gene)
