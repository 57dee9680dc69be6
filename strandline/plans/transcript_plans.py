"""Transcript, comparison and browsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment, compare, sequences, transcripts
from .registry import query
from .tables import EXONS, JUDGED, SCORED, exons, judged, scored, table


def cds(spark, sf_dir):
    """Disjoint intervals of a transcript: orders of different days, cut to one day each."""
    e = exons(spark, sf_dir).groupBy("transcript_id", "strand", "start").agg(F.max(F.col("end") - F.col("start")).alias("n"))
    return e.select("transcript_id", "strand", (F.col("start") * 10).alias("start"), (F.col("start") * 10 + F.col("n")).alias("end"))


CDS = f"""{EXONS}, cds AS (SELECT transcript_id, strand, start * 10 AS start, start * 10 + max("end" - start) AS "end" FROM exons GROUP BY transcript_id, strand, exons.start)"""


@query("coding_to_genomic", f"""WITH {CDS}, r AS (SELECT *, sum("end" - start + 1) OVER (PARTITION BY transcript_id ORDER BY CASE WHEN strand = '-' THEN -start ELSE start END) AS last FROM cds), w AS (SELECT DISTINCT transcript_id, k AS coding_position, transcript_id % 3 AS intron_offset FROM exons, (SELECT unnest([1, 4, 9, 25, 400]) AS k))
SELECT w.transcript_id, coding_position, intron_offset, CASE WHEN strand = '-' THEN "end" - (coding_position - (last - ("end" - start))) - intron_offset ELSE start + (coding_position - (last - ("end" - start))) + intron_offset END AS position
FROM w JOIN r USING (transcript_id) WHERE coding_position BETWEEN last - ("end" - start) AND last""")  # fmt: skip
def coding_to_genomic(spark, sf_dir):
    wanted = exons(spark, sf_dir).select("transcript_id").distinct().select("transcript_id", F.explode(F.array(*map(F.lit, [1, 4, 9, 25, 400]))).alias("coding_position"), (F.col("transcript_id") % 3).alias("intron_offset"))
    return transcripts.coding_to_genomic(cds(spark, sf_dir), wanted)


@query("liftover", f"""WITH {EXONS}, p AS (SELECT exon, strand AS chrom, start AS position FROM exons), c AS (SELECT b AS start, b + 79 AS "end", s AS chrom, 1000 + b * 2 AS new_start, CASE WHEN b % 200 = 0 THEN '-' ELSE '+' END AS new_strand FROM (SELECT unnest(range(0, 6000, 100)) AS b), (SELECT unnest(['+', '-']) AS s))
SELECT exon, p.chrom, position, 'new' || p.chrom AS new_chrom, CASE WHEN new_strand = '-' THEN new_start + "end" - position ELSE new_start + position - start END AS new_position, new_strand FROM p JOIN c ON p.chrom = c.chrom AND position BETWEEN start AND "end" """)  # fmt: skip
def liftover(spark, sf_dir):
    b = F.col("id")
    chain = spark.range(0, 6000, 100).select(F.explode(F.array(F.lit("+"), F.lit("-"))).alias("chrom"), b.alias("start"), (b + 79).alias("end"), (1000 + b * 2).alias("new_start"), F.when(b % 200 == 0, "-").otherwise("+").alias("new_strand")).withColumn("new_chrom", F.concat(F.lit("new"), "chrom"))
    return transcripts.liftover(exons(spark, sf_dir).select("exon", F.col("strand").alias("chrom"), F.col("start").alias("position")), chain, width=128)


MOTIFS = f"""{EXONS}, s AS (SELECT DISTINCT strand, biotype, start AS position FROM exons), m AS (SELECT DISTINCT strand, start AS spot FROM exons WHERE start % 7 = 3)"""


def motif_sites(spark, sf_dir):
    e = exons(spark, sf_dir)
    return e.select("strand", "biotype", F.col("start").alias("position")).distinct(), e.where("start % 7 = 3").select("strand", F.col("start").alias("position"))


@query("motif_snapping", f"""WITH {MOTIFS} SELECT s.strand, s.biotype, s.position, CAST(first(spot - s.position ORDER BY abs(spot - s.position), spot) AS INTEGER) AS snap_offset, first(spot ORDER BY abs(spot - s.position), spot) AS snapped FROM s LEFT JOIN m ON m.strand = s.strand AND abs(spot - s.position) <= 2 GROUP BY 1, 2, 3""")
def motif_snapping(spark, sf_dir):
    sites, motifs = motif_sites(spark, sf_dir)
    return transcripts.snap_to_motif(sites, motifs, ["strand"]).select("strand", "biotype", "position", "snap_offset", "snapped")


@query("motif_offset_scan", f"""WITH {MOTIFS}, o AS (SELECT unnest(range(-4, 5)) AS o), r AS (SELECT biotype, o, avg(CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.strand = s.strand AND spot = s.position + o) THEN 1.0 ELSE 0.0 END) AS rate FROM s, o GROUP BY 1, 2)
SELECT biotype, CAST(first(o ORDER BY rate DESC, abs(o), o) AS INTEGER) AS best_offset, round(max(rate), 8) AS best_rate FROM r GROUP BY biotype""")  # fmt: skip
def motif_offset_scan(spark, sf_dir):
    sites, motifs = motif_sites(spark, sf_dir)
    return transcripts.motif_rate_by_offset(sites, motifs, ["strand"], ["biotype"]).select("biotype", "best_offset", F.round("best_rate", 8).alias("best_rate"))


@query("sequence_windows", """WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0), w AS (SELECT doc_id, n, least(k * 300, greatest(n - 500, 0)) AS window_start FROM d, range(0, 1000) r(k) WHERE k <= greatest(CAST(ceil((n - 500) / 300.0) AS BIGINT), 0))
SELECT DISTINCT doc_id, window_start, least(window_start + 500, n) AS window_end FROM w""")  # fmt: skip
def sequence_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.length("text").alias("n"))
    return transcripts.sliding_windows(d, "n", 500, 300, ["doc_id"])


@query("exon_window_filter", """WITH w AS (SELECT s AS transcript_id, b AS window_start, b + 500 AS window_end FROM (SELECT unnest(range(0, 60000, 300)) AS b), (SELECT c_custkey AS s FROM customer)),
x AS (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS transcript_id, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 10 AS start FROM orders)
SELECT w.transcript_id, window_start, window_end, round(sum(least(window_end, start + 9) - greatest(window_start, start)) / 500, 8) AS exon_share FROM w JOIN x USING (transcript_id) WHERE start < window_end AND start + 9 > window_start GROUP BY 1, 2, 3 HAVING sum(least(window_end, start + 9) - greatest(window_start, start)) / 500 >= 0.01""")  # fmt: skip
def exon_window_filter(spark, sf_dir):
    x = exons(spark, sf_dir).select("transcript_id", (F.col("start") * 10).alias("start")).distinct().withColumn("end", F.col("start") + 9)
    x = x.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("transcript_id")), "transcript_id")
    return transcripts.grid_windows_with_exons(x, ["transcript_id"], 500, 300, 59_700, 0.01).withColumn("exon_share", F.round("exon_share", 8))


@query("exon_bases", f"""WITH {EXONS}, p AS (SELECT transcript_id, biotype, min(start) AS s, least(max("end"), min(start) + 40) AS e, count(*) AS n FROM exons GROUP BY 1, 2 HAVING count(*) >= 2), b AS (SELECT DISTINCT transcript_id, unnest(range(s, e + 1)) AS position FROM p)
SELECT transcript_id, count(*) AS n_bases, min(position) AS first_base FROM b GROUP BY transcript_id""")  # fmt: skip
def exon_bases(spark, sf_dir):
    e = exons(spark, sf_dir).groupBy("transcript_id", "biotype").agg(F.min("start").alias("s"), F.least(F.max("end"), F.min("start") + 40).alias("e"), F.count("*").alias("n")).where("n >= 2")
    sites = e.select("transcript_id", F.lit(1).alias("tx"), F.col("biotype").alias("exon_rank"), F.explode(F.array("s", "e")).alias("position"))
    return transcripts.exon_bases(sites, "transcript_id", "tx").groupBy("transcript_id").agg(F.count("*").alias("n_bases"), F.min("position").alias("first_base"))


@query("prior_fill", f"""WITH {SCORED} SELECT e.event_id, round(coalesce(s.donor, 1.0 / 3), 8) AS donor, round(coalesce(s.acceptor, 1.0 / 3), 8) AS acceptor, round(coalesce(s.neither, 1.0 / 3), 8) AS neither FROM events e LEFT JOIN (SELECT * FROM scored WHERE event_type <> 'view') s USING (event_id)""")
def prior_fill(spark, sf_dir):
    s = scored(spark, sf_dir)
    got = transcripts.with_prior(s.select("event_id"), s.where("event_type <> 'view'"), ["event_id"])
    return got.select("event_id", *(F.round(c, 8).alias(c) for c in ("donor", "acceptor", "neither")))


@query("model_comparison", f"""WITH {JUDGED}, e AS (SELECT quality, 'base' AS model, score AS s FROM judged UNION ALL SELECT quality, 'meta', 0.5 * score + 0.5 * quality FROM judged), n AS (SELECT model, count(*) FILTER (s >= 0.5 AND quality = 1) AS tp, count(*) FILTER (s >= 0.5 AND quality <> 1) AS fp, count(*) FILTER (s < 0.5 AND quality = 1) AS fn FROM e GROUP BY model)
SELECT model, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1 FROM n""")  # fmt: skip
def model_comparison(spark, sf_dir):
    df = judged(spark, sf_dir).withColumn("meta", 0.5 * F.col("score") + 0.5 * F.col("quality"))
    return compare.compare_models(df, "quality", {"base": "score", "meta": "meta"})


@query("outside_reference", f"""WITH {SCORED}, t AS (SELECT DISTINCT user_id, position FROM scored WHERE event_type = 'purchase') SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, position FROM scored WHERE donor >= 0.4) s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = s.user_id AND t.position = s.position) GROUP BY user_id""")
def outside_reference(spark, sf_dir):
    s = scored(spark, sf_dir)
    got = compare.outside(s.where("donor >= 0.4").select("user_id", "position").distinct(), s.where("event_type = 'purchase'"), ["user_id", "position"])
    return got.groupBy("user_id").agg(F.count("*").alias("n"))


def _spearman_sql(pairs):
    ranks = "r AS (SELECT *, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS r1, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS r2, rank() OVER (ORDER BY p_partkey) AS r3 FROM part)"
    return f"WITH {ranks} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({x}, {y}), 7) AS spearman FROM r" for a, b, x, y in pairs)


@query("rank_correlations", _spearman_sql([("p_size", "p_retailprice", "r1", "r2"), ("p_size", "p_partkey_", "r1", "r3"), ("p_retailprice", "p_partkey_", "r2", "r3")]))
def rank_correlations(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("p_partkey_", F.col("p_partkey"))
    return compare.rank_correlations(p, ["p_size", "p_retailprice", "p_partkey_"], "p_partkey").withColumn("spearman", F.round("spearman", 7))


@query("gene_browser_stats", "SELECT c_mktsegment AS status, count(*) AS n FROM customer GROUP BY 1")
def gene_browser_stats(spark, sf_dir):
    return compare.status_summary(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "status"))


@query("random_common_keys", """WITH k AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O') SELECT key FROM k ORDER BY ((key % 1000003 + 42) * 2654435761) % 4294967296 % 2147483648, key LIMIT 50""")
def random_common_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("key", F.col("o_custkey"))
    return compare.random_common(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "key", 50)


@query("aligned_paralogs")
def aligned_paralogs(spark, sf_dir):
    """Documents as sequences of 8 bases a word, by a hash of it and the word before; those of the test split that have a paralog in the train split, both split by source."""
    w = F.split(F.trim("text"), "[ \n]+")
    word = lambda x, before: F.translate(F.lpad(F.conv(F.pmod(F.xxhash64(x, before), F.lit(65536)).cast("string"), 10, 4), 8, "0"), "0123", "ACGT")
    bases = F.array_join(F.zip_with("_w", F.slice(F.concat(F.array(F.lit("")), "_w"), F.lit(1), F.size("_w")), word), "")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", w.alias("_w")).select("doc_id", "source", bases.alias("bases"))
    in_test = F.coalesce(F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(4)) == 1, F.lit(False))
    got = alignment.paralogs(d.where(in_test), d.where(~in_test), "doc_id", "bases")
    return got.select("doc_id", "target", F.round("identity", 6).alias("identity"), F.round("coverage", 6).alias("coverage"))


@query("similar_families")
def similar_families(spark, sf_dir):
    """Pairs of sequences that share a fifth of their 3-letter words or more."""
    return transcripts.similar_sequences(table(spark, sf_dir, "benchmark"), "item_id", "text", 3, 0.8)


def contigs(spark, sf_dir):
    """documents as contigs of A, C, G, T and N, named chr, the id (if there is one) and a hash of the text, as an id may have several. n: the number of bases, told without making them."""
    low = F.lower(F.replace("text", F.lit("\u0130"), F.lit("i")))  # by itself Spark lowers it to two letters, SQL to one
    bases = F.regexp_replace(F.translate(low, "eorisul", "ACGTACG"), "[^ACGT]", "N")
    name = F.concat(F.lit("chr"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("."), F.hex(F.xxhash64("text")))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", name.alias("contig"), bases.alias("bases"), F.length(low).alias("n"))


CONTIGS = "contigs AS (SELECT doc_id, regexp_replace(translate(lower(text), 'eorisul', 'ACGTACG'), '[^ACGT]', 'N', 'g') AS bases, length(text) AS n FROM documents WHERE text IS NOT NULL)"


@query("fetched_spans", f"""WITH {CONTIGS}, s AS (SELECT doc_id, k, bases, CASE k WHEN 0 THEN -9 WHEN 1 THEN n // 3 WHEN 2 THEN n - 30 ELSE n + 5 END AS start, CASE k WHEN 0 THEN 40 WHEN 1 THEN n // 3 + 800 WHEN 2 THEN n + 100 ELSE n + 9 END AS stop FROM contigs, range(4) r(k)),
f AS (SELECT doc_id, k, CASE WHEN stop < 1 OR stop < start THEN '' ELSE substr(bases, greatest(start, 1), stop - greatest(start, 1) + 1) END AS q FROM s)
SELECT doc_id, CAST(k AS INTEGER) AS k, length(q) AS n_bases, CASE WHEN (doc_id + k) % 2 = 0 THEN reverse(translate(q, 'ACGTN', 'TGCAN')) ELSE q END AS bases FROM f""")  # fmt: skip
def fetched_spans(spark, sf_dir):
    """Spans off both ends, over several blocks and beyond the end, from blocks of 256 bases; names with and without chr."""
    c = contigs(spark, sf_dir)
    n = F.col("n")
    ends = [(F.lit(-9), F.lit(40)), (F.floor(n / 3), F.floor(n / 3) + 800), (n - 30, n + 100), (n + 5, n + 9)]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), a.cast("bigint").alias("start"), b.cast("bigint").alias("end")) for k, (a, b) in enumerate(ends))))
    spans = c.select("doc_id", "contig", each.alias("s")).select("doc_id", "contig", "s.*")
    spans = spans.select("doc_id", "k", "start", "end", F.when(F.col("k") % 2 == 0, F.col("contig")).otherwise(F.substring("contig", 4, 1 << 30)).alias("chrom"), F.when((F.col("doc_id") + F.col("k")) % 2 == 0, "-").otherwise("+").alias("strand"))
    got = sequences.fetch(spans, sequences.blocks(c, "contig", "bases", 256), strand="strand", size=256)
    return got.select("doc_id", "k", F.length("sequence").cast("bigint").alias("n_bases"), F.col("sequence").alias("bases"))


def labelled(exons: str, checked: str) -> str:
    """SQL of genes with labels: of the exons and introns that two conditions let through."""
    return f"""WITH {CONTIGS}, g AS (SELECT doc_id, 31 AS gene_start, n - 20 AS stop, CASE WHEN doc_id % 2 = 0 THEN '-' ELSE '+' END AS strand, substr(bases, 31, n - 50) AS q FROM contigs WHERE n >= 60),
o AS (SELECT *, CASE WHEN strand = '-' THEN reverse(translate(q, 'ACGTN', 'TGCAN')) ELSE q END AS s FROM g),
x AS (SELECT doc_id, t, 31 + (t + 1) * 60 * i AS start, 31 + (t + 1) * 60 * i + (doc_id + i) % 40 AS stop FROM (SELECT doc_id, stop AS gene_stop, t, unnest(range(0, stop // ((t + 1) * 60) + 1)) AS i FROM g, (VALUES (0), (1)) v(t)) WHERE start <= gene_stop - 40),
p AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY max(stop) - min(start) DESC, min(start), t) AS k FROM x GROUP BY doc_id, t),
n AS (SELECT doc_id, t, stop, lead(start) OVER (PARTITION BY doc_id, t ORDER BY start) AS nxt, min(start) OVER (PARTITION BY doc_id, t) AS first, row_number() OVER (PARTITION BY doc_id, t ORDER BY start) AS nth FROM x JOIN p USING (doc_id, t) WHERE {exons}),
d AS (SELECT n.*, s, CASE WHEN strand = '-' THEN length(s) - (nxt - gene_start) - 1 ELSE n.stop - gene_start END AS donor, CASE WHEN strand = '-' THEN length(s) - (n.stop - gene_start) - 1 ELSE nxt - gene_start END AS acceptor FROM n JOIN o USING (doc_id) WHERE nxt IS NOT NULL),
i AS (SELECT * FROM d WHERE {checked}),
l AS (SELECT doc_id, offset_, label, row_number() OVER (PARTITION BY doc_id, offset_ ORDER BY first DESC, t DESC, nth DESC, label) AS k FROM (SELECT doc_id, first, t, nth, donor AS offset_, 2 AS label FROM i UNION ALL SELECT doc_id, first, t, nth, acceptor, 1 FROM i)),
c AS (SELECT o.doc_id, s, string_agg(CAST(coalesce(label, 0) AS VARCHAR), '' ORDER BY b) AS labels, CAST(coalesce(sum(CASE label WHEN 2 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_donors, CAST(coalesce(sum(CASE label WHEN 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_acceptors
  FROM (SELECT doc_id, s, unnest(range(length(s))) AS b FROM o) o LEFT JOIN l ON l.doc_id = o.doc_id AND l.offset_ = b AND l.k = 1 GROUP BY o.doc_id, s)
SELECT doc_id, length(s) AS n_bases, md5(s) AS bases_md5, md5(labels) AS labels_md5, n_donors, n_acceptors FROM c"""  # fmt: skip


def genes_and_exons(spark, sf_dir):
    """A gene a contig, with two transcripts of exons every 60 and 120 bases."""
    c = contigs(spark, sf_dir).where("n >= 60")
    genes = c.select("doc_id", F.col("contig").alias("chrom"), F.lit(31).cast("bigint").alias("start"), (F.col("n") - 20).cast("bigint").alias("end"), F.when(F.col("doc_id") % 2 == 0, "-").otherwise("+").alias("strand"))
    step = (F.col("transcript_id") + 1) * 60
    each = genes.select("doc_id", F.col("end").alias("_stop"), F.explode(F.array(F.lit(0), F.lit(1))).alias("transcript_id"))
    each = each.select("doc_id", "_stop", "transcript_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_stop") / step))).alias("_i"))
    exon = each.select("doc_id", "transcript_id", "_stop", (31 + step * F.col("_i")).alias("start"), (31 + step * F.col("_i") + (F.col("doc_id") + F.col("_i")) % 40).alias("end"))
    return genes, exon.where(F.col("start") <= F.col("_stop") - 40).drop("_stop"), sequences.blocks(c, "contig", "bases", 1024)


def label_digests(df):
    count = lambda of: F.length(F.regexp_replace("labels", f"[^{of}]", "")).cast("bigint")
    return df.select("doc_id", F.length("sequence").cast("bigint").alias("n_bases"), F.md5("sequence").alias("bases_md5"), F.md5("labels").alias("labels_md5"), count(2).alias("n_donors"), count(1).alias("n_acceptors"))


@query("gene_base_labels", labelled("k = 1", "true"))
def gene_base_labels(spark, sf_dir):
    """The canonical transcript's sites, motifs unchecked."""
    return label_digests(sequences.genes_with_labels(*genes_and_exons(spark, sf_dir), checked=False, gene="doc_id", size=1024))


@query("gene_base_labels_checked", labelled("true", "acceptor >= 2 AND (substr(s, donor + 2, 2), substr(s, acceptor - 1, 2)) IN (('GT', 'AG'), ('GC', 'AG'), ('AT', 'AC'))"))
def gene_base_labels_checked(spark, sf_dir):
    """All transcripts' sites whose introns begin and end with known motifs."""
    return label_digests(sequences.genes_with_labels(*genes_and_exons(spark, sf_dir), canonical=False, gene="doc_id", size=1024))
