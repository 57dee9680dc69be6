"""Relational queries: junction indexes, intervals, joins, sets, aggregates (A*, J*, U*, W11, O*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, intervals, junctions, labels, relations, verify, windows
from .registry import query
from .tables import EXONS, JUNCTIONS, SCORED, exons, scored, table
from .tables import junctions as junction_rows


def r(df, *names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


@query("junction_melt", f"WITH {JUNCTIONS} SELECT side, position, partner, count(*) AS n, CAST(sum(reads) AS BIGINT) AS reads FROM ends GROUP BY side, position, partner")
def junction_melt(spark, sf_dir):
    return junctions.melt(junction_rows(spark, sf_dir)).groupBy("side", "position", "partner").agg(F.count("*").alias("n"), F.sum("reads").alias("reads"))


@query("junction_index_single", f"""WITH {JUNCTIONS} SELECT side, position, CAST(sum(reads) AS DOUBLE) AS total_reads, CAST(max(reads) AS DOUBLE) AS max_reads, count(DISTINCT partner) AS n_partners, round(ln(1 + sum(reads)), 6) AS log1p_reads,
CASE WHEN count(*) <= 1 THEN 0.0 ELSE round(log2(sum(reads)) - sum(reads * log2(reads)) / sum(reads), 5) END AS entropy, CASE WHEN count(*) > 1 THEN round(max(reads) / sum(reads), 6) END AS psi
FROM ends GROUP BY side, position""")  # fmt: skip
def junction_index_single(spark, sf_dir):
    ends = junctions.melt(junction_rows(spark, sf_dir))
    df = junctions.single_index(ends, ["side", "position"])
    return df.select("side", "position", "total_reads", "max_reads", "n_partners", *r(df, "log1p_reads", "psi"), F.round("entropy", 5).alias("entropy"))


@query("junction_index_tissue", f"""WITH {JUNCTIONS}, t AS (SELECT side, position, tissue, CAST(sum(reads) AS DOUBLE) AS t_reads, count(DISTINCT partner) AS t_partners, CASE WHEN count(*) > 1 THEN max(reads) / sum(reads) END AS t_psi FROM ends GROUP BY 1, 2, 3)
SELECT side, position, sum(t_reads) AS total_reads, max(t_reads) AS tissue_max, round(avg(t_reads), 6) AS tissue_mean, round(coalesce(var_samp(t_reads), 0), 4) AS tissue_variance, CAST(sum(CASE WHEN t_reads >= 30 THEN 1 ELSE 0 END) AS BIGINT) AS tissue_breadth,
max(t_partners) AS n_partners, round(avg(t_psi), 6) AS psi, CASE WHEN count(t_psi) > 1 THEN round(var_pop(t_psi), 6) END AS psi_variance FROM t GROUP BY side, position""")  # fmt: skip
def junction_index_tissue(spark, sf_dir):
    ends = junctions.melt(junction_rows(spark, sf_dir))
    df = junctions.tissue_index(ends, ["side", "position"], least_reads=30)
    return df.select("side", "position", "total_reads", "tissue_max", "tissue_breadth", "n_partners", *r(df, "tissue_mean", "psi", "psi_variance"), F.round("tissue_variance", 4).alias("tissue_variance"))


@query("tissue_summary", f"""WITH {JUNCTIONS}, j AS (SELECT donor_pos, tissue || status AS tissue, reads FROM junctions), t AS (SELECT donor_pos, tissue, CAST(sum(reads) AS DOUBLE) AS r, count(*) AS s FROM j GROUP BY 1, 2)
SELECT donor_pos, max(r) AS max_reads, sum(r) AS sum_reads, count(*) AS n_tissues, max(struct_pack(r := r, t := tissue)).t AS max_tissue, round(avg(s), 6) AS mean_samples_per_tissue, round(count(*) / (SELECT count(DISTINCT tissue) FROM j), 6) AS tissue_breadth FROM t GROUP BY donor_pos""")  # fmt: skip
def tissue_summary(spark, sf_dir):
    j = junction_rows(spark, sf_dir).select("donor_pos", F.concat("tissue", "status").alias("tissue"), "reads", F.lit(1).alias("one"))
    df = junctions.tissue_summary(j, ["donor_pos"], reads="reads", samples="one")
    return df.select("donor_pos", "max_reads", "sum_reads", "n_tissues", "max_tissue", *r(df, "mean_samples_per_tissue", "tissue_breadth"))


@query("tissue_matrix", """WITH s AS (SELECT DISTINCT l_suppkey, 'T' || (l_suppkey % 4) AS tissue FROM lineitem) SELECT l_partkey, tissue, sum(l_quantity - 1) AS total_reads, CAST(sum(CASE WHEN l_quantity > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_samples
FROM lineitem JOIN s USING (l_suppkey) GROUP BY 1, 2 HAVING sum(l_quantity - 1) > 0""")  # fmt: skip
def tissue_matrix(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("sample"), (F.col("l_quantity") - 1).alias("reads"))
    tissues = counts.select("sample").distinct().withColumn("tissue", F.concat(F.lit("T"), (F.col("sample") % 4).cast("string")))
    return junctions.tissue_matrix(counts, tissues, "l_partkey")


@query("junction_feature_join", f"""WITH {JUNCTIONS}, i AS (SELECT side, position, count(DISTINCT partner) AS n_partners, CASE WHEN count(*) > 1 THEN round(max(reads) / sum(reads), 6) END AS psi FROM ends WHERE reads > 45 GROUP BY side, position),
p AS (SELECT p_partkey AS position, unnest(['donor', 'acceptor']) AS side FROM part)
SELECT p.side, p.position, coalesce(n_partners, 0) AS n_partners, psi FROM p LEFT JOIN i ON p.position = i.position AND p.side = i.side""")  # fmt: skip
def junction_feature_join(spark, sf_dir):
    index = junctions.single_index(junctions.melt(junction_rows(spark, sf_dir)).where("reads > 45"), ["side", "position"]).select("side", "position", "n_partners", F.round("psi", 6).alias("psi"))
    sites = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("position"), F.explode(F.array(F.lit("donor"), F.lit("acceptor"))).alias("side"))
    return junctions.join_features(sites, index, ["side", "position"], ["n_partners"]).select("side", "position", "n_partners", "psi")


DAYS = "CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS BIGINT)"


@query("interval_overlap_features", f"""WITH p AS (SELECT l_returnflag AS chrom, l_suppkey AS rbp, l_linestatus AS cell_line, {DAYS} AS start, {DAYS} + l_linenumber AS "end", l_quantity AS signal_value, l_discount AS p FROM lineitem),
q AS (SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS chrom, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS position FROM orders)
SELECT chrom, position, count(DISTINCT rbp) AS n_bound, max(signal_value) AS max_signal, round(avg(signal_value), 6) AS mean_signal, max(p) AS max_neg_log10_pvalue, max(CAST(rbp IN (1, 2) AS INTEGER)) AS has_splice_regulator,
count(DISTINCT CASE WHEN rbp IN (3, 4, 5) THEN rbp END) AS n_sr_proteins, count(DISTINCT cell_line) AS cell_line_breadth FROM q JOIN p USING (chrom) WHERE position >= start AND position < "end" GROUP BY chrom, position""")  # fmt: skip
def interval_overlap_features(spark, sf_dir):
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1990-01-01").cast("date")).cast("bigint")
    peaks = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("chrom"), F.col("l_suppkey").alias("rbp"), F.col("l_linestatus").alias("cell_line"), day("l_shipdate").alias("start"), (day("l_shipdate") + F.col("l_linenumber")).alias("end"), F.col("l_quantity").alias("signal_value"), F.col("l_discount").alias("neg_log10_pvalue"))
    k = F.col("o_orderkey") % 3
    points = table(spark, sf_dir, "orders").select(F.when(k == 0, "A").when(k == 1, "N").otherwise("R").alias("chrom"), day("o_orderdate").alias("position")).distinct()
    df = relations.peak_features_at(points, peaks, ["chrom"], regulators=[1, 2], sr=[3, 4, 5], width=16, closed=False)
    return df.select("chrom", "position", "n_bound", "max_signal", F.round("mean_signal", 6).alias("mean_signal"), "max_neg_log10_pvalue", "has_splice_regulator", "n_sr_proteins", "cell_line_breadth")


@query("proximity_mask", f"""WITH {SCORED}, m AS (SELECT event_id, max(CASE WHEN donor > 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY position RANGE BETWEEN 2000 PRECEDING AND 2000 FOLLOWING) = 1 AS is_near,
least(position - last_value(CASE WHEN donor > 0.6 THEN position END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value(CASE WHEN donor > 0.6 THEN position END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - position) AS nearest_distance FROM scored)
SELECT * FROM m""")  # fmt: skip
def proximity_mask(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("flag", F.col("donor") > 0.6)
    df = intervals.near_flagged(df, "flag", "position", ["user_id"], 2000)
    return windows.nearest_flagged(df, "flag", "position", ["user_id"], ["ts", "event_id"]).select("event_id", "is_near", "nearest_distance")


@query("overlapping_spans", f"""WITH {EXONS}, s AS (SELECT transcript_id, strand, min(start) AS start, min(start) + 20 AS "end" FROM exons GROUP BY 1, 2),
p AS (SELECT a.strand, a.transcript_id, b.transcript_id AS other, row_number() OVER (PARTITION BY a.transcript_id ORDER BY b.start, b.transcript_id) AS k FROM s a JOIN s b ON a.strand = b.strand AND a.start <= b."end" AND b.start <= a."end" AND a.transcript_id <> b.transcript_id)
SELECT s.transcript_id, coalesce(count(other), 0) AS n_overlaps, coalesce(string_agg(CAST(other AS VARCHAR), ',' ORDER BY k) FILTER (k <= 10), '') AS overlaps FROM s LEFT JOIN p USING (transcript_id) GROUP BY s.transcript_id""")  # fmt: skip
def overlapping_spans(spark, sf_dir):
    s = exons(spark, sf_dir).groupBy("transcript_id", "strand").agg(F.min("start").alias("start"), (F.min("start") + 20).alias("end"))
    return intervals.overlap_summary(s, ["strand"], "transcript_id").select("transcript_id", "n_overlaps", "overlaps")


@query("overlapping_whole_spans", f"""WITH {EXONS}, s AS (SELECT transcript_id, strand, min(start) AS start, max("end") AS "end" FROM exons GROUP BY 1, 2),
p AS (SELECT a.transcript_id, b.transcript_id AS other, row_number() OVER (PARTITION BY a.transcript_id ORDER BY b.start, b.transcript_id) AS k FROM s a JOIN s b ON a.strand = b.strand AND a.start <= b."end" AND b.start <= a."end" AND a.transcript_id <> b.transcript_id)
SELECT s.transcript_id, coalesce(count(other), 0) AS n_overlaps, coalesce(string_agg(CAST(other AS VARCHAR), ',' ORDER BY k) FILTER (k <= 10), '') AS overlaps FROM s LEFT JOIN p USING (transcript_id) GROUP BY s.transcript_id""")  # fmt: skip
def overlapping_whole_spans(spark, sf_dir):
    """J8 on whole spans, nearly all of which overlap: counts by ranks, no pairs."""
    s = exons(spark, sf_dir).groupBy("transcript_id", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return intervals.overlap_summary(s, ["strand"], "transcript_id").select("transcript_id", "n_overlaps", "overlaps")


@query("merged_intervals", f"""WITH {EXONS}, a AS (SELECT biotype, strand, start, "end", max("end") OVER (PARTITION BY biotype, strand ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM exons),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR start > b THEN 1 ELSE 0 END) OVER (PARTITION BY biotype, strand ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT biotype, strand, min(start) AS start, max("end") AS "end", count(*) AS n_merged FROM i GROUP BY biotype, strand, k""")  # fmt: skip
def merged_intervals(spark, sf_dir):
    return windows.merge_intervals(exons(spark, sf_dir).select("biotype", "strand", "start", "end"), "start", "end", ["biotype", "strand"])


@query("novel_sites_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def novel_sites_anti(spark, sf_dir):
    return relations.novel(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("confirmed_sites_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def confirmed_sites_semi(spark, sf_dir):
    return relations.confirmed(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("merged_sources_full", """WITH a AS (SELECT l_partkey AS k, sum(l_quantity) AS qa FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1 GROUP BY 1), b AS (SELECT l_partkey AS k, sum(l_quantity) AS qb FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, qa, qb, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'gtex' ELSE 'vault' END AS sources FROM a FULL JOIN b ON a.k = b.k""")  # fmt: skip
def merged_sources_full(spark, sf_dir):
    side = lambda flag, n, q: table(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == flag) & (F.col("l_linenumber") == n)).groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias(q))
    return relations.merge_sources(side("A", 1, "qa"), side("R", 2, "qb"), ["k"], ("gtex", "vault"))


@query("membership_flag", "SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS is_member FROM part")
def membership_flag(spark, sf_dir):
    return relations.membership(table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"], "is_member")


@query("coverage_summary", """WITH s AS (SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS r FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT p_brand, count(*) AS n_sites, round(avg(CASE WHEN r IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS covered_share, median(CAST(r AS DOUBLE)) AS median_support FROM part LEFT JOIN s ON p_partkey = l_partkey GROUP BY p_brand""")  # fmt: skip
def coverage_summary(spark, sf_dir):
    support = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("bigint").alias("reads"))
    df = relations.coverage(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), support, ["p_partkey"], ["p_brand"])
    return df.select("p_brand", "n_sites", F.round("covered_share", 6).alias("covered_share"), "median_support")


@query("biotype_filtered_coverage", "SELECT p_brand, bool_or(p_type NOT LIKE '%BRASS%' AND p_type NOT LIKE '%STEEL%') AS any_kept, count(*) AS n FROM part GROUP BY p_brand")
def biotype_filtered_coverage(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.bool_or(~F.col("p_type").contains("BRASS") & ~F.col("p_type").contains("STEEL")).alias("any_kept"), F.count("*").alias("n"))


@query("source_union_dedup", """WITH u AS (SELECT user_id, event_type, value FROM events WHERE value > 50 UNION SELECT user_id, event_type, value FROM events WHERE event_type <> 'view')
SELECT user_id, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS sources, max(value) AS support, count(*) AS n FROM u GROUP BY user_id""")  # fmt: skip
def source_union_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    u = e.where("value > 50").union(e.where("event_type <> 'view'")).distinct()
    return u.groupBy("user_id").agg(relations.joined_set("event_type").alias("sources"), F.max("value").alias("support"), F.count("*").alias("n"))


@query("canonical_pick_sites", f"""WITH {EXONS}, n AS (SELECT strand, transcript_id % 50 AS gene_id, transcript_id, count(DISTINCT start) AS n_sites FROM exons GROUP BY 1, 2, 3)
SELECT gene_id, n_sites, min(transcript_id) AS transcript_id FROM n JOIN (SELECT gene_id, max(n_sites) AS n_sites FROM n GROUP BY gene_id) USING (gene_id, n_sites) GROUP BY gene_id, n_sites""")  # fmt: skip
def canonical_pick_sites(spark, sf_dir):
    return relations.canonical_by_sites(exons(spark, sf_dir).withColumn("gene_id", F.col("transcript_id") % 50), position="start").select("gene_id", "n_sites", "transcript_id")


@query("canonical_pick_length", f"""WITH {EXONS}, n AS (SELECT transcript_id % 50 AS gene_id, transcript_id, sum("end" - start) AS l, max(CAST(biotype = 'P' AS INTEGER)) AS p FROM exons GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY p DESC, l DESC, transcript_id) AS k FROM n) SELECT gene_id, CAST(l AS BIGINT) AS exon_length, transcript_id FROM k WHERE k = 1""")  # fmt: skip
def canonical_pick_length(spark, sf_dir):
    return relations.canonical_by_length(exons(spark, sf_dir).withColumn("gene_id", F.col("transcript_id") % 50), preferred=F.col("biotype") == "P").select("gene_id", "exon_length", "transcript_id")


@query("canonical_pick_span", f"""WITH {EXONS}, n AS (SELECT transcript_id % 50 AS gene_id, transcript_id, max("end") - min(start) AS span FROM exons GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY span DESC, transcript_id) AS k FROM n)
SELECT gene_id, span, transcript_id FROM k WHERE k = 1""")  # fmt: skip
def canonical_pick_span(spark, sf_dir):
    return relations.canonical_by_span(exons(spark, sf_dir).withColumn("gene_id", F.col("transcript_id") % 50)).select("gene_id", "span", "transcript_id")


@query("shared_positions", "SELECT l_partkey, l_linenumber, count(DISTINCT l_suppkey) AS n_transcripts FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) >= 2")
def shared_positions(spark, sf_dir):
    return relations.shared_positions(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_linenumber"], "l_suppkey")


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return relations.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("gene_bounds", f"""WITH {EXONS} SELECT transcript_id, min(start) AS start, max("end") AS "end", min(strand) AS strand FROM exons GROUP BY transcript_id""")
def gene_bounds(spark, sf_dir):
    return relations.gene_bounds(exons(spark, sf_dir), "transcript_id", attributes=["strand"])


@query("class_weights", "SELECT event_type, count(*) AS n, round((SELECT count(*) FROM events) / (6 * count(*)), 6) AS weight FROM events GROUP BY event_type UNION ALL SELECT 'absent', 0, 1.0")
def class_weights(spark, sf_dir):
    got = relations.class_weights(table(spark, sf_dir, "events"), "event_type", ["click", "error", "purchase", "signup", "view", "absent"])
    return got.select("event_type", "n", F.round("weight", 6).alias("weight"))


@query("norm_stats", "SELECT 'p_retailprice' AS \"column\", round(avg(p_retailprice), 5) AS mean, round(stddev_samp(p_retailprice), 5) AS std FROM part UNION ALL SELECT 'p_size', round(avg(p_size), 5), round(stddev_samp(p_size), 5) FROM part")
def norm_stats(spark, sf_dir):
    return relations.norm_stats(table(spark, sf_dir, "part"), ["p_retailprice", "p_size"]).select("column", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query("cross_source_summary", """WITH t AS (SELECT l_partkey, l_returnflag, avg(l_extendedprice) / 1000 AS value FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, round(max(value), 9) AS max_value, round(avg(value), 9) AS mean_value, round(var_pop(value), 6) AS variance, CAST(sum(CASE WHEN value > 40 THEN 1 ELSE 0 END) AS BIGINT) AS breadth, CAST(max(value) > 60 AS INTEGER) AS has_peak FROM t GROUP BY l_partkey""")  # fmt: skip
def cross_source_summary(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg((F.avg("l_extendedprice") / 1000).alias("value"))
    df = relations.cross_source_summary(t, ["l_partkey"], breadth=40, peak=60)
    return df.select("l_partkey", F.round("max_value", 9).alias("max_value"), F.round("mean_value", 9).alias("mean_value"), F.round("variance", 6).alias("variance"), "breadth", "has_peak")


@query("ensemble_mean", "WITH m AS (SELECT l_partkey, l_suppkey, avg(l_tax) AS s FROM lineitem GROUP BY 1, 2) SELECT l_partkey, round(avg(s), 8) AS score FROM m GROUP BY 1")
def ensemble_mean(spark, sf_dir):
    first = relations.ensemble(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_linenumber", ["l_tax"])
    return relations.ensemble(first, ["l_partkey"], "l_suppkey", ["l_tax"]).select("l_partkey", F.round("l_tax", 8).alias("score"))


@query("column_profile", "SELECT * FROM (" + " UNION ALL ".join([*(f"SELECT '{c}' AS column_name, 'number' AS kind, 1 - count({c}) / count(*) AS null_share, min(CAST({c} AS DOUBLE)) AS min_value, max(CAST({c} AS DOUBLE)) AS max_value, CAST(NULL AS BIGINT) AS n_distinct FROM customer" for c in ("c_custkey", "c_nationkey", "c_acctbal")), *(f"SELECT '{c}', 'other', 1 - count({c}) / count(*), NULL, NULL, count(DISTINCT {c}) FROM customer" for c in ("c_name", "c_mktsegment"))]) + ")")
def column_profile(spark, sf_dir):
    return verify.column_profile(table(spark, sf_dir, "customer"))


@query("gene_page", """WITH f AS (SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%11%'), p AS (SELECT *, count(*) OVER () AS total FROM f ORDER BY c_custkey LIMIT 10 OFFSET 10) SELECT c_custkey, c_name, total, CAST(ceil(total / 10) AS BIGINT) AS pages FROM p""")
def gene_page(spark, sf_dir):
    """A page of a search, with the total."""
    page, total = compare.browse(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "11", ["c_name"], 2, 10, "c_custkey")
    return page.join(F.broadcast(total))  # one row is broadcast


@query("common_column_append", "SELECT o_custkey AS key, o_totalprice AS amount FROM orders UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def common_column_append(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("amount"), "o_orderstatus")
    b = table(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_acctbal").alias("amount"), F.col("c_custkey").alias("key"))
    return relations.common_columns(a, b)


@query("stab_query", f"""WITH {EXONS}, g AS (SELECT transcript_id, strand, min(start) AS start, max("end") AS "end" FROM exons GROUP BY 1, 2), q AS (SELECT DISTINCT strand, start AS position FROM exons)
SELECT strand, position, count(*) AS n_genes, min(transcript_id) AS first_gene FROM q JOIN g USING (strand) WHERE position BETWEEN g.start AND g."end" GROUP BY 1, 2""")  # fmt: skip
def stab_query(spark, sf_dir):
    e = exons(spark, sf_dir)
    g = e.groupBy("transcript_id", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    q = e.select("strand", F.col("start").alias("position")).distinct()
    return intervals.points_in_intervals(q, g, ["strand"], width=365).groupBy("strand", "position").agg(F.count("*").alias("n_genes"), F.min("transcript_id").alias("first_gene"))


@query("class_balance", """WITH n AS (SELECT min(c) AS m FROM (SELECT event_type, count(*) AS c FROM events GROUP BY 1)), h AS (SELECT event_id, event_type, ((event_id % 1000003 + 42) * 2654435761) % 4294967296 % 2147483648 AS h FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) AS k FROM h) SELECT event_id, event_type FROM k, n WHERE k <= m""")  # fmt: skip
def class_balance(spark, sf_dir):
    return labels.balance(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id")
