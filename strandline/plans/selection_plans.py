"""Filters, picks and small aggregates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coords, scores, text
from ..operators import labels, selection, variants, verify
from .registry import query
from .tables import EXONS, JUDGED, SCORED, exons, judged, scored, table


@query("gene_filter", "SELECT p_partkey, p_brand, p_type FROM part WHERE upper(p_brand) IN ('BRAND#2', 'BRAND#17') OR upper(p_type) = 'ECONOMY'")
def gene_filter(spark, sf_dir):
    return selection.genes(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), ["brand#2", "Brand#17", "economy"], ["p_brand", "p_type"])


@query("value_filter", "SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') AND p_size IN (1, 5, 11, 28)")
def value_filter(spark, sf_dir):
    return selection.values(table(spark, sf_dir, "part"), p_type=["ECONOMY", "STANDARD"], p_size=[1, 5, 11, 28], p_brand=None).select("p_partkey")


@query("peak_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 20 AND l_discount >= 0.05 AND l_linenumber BETWEEN 2 AND 4 AND l_returnflag IN ('A', 'R')")
def peak_filter(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("signal_value"), F.col("l_discount").alias("neg_log10_pvalue"), F.lit(0).alias("start"), F.col("l_linenumber").alias("end"), F.col("l_returnflag").alias("rbp"))
    return selection.peaks(p, 20, 0.05, (2, 4), ["A", "R"]).select("l_orderkey", "l_linenumber")


@query("deep_and_broad", "SELECT * FROM (SELECT l_partkey, sum(l_quantity) AS depth, count(DISTINCT l_returnflag) AS breadth FROM lineitem GROUP BY 1) WHERE depth >= 100 AND breadth >= 3")
def deep_and_broad(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("depth"), F.countDistinct("l_returnflag").alias("breadth"))
    return selection.deep_and_broad(per, "depth", "breadth", 100, 3)


@query("regex_filter", "SELECT p_partkey FROM part WHERE NOT regexp_matches(p_name, '^(red|small) .*g')")
def regex_filter(spark, sf_dir):
    return selection.matching(table(spark, sf_dir, "part"), "p_name", "^(red|small) .*g", drop=True).select("p_partkey")


@query("finite_features", "SELECT event_id, CASE WHEN user_id % 7 = 0 OR value IS NULL OR user_id % 5 = 0 THEN 0.0 ELSE value END AS value, CAST(user_id AS DOUBLE) AS user_id FROM events")
def finite_features(spark, sf_dir):
    """Numeric columns without those that tell the label or name the row; null, NaN and infinite as 0."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 7 == 0, float("inf")).when(F.col("user_id") % 5 == 0, float("nan")).otherwise(F.col("value")).alias("value"), "user_id", F.lit(1).alias("label_code"), F.lit(2).alias("position"), "event_type")
    columns = [c for c in selection.feature_columns(e) if c != "event_id"]
    return selection.finite(e, columns).select("event_id", *columns)


VARIANTS = """variants AS (SELECT p_partkey AS variant, 'chr' || (p_partkey % 5) AS chrom, p_partkey AS position, CASE p_partkey % 4 WHEN 3 THEN 'AC' ELSE 'A' END AS ref_allele, CASE p_partkey % 4 WHEN 1 THEN 'ATT' ELSE 'G' END AS alt_allele,
  CASE p_size % 3 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Benign' ELSE 'VUS' END AS clinical_significance, CASE p_size % 4 WHEN 0 THEN 'practice guideline' WHEN 1 THEN 'Reviewed by expert panel' WHEN 2 THEN 'criteria provided, single submitter' END AS review_status, p_name AS consequence FROM part)"""


def variant_rows(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        k.alias("variant"), F.concat(F.lit("chr"), (k % 5).cast("string")).alias("chrom"), k.alias("position"), F.when(k % 4 == 3, "AC").otherwise("A").alias("ref_allele"), F.when(k % 4 == 1, "ATT").otherwise("G").alias("alt_allele"),
        F.when(s % 3 == 0, "Pathogenic").when(s % 3 == 1, "Benign").otherwise("VUS").alias("clinical_significance"), F.when(s % 4 == 0, "practice guideline").when(s % 4 == 1, "Reviewed by expert panel").when(s % 4 == 2, "criteria provided, single submitter").alias("review_status"), F.col("p_name").alias("consequence"),
    )


@query("variant_filters", f"WITH {VARIANTS} SELECT variant FROM variants WHERE clinical_significance IN ('Pathogenic', 'Benign') AND review_status IN ('practice guideline', 'Reviewed by expert panel') AND length(ref_allele) = 1 AND length(alt_allele) = 1 AND regexp_matches(consequence, 'ring|widget')")
def variant_filters(spark, sf_dir):
    return selection.variants(variant_rows(spark, sf_dir), ["Pathogenic", "Benign"], 3, True, "ring|widget").select("variant")


@query("variant_statistics", f"WITH {VARIANTS} SELECT clinical_significance, count(*) AS n, count(DISTINCT chrom) AS n_chroms, count(*) FILTER (length(ref_allele) = 1 AND length(alt_allele) = 1) AS n_snv, round(avg(length(alt_allele) - length(ref_allele)), 8) AS mean_change FROM variants GROUP BY 1")
def variant_statistics(spark, sf_dir):
    return selection.variant_statistics(variant_rows(spark, sf_dir), "clinical_significance").withColumn("mean_change", F.round("mean_change", 8))


@query("with_sequence", "SELECT doc_id FROM documents WHERE length(trim(text, ' ')) > 0")
def with_sequence(spark, sf_dir):
    return selection.with_sequence(table(spark, sf_dir, "documents"), "text").select("doc_id")


@query("transcript_filter", f"""WITH {EXONS}, c AS (SELECT transcript_id FROM exons GROUP BY 1 HAVING count(*) >= 8), s AS (SELECT strand, start FROM exons GROUP BY 1, 2 HAVING count(DISTINCT transcript_id) >= 2), m AS (
SELECT 'all' AS mode, exon FROM exons UNION ALL SELECT 'canonical', exon FROM exons WHERE transcript_id IN (SELECT transcript_id FROM c)
UNION ALL SELECT 'shared', exon FROM exons JOIN s USING (strand, start) UNION ALL SELECT 'custom', exon FROM exons WHERE transcript_id IN (7, 8)) SELECT mode, count(*) AS n, sum(exon) AS exons FROM m GROUP BY mode""")  # fmt: skip
def transcript_filter(spark, sf_dir):
    """E5, J11."""
    e = exons(spark, sf_dir)
    canonical = e.groupBy("transcript_id").agg(F.count("*").alias("n")).where("n >= 8")
    shared = e.groupBy("strand", "start").agg(F.countDistinct("transcript_id").alias("n")).where("n >= 2")
    some = lambda mode: selection.of_transcripts(e, mode, canonical, shared, [7, 8], position=("strand", "start")).select(F.lit(mode).alias("mode"), "exon")
    return some("all").unionByName(some("canonical")).unionByName(some("shared")).unionByName(some("custom")).groupBy("mode").agg(F.count("*").alias("n"), F.sum("exon").alias("exons"))


@query("exon_counts", "SELECT c_custkey, count(o_orderkey) AS n_exons FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def exon_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return selection.with_counts(table(spark, sf_dir, "customer").select("c_custkey"), rows, "c_custkey", "n_exons")


@query("strand_recovery", f"""WITH {EXONS}, k AS (SELECT start, min(strand) AS strand FROM exons GROUP BY start HAVING count(DISTINCT strand) = 1) SELECT o.exon, k.strand FROM exons o JOIN k ON o."end" = k.start""")
def strand_recovery(spark, sf_dir):
    e = exons(spark, sf_dir)
    return selection.recover_strand(e.select("exon", "strand", F.col("end").alias("start")), e.select("start", "strand"), ["start"]).select("exon", "strand")


@query("aligned_vectors", "SELECT d.doc_id, min(v.vec_id) AS vec_id, count(v.vec_id) > 0 AS has_vec_id FROM documents d LEFT JOIN embeddings v ON d.doc_id % 50 = v.label AND d.doc_id % 3 = v.vec_id % 3 GROUP BY d.doc_id")
def aligned_vectors(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50).cast("int").alias("label"), (F.col("doc_id") % 3).alias("k"))
    return selection.align_exact(d, table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 3).alias("k"), "vec_id"), ["label", "k"], "vec_id").select("doc_id", "vec_id", "has_vec_id")


@query("names_at_position", f"""WITH {EXONS}, e AS (SELECT DISTINCT strand, start, transcript_id FROM exons), k AS (SELECT *, row_number() OVER (PARTITION BY strand, start ORDER BY transcript_id) AS k FROM e)
SELECT strand, start, count(*) AS n_names, string_agg(CAST(transcript_id AS VARCHAR), ',' ORDER BY transcript_id) FILTER (k <= 10) AS names FROM k GROUP BY 1, 2 HAVING count(*) > 1""")  # fmt: skip
def names_at_position(spark, sf_dir):
    return selection.names_at(exons(spark, sf_dir).select("strand", "start", "transcript_id"), ["strand", "start"], "transcript_id")


@query("strongest_effect", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 20) DESC, value DESC) AS k FROM events)
SELECT user_id, max(value - 20) FILTER (k = 1) AS effect, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources, count(*) AS n_rows FROM r GROUP BY user_id""")  # fmt: skip
def strongest_effect(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("value") - 20).alias("effect"), "event_type")
    return selection.strongest(e, ["user_id"], "effect", "event_type")


@query("most_frequent_site", "WITH t AS (SELECT l_partkey, max(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT l.l_partkey, t.q AS l_quantity, min(l_suppkey) AS l_suppkey FROM lineitem l JOIN t ON l.l_partkey = t.l_partkey AND l.l_quantity = t.q GROUP BY 1, 2")
def most_frequent_site(spark, sf_dir):
    return selection.most_frequent(table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_suppkey"), ["l_partkey"], "l_quantity", "l_suppkey")


@query("subsample", "SELECT event_id FROM events WHERE ((event_id * 7919 + 42) % 10007) / 10007.0::DOUBLE < 0.25")
def subsample(spark, sf_dir):
    """O9."""
    return selection.subsample(table(spark, sf_dir, "events").select("event_id"), "event_id", 0.25)


@query("events_by_magnitude", "SELECT event_id, value - 20 AS delta FROM events ORDER BY abs(value - 20) DESC, event_id LIMIT 25")
def events_by_magnitude(spark, sf_dir):
    return selection.by_magnitude(table(spark, sf_dir, "events").select("event_id", (F.col("value") - 20).alias("delta")), "delta", 25, "event_id")


@query("gene_chromosomes", "SELECT o_custkey, first(o_orderstatus ORDER BY o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def gene_chromosomes(spark, sf_dir):
    return selection.gene_chromosomes(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderkey")


@query("flattened", "SELECT p_partkey, unnest([p_size, p_size + 1, p_size * 2]) AS item FROM part")
def flattened(spark, sf_dir):
    nested = F.array(F.array(F.col("p_size"), F.col("p_size") + 1), F.lit(None).cast("array<int>"), F.array(F.col("p_size") * 2))
    return selection.flatten(table(spark, sf_dir, "part").select("p_partkey", nested.alias("nested")), "nested", "item")


@query("calibration_change", f"""WITH {JUDGED}, b AS (SELECT CAST(quality AS DOUBLE) AS y, 'before' AS scores, score AS p FROM judged UNION ALL SELECT quality, 'after', 0.5 * score + 0.4 FROM judged),
g AS (SELECT scores, least(floor(p * 10), 9) AS k, count(*) AS n, abs(avg(p) - avg(y)) AS gap, sum((p - y) * (p - y)) AS sq FROM b GROUP BY 1, 2)
SELECT scores, round(sum(gap * n) / sum(n), 7) AS ece, round(max(gap), 7) AS mce, round(sum(sq) / sum(n), 7) AS brier FROM g GROUP BY scores""")  # fmt: skip
def calibration_change(spark, sf_dir):
    df = judged(spark, sf_dir).withColumn("after", 0.5 * F.col("score") + 0.4)
    return selection.calibration_change(df, "quality", "score", "after").select("scores", *(F.round(c, 7).alias(c) for c in ("ece", "mce", "brier")))


@query("top_l_statistics", f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY donor DESC, event_id) AS k, count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id) AS l FROM scored)
SELECT user_id, ratio, round(count(*) FILTER (event_type = 'view') / max(l), 8) AS found, round(min(donor), 8) AS threshold FROM r, (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS ratio) WHERE l > 0 AND k <= floor(ratio * l) GROUP BY 1, 2""")  # fmt: skip
def top_l_statistics(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("label", F.col("event_type") == "view")
    return selection.top_l(s, ["user_id"], "donor", "label", (0.5, 1.0, 2.0), "event_id").select("user_id", "ratio", F.round("found", 8).alias("found"), F.round("threshold", 8).alias("threshold"))


@query("gene_problems", """WITH g AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'g' || (c_custkey // 2 * (c_custkey % 2) + c_custkey * (1 - c_custkey % 2)) END AS gene_id, CASE WHEN c_nationkey % 5 = 0 THEN '.' ELSE '+' END AS strand, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey END AS start, c_custkey + c_custkey % 3 - 1 AS "end" FROM customer),
n AS (SELECT *, count(*) OVER (PARTITION BY gene_id) AS n FROM g) SELECT gene_id, problem FROM (
SELECT gene_id, 'no_id' AS problem FROM n WHERE gene_id = '' UNION ALL SELECT gene_id, 'strand' FROM n WHERE strand NOT IN ('+', '-') UNION ALL SELECT gene_id, 'no_coordinate' FROM n WHERE start IS NULL UNION ALL SELECT gene_id, 'end_before_start' FROM n WHERE "end" < start UNION ALL SELECT gene_id, 'repeated' FROM n WHERE n > 1)""")  # fmt: skip
def gene_problems(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.floor(k / 2) * (k % 2) + k * (1 - k % 2)
    g = table(spark, sf_dir, "customer").select(F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("g"), name.cast("bigint").cast("string"))).alias("gene_id"), F.when(F.col("c_nationkey") % 5 == 0, ".").otherwise("+").alias("strand"), F.when(k % 13 != 0, k).alias("start"), (k + k % 3 - 1).alias("end"))
    return selection.gene_problems(g)


@query("directory_report", "SELECT 'part' AS path, '' AS missing, true AS passes UNION ALL SELECT 'supplier', 'p_partkey,p_size', false")
def directory_report(spark, sf_dir):
    """V7: the columns of two tables against what a report needs."""
    found = spark.createDataFrame([(t, table(spark, sf_dir, t).columns) for t in ("part", "supplier")], "path string, columns array<string>")
    return selection.directory_report(found, ["p_partkey", "p_size"]).withColumn("missing", F.array_join("missing", ","))


@query("artifact_report", """SELECT * FROM (SELECT 'part' AS artifact, count(*) AS n_rows, 0 AS n_null_keys, count(*) - count(DISTINCT p_partkey) AS n_repeated, '' AS missing, count(*) > 0 AND count(*) = count(DISTINCT p_partkey) AS passes FROM part)
UNION ALL SELECT 'supplier', count(*), NULL, NULL, 'p_partkey,p_size', false FROM supplier UNION ALL SELECT 'brands', count(*), 0, 0, 'p_partkey', false FROM (SELECT DISTINCT p_size FROM part)""")  # fmt: skip
def artifact_report(spark, sf_dir):
    """V7: rows, keys and columns of three artifacts."""
    part = table(spark, sf_dir, "part")
    tables = {"part": part, "supplier": table(spark, sf_dir, "supplier")}
    got = selection.artifact_report(tables, ["p_partkey", "p_size"], ["p_partkey"])
    return got.unionByName(selection.artifact_report({"brands": part.select("p_size").distinct()}, ["p_partkey"], ["p_size"]))


@query("subsample_rows", "SELECT event_id FROM events ORDER BY (event_id % 1000003 + 42) * 2654435761 % 4294967296 % 2147483648, event_id LIMIT (SELECT count(*) // 3 FROM events)")
def subsample_rows(spark, sf_dir):
    """A number of rows."""
    e = table(spark, sf_dir, "events").select("event_id")
    return selection.subsample_rows(e, "event_id", e.count() // 3)


@query("channel_deltas", f"""WITH {SCORED}, r AS (SELECT user_id, position, max(donor) AS donor, max(acceptor) AS acceptor FROM scored WHERE event_id % 2 = 0 GROUP BY 1, 2), a AS (SELECT user_id, position, max(donor) AS donor, max(acceptor) AS acceptor FROM scored GROUP BY 1, 2)
SELECT user_id, position, round(a.donor - r.donor, 8) AS delta_donor, round(a.acceptor - r.acceptor, 8) AS delta_acceptor FROM a JOIN r USING (user_id, position)""")  # fmt: skip
def channel_deltas(spark, sf_dir):
    """The largest scores of all events of a position less those of its even ones."""
    s = scored(spark, sf_dir)
    best = lambda df: df.groupBy("user_id", "position").agg(F.max("donor").alias("donor"), F.max("acceptor").alias("acceptor"))
    got = scores.deltas(best(s), best(s.where("event_id % 2 = 0")), ["user_id", "position"], ["donor", "acceptor"])
    return got.select("user_id", "position", *(F.round(c, 8).alias(c) for c in ("delta_donor", "delta_acceptor")))


@query("knockdown_boundary", """SELECT l_orderkey, l_linenumber, CASE WHEN kind = 'A5SS' THEN CASE WHEN forward THEN l_partkey ELSE l_suppkey END ELSE CASE WHEN forward THEN l_suppkey ELSE l_partkey END END AS boundary
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'A5SS' ELSE 'A3SS' END AS kind, (l_linestatus = 'O') = (l_discount - 0.05 > 0) AS forward FROM lineitem)""")  # fmt: skip
def knockdown_boundary(spark, sf_dir):
    """R12."""
    kind, strand = F.when(F.col("l_returnflag") == "A", "A5SS").otherwise("A3SS"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-")
    at = variants.kd_gained_boundary(kind, strand, F.col("l_discount") - 0.05, F.col("l_partkey"), F.col("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", at.alias("boundary"))


@query("rows_preserved", "SELECT (SELECT count(*) FROM orders) AS n_before, (SELECT count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey) AS n_after, true AS preserved")
def rows_preserved(spark, sf_dir):
    """V6."""
    o = table(spark, sf_dir, "orders")
    return verify.same_rows(o, o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left"))


@query("record_deltas", """WITH r AS (SELECT p_partkey AS variant, 'chr' || (p_partkey % 5) AS chrom, p_partkey AS position, 1 + CAST(p_partkey % 4 = 3 AS INTEGER) AS nr, 1 + 2 * CAST(p_partkey % 4 = 1 AS INTEGER) AS na FROM part),
s AS (SELECT variant, chrom, position, nr, na, a, o, ((variant * 31 + o * 17 + CASE a WHEN 'alt' THEN 5 ELSE 0 END + 1000) % 97) / 97.0::DOUBLE AS donor, ((variant * 13 + o * 29 + CASE a WHEN 'alt' THEN 7 ELSE 0 END + 1000) % 89) / 89.0::DOUBLE AS acceptor
  FROM r, (SELECT unnest(['ref', 'alt']) AS a), (SELECT unnest(range(-6, 7)) AS o)),
p AS (SELECT *, CASE WHEN a = 'ref' OR o <= 0 THEN o WHEN na > nr THEN greatest(0, o - (na - nr)) ELSE o - (na - nr) END AS off FROM s),
d AS (SELECT variant, chrom, off, position + off AS pos, coalesce(max(donor) FILTER (a = 'alt'), 0) - coalesce(max(donor) FILTER (a = 'ref'), 0) AS dd, coalesce(max(acceptor) FILTER (a = 'alt'), 0) - coalesce(max(acceptor) FILTER (a = 'ref'), 0) AS da FROM p WHERE abs(off) <= 6 GROUP BY variant, chrom, off, position),
m AS (SELECT variant, off, CASE WHEN (pos % 3 = 0) = (dd > 0) AND dd <> 0 THEN 0 ELSE dd END AS dd, CASE WHEN da < 0 THEN 0 ELSE da END AS da FROM d)
SELECT variant, round(max(greatest(da, 0)), 8) AS acceptor_gain, first(off ORDER BY greatest(da, 0) DESC, off) AS acceptor_gain_at, round(max(greatest(-da, 0)), 8) AS acceptor_loss, first(off ORDER BY greatest(-da, 0) DESC, off) AS acceptor_loss_at,
round(max(greatest(dd, 0)), 8) AS donor_gain, first(off ORDER BY greatest(dd, 0) DESC, off) AS donor_gain_at, round(max(greatest(-dd, 0)), 8) AS donor_loss, first(off ORDER BY greatest(-dd, 0) DESC, off) AS donor_loss_at FROM m GROUP BY variant""")  # fmt: skip
def record_deltas(spark, sf_dir):
    """Every third position is an annotated donor, none an acceptor."""
    v = variant_rows(spark, sf_dir)
    k, o = F.col("variant"), F.col("offset")
    s = v.select("variant", F.explode(F.array(F.lit("ref"), F.lit("alt"))).alias("allele")).withColumn("offset", F.explode(F.sequence(F.lit(-6), F.lit(6))))
    extra = lambda n: F.when(F.col("allele") == "alt", n).otherwise(0)
    s = s.select("variant", "allele", "offset", (((k * 31 + o * 17 + extra(5) + 1000) % 97) / 97.0).alias("donor"), (((k * 13 + o * 29 + extra(7) + 1000) % 89) / 89.0).alias("acceptor"))
    reach = v.select("chrom", F.explode(F.sequence(F.col("position") - 6, F.col("position") + 6)).alias("position")).where("position % 3 = 0").distinct().withColumn("splice_type", F.lit("donor"))
    got = selection.record_deltas(v, s, 6, reach)
    sizes = ("acceptor_gain", "acceptor_loss", "donor_gain", "donor_loss")
    return got.select("variant", *(F.round(c, 8).alias(c) for c in sizes), *(f"{c}_at" for c in sizes))


@query("moved_families", "SELECT p_partkey FROM part WHERE p_partkey % 5 = 0 AND p_brand IN (SELECT p_brand FROM part WHERE p_partkey % 5 = 1)")
def moved_families(spark, sf_dir):
    """L7."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return labels.shared_families(p.where("p_partkey % 5 = 0"), p.where("p_partkey % 5 = 1"), "p_brand").select("p_partkey")


BASES = "regexp_replace(translate(text, 'eorisEORIS', 'ACGTAACGTA'), '[^ACGT]', 'N', 'g')"


def bases():
    """A text as bases: a few letters stand for them, all else is N."""
    return F.regexp_replace(F.translate("text", "eorisEORIS", "ACGTAACGTA"), "[^ACGT]", "N").alias("s")


@query("encoded_bases", f"""WITH s AS (SELECT item_id, {BASES} AS s FROM benchmark), b AS (SELECT item_id, unnest(string_split(s, '')) AS x FROM s)
SELECT item_id, count(*) AS n, count(*) FILTER (x = 'A') AS n_a, count(*) FILTER (x = 'T') AS n_t, CAST(sum(CASE x WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END) AS BIGINT) AS code_sum FROM b GROUP BY item_id""")  # fmt: skip
def encoded_bases(spark, sf_dir):
    """T11, T12."""
    df = table(spark, sf_dir, "benchmark").select("item_id", bases())
    count = lambda channel: F.aggregate(text.one_hot(F.col("s")), F.lit(0).cast("bigint"), lambda acc, x: acc + x[channel])
    codes = text.base_codes(F.col("s"))
    return df.select("item_id", F.size(codes).cast("bigint").alias("n"), count(0).alias("n_a"), count(3).alias("n_t"), F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("code_sum"))


@query("site_texts", """SELECT p_partkey, p_partkey % 2 = 0 AS canonical, CASE WHEN p_partkey % 2 = 0 THEN 'GT' ELSE 'AC' END AS on_plus, 'chr' || (p_partkey % 5) AS chrom, p_partkey AS start, p_partkey + p_size AS "end",
CASE p_size % 3 WHEN 0 THEN 'exon_skipping' WHEN 1 THEN 'site_gain' ELSE 'other' END AS effect, CASE p_size % 3 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely_benign' ELSE 'VUS' END AS significance,
CASE WHEN p_size >= 30 THEN 'moderate' WHEN p_size >= 10 THEN 'weak' ELSE 'none' END AS category, greatest(p_size, p_retailprice) AS largest, p_size + p_retailprice AS total FROM part""")  # fmt: skip
def site_texts(spark, sf_dir):
    """T10, T18, T19, T21, T26, M1, M18."""
    k, s = F.col("p_partkey"), F.col("p_size")
    locus = text.locus_parts(F.concat(F.lit("chr"), (k % 5).cast("string"), F.lit(":"), k.cast("string"), F.lit("-"), (k + s).cast("string")))
    kind = lambda a, b, c: F.when(s % 3 == 0, a).when(s % 3 == 1, b).otherwise(c)
    strand = F.when(k % 2 == 0, "+").otherwise("-")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.canonical_motif(F.lit("donor"), F.when(k % 2 == 0, "GT").otherwise("GC")).alias("canonical"), text.allele_on_plus(F.lit("GT"), strand).alias("on_plus"), *(locus[c].alias(c) for c in ("chrom", "start", "end")),
        text.effect(kind("Exon skip seen", "Gain of a site", "unclear")).alias("effect"), text.significance(kind("Pathogenic|x", "Likely_benign,y", "Uncertain_significance")).alias("significance"),
        scores.signal_category(s, 10, 30).alias("category"), scores.row_max("p_size", "p_retailprice").alias("largest"), scores.row_sum("p_size", "p_retailprice").alias("total"),
    )


@query("listed_events", "SELECT p_partkey, unnest(['CD', 'ES']) AS kind, unnest([CAST(-p_size AS VARCHAR), '1-2']) AS \"offset\", unnest([p_size, 12.5]::DOUBLE[]) AS freq_pct FROM part")
def listed_events(spark, sf_dir):
    """T17."""
    s = F.col("p_size").cast("string")
    df = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Top1:CD;-"), s, F.lit(";"), s, F.lit("%|Top2:ES;1-2;12.5%")).alias("list"))
    return text.top_events(df, "list").select("p_partkey", "kind", "offset", "freq_pct")


@query("motif_counts", f"WITH s AS (SELECT item_id, {BASES} AS s FROM benchmark) SELECT CASE WHEN item_id % 2 = 0 THEN 'donor' ELSE 'acceptor' END AS kind, substr(s, 1 + item_id % 7, 2) AS motif, count(*) AS n FROM s GROUP BY 1, 2")
def motif_counts(spark, sf_dir):
    """T29."""
    df = table(spark, sf_dir, "benchmark").select(bases(), (1 + F.col("item_id") % 7).alias("position"), F.when(F.col("item_id") % 2 == 0, "donor").otherwise("acceptor").alias("kind"))
    return text.motif_counts(df, "s", "position", "kind")


@query("context_blocks", f"""WITH s AS (SELECT item_id, {BASES} AS s, length(text) AS n FROM benchmark WHERE length(text) > 0)
SELECT item_id, k AS block, substr(repeat('N', 20) || s || repeat('N', 120), 1 + k * 100, 140) AS block_sequence FROM s, range(0, 1000) r(k) WHERE k < ceil(n / 100.0)""")  # fmt: skip
def context_blocks(spark, sf_dir):
    """X10."""
    return text.blocks(table(spark, sf_dir, "benchmark").select("item_id", bases()), "s", 100, 20).select("item_id", "block", "block_sequence")


@query("position_kind", """SELECT 'relative' AS kind, round(avg(CAST(p_size BETWEEN p_partkey + 60 AND p_partkey + 160 AS INTEGER)), 8) AS absolute_share, round(avg(CAST(p_size BETWEEN 1 AND 101 AS INTEGER)), 8) AS relative_share FROM part""")
def position_kind(spark, sf_dir):
    """M13."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("position"), (F.col("p_partkey") + 60).alias("gene_start"), (F.col("p_partkey") + 160).alias("gene_end"))
    return coords.position_kind(p).select("kind", F.round("absolute_share", 8).alias("absolute_share"), F.round("relative_share", 8).alias("relative_share"))
