"""Feature queries: base scores, context, positions, tracks, labels (W1-W7, M1-M19, X4, T*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, coords, scores, text
from ..operators import moments, relations, windows
from ..streaming.metrics import shared_folder
from .registry import query
from .tables import EXONS, SCORED, exons, scored, table

CONTEXT = """
ctx AS (SELECT *, lag(donor, 1, 0.0) OVER w AS donor_m1, lag(donor, 2, 0.0) OVER w AS donor_m2, lead(donor, 1, 0.0) OVER w AS donor_p1, lead(donor, 2, 0.0) OVER w AS donor_p2
  FROM scored WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def rounded(df, *names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


def context(spark, sf_dir):
    return windows.context_scores(scored(spark, sf_dir), "donor", 2, ["user_id"], ["ts", "event_id"])


@query("base_context_scores", f"WITH {SCORED}, {CONTEXT} SELECT event_id, round(donor_m1, 6) AS donor_m1, round(donor_m2, 6) AS donor_m2, round(donor_p1, 6) AS donor_p1, round(donor_p2, 6) AS donor_p2 FROM ctx")
def base_context_scores(spark, sf_dir):
    df = context(spark, sf_dir)
    return df.select("event_id", *rounded(df, "donor_m1", "donor_m2", "donor_p1", "donor_p2"))


@query("base_probability_features", f"""WITH {SCORED} SELECT event_id, round(donor / (donor + acceptor + 1e-10), 6) AS relative_donor_probability, round((donor + acceptor) / (donor + acceptor + neither + 1e-10), 6) AS splice_probability,
round((donor - acceptor) / (greatest(donor, acceptor) + 1e-10), 6) AS donor_acceptor_diff, round((greatest(donor, acceptor) - neither) / (greatest(donor, acceptor, neither) + 1e-10), 6) AS splice_neither_diff,
round(ln(donor + 1e-10) - ln(acceptor + 1e-10), 6) AS donor_acceptor_logodds, round(ln(donor + acceptor + 1e-10) - ln(neither + 1e-10), 6) AS splice_neither_logodds,
round(-(donor * ln(donor + 1e-10) + acceptor * ln(acceptor + 1e-10) + neither * ln(neither + 1e-10)), 6) AS probability_entropy FROM scored""")  # fmt: skip
def base_probability_features(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", *(F.round(v, 6).alias(k) for k, v in scores.probability_features().items()))


@query("base_gradient_features", f"""WITH {SCORED}, {CONTEXT} SELECT event_id, round((donor_m1 + donor_m2 + donor_p1 + donor_p2) / 4, 6) AS donor_context_mean,
round(((donor_p1 + donor_p2) - (donor_m1 + donor_m2)) / (donor_p1 + donor_p2 + donor_m1 + donor_m2 + 1e-10), 6) AS donor_context_asymmetry, round(greatest(donor_m1, donor_m2, donor_p1, donor_p2), 6) AS donor_context_max,
round(donor - donor_m1, 6) AS donor_diff_m1, round(donor - donor_p2, 6) AS donor_diff_p2, round(donor / (donor_m1 + donor_p1 + 1e-10), 4) AS donor_surge_ratio,
CAST(donor > donor_m1 AND donor > donor_p1 AND donor > 0.001 AS INTEGER) AS donor_is_local_peak, round(0.1 * donor_m2 + 0.2 * donor_m1 + 0.4 * donor + 0.2 * donor_p1 + 0.1 * donor_p2, 6) AS donor_weighted_context,
round(donor_m1 - 2 * donor + donor_p1, 6) AS donor_second_derivative, round(donor - (donor_m1 + donor_m2 + donor_p1 + donor_p2) / 4, 6) AS donor_signal_strength FROM ctx""")  # fmt: skip
def base_gradient_features(spark, sf_dir):
    df = context(spark, sf_dir)
    out = scores.context_pattern("donor") | scores.gradient_features("donor")
    keep = ["donor_context_mean", "donor_context_asymmetry", "donor_context_max", "donor_diff_m1", "donor_diff_p2", "donor_weighted_context", "donor_second_derivative", "donor_signal_strength"]
    return df.select("event_id", *(F.round(out[k], 6).alias(k) for k in keep), F.round(out["donor_surge_ratio"], 4).alias("donor_surge_ratio"), out["donor_is_local_peak"].alias("donor_is_local_peak"))


@query("base_comparative_features", f"""WITH {SCORED}, c AS (SELECT *, lag(donor, 1, 0.0) OVER w AS dm, lead(donor, 1, 0.0) OVER w AS dp, lag(acceptor, 1, 0.0) OVER w AS am, lead(acceptor, 1, 0.0) OVER w AS ap FROM scored WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(donor / (dm + dp + 1e-10) - acceptor / (am + ap + 1e-10), 3) AS surge_difference, round((dm - 2 * donor + dp) - (am - 2 * acceptor + ap), 6) AS curvature_difference FROM c""")  # fmt: skip
def base_comparative_features(spark, sf_dir):
    df = scored(spark, sf_dir)
    for c in ("donor", "acceptor"):
        df = windows.context_scores(df, c, 2, ["user_id"], ["ts", "event_id"])
    df = df.select("*", *(v.alias(k) for c in ("donor", "acceptor") for k, v in scores.gradient_features(c).items()))
    out = scores.comparative_features()
    return df.select("event_id", F.round(out["surge_difference"], 3).alias("surge_difference"), F.round(out["curvature_difference"], 6).alias("curvature_difference"))


@query("softmax_blend", f"""WITH {SCORED}, e AS (SELECT event_id, donor, exp((ln(donor + 1e-10) - ln(neither)) / 1.5) AS x, exp((ln(acceptor + 1e-10) - ln(neither)) / 1.5) AS y FROM scored)
SELECT event_id, round(x / (x + y + 1), 6) AS donor_softmax, round(0.7 * donor + 0.3 * x / (x + y + 1), 6) AS donor_blend FROM e""")  # fmt: skip
def softmax_blend(spark, sf_dir):
    df = scored(spark, sf_dir).select("event_id", "donor", *(F.log(F.col(c) + (1e-10 if c != "neither" else 0.0)).alias(f"l_{c}") for c in ("donor", "acceptor", "neither")))
    df = df.withColumn("donor_softmax", scores.softmax(["l_donor", "l_acceptor", "l_neither"], 1.5)["l_donor"])
    return df.select("event_id", F.round("donor_softmax", 6).alias("donor_softmax"), F.round(scores.residual_blend("donor", "donor_softmax", 0.3), 6).alias("donor_blend"))


@query("relative_position", f"""WITH {SCORED}, s AS (SELECT *, min(position) OVER (PARTITION BY user_id) AS gene_start, max(position) OVER (PARTITION BY user_id) AS gene_end, CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM scored)
SELECT event_id, CASE WHEN strand = '-' THEN gene_end - position + 1 ELSE position - gene_start + 1 END AS relative, position AS absolute,
round(CASE WHEN strand = '-' THEN 1 - (position - gene_start) / greatest(CAST(gene_end - gene_start AS DOUBLE), 1.0) ELSE (position - gene_start) / greatest(CAST(gene_end - gene_start AS DOUBLE), 1.0) END, 6) AS relative_gene_position,
position - gene_start AS distance_to_gene_start, gene_end - position AS distance_to_gene_end FROM s""")  # fmt: skip
def relative_position(spark, sf_dir):
    df = scored(spark, sf_dir)
    span = df.groupBy("user_id").agg(F.min("position").alias("gene_start"), F.max("position").alias("gene_end"))
    df = df.join(span, "user_id").withColumn("strand", F.when(F.col("user_id") % 2 == 0, "+").otherwise("-")).withColumn("relative", coords.to_relative("position", "gene_start", "gene_end", "strand"))
    out = coords.gene_position()
    return df.select("event_id", "relative", coords.to_absolute("relative", "gene_start", "gene_end", "strand").alias("absolute"), F.round(out["relative_gene_position"], 6).alias("relative_gene_position"), *(out[k].alias(k) for k in ("distance_to_gene_start", "distance_to_gene_end")))


@query("exon_pairing", f"""WITH {EXONS}, k AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY start, "end", exon) AS k, count(*) OVER (PARTITION BY transcript_id) AS n FROM exons)
SELECT exon, transcript_id, 'donor' AS splice_type, CASE WHEN strand = '-' THEN start ELSE "end" END AS position FROM k WHERE n > 1 AND (CASE WHEN strand = '-' THEN k <> 1 ELSE k <> n END)
UNION ALL SELECT exon, transcript_id, 'acceptor', CASE WHEN strand = '-' THEN "end" ELSE start END FROM k WHERE n > 1 AND (CASE WHEN strand = '-' THEN k <> n ELSE k <> 1 END)""")  # fmt: skip
def exon_pairing(spark, sf_dir):
    return windows.splice_sites(exons(spark, sf_dir), order=["start", "end", "exon"]).select("exon", "transcript_id", "splice_type", "position")


@query("consecutive_exons", f"""WITH {EXONS} SELECT * FROM (SELECT exon, transcript_id, lead(start) OVER (PARTITION BY transcript_id ORDER BY start, exon) AS next_start FROM exons) WHERE next_start IS NOT NULL""")
def consecutive_exons(spark, sf_dir):
    return windows.next_exon(exons(spark, sf_dir), tiebreak=["exon"]).select("exon", "transcript_id", "next_start")


@query("exon_renumbering", f"""WITH {EXONS}, u AS (SELECT DISTINCT transcript_id, strand, start FROM exons) SELECT transcript_id, start, row_number() OVER (PARTITION BY transcript_id ORDER BY CASE WHEN strand = '-' THEN -start ELSE start END) AS exon_number FROM u""")
def exon_renumbering(spark, sf_dir):
    return windows.exon_numbers(exons(spark, sf_dir).select("transcript_id", "strand", "start").distinct()).select("transcript_id", "start", "exon_number")


@query("chunk_assignment", "SELECT c_custkey, c_nationkey, CAST(floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) / 10) AS BIGINT) AS chunk FROM customer")
def chunk_assignment(spark, sf_dir):
    return windows.chunk_numbers(table(spark, sf_dir, "customer"), 10, ["c_nationkey"], ["c_custkey"]).select("c_custkey", "c_nationkey", "chunk")


@query("array_roll_edges", f"WITH {SCORED} SELECT event_id, round(lag(donor, 3, 0.25) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS donor_rolled FROM scored")
def array_roll_edges(spark, sf_dir):
    return windows.roll(scored(spark, sf_dir), "donor", 3, ["user_id"], ["ts", "event_id"], 0.25).select("event_id", F.round("donor_rolled", 6).alias("donor_rolled"))


TRACK = f"{SCORED}, track AS (SELECT event_type, position // 60 AS hour, avg(value) AS v FROM scored GROUP BY 1, 2)"


def track(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("event_type", F.floor(F.col("position") / 60).alias("hour")).agg(F.avg("value").alias("v"))


@query("track_window_stats", f"""WITH {TRACK} SELECT event_type, hour, round(avg(v) OVER w, 9) AS v_context_mean, round(max(v) OVER w, 9) AS v_context_max, round(stddev_pop(v) OVER w, 5) AS v_context_std, round(v - avg(v) OVER w, 9) AS v_contrast
FROM track WINDOW w AS (PARTITION BY event_type ORDER BY hour RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING)""")  # fmt: skip
def track_window_stats(spark, sf_dir):
    df = windows.track_context(track(spark, sf_dir), "v", 10, ["event_type"], "hour")
    return df.select("event_type", "hour", F.round("v_context_mean", 9).alias("v_context_mean"), F.round("v_context_max", 9).alias("v_context_max"), F.round("v_context_std", 5).alias("v_context_std"), F.round(scores.contrast("v", "v_context_mean"), 9).alias("v_contrast"))


@query("track_directional_ratio", f"""WITH {TRACK}, r AS (SELECT event_type, hour, coalesce(avg(v) OVER (PARTITION BY event_type ORDER BY hour RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING), 0.0) AS a,
coalesce(avg(v) OVER (PARTITION BY event_type ORDER BY hour RANGE BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0.0) AS b FROM track)
SELECT event_type, hour, round(CASE WHEN hour % 2 = 1 THEN log2(b + 1) - log2(a + 1) ELSE log2(a + 1) - log2(b + 1) END, 6) AS v_ratio FROM r""")  # fmt: skip
def track_directional_ratio(spark, sf_dir):
    df = track(spark, sf_dir).withColumn("strand", F.when(F.col("hour") % 2 == 1, "-").otherwise("+"))
    return windows.directional_ratio(df, "v", 5, ["event_type"], "hour").select("event_type", "hour", F.round("v_ratio", 6).alias("v_ratio"))


@query("embedding_norm_cosine", """WITH c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
x AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i))
SELECT vec_id, round(sqrt(sum(v * v)), 5) AS norm, round(sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))), 5) AS centroid_cosine FROM x JOIN c USING (label, i) GROUP BY vec_id""")  # fmt: skip
def embedding_norm_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where(arrays.valid_vector(F.col("embedding")))
    got = e.join(arrays.centroid(e, "label", "embedding"), "label")
    return got.select("vec_id", F.round(arrays.norm(F.col("embedding")), 5).alias("norm"), F.round(arrays.cosine(F.col("embedding"), F.col("centroid")), 5).alias("centroid_cosine"))


@query("embedding_gradient", """WITH x AS (SELECT vec_id, label, embedding AS e, lag(embedding) OVER w AS a, lead(embedding) OVER w AS b FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT vec_id, round(CASE WHEN any_value(a) IS NOT NULL AND any_value(b) IS NOT NULL THEN sqrt(sum((CAST(e[i] AS DOUBLE) - (CAST(a[i] AS DOUBLE) + CAST(b[i] AS DOUBLE)) / 2) ** 2)) END, 5) AS local_gradient FROM x, range(1, 65) r(i) GROUP BY vec_id""")  # fmt: skip
def embedding_gradient(spark, sf_dir):
    return windows.gradient_norm(table(spark, sf_dir, "embeddings"), "embedding", ["label"], ["vec_id"]).select("vec_id", F.round("local_gradient", 5).alias("local_gradient"))


@query("pca_projection")
def pca_projection(spark, sf_dir):
    """Fitted with ml's PCA on all vectors, applied by expressions; signs are fixed by the largest loading."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf_dir, "embeddings").where(arrays.valid_vector(F.col("embedding")))
    d = e.select(F.size("embedding").alias("d")).first()
    if d is None:
        return spark.createDataFrame([], "vec_id bigint, pca_1 double, pca_2 double")
    model = PCA(k=2, inputCol="x", outputCol="y").fit(e.select(array_to_vector(arrays.as_double(F.col("embedding"))).alias("x")))
    mean = [r["m"] for r in e.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()]  # one row a component
    axes = model.pc.toArray().T
    axes = [(a if abs(a).argmax() is not None and a[abs(a).argmax()] > 0 else -a).tolist() for a in axes]
    return e.select("vec_id", *(F.round(arrays.project(F.col("embedding"), mean, a), 6).alias(f"pca_{i}") for i, a in enumerate(axes, 1)))


@query("vector_moments", """WITH e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE embedding IS NOT NULL),
m AS (SELECT i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY i), c AS (SELECT vec_id, e.i, CAST(x AS DOUBLE) - m AS x, m FROM e JOIN m ON e.i = m.i)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, count(*) AS n, round(any_value(a.m), 7) AS mean_i, round(any_value(b.m), 7) AS mean_j, round(avg(a.x * b.x), 7) AS covariance FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i""")  # fmt: skip
def vector_moments(spark, sf_dir):
    """The moments of four batches, added up."""
    e = moments.usable(table(spark, sf_dir, "embeddings"), "embedding")
    first = moments.batch_moments(e)
    shift = (first.select("shift").first() or [[]])[0]
    part = F.pmod(F.xxhash64("x"), F.lit(4))
    several = [moments.batch_moments(e.where(part == k), shift) for k in range(4)]
    df = moments.explained(moments.merged(reduce(DataFrame.unionByName, several)))
    return df.select("i", "j", "n", *(F.round(c, 7).alias(c) for c in ("mean_i", "mean_j", "covariance")))


@query("incremental_pca")
def incremental_pca(spark, sf_dir):
    """Loadings of two components, fitted batch by batch into a folder."""
    e, folder = table(spark, sf_dir, "embeddings"), shared_folder(spark, "moments")
    for k in range(3):
        moments.partial_fit(e.where(F.pmod(F.xxhash64("vec_id"), F.lit(3)) == k), folder, str(k))
    mean, axes, variances = moments.components(moments.merged(moments.held_moments(spark, folder)), 2)
    rows = [(c, i, x, variances[c]) for c, axis in enumerate(axes) for i, x in enumerate(axis)]
    return spark.createDataFrame(rows, "component int, i int, loading double, variance double").select("component", "i", F.round("loading", 6).alias("loading"), F.round("variance", 6).alias("variance"))


@query("sequence_stats", """SELECT doc_id, length(s) AS n, round(CASE WHEN length(s) > 0 THEN length(regexp_replace(s, '[^GC]', '', 'g')) / length(s) ELSE 0 END, 6) AS gc_content,
round(CASE WHEN length(s) > 1 THEN (length(s) - length(replace(s, 'CG', ''))) / 2 / (length(s) - 1) ELSE 0 END, 6) AS cpg_density, reverse(translate(s, 'ACGTN', 'TGCAN')) AS rc, substr(s, 5, 2) AS dinucleotide
FROM (SELECT doc_id, regexp_replace(translate(lower(text), 'eorisul', 'ACGTACG'), '[^ACGT]', 'N', 'g') AS s FROM documents WHERE text IS NOT NULL)""")  # fmt: skip
def sequence_stats(spark, sf_dir):
    s = F.regexp_replace(F.translate(F.lower("text"), "eorisul", "ACGTACG"), "[^ACGT]", "N")
    df = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", s.alias("s"))
    return df.select("doc_id", F.length("s").alias("n"), F.round(text.share_of(F.col("s"), "GC"), 6).alias("gc_content"), F.round(text.cpg_density(F.col("s")), 6).alias("cpg_density"), text.reverse_complement(F.col("s")).alias("rc"), F.substring("s", 5, 2).alias("dinucleotide"))


@query("attribute_parse", """SELECT event_id, json_extract_string(props, '$.k') AS k, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k_number, event_type AS gene_name FROM events""")
def attribute_parse(spark, sf_dir):
    """The event's properties written as a GTF attribute string and as JSON, and parsed."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    e = e.withColumn("attributes", F.concat(F.lit('gene_id "E'), F.col("event_id").cast("string"), F.lit('"; gene "'), F.col("event_type"), F.lit('"; k "'), F.coalesce("k", F.lit("")), F.lit('";')))
    return e.select("event_id", text.attribute(F.col("attributes"), "k").alias("k"), text.digits_or(F.col("k"), 0).alias("k_number"), text.first_attribute(F.col("attributes"), "gene_name", "gene", "Name").alias("gene_name"))


@query("id_parse", """SELECT p_partkey, 'chr_' || (p_partkey % 5) AS chrom, p_partkey AS start, p_partkey + p_size AS "end", p_partkey * 2 AS position, 'A' AS ref_allele, 'TT' AS alt_allele, 'insertion' AS variant_type FROM part""")
def id_parse(spark, sf_dir):
    """Identifiers written in each form and parsed."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k, F.concat(F.lit("chr_"), (k % 5).cast("string"), F.lit("_"), k.cast("string"), F.lit("_"), (k + F.col("p_size")).cast("string")).alias("junction"), F.concat(F.lit('"1-'), (k * 2).cast("string"), F.lit('-A-TT"')).alias("variant"))
    j, v = text.junction_parts(F.col("junction")), text.variant_parts(F.col("variant"))
    return p.select("p_partkey", j["chrom"].alias("chrom"), j["start"].alias("start"), j["end"].alias("end"), v["position"].alias("position"), v["ref_allele"].alias("ref_allele"), v["alt_allele"].alias("alt_allele"), text.variant_type(v["ref_allele"], v["alt_allele"]).alias("variant_type"))


@query("sequence_chunks", """WITH c AS (SELECT doc_id, text, length(text) AS n, greatest(CAST(ceil((length(text) - 500) / 400.0) AS BIGINT), 0) AS last FROM documents WHERE text IS NOT NULL),
e AS (SELECT *, unnest(range(0, last + 1)) AS chunk FROM c)
SELECT doc_id, chunk, chunk * 400 AS chunk_start, least(chunk * 400 + 500, n) AS chunk_end, CASE WHEN chunk = 0 THEN 0 ELSE chunk * 400 + 50 END AS keep_start, CASE WHEN chunk = last THEN n ELSE chunk * 400 + 450 END AS keep_end, length(substr(text, chunk * 400 + 1, 500)) AS n_chars FROM e""")  # fmt: skip
def sequence_chunks(spark, sf_dir):
    d = text.chunks(table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL"), "text", 500, 100)
    return d.select("doc_id", "chunk", "chunk_start", "chunk_end", "keep_start", "keep_end", F.length("chunk_sequence").alias("n_chars"))


@query("annotation_label_join", """WITH s AS (SELECT o_custkey, min(o_orderstatus) AS splice_type, min(o_orderpriority) AS transcript_id, count(DISTINCT o_orderpriority) AS transcript_count FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey)
SELECT c_custkey, coalesce(splice_type, '') AS splice_type, coalesce(transcript_id, '') AS transcript_id, coalesce(transcript_count, 0) AS transcript_count, CASE coalesce(splice_type, '') WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS code
FROM customer LEFT JOIN s ON c_custkey = o_custkey""")  # fmt: skip
def annotation_label_join(spark, sf_dir):
    sites = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("splice_type"), F.col("o_orderpriority").alias("transcript_id"))
    got = relations.label_join(table(spark, sf_dir, "customer").select("c_custkey"), sites, ["c_custkey"])
    named = got.withColumn("_t", F.when(F.col("splice_type") == "F", "donor").when(F.col("splice_type") == "O", "acceptor"))
    return named.select("c_custkey", "splice_type", "transcript_id", "transcript_count", scores.label_code("_t").alias("code"))
