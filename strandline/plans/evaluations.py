"""Evaluation, calibration, split, sample and check queries (E*, L*, O5-O7, V*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import compare, evaluation, labels, verify
from ..streaming import metrics
from .registry import query
from .tables import JUDGED, SCORED, judged, scored, scored_events, table

SITES = f"""{SCORED}, pos AS (SELECT user_id, position, max(donor) AS score, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS truth FROM scored GROUP BY 1, 2),
t AS (SELECT DISTINCT user_id, position FROM pos WHERE truth = 1)"""


def sites(spark, sf_dir):
    pos = scored(spark, sf_dir).groupBy("user_id", "position").agg(F.max("donor").alias("score"), F.max((F.col("event_type") == "purchase").cast("int")).alias("truth"))
    return pos.where("truth = 1").select("user_id", "position"), pos.select("user_id", "position", "score")


CLASSIFIED = f"""{SITES}, best AS (SELECT t.user_id, t.position, greatest(coalesce(max(score), 0), 0) AS score FROM t LEFT JOIN pos s ON s.user_id = t.user_id AND s.position BETWEEN t.position - 30 AND t.position + 30 GROUP BY 1, 2),
classified AS (SELECT user_id, position, CASE WHEN score >= 0.4 THEN 'TP' ELSE 'FN' END AS pred_type, score FROM best
UNION ALL SELECT user_id, position, 'FP', score FROM pos s WHERE score >= 0.4 AND NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = s.user_id AND s.position BETWEEN t.position - 30 AND t.position + 30))"""


def classified(spark, sf_dir):
    truth, pos = sites(spark, sf_dir)
    return evaluation.classify_sites(truth, pos, ["user_id"], 0.4, 30)


@query("consensus_classification", f"WITH {CLASSIFIED} SELECT user_id, position, pred_type, round(score, 6) AS score FROM classified")
def consensus_classification(spark, sf_dir):
    return classified(spark, sf_dir).select("user_id", "position", "pred_type", F.round("score", 6).alias("score"))


RATES = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1"""


@query("site_metrics", f"WITH {CLASSIFIED}, n AS (SELECT count(*) FILTER (pred_type = 'TP') AS tp, count(*) FILTER (pred_type = 'FP') AS fp, count(*) FILTER (pred_type = 'FN') AS fn FROM classified) SELECT tp, fp, fn, {RATES} FROM n")
def site_metrics(spark, sf_dir):
    return evaluation.site_metrics(classified(spark, sf_dir))


RANKED = f"""{JUDGED}, g AS (SELECT score, sum(quality) AS pos, sum(1 - quality) AS neg FROM judged GROUP BY score),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p_all, sum(neg) OVER () AS n_all FROM g WINDOW w AS (ORDER BY score DESC)),
k AS (SELECT *, tp / (tp + fp) AS precision, tp / p_all AS recall FROM c)"""


@query("average_precision", f"WITH {RANKED} SELECT round(sum(precision * pos / p_all), 8) AS average_precision FROM k")
def average_precision(spark, sf_dir):
    return evaluation.average_precision(judged(spark, sf_dir), "quality", "score").select(F.round("average_precision", 8).alias("average_precision"))


@query("pr_auc", f"WITH {RANKED}, l AS (SELECT *, lag(precision, 1, 1.0) OVER (ORDER BY score DESC) AS p0, lag(recall, 1, 0.0) OVER (ORDER BY score DESC) AS r0 FROM k) SELECT round(sum((recall - r0) * (precision + p0) / 2), 8) AS pr_auc FROM l")
def pr_auc(spark, sf_dir):
    return evaluation.pr_auc(judged(spark, sf_dir), "quality", "score").select(F.round("pr_auc", 8).alias("pr_auc"))


@query("roc_auc", f"WITH {RANKED}, l AS (SELECT *, lag(tp, 1, 0) OVER (ORDER BY score DESC) AS t0, lag(fp, 1, 0) OVER (ORDER BY score DESC) AS f0 FROM k) SELECT round(sum((fp - f0) * (tp + t0) / 2 / (p_all * n_all)), 8) AS roc_auc FROM l")
def roc_auc(spark, sf_dir):
    return evaluation.roc_auc(judged(spark, sf_dir), "quality", "score").select(F.round("roc_auc", 8).alias("roc_auc"))


TOPK = f"{SITES}, n AS (SELECT user_id, count(*) AS n_true FROM t GROUP BY 1)"


@query("topk_floor", f"""WITH {TOPK}, r AS (SELECT s.*, n_true, row_number() OVER (PARTITION BY s.user_id ORDER BY score DESC, position) AS rank FROM pos s JOIN n USING (user_id) WHERE score >= 0.1),
h AS (SELECT r.user_id, count(*) AS hits FROM r JOIN t USING (user_id, position) WHERE rank <= greatest(1, floor(n_true * 1.5)) GROUP BY 1)
SELECT user_id, n_true, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / n_true, 6) AS accuracy FROM n LEFT JOIN h USING (user_id)""")  # fmt: skip
def topk_floor(spark, sf_dir):
    truth, pos = sites(spark, sf_dir)
    return evaluation.topk_accuracy(pos, truth, ["user_id"], factor=1.5, least=0.1).withColumn("accuracy", F.round("accuracy", 6))


@query("topk_ceil", f"""WITH {TOPK}, r AS (SELECT s.*, n_true, row_number() OVER (PARTITION BY s.user_id ORDER BY score DESC, position) AS rank FROM pos s JOIN n USING (user_id)),
h AS (SELECT r.user_id, count(*) AS hits FROM r JOIN t USING (user_id, position) WHERE rank <= greatest(1, ceil(n_true * 0.5)) GROUP BY 1)
SELECT user_id, n_true, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / n_true, 6) AS accuracy FROM n LEFT JOIN h USING (user_id)""")  # fmt: skip
def topk_ceil(spark, sf_dir):
    truth, pos = sites(spark, sf_dir)
    return evaluation.topk_accuracy(pos, truth, ["user_id"], factor=0.5, ceil=True).withColumn("accuracy", F.round("accuracy", 6))


@query("windowed_recall", f"""WITH {SITES}, w AS (SELECT unnest([1, 2, 5, 10]) AS width), d AS (SELECT t.user_id, t.position, width, bool_or(s.position IS NOT NULL) AS found FROM t CROSS JOIN w LEFT JOIN (SELECT * FROM pos WHERE score >= 0.4) s ON s.user_id = t.user_id AND abs(s.position - t.position) <= width GROUP BY 1, 2, 3)
SELECT width, count(*) AS n_sites, count(*) FILTER (found) AS n_found, round(count(*) FILTER (found) / count(*), 6) AS recall FROM d GROUP BY width""")  # fmt: skip
def windowed_recall(spark, sf_dir):
    truth, pos = sites(spark, sf_dir)
    return evaluation.windowed_recall(truth, pos, ["user_id"], [1, 2, 5, 10], 0.4).withColumn("recall", F.round("recall", 6))


@query("gap_analysis", f"""WITH {SITES}, o AS (SELECT t.user_id, t.position, s.score AS own, (SELECT coalesce(max(x.score), 0) FROM pos x WHERE x.user_id = t.user_id AND x.position BETWEEN t.position - 20 AND t.position + 20) AS near FROM t LEFT JOIN pos s ON s.user_id = t.user_id AND s.position = t.position)
SELECT user_id, count(*) AS n_sites, count(*) FILTER (own >= 0.5) AS detected, count(*) FILTER (own < 0.5 AND near >= 0.5) AS shifted, count(*) FILTER (own < 0.5 AND near >= 0.1 AND near < 0.5) AS moderate,
count(*) FILTER (own < 0.5 AND near >= 0.01 AND near < 0.1) AS weak, count(*) FILTER (own < 0.5 AND near < 0.01) AS none FROM o GROUP BY user_id""")  # fmt: skip
def gap_analysis(spark, sf_dir):
    truth, pos = sites(spark, sf_dir)
    return evaluation.gap_analysis(truth, pos, ["user_id"], ["user_id"], 0.5, 20)


GRID = [0.01, 0.05, *[round(0.05 * i, 2) for i in range(2, 20)], 0.99, 0.999]


@query("threshold_sweep", f"""WITH {JUDGED}, h AS (SELECT unnest({GRID}) AS threshold), n AS (SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (score >= threshold AND quality = 1) AS tp, count(*) FILTER (score >= threshold AND quality <> 1) AS fp, count(*) FILTER (score < threshold AND quality = 1) AS fn FROM judged, h GROUP BY 1)
SELECT threshold, tp, fp, fn, {RATES} FROM n""")  # fmt: skip
def threshold_sweep(spark, sf_dir):
    return evaluation.threshold_sweep(judged(spark, sf_dir), "quality", "score", GRID)


BINS = f"{JUDGED}, b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS mean_score, avg(quality) AS observed FROM judged GROUP BY 1)"


@query("sampled_class_ap", f"""WITH {SCORED}, y AS (SELECT *, least(event_id % 20, 2) AS y FROM scored), kept AS (SELECT * FROM y WHERE y < 2 OR ((event_id % 1000003 + 42) * 2654435761) % 4294967296 % 100000 < 10000),
l AS (SELECT 0 AS class_index, donor AS p, CAST(y = 0 AS INTEGER) AS label FROM kept UNION ALL SELECT 1, acceptor, CAST(y = 1 AS INTEGER) FROM kept UNION ALL SELECT 2, neither, CAST(y = 2 AS INTEGER) FROM kept),
g AS (SELECT class_index, p, sum(label) AS pos, count(*) AS n FROM l GROUP BY 1, 2), c AS (SELECT class_index, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS upto, sum(pos) OVER (PARTITION BY class_index) AS p_all FROM g WINDOW w AS (PARTITION BY class_index ORDER BY p DESC))
SELECT class_index, round(sum(tp / upto * pos / p_all), 7) AS average_precision FROM c GROUP BY class_index""")  # fmt: skip
def sampled_class_ap(spark, sf_dir):
    """E8."""
    df = scored(spark, sf_dir).withColumn("y", F.least(F.col("event_id") % 20, F.lit(2)))
    return evaluation.sampled_average_precision(df, "y", ["donor", "acceptor", "neither"], "event_id", 0.1).select("class_index", F.round("average_precision", 7).alias("average_precision"))


#: ROC-AUC of l(k, label, p) by k.
AREAS = """g AS (SELECT k, p, sum(label) AS pos, count(*) - sum(label) AS neg FROM l GROUP BY k, p),
a AS (SELECT k, pos, neg, sum(pos) OVER w AS tp, sum(pos) OVER w + sum(neg) OVER w AS upto, sum(pos) OVER (PARTITION BY k) AS p_all, sum(neg) OVER (PARTITION BY k) AS n_all FROM g WINDOW w AS (PARTITION BY k ORDER BY p DESC)),
area AS (SELECT k, round(sum(neg * (tp - pos / 2) / (p_all * n_all)), 7) AS roc_auc, round(sum(tp / upto * pos / p_all), 7) AS average_precision FROM a GROUP BY k)"""


@query("score_report", f"""WITH {JUDGED}, l AS (SELECT 'score' AS k, quality AS label, score AS p FROM judged UNION ALL SELECT 'base', quality, (doc_id * 31 % 1000) / 1000.0::DOUBLE FROM judged), {AREAS}
SELECT k AS scores, threshold, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative, round(avg(CAST(p >= threshold AS INTEGER)) FILTER (label = 1), 7) AS sensitivity,
round(avg(CAST(p < threshold AS INTEGER)) FILTER (label = 0), 7) AS specificity, roc_auc, average_precision FROM l JOIN area USING (k), (SELECT unnest([0.1, 0.2, 0.5, 0.8]::DOUBLE[]) AS threshold) GROUP BY k, threshold, roc_auc, average_precision""")  # fmt: skip
def score_report(spark, sf_dir):
    """E17."""
    df = judged(spark, sf_dir).withColumn("base", F.col("doc_id") * 31 % 1000 / 1000.0)
    got = evaluation.score_report(df, "quality", ["score", "base"])
    return got.select("scores", "threshold", "n_positive", "n_negative", *(F.round(c, 7).alias(c) for c in ("sensitivity", "specificity", "roc_auc", "average_precision")))


CHANNELS = {"first": 31, "second": 137}


def channels(spark, sf_dir):
    return judged(spark, sf_dir).withColumns({c: F.col("doc_id") * m % 1000 / 1000.0 + 0.1 * F.col("quality") for c, m in CHANNELS.items()})


@query("rescue_signal", f"""WITH {JUDGED}, c AS (SELECT quality, score, unnest(['first', 'second']) AS channel, unnest([doc_id * 31 % 1000, doc_id * 137 % 1000]) / 1000.0::DOUBLE + 0.1::DOUBLE * quality AS p FROM judged),
l AS (SELECT channel || '|all' AS k, quality AS label, p FROM c UNION ALL SELECT channel || '|uncertain', quality, p FROM c WHERE quality = 0 OR score < 0.3), {AREAS}
SELECT channel, (SELECT count(*) FROM judged WHERE quality = 1 AND score < 0.3) AS n_uncertain, (SELECT roc_auc FROM area WHERE k = channel || '|uncertain') AS roc_auc_uncertain, (SELECT roc_auc FROM area WHERE k = channel || '|all') AS roc_auc_all
FROM (SELECT unnest(['first', 'second']) AS channel)""")  # fmt: skip
def rescue_signal(spark, sf_dir):
    """L11."""
    got = compare.rescue(channels(spark, sf_dir), "quality", "score", list(CHANNELS), 0.3)
    return got.select("channel", "n_uncertain", F.round("roc_auc_uncertain", 7).alias("roc_auc_uncertain"), F.round("roc_auc_all", 7).alias("roc_auc_all"))


@query("incremental_auc")
def incremental_auc(spark, sf_dir):
    """A fitted model, so without SQL; tests/test_reports.py holds it against closed cases."""
    return compare.incremental_auc(channels(spark, sf_dir), "quality", ["score"], {c: [c] for c in CHANNELS}, "doc_id")


@query("length_split", """WITH n AS (SELECT c_nationkey, count(*) AS length FROM customer GROUP BY 1), h AS (SELECT *, ((c_nationkey % 1000003 + 42) * 2654435761) % 4294967296 % 2147483648 AS h FROM n),
b AS (SELECT *, sum(length) OVER (ORDER BY h, c_nationkey) - length AS before, sum(length) OVER () AS total FROM h) SELECT c_nationkey, length, CASE WHEN before < total * 0.2::DOUBLE THEN 'test' ELSE 'train' END AS split FROM b""")  # fmt: skip
def length_split(spark, sf_dir):
    """L9."""
    return labels.length_split(table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("length")), "c_nationkey", "length")


@query("length_weighted_negatives", """WITH g AS (SELECT p_partkey, p_partkey * 1000 AS start, p_size * 20 AS size FROM part WHERE p_size * 20 > 400), d AS (SELECT start, size, unnest(range(0, size // 50)) AS k FROM g),
c AS (SELECT DISTINCT start + 100 + ((start + k) % 1000003 + 42) * 2654435761 % 4294967296 % (size - 200) AS position FROM d), n AS (SELECT position, CASE WHEN position % 4 = 0 THEN 'hard' ELSE 'easy' END AS kind FROM c WHERE position NOT IN (SELECT l_suppkey * 1000 + 150 FROM lineitem)),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY (position % 1000003 + 42) * 2654435761 % 4294967296 % 2147483648, position) AS k FROM n) SELECT position, kind FROM r WHERE k <= CASE kind WHEN 'hard' THEN 40 ELSE 60 END""")  # fmt: skip
def length_weighted_negatives(spark, sf_dir):
    """O10; parts are genes of 20 bases a size."""
    genes = table(spark, sf_dir, "part").select((F.col("p_partkey") * 1000).alias("start"), (F.col("p_partkey") * 1000 + F.col("p_size") * 20).alias("end"))
    drawn = labels.drawn_positions(genes, 50).select("position", F.when(F.col("position") % 4 == 0, "hard").otherwise("easy").alias("kind"))
    real = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 1000 + 150).alias("position"))
    return labels.stratified_negatives(drawn, real, ["position"], "kind", "position", {"hard": 40, "easy": 60}).select("position", "kind")


@query("calibration_bins", f"WITH {BINS} SELECT CAST(bin AS INTEGER) AS bin, n, round(mean_score, 7) AS mean_score, round(observed, 7) AS observed FROM b")
def calibration_bins(spark, sf_dir):
    return evaluation.calibration_bins(judged(spark, sf_dir), "quality", "score").select("bin", "n", F.round("mean_score", 7).alias("mean_score"), F.round("observed", 7).alias("observed"))


@query("ece_mce", f"WITH {BINS} SELECT round(sum(abs(mean_score - observed) * n) / sum(n), 8) AS ece, round(max(abs(mean_score - observed)), 8) AS mce FROM b")
def ece_mce(spark, sf_dir):
    return evaluation.ece_mce(judged(spark, sf_dir), "quality", "score").select(F.round("ece", 8).alias("ece"), F.round("mce", 8).alias("mce"))


@query("brier", f"""WITH {BINS}, w AS (SELECT avg((score - quality) ** 2) AS brier, avg(quality) AS base, count(*) AS total FROM judged)
SELECT round(any_value(brier), 8) AS brier, round(sum(n * (mean_score - observed) ** 2) / any_value(total), 8) AS calibration, round(sum(n * (observed - base) ** 2) / any_value(total), 8) AS refinement, round(any_value(base * (1 - base)), 8) AS uncertainty FROM b, w""")  # fmt: skip
def brier(spark, sf_dir):
    return evaluation.brier(judged(spark, sf_dir), "quality", "score").select(*(F.round(c, 8).alias(c) for c in ("brier", "calibration", "refinement", "uncertainty")))


CONFUSION = f"""WITH {SCORED}, k AS (SELECT CAST(event_id % 3 AS INTEGER) AS y, CASE greatest(donor, acceptor, neither) WHEN donor THEN 0 WHEN acceptor THEN 1 ELSE 2 END AS z FROM scored), c AS (SELECT unnest([0, 1, 2]) AS class_index)
SELECT class_index, count(*) FILTER (y = class_index) AS n_true, count(*) FILTER (y = class_index AND z = class_index) AS tp, count(*) FILTER (y <> class_index AND z = class_index) AS fp, count(*) FILTER (y = class_index AND z <> class_index) AS fn FROM k, c GROUP BY 1"""


@query("confusion_by_class", CONFUSION)
def confusion_by_class(spark, sf_dir):
    return evaluation.confusion_by_class(scored(spark, sf_dir).withColumn("y", F.col("event_id") % 3), "y", ["donor", "acceptor", "neither"])


def streamed(spark, sf_dir):
    """events read as a stream, counted as state (G1): the counters of each class."""
    kind, folder = table(spark, sf_dir, "events").schema, metrics.shared_folder(spark, "class-counters")
    stream = scored_events(spark.readStream.schema(kind).parquet(f"{sf_dir}/event[s].parquet")).withColumn("y", F.col("event_id") % 3)  # as a pattern, a file or a folder
    metrics.accumulate(stream, f"{folder}/counters", f"{folder}/checkpoint", "y", ["donor", "acceptor", "neither"], "user_id", shards=8)
    return metrics.totals(spark, f"{folder}/counters")


@query("streamed_class_counters", CONFUSION)
def streamed_class_counters(spark, sf_dir):
    return streamed(spark, sf_dir).select("class_index", "n_true", "tp", "fp", "fn")


@query("streamed_class_sweep", f"""WITH {SCORED}, k AS (SELECT event_id % 3 AS y, unnest([0, 1, 2]) AS c, unnest([donor, acceptor, neither]) AS p FROM scored), b AS (SELECT c, y = c AS hit, least(greatest(floor(p * 100), 0), 99) AS at_bin FROM k), t AS (SELECT unnest(range(100)) AS t),
n AS (SELECT c AS class_index, t / 100 AS threshold, count(*) FILTER (hit AND at_bin >= t) AS tp, count(*) FILTER (NOT hit AND at_bin >= t) AS fp, count(*) FILTER (hit AND at_bin < t) AS fn FROM b, t GROUP BY c, t)
SELECT CAST(class_index AS INTEGER) AS class_index, threshold, tp, fp, fn FROM n""")  # fmt: skip
def streamed_class_sweep(spark, sf_dir):
    return metrics.swept(streamed(spark, sf_dir)).select("class_index", "threshold", "tp", "fp", "fn")


@query("offset_detection", f"""WITH {SITES}, c AS (SELECT user_id, position FROM pos WHERE score >= 0.4), o AS (SELECT unnest(range(-5, 6)) AS o), h AS (SELECT o, count(*) AS tp FROM t, o WHERE EXISTS (SELECT 1 FROM c WHERE c.user_id = t.user_id AND c.position = t.position + o) GROUP BY o),
f AS (SELECT o, 2 * tp / ((SELECT count(*) FROM t) + (SELECT count(*) FROM c)) AS f1 FROM h), b AS (SELECT first(o ORDER BY f1 DESC, abs(o)) AS best, max(f1) AS best_f1, coalesce(max(f1) FILTER (o = 0), 0) AS base_f1 FROM f)
SELECT CAST(CASE WHEN best_f1 > base_f1 THEN best ELSE 0 END AS INTEGER) AS "offset", round(best_f1, 8) AS best_f1, round(base_f1, 8) AS base_f1 FROM b""")  # fmt: skip
def offset_detection(spark, sf_dir):
    truth, pos = sites(spark, sf_dir)
    return evaluation.best_offset(truth, pos, ["user_id"], threshold=0.4).select("offset", F.round("best_f1", 8).alias("best_f1"), F.round("base_f1", 8).alias("base_f1"))


@query("temperature_fit")
def temperature_fit(spark, sf_dir):
    """One row, the temperature of least log-likelihood on a grid."""
    df = scored(spark, sf_dir).select(*(F.log(F.col(c) + 1e-10).alias(c) for c in ("donor", "acceptor", "neither")), (F.col("event_id") % 3).cast("int").alias("y"))
    return spark.createDataFrame([(evaluation.fit_temperature(df, ["donor", "acceptor", "neither"], "y"),)], "temperature double")


#: Labels drawn by a hash from softmax(logit * inverse temperature), so that the fit has something to find.
DRAWN = (0.6, 1.7, 1.1)


def newton_sql(steps: int) -> str:
    """The same Newton steps as common tables: sums of gradient and curvature, then Cramer's rule."""
    z = ("z0", "z1", "z2")
    tables = [f"""{SCORED}, l AS (SELECT event_id, ln(donor + 1e-10) AS z0, ln(acceptor + 1e-10) AS z1, ln(neither + 1e-10) AS z2, ((event_id * 31337) % 9973) / 9973.0::DOUBLE AS u FROM scored),
e AS (SELECT *, exp({DRAWN[0]}::DOUBLE * z0) AS e0, exp({DRAWN[1]}::DOUBLE * z1) AS e1, exp({DRAWN[2]}::DOUBLE * z2) AS e2 FROM l),
y AS MATERIALIZED (SELECT z0, z1, z2, CASE WHEN u < e0 / (e0 + e1 + e2) THEN 0 WHEN u < (e0 + e1) / (e0 + e1 + e2) THEN 1 ELSE 2 END AS y FROM e),
b0 AS (SELECT 1.0::DOUBLE AS b0, 1.0::DOUBLE AS b1, 1.0::DOUBLE AS b2)"""]  # fmt: skip
    for k in range(steps):
        share = ", ".join(f"exp(b{i} * z{i}) / (exp(b0 * z0) + exp(b1 * z1) + exp(b2 * z2)) AS p{i}" for i in range(3))
        sums = ", ".join([f"avg({z[i]} * (p{i} - CASE WHEN y = {i} THEN 1 ELSE 0 END)) AS g{i}" for i in range(3)] + [f"avg({z[i]} * {z[j]} * p{i} * ({1 if i == j else 0} - p{j})) AS h{i}{j}" for i in range(3) for j in range(i, 3)])
        det = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
        solved = (
            f"(g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / {det}",
            f"(h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / {det}",
            f"(h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / {det}",
        )
        tables.append(f"s{k} AS MATERIALIZED (SELECT b0, b1, b2, {sums} FROM (SELECT z0, z1, z2, y, b0, b1, b2, {share} FROM y, b{k}) GROUP BY b0, b1, b2)")
        tables.append(f"b{k + 1} AS MATERIALIZED (SELECT {', '.join(f'b{i} - {solved[i]} AS b{i}' for i in range(3))} FROM s{k})")
    nll = lambda n: f"(SELECT avg(ln(exp(b0 * z0) + exp(b1 * z1) + exp(b2 * z2)) - CASE y WHEN 0 THEN b0 * z0 WHEN 1 THEN b1 * z1 ELSE b2 * z2 END) FROM y, b{n})"
    return f"WITH {', '.join(tables)} SELECT CAST(i AS INTEGER) AS class_index, round(1 / CASE i WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END, 6) AS temperature, round({nll(0)}, 8) AS nll_before, round({nll(steps)}, 8) AS nll_after FROM b{steps}, range(3) r(i)"


@query("class_temperatures", newton_sql(9))
def class_temperatures(spark, sf_dir):
    """A temperature a class by Newton steps, one aggregate each."""
    df = scored(spark, sf_dir).select("event_id", *(F.log(F.col(c) + 1e-10).alias(c) for c in ("donor", "acceptor", "neither")))
    parts = [F.exp(F.lit(b) * F.col(c)) for b, c in zip(DRAWN, ("donor", "acceptor", "neither"))]
    u, total = F.pmod(F.col("event_id") * 31337, F.lit(9973)) / 9973.0, parts[0] + parts[1] + parts[2]
    df = df.withColumn("y", F.when(u < parts[0] / total, 0).when(u < (parts[0] + parts[1]) / total, 1).otherwise(2))
    got = evaluation.fit_class_temperatures(df, ["donor", "acceptor", "neither"], "y")
    rows = [(i, round(t, 6), got["nll_before"] and round(got["nll_before"], 8), got["nll_after"] and round(got["nll_after"], 8)) for i, t in enumerate(got["temperature"])]
    return spark.createDataFrame(rows, "class_index int, temperature double, nll_before double, nll_after double")


@query("balanced_split", """WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT c_nationkey, n, CASE WHEN sum(n) OVER (ORDER BY n DESC, c_nationkey ROWS UNBOUNDED PRECEDING) - n < 0.8 * sum(n) OVER () THEN 'train' ELSE 'test' END AS split FROM n""")
def balanced_split(spark, sf_dir):
    return labels.balanced_split(table(spark, sf_dir, "customer"), "c_nationkey")


@query("preset_split", "SELECT c_custkey, CASE WHEN c_nationkey IN (1, 3, 5, 7, 9) THEN 'test' ELSE 'train' END AS split FROM customer")
def preset_split(spark, sf_dir):
    return labels.preset_split(table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("chr"), F.col("c_nationkey").cast("string")).alias("chrom"))).select("c_custkey", "split")


@query("val_holdout", """WITH h AS (SELECT c_custkey, c_nationkey, ((c_custkey % 1000003 + 42) * 2654435761) % 4294967296 % 2147483648 AS h FROM customer)
SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY h, c_custkey) <= greatest(1, floor(count(*) OVER (PARTITION BY c_nationkey) * 0.1)) AS is_val FROM h""")  # fmt: skip
def val_holdout(spark, sf_dir):
    return labels.holdout(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", 0.1).select("c_custkey", "is_val")



@query("family_split_exclusion", """WITH fam AS (SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '^Brand#1') THEN 'B1' WHEN regexp_matches(p_brand, '^Brand#2') THEN 'B2' ELSE nullif(regexp_extract(p_name || p_size, '^(.*?)[0-9]+$', 1), '') END AS f, p_partkey % 50 <> 0 AS is_test FROM part),
s AS (SELECT f, count(*) AS n FROM fam WHERE f IS NOT NULL GROUP BY f HAVING count(*) >= 2), g AS (SELECT p_partkey, is_test, s.f AS family, n AS family_size FROM fam LEFT JOIN s ON fam.f = s.f)
SELECT p_partkey, family, family_size FROM g WHERE is_test AND (family IS NULL OR family NOT IN (SELECT family FROM g WHERE NOT is_test AND family IS NOT NULL))""")  # fmt: skip
def family_split_exclusion(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", F.col("p_size").cast("string")))
    rule = F.when(F.col("p_brand").rlike("^Brand#1"), "B1").when(F.col("p_brand").rlike("^Brand#2"), "B2").otherwise(text.family(F.col("name"), []))
    g = labels.family_sizes(p, rule).select("p_partkey", "family", "family_size")
    return labels.without_shared_families(g.where("p_partkey % 50 <> 0"), g.where("p_partkey % 50 = 0"), "family").select("p_partkey", "family", "family_size")


@query("three_class_labels", f"""WITH {SCORED}, p AS (SELECT DISTINCT user_id, position FROM scored), s AS (SELECT user_id, position, max(CASE event_type WHEN 'purchase' THEN 2 WHEN 'view' THEN 1 ELSE 0 END) AS label FROM scored WHERE event_type IN ('purchase', 'view') GROUP BY 1, 2)
SELECT p.user_id, p.position, coalesce(label, 0) AS label FROM p LEFT JOIN s USING (user_id, position)""")  # fmt: skip
def three_class_labels(spark, sf_dir):
    e = scored(spark, sf_dir)
    marks = e.where("event_type IN ('purchase', 'view')").select("user_id", "position", F.when(F.col("event_type") == "purchase", "donor").otherwise("acceptor").alias("splice_type"))
    return labels.three_class(e.select("user_id", "position").distinct(), marks, ["user_id", "position"])


@query("layered_labels", f"""WITH {SCORED}, p AS (SELECT DISTINCT user_id, position FROM scored), k AS (SELECT DISTINCT user_id, position FROM scored WHERE event_type = 'view'), q AS (SELECT user_id, position, bool_or(value > 50) AS c FROM scored WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT p.user_id, p.position, CASE WHEN q.user_id IS NOT NULL THEN 0 WHEN k.user_id IS NOT NULL THEN 255 ELSE 2 END AS label, CASE WHEN coalesce(c, false) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM p LEFT JOIN k USING (user_id, position) LEFT JOIN q USING (user_id, position)""")  # fmt: skip
def layered_labels(spark, sf_dir):
    e = scored(spark, sf_dir)
    q = e.where("event_type = 'purchase'").groupBy("user_id", "position").agg(F.bool_or(F.col("value") > 50).alias("confirmed")).withColumn("label", F.lit(0))
    return labels.layered(e.select("user_id", "position").distinct(), e.where("event_type = 'view'"), q, ["user_id", "position"]).select("user_id", "position", "label", "weight")


@query("tier_sampling", f"""WITH {SCORED}, f AS (SELECT event_id, donor > 0.6 AS s, max(CASE WHEN donor > 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY position RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) = 1 AS near, ((event_id % 1000003 + 42) * 2654435761) % 4294967296 % 100000 < 5000 AS drawn FROM scored)
SELECT event_id, CASE WHEN s THEN 'splice' WHEN near THEN 'proximity' ELSE 'background' END AS tier FROM f WHERE s OR near OR drawn""")  # fmt: skip
def tier_sampling(spark, sf_dir):
    return labels.tiers(scored(spark, sf_dir), "donor", ["user_id"], "position", "event_id", 0.6, 500, 0.05).select("event_id", "tier")


@query("stratified_downsample", """WITH h AS (SELECT event_id, event_type, ((event_id % 1000003 + 42) * 2654435761) % 4294967296 % 2147483648 AS h FROM events), o AS (SELECT event_id, event_type, row_number() OVER (ORDER BY h, event_id) AS k FROM h WHERE event_type <> 'purchase')
SELECT event_id, event_type FROM h WHERE event_type = 'purchase' UNION ALL SELECT event_id, event_type FROM o WHERE k <= floor((SELECT count(*) FROM h WHERE event_type = 'purchase') * 1.2)""")  # fmt: skip
def stratified_downsample(spark, sf_dir):
    return labels.downsample(table(spark, sf_dir, "events").select("event_id", "event_type"), F.col("event_type") == "purchase", "event_id", 1.2)


@query("leakage_correlation", """SELECT * FROM (SELECT 'l_extendedprice' AS feature, round(corr(l_extendedprice, l_quantity), 6) AS correlation FROM lineitem UNION ALL SELECT 'l_tax', round(corr(l_tax, l_quantity), 6) FROM lineitem UNION ALL SELECT 'l_quantity', 1.0) WHERE abs(correlation) >= 0.5""")
def leakage_correlation(spark, sf_dir):
    return labels.leaking(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_tax", "l_quantity"], "l_quantity", 0.5).select("feature", F.round("correlation", 6).alias("correlation"))


@query("dead_channels", "SELECT 'l_tax' AS channel, max(abs(l_tax)) = 0 AS is_dead FROM lineitem UNION ALL SELECT 'zero', true")
def dead_channels(spark, sf_dir):
    return labels.dead_channels(table(spark, sf_dir, "lineitem").withColumn("zero", F.lit(0)), ["l_tax", "zero"])


@query("verify_report", """WITH e AS (SELECT event_id AS position, value / 1000 AS p, value, event_id % 3 AS b FROM events), n AS (SELECT count(*) AS n FROM e)
SELECT 'position_null' AS check_name, count(*) FILTER (position IS NULL) AS violations, count(*) FILTER (position IS NULL) = 0 AS passed FROM e UNION ALL SELECT 'position_negative', count(*) FILTER (position < 0), count(*) FILTER (position < 0) = 0 FROM e
UNION ALL SELECT 'p_range', count(*) FILTER (p < -0.001 OR p > 1.001), count(*) FILTER (p < -0.001 OR p > 1.001) = 0 FROM e UNION ALL SELECT 'b_binary', count(*) FILTER (b NOT IN (0, 1)), count(*) FILTER (b NOT IN (0, 1)) = 0 FROM e
UNION ALL SELECT 'value_negative', count(*) FILTER (value < 0), count(*) FILTER (value < 0) = 0 FROM e UNION ALL SELECT 'p_nulls', count(*) FILTER (p IS NULL), count(*) FILTER (p IS NULL) <= 0.01 * count(*) FROM e
UNION ALL SELECT 'b_nulls', count(*) FILTER (b IS NULL), true FROM e UNION ALL SELECT 'value_nulls', count(*) FILTER (value IS NULL), count(*) FILTER (value IS NULL) <= 0.01 * count(*) FROM e
UNION ALL SELECT 'duplicate_keys', coalesce(CAST(sum(c - 1) AS BIGINT), 0), coalesce(sum(c - 1), 0) = 0 FROM (SELECT count(*) AS c FROM e GROUP BY position)""")  # fmt: skip
def verify_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("position"), (F.col("value") / 1000).alias("p"), "value", (F.col("event_id") % 3).alias("b"))
    return verify.report(e, ["position"], "position", ["p"], ["b"], ["value"])


@query("label_alignment", f"""WITH {SCORED}, k AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'donor' ELSE 'acceptor' END AS kind, donor, acceptor FROM scored), m AS (SELECT kind, avg(donor) AS d, avg(acceptor) AS a FROM k GROUP BY kind)
SELECT kind, round(d, 8) AS mean_donor, round(a, 8) AS mean_acceptor, CASE kind WHEN 'donor' THEN d >= a ELSE a >= d END AS aligned FROM m""")  # fmt: skip
def label_alignment(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("kind", F.when(F.col("event_id") % 2 == 0, "donor").otherwise("acceptor"))
    return verify.label_alignment(df, "kind", "donor", "acceptor").select("kind", F.round("mean_donor", 8).alias("mean_donor"), F.round("mean_acceptor", 8).alias("mean_acceptor"), "aligned")


@query("split_overlap", "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def split_overlap(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("key", F.col("o_custkey"))
    return verify.overlap(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "key")
