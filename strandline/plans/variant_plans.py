"""Variant queries (R*, J22, J25) and event-time windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals, variants
from ..streaming import incremental
from .registry import query
from .tables import EXONS, JUDGED, SCORED, exons, judged, scored, table

DELTAS = f"""{SCORED}, d AS (SELECT event_id, user_id, position, donor - lag(donor) OVER w AS delta_donor, acceptor - lag(acceptor) OVER w AS delta_acceptor FROM scored WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
ev AS (SELECT event_id, user_id, position, 'donor' AS channel, delta_donor AS delta FROM d WHERE abs(delta_donor) > 0.25 UNION ALL SELECT event_id, user_id, position, 'acceptor', delta_acceptor FROM d WHERE abs(delta_acceptor) > 0.25),
e AS (SELECT *, CASE WHEN delta > 0 THEN 'gain' ELSE 'loss' END AS direction FROM ev)"""


def deltas(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return scored(spark, sf_dir).select("event_id", "user_id", "position", *((F.col(c) - F.lag(c).over(w)).alias(f"delta_{c}") for c in ("donor", "acceptor")))


def events(spark, sf_dir):
    return variants.detect_events(deltas(spark, sf_dir), ["event_id", "user_id", "position"], threshold=0.25)


@query("delta_events", f"WITH {DELTAS} SELECT event_id, channel, round(delta, 6) AS delta, direction FROM e")
def delta_events(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "channel", F.round("delta", 6).alias("delta"), "direction")


@query("delta_summary", f"""WITH {DELTAS} SELECT user_id, round(greatest(max(delta_donor), 0), 6) AS max_donor_gain, round(least(min(delta_donor), 0), 6) AS max_donor_loss, round(max(CASE WHEN abs(position % 100 - 50) <= 20 THEN abs(delta_donor) END), 6) AS max_donor_near FROM d GROUP BY user_id""")
def delta_summary(spark, sf_dir):
    d = deltas(spark, sf_dir).withColumn("distance", F.col("position") % 100 - 50)
    return variants.delta_summary(d, ["user_id"], "distance", 20, ["donor"]).select("user_id", *(F.round(c, 6).alias(c) for c in ("max_donor_gain", "max_donor_loss", "max_donor_near")))


ANNOTATED = f"""{DELTAS}, m AS (SELECT DISTINCT user_id, position AS mark FROM scored WHERE event_type = 'purchase'),
n AS (SELECT e.*, first(mark - e.position ORDER BY abs(mark - e.position), mark) AS md FROM e LEFT JOIN m ON m.user_id = e.user_id AND abs(mark - e.position) <= 600 GROUP BY ALL),
x AS (SELECT *, CASE WHEN abs(md) <= 120 THEN 'canonical' WHEN abs(md) <= 600 THEN 'shifted' ELSE 'cryptic' END AS event_class FROM n)"""


def annotated(spark, sf_dir):
    marks = scored(spark, sf_dir).where("event_type = 'purchase'").select("user_id", F.col("position").alias("mark"))
    return variants.annotate(events(spark, sf_dir), marks, ["user_id"], 120, 600)


@query("event_annotation_class", f"WITH {ANNOTATED} SELECT event_id, channel, md AS mark_distance, event_class FROM x")
def event_annotation_class(spark, sf_dir):
    return annotated(spark, sf_dir).select("event_id", "channel", "mark_distance", "event_class")


@query("consequence_class", f"""WITH {ANNOTATED}, f AS (SELECT user_id, bool_or(direction = 'loss' AND channel = 'donor' AND event_class = 'canonical') AS ld, bool_or(direction = 'loss' AND channel = 'acceptor' AND event_class = 'canonical') AS la,
bool_or(direction = 'gain' AND event_class = 'shifted') AS gs, bool_or(direction = 'gain' AND event_class = 'cryptic') AS gc, bool_or(direction = 'gain') AS g, max(abs(delta)) AS m, count(*) AS n_events FROM x GROUP BY user_id)
SELECT user_id, CASE WHEN ld AND la AND NOT g THEN 'exon_skipping' WHEN (ld OR la) AND gs THEN 'site_shift' WHEN (ld OR la) AND NOT g THEN 'site_destruction' WHEN (ld OR la) AND gc THEN 'intron_retention' WHEN gc THEN 'cryptic_exon' ELSE 'complex' END AS consequence,
round(m, 6) AS max_abs_delta, CASE WHEN m >= 0.5 THEN 'HIGH' WHEN m >= 0.2 THEN 'MODERATE' ELSE 'LOW' END AS confidence, n_events FROM f""")  # fmt: skip
def consequence_class(spark, sf_dir):
    return variants.consequence(annotated(spark, sf_dir), "user_id").withColumn("max_abs_delta", F.round("max_abs_delta", 6))


@query("event_pairing")
def event_pairing(spark, sf_dir):
    return variants.pair_events(events(spark, sf_dir), "user_id", 2000)


@query("affected_exons", f"""WITH {EXONS}, v AS (SELECT exon AS variant, transcript_id, start + 1 AS position FROM exons)
SELECT v.variant, string_agg(DISTINCT CAST(e.exon AS VARCHAR), ',' ORDER BY CAST(e.exon AS VARCHAR)) AS exons FROM v JOIN exons e ON e.transcript_id = v.transcript_id AND (abs(e.start - v.position) <= 2 OR abs(e."end" - v.position) <= 2) GROUP BY v.variant""")  # fmt: skip
def affected_exons(spark, sf_dir):
    e = exons(spark, sf_dir).withColumn("exon_number", F.col("exon").cast("string"))
    v = e.select(F.col("exon").alias("variant"), "transcript_id", (F.col("start") + 1).alias("position"))
    return variants.affected_exons(v, e, ["transcript_id"], "variant").select("variant", F.array_join("exons", ",").alias("exons"))


@query("variant_eval_summary", f"""WITH {JUDGED} SELECT count(*) AS n, round(count(*) FILTER (quality = 1 AND score >= 0.5) / count(*) FILTER (quality = 1), 8) AS detection_rate, round(count(*) FILTER (quality <> 1 AND score >= 0.5) / count(*) FILTER (quality <> 1), 8) AS false_positive_rate,
round(count(*) FILTER ((quality = 1) = (score >= 0.5)) / count(*), 8) AS accuracy FROM judged""")  # fmt: skip
def variant_eval_summary(spark, sf_dir):
    df = judged(spark, sf_dir).withColumn("detected", F.col("score") >= 0.5)
    return variants.evaluation_summary(df, "quality", "detected").select("n", *(F.round(c, 8).alias(c) for c in ("detection_rate", "false_positive_rate", "accuracy")))


@query("model_corrections", f"""WITH {JUDGED}, c AS (SELECT source, CASE WHEN quality = 1 AND score < 0.5 AND 1 - score >= 0.5 THEN 'fn_fixed' WHEN quality <> 1 AND score >= 0.5 AND 1 - score < 0.5 THEN 'fp_fixed' WHEN quality = 1 AND score >= 0.5 AND 1 - score < 0.5 THEN 'fn_new'
WHEN quality <> 1 AND score < 0.5 AND 1 - score >= 0.5 THEN 'fp_new' ELSE 'same' END AS change FROM judged) SELECT source, change, count(*) AS n FROM c GROUP BY 1, 2""")  # fmt: skip
def model_corrections(spark, sf_dir):
    df = judged(spark, sf_dir).withColumn("other", 1 - F.col("score"))
    return variants.corrections(df, "score", "other", "quality").groupBy("source", "change").agg(F.count("*").alias("n"))


@query("site_calls", f"WITH {SCORED} SELECT user_id, CASE WHEN donor >= 0.4 AND donor >= acceptor THEN 'donor' WHEN acceptor >= 0.4 THEN 'acceptor' ELSE 'none' END AS call, count(*) AS n FROM scored GROUP BY 1, 2")
def site_calls(spark, sf_dir):
    return variants.call_sites(scored(spark, sf_dir), threshold=0.4).groupBy("user_id", "call").agg(F.count("*").alias("n"))


@query("nearest_site", f"""WITH {SCORED}, b AS (SELECT DISTINCT user_id, position AS mark FROM scored WHERE event_type = 'error' AND event_id % 4 = 1) SELECT s.event_id, first(mark - s.position ORDER BY abs(mark - s.position), mark) AS mark_distance
FROM (SELECT event_id, user_id, position FROM scored) s LEFT JOIN b ON b.user_id = s.user_id GROUP BY s.event_id""")  # fmt: skip
def nearest_site(spark, sf_dir):
    """At any distance; some users have one mark or none."""
    s = scored(spark, sf_dir)
    marks = s.where("event_type = 'error' AND event_id % 4 = 1").select("user_id", F.col("position").alias("mark"))
    return intervals.nearest_at_any_distance(s.select("event_id", "user_id", "position"), marks, ["user_id"]).select("event_id", "mark_distance")


@query("nearest_boundary", f"""WITH {SCORED}, b AS (SELECT DISTINCT user_id, position AS mark FROM scored WHERE event_type = 'error') SELECT s.event_id, first(mark - s.position ORDER BY abs(mark - s.position), mark) AS mark_distance
FROM (SELECT event_id, user_id, position FROM scored) s LEFT JOIN b ON b.user_id = s.user_id AND abs(mark - s.position) <= 1000 GROUP BY s.event_id""")  # fmt: skip
def nearest_boundary(spark, sf_dir):
    s = scored(spark, sf_dir)
    marks = s.where("event_type = 'error'").select("user_id", F.col("position").alias("mark"))
    return intervals.nearest_of(s.select("event_id", "user_id", "position"), marks, ["user_id"], within=1000).select("event_id", "mark_distance")


@query("tumbling_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    return incremental.event_windows(table(spark, sf_dir, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("sliding_windows", """WITH w AS (SELECT *, time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS window_start FROM events, range(0, 4) r(k)) SELECT window_start, window_start + INTERVAL '2 hours' AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def sliding_windows(spark, sf_dir):
    return incremental.event_windows(table(spark, sf_dir, "events"), "2 hours", "30 minutes").withColumn("total", F.round("total", 4))


@query("session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '12 hours' THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '12 hours' AS session_end, count(*) AS n FROM i GROUP BY user_id, k""")  # fmt: skip
def session_windows(spark, sf_dir):
    return incremental.sessions(table(spark, sf_dir, "events"), "12 hours")
