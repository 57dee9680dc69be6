"""Windows with exons: the exons name their windows, against windows made one by one."""

import random

from pyspark.sql import functions as F
from strandline.operators import transcripts
from strandline.plans import registry

SF = "/root/testdata/sf0.001"


def test_grid_as_single_windows(spark):
    rng = random.Random(5)
    rows = [(k, a, a + rng.choice([0, 1, 9, 40])) for k in (1, None, 3) for a in range(-100, 1500, 50) if rng.random() < 0.4]
    exons = spark.createDataFrame(rows, "k long, start long, end long")
    true = set()
    for k in (1, None, 3):
        for s in range(0, 901, 30):
            share = sum(max(0, min(s + 70, e) - max(s, a)) for i, a, e in rows if i == k) / 70
            if share >= 0.1:
                true.add((k, s, s + 70, round(share, 9)))
    got = transcripts.grid_windows_with_exons(exons, ["k"], 70, 30, 900, 0.1)
    assert {(r.k, r.window_start, r.window_end, round(r.exon_share, 9)) for r in got.collect()} == true
    windows = spark.range(31).select(F.lit(1).cast("long").alias("k"), (F.col("id") * 30).alias("window_start"), (F.col("id") * 30 + 70).alias("window_end"))
    plain = transcripts.windows_with_exons(windows, exons, ["k"], 0.1, 64)
    assert {(r.k, r.window_start, r.window_end, round(r.exon_share, 9)) for r in plain.collect()} == {t for t in true if t[0] == 1}
    assert "BroadcastExchange" not in plain._jdf.queryExecution().executedPlan().toString()


def test_no_window_without_an_exon_is_made(spark):
    plan = registry.queries()["exon_window_filter"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate" in line]
    assert len(made) == 1 and "start" in made[0]


def test_site_metrics_keep_a_row_a_site(spark):
    """the query's sites were rows of 61 offsets."""
    plan = registry.queries()["site_metrics"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_core" in plan and "sequence(" not in plan
