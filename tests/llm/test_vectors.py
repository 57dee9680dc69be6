"""The vector operators: fewer candidates on clustered vectors, lengths apart, queries in small leaves."""

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import ann, neargraph
from strandline.llm.common import written


def test_few_candidates_on_clusters(spark):
    """Clustered vectors: recall of 0.9 or more from under a fifth of the rows."""
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(60, 32))[rng.integers(0, 60, 6000)] + 0.4 * rng.normal(size=(6000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    f = ann.fit(x, 7)
    classes = written(df.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("v")), "test-classes")
    visits, said = ann.plan(classes, classes.where("cid % 50 = 0").select(F.col("cid").alias("qid"), "v"), f)
    leaf = ann.route(x, f)
    share = np.mean([np.isin(leaf, row).any(1).mean() for row in ann.queue(x[::50], f, visits)])
    found = ann.nearest(df, F.col("vec_id") % 50 == 0)
    assert said >= 0.9 and share < 0.2 and ann.recall(df, F.col("vec_id") % 50 == 0, found) >= 0.9


def test_lengths_apart(spark):
    """Vectors of a rarer length are compared among themselves, by both operators."""
    rows = [(i, [1.0, float(i), 0.5], 1) for i in range(20)] + [(100 + i, [1.0, 0.001 * i], 1) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {}
    for r in ann.nearest(df, F.col("vec_id").isin(0, 100)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert [v for _, v in sorted(got[100])] == [101, 102, 103, 104] and len(got[0]) == 10 and all(v < 20 for _, v in got[0])
    linked = {r.vec_id: r for r in neargraph.near_duplicates(df).collect()}
    assert all(linked[100 + i].n_links == 4 and linked[100 + i].component_id == 100 for i in range(5))


def test_short_queries_see_all(spark):
    """A query whose leaves hold fewer than K members still gets K neighbours: a far point beside a tight group."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(400, 8)) * 1e-3 + 1, [[50.0] * 8], [[-50.0] * 8]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") >= 400, leaf=2).collect()
    assert sorted(r["rank"] for r in got) == sorted([*range(1, 11)] * 2)
