"""Scans over ranges, and what is built on them, against plain Python; one key or value has most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import intervals, scans, windows

PLAIN = lambda rows: sorted(map(repr, map(tuple, rows)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    return [(rng.choice(["a", "a", "a", "b", None]), 50 if rng.random() < 0.4 else rng.randrange(-100, 400), i, rng.choice([None, rng.randrange(100)])) for i in range(3000)]


def test_scan(spark, rows):
    df = spark.createDataFrame(rows, "k string, p long, i long, v long").repartition(5)
    got = scans.scan(df, ["k"], ["p", "i"], total=("sum", "v"), top=("max_before", "v"), seen=("last", "v"), coming=("next", F.col("v") + 0))
    true = []
    for key in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for n, r in enumerate(mine):
            before, on = [x[3] for x in mine[:n] if x[3] is not None], [x[3] for x in mine[n:] if x[3] is not None]
            upto = before + ([r[3]] if r[3] is not None else [])
            true.append((*r, sum(upto), max(before, default=None), upto[-1] if upto else None, on[0] if on else None))
    assert PLAIN(got.collect()) == PLAIN(true)
    whole = scans.scan(df.where("k = 'a'"), [], ["p", "i"], n=("sum", F.lit(1)))
    assert sorted(r.n for r in whole.collect()) == list(range(1, whole.count() + 1))


def test_no_range_has_much_of_the_table(spark, rows):
    """Two fifths of the rows share a position: the second column cuts them."""
    df = spark.createDataFrame(rows, "k string, p long, i long, v long")
    assert df.groupBy(scans.ranges(df, ["p", "i"]).alias("r")).count().agg(F.max("count")).first()[0] < 3000 / 12
    assert df.groupBy(scans.ranges(df, ["p"]).alias("r")).count().agg(F.max("count")).first()[0] > 1000
    assert df.limit(0).groupBy(scans.ranges(df.limit(0), ["p", "i"]).alias("r")).count().count() == 0
    texts = df.select(F.concat(F.lit("gene"), F.lpad("i", 5, "0")).alias("t"))
    assert texts.groupBy(scans.ranges(texts, ["t"]).alias("r")).count().count() > 8


def test_windows_have_ranges_beside_the_key(spark, rows):
    df = spark.createDataFrame(rows, "k string, p long, i long, v long").withColumn("e", F.col("p") + 5)
    for got in (windows.merge_intervals(df, "p", "e", ["k"]), windows.chunk_numbers(df, 10, ["k"], ["p", "i"]), windows.nearest_flagged(df.withColumn("f", F.col("v") > 90), "f", "p", ["k"], ["p", "i"])):
        plan = got._jdf.queryExecution().analyzed().toString()
        keyed = [line for line in plan.split("\n") if "Window [" in line and "_scan_of" not in line]
        assert keyed and all("_scan_at" in line.split("], [", 1)[-1] for line in keyed if "windowspecdefinition" in line), plan


def test_merge_against_a_sweep(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), a, a + rng.choice([0, 1, 7, 90])) for a in (rng.randrange(4000) for _ in range(900))] + [("x", 10_000, 10_001)] * 500 + [("x", None, 5), ("y", 3, None)]
    got = windows.merge_intervals(spark.createDataFrame(rows, "c string, s long, e long"), "s", "e", ["c"])
    true = []
    for c in "xy":
        island = None
        for _, s, e in sorted(r for r in rows if r[0] == c and r[1] is not None and r[2] is not None):
            if island and s <= island[2]:
                island = (c, island[1], max(island[2], e), island[3] + 1)
                true[-1] = island
            else:
                island = (c, s, e, 1)
                true.append(island)
    assert PLAIN(got.select("c", "s", "e", "n_merged").collect()) == PLAIN(true)


def test_overlaps_without_pairs(spark):
    rng = random.Random(5)
    rows = [("c", i, a, a + rng.choice([0, 3, 40, 700, 5000])) for i, a in enumerate(rng.randrange(-2000, 3000) for _ in range(400))]
    rows += [("d", i, 7, 9) for i in range(60)] + [("d", 60, 100, 100), ("e", 1, 5, 4), ("e", 2, None, 4), (None, 3, 1, 9), (None, 4, 1, 9)]
    got = intervals.overlap_summary(spark.createDataFrame(rows, "chrom string, id long, start long, end long").repartition(4), ["chrom"], "id")
    true = []
    for c, i, a, b in rows:
        near = sorted((s, j) for d, j, s, e in rows if c is not None and d == c and j != i and None not in (a, s) and a <= b and s <= e and a <= e and s <= b)
        true.append((c, i, len(near), ",".join(str(j) for _, j in near[:10])))
    assert PLAIN(got.select("chrom", "id", "n_overlaps", "overlaps").collect()) == PLAIN(true)
    assert "Cartesian" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_nearest_at_any_distance(spark):
    rng = random.Random(9)
    points = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(100_000)) for _ in range(800)] + [("a", 50)] * 5 + [("b", None), ("a", None)]
    marks = [("a", rng.randrange(100_000)) for _ in range(70)] + [("a", 40), ("a", 60), ("a", 60), ("b", 500), (None, 9), ("a", None)]
    got = intervals.nearest_at_any_distance(spark.createDataFrame(points, "gene string, position long"), spark.createDataFrame(marks, "gene string, mark long"), ["gene"])
    assert got.columns == ["gene", "position", "mark_distance"]
    true = []
    for g, p in points:
        near = min(((abs(m - p), m) for k, m in marks if k == g and m is not None), default=None) if p is not None else None
        true.append((g, p, near and near[1] - p))
    assert PLAIN(got.collect()) == PLAIN(true)


def test_top_k_ranks_ranges(spark):
    """One group has half of the table and one score a third of it; k differs from group to group."""
    rng = random.Random(2)
    rows = [(0 if i % 2 else i % 40, rng.choice([None, 0.25, 0.25, float("nan"), rng.random(), rng.random()]) if i % 3 else 0.5, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g long, score double, i long").withColumn("k", F.col("g") * 3 + 700).repartition(6)
    order = lambda r: (r[1] is None, not (r[1] is not None and r[1] != r[1]), -(r[1] or 0), r[2])
    true = sorted((r[2], n) for g in {r[0] for r in rows} for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=order), 1) if n <= g * 3 + 700)
    got = scans.top_k(df, "score", F.col("k"), ["g"], ["i"])
    assert sorted((r.i, r["rank"]) for r in got.collect()) == true
    most = df.groupBy("g", scans.ranges(df, ["score", "i"]).alias("r")).count().agg(F.max("count")).first()[0]
    assert most < 4000 / 12
    assert scans.top_k(df.limit(0), "score", F.col("k"), ["g"], ["i"]).count() == 0
