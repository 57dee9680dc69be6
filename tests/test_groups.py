"""Groups with most of the rows: pairing, balance and downsampling against brute force, and the rows that a group or window sees."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandline.operators import junctions, labels, variants


def hashed(i):
    return (i % 1000003 + 42) * 2654435761 % (1 << 32) % (1 << 31)


def test_pair_events_by_chains(spark):
    rng = random.Random(3)
    rows = [("u", rng.choice(["donor", "acceptor"]), rng.randrange(20_000) + 50_000 * (i % 3), rng.choice([-1, 1]) * rng.randint(1, 40) / 40) for i in range(700)]
    rows += [(None, "donor", 5, -0.5), (None, "donor", 9, 0.5), ("v", "donor", 7, -0.25)]
    true, used = [], set()
    for v, c, p, d in sorted((r for r in rows if r[3] < 0), key=lambda r: (r[3], r[2])):
        near = [(-g[3], g[2], k) for k, g in enumerate(rows) if g[3] > 0 and g[:2] == (v, c) and abs(g[2] - p) <= 100 and k not in used]
        best = min(near, default=None)
        used |= {best[2]} if best else set()
        true.append((v, c, p, d, best and best[1], best and -best[0]))
    e = spark.createDataFrame([(*r, "gain" if r[3] > 0 else "loss") for r in rows], "variant string, channel string, position long, delta double, direction string")
    got = variants.pair_events(e, "variant", 100)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, true))
    assert "_chain" in got._jdf.queryExecution().optimizedPlan().toString()


def test_many_short_chains_are_few_calls(spark, monkeypatch):
    """a call a chain cost milliseconds each. Chains go over batches' ends here, and a null position pairs with nothing."""
    calls = []
    rng = random.Random(5)
    rows = [(None if v % 50 == 0 else v + 2**53, 40 * k + rng.randrange(30), rng.choice([-1, 1]) * rng.randint(1, 9) / 10) for v in range(400) for k in range(rng.randint(1, 4))]
    rows += [(7, rng.randrange(900), rng.choice([-1, 1]) * rng.randint(1, 9) / 10) for _ in range(300)] + [(9, None, -0.5), (9, None, 0.5)]
    true, used = [], set()
    for v, p, d in sorted((r for r in rows if r[2] < 0), key=lambda r: (r[2], r[1] or 0)):
        near = [(-g[2], g[1], k) for k, g in enumerate(rows) if g[2] > 0 and g[0] == v and None not in (p, g[1]) and abs(g[1] - p) <= 35 and k not in used]
        best = min(near, default=None)
        used |= {best[2]} if best else set()
        true.append((v, "donor", p, d, best and best[1], best and -best[0]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        e = spark.createDataFrame([(v, "donor", p, d, "gain" if d > 0 else "loss") for v, p, d in rows], "variant long, channel string, position long, delta double, direction string")
        got = variants.pair_events(e, "variant", 35)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, true))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(variants, "strongest_free", lambda *a, f=variants.strongest_free: calls.append(1) or f(*a))
    chains = pa.RecordBatch.from_pydict({"_variant": list(range(900)) * 2, "channel": ["donor"] * 1800, "position": [5] * 1800, "delta": [0.5, -0.5] * 900, "direction": ["gain", "loss"] * 900, "_k": pa.array([1, 2] * 900, pa.int32())})
    assert sum(b.num_rows for b in variants.pair_chains([chains], 35, list("abcdef"))) == 900 and len(calls) == 1


def test_strongest_free_is_not_quadratic():
    n = 60_000
    taken = variants.strongest_free(np.arange(n), np.arange(n), n)
    assert taken.tolist() == list(range(n))
    assert variants.strongest_free(np.zeros(0, int), np.arange(3), 5).tolist() == [-1, -1, -1]


def test_balance_and_downsample_rank_one_range(spark):
    rows = [(i, "a" if i % 3 else None if i % 2 else "b") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, kind string")
    order = lambda keep: sorted((i for i, k in rows if keep(k)), key=lambda i: (hashed(i), i))
    got = labels.balance(df, "kind", "id").toPandas()
    for kind in ("a", "b", None):
        mine = got[got["kind"].isna()] if kind is None else got[got["kind"] == kind]
        assert sorted(mine["id"]) == sorted(order(lambda k: k == kind)[:500])
    few = labels.downsample(df.where("kind IS NOT NULL"), F.col("kind") == "b", "id", 1.5)
    assert sorted(r.id for r in few.where("kind = 'a'").collect()) == sorted(order(lambda k: k == "a")[:750])
    assert few.where("kind = 'b'").count() == 500
    assert labels.downsample(df, F.col("kind") == "c", "id", 1.5).count() == 0
    for out in (labels.balance(df, "kind", "id"), few):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "_rows" in plan and "GlobalLimit" not in plan


def test_tissue_sums_are_made_of_rows_dealt_by_junction(spark):
    """a task summed up junctions of all rows that lie with its samples, nearly one a row."""
    rng = random.Random(11)
    rows = [(0 if i % 3 else rng.choice([None, *range(200)]), rng.choice([None, *range(30)]), rng.choice([None, 0, 0, 1, 5])) for i in range(6000)]
    of = {s: f"T{s % 4}" for s in range(25)}
    true = {}
    for j, s, n in rows:
        if s in of:
            held = true.setdefault((j, of[s]), [0, 0])
            held[0] += n or 0
            held[1] += (n or 0) > 0
    counts = spark.createDataFrame(rows, "junction int, sample int, reads long")
    got = junctions.tissue_matrix(counts, spark.createDataFrame(list(of.items()), "sample int, tissue string"), "junction")
    assert {(r.junction, r.tissue): [r.total_reads, r.n_samples] for r in got.collect()} == {k: v for k, v in true.items() if v[0] > 0}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan and "SortMergeJoin" not in plan
