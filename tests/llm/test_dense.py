"""Embedding near-duplicates: shards above a bound, in blocks, against brute force."""

import numpy as np
from strandline.llm import neargraph
from strandline.llm.common import components, written


def test_dense_group_in_blocks(spark):
    rng = np.random.default_rng(4)
    near = rng.normal(size=16) + rng.normal(size=(260, 16)) * rng.choice([0.02, 0.15, 0.3], size=(260, 1))
    x = np.concatenate([near, rng.normal(size=(240, 16))])
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "vec_id long, label long, embedding array<double>")
    nodes = written(neargraph.nodes_of(df)[1], "test-nodes")
    found = written(neargraph.links(nodes, most=20, block=16), "test-links")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= neargraph.COSINE) & (np.arange(500)[:, None] % 2 == np.arange(500)[None] % 2) & ~np.eye(500, dtype=bool)
    got = np.zeros(500, int)
    for r in found.groupBy("cid").sum("m").collect():
        got[r[0]] = r[1]
    assert true.any(1).sum() > 100 and np.array_equal(got, true.sum(1))
    root = np.arange(500)
    for _ in range(500):
        new = np.minimum(root, np.where(true, root[None], 500).min(1))
        if np.array_equal(new, root):
            break
        root = new
    reach = components(found.selectExpr("cid AS src", "root AS dst"), "test").collect()
    assert {r.node: r.component for r in reach} == {int(i): int(root[i]) for i in np.flatnonzero(true.any(1))}


def test_tight_group_without_comparisons(spark):
    """Near copies within half the angle of a centre are a core: a row a node, whatever the number of pairs."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=8) + rng.normal(size=(300, 8)) * 0.01
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "vec_id long, label long, embedding array<double>")
    nodes = written(neargraph.nodes_of(df)[1], "test-nodes")
    found = written(neargraph.links(nodes, most=100, block=50), "test-links")
    rows = {r[0]: (r[1], r[2]) for r in found.groupBy("cid").agg({"m": "sum", "*": "count"}).select("cid", "sum(m)", "count(1)").collect()}
    assert rows == {i: (299, 1) for i in range(300)}


def test_attempts_then_exact(spark, monkeypatch):
    """A walk that finds too little is widened, and replaced by the exact way in the end; an audit without links says nothing."""
    rng = np.random.default_rng(6)
    near = rng.normal(size=(40, 12)).repeat(6, 0) + rng.normal(size=(240, 12)) * 0.15
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(near)], "vec_id long, label string, embedding array<double>")
    nodes = written(neargraph.nodes_of(df)[1], "test-nodes")
    u = near / np.linalg.norm(near, axis=1, keepdims=True)
    want = {i: int(m) for i, m in enumerate((u @ u.T >= neargraph.COSINE).sum(1) - 1) if m}
    monkeypatch.setattr(neargraph, "links", lambda nodes, *a, **k: nodes.sparkSession.createDataFrame([], neargraph.LINKS))
    found, recall = neargraph.audited_links(nodes)
    assert recall == 1.0 and {r[0]: r[1] for r in found.groupBy("cid").sum("m").collect()} == want
    far = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(np.eye(12))], "vec_id long, label string, embedding array<double>")
    assert neargraph.audited_links(written(neargraph.nodes_of(far)[1], "test-nodes"))[1] is None


def test_guests_cross_shards():
    """A linked pair that shares no shard is found through a guest, and given as a pair."""
    x = np.array([[1.0, 0.0], [0.99, 0.1], [0.98, 0.19]])
    lists = np.array([[1, -1], [0, 2], [1, -1]])
    homes, core = np.array([[1, 2], [1, 2], [3, 4]]), np.full(3, neargraph.NONE)
    linked, _, far = neargraph.shard_links(x, 2, np.ones(3, np.int64), homes, core, 1, lists, 0.93, 4)
    assert linked.tolist() == [1, 1, 0] and sorted(map(tuple, far.tolist())) == [(0, 2), (1, 2)]


def test_small_label_beside_a_large_one(spark):
    """A small label has shards of its own size: no link of it is lost beside a label that has many centres."""
    rng = np.random.default_rng(9)
    big, one = rng.normal(size=(24_000, 16)), rng.normal(size=(150, 16))
    two = one + rng.normal(size=one.shape) * 0.27
    x = np.concatenate([big, one, two])
    df = spark.createDataFrame([(i, "big" if i < 24_000 else "small", v.tolist()) for i, v in enumerate(x)], "vec_id long, label string, embedding array<double>")
    small = x[24_000:] / np.linalg.norm(x[24_000:], axis=1, keepdims=True)
    want = ((small @ small.T >= neargraph.COSINE) & ~np.eye(300, dtype=bool)).sum(1)
    rows = neargraph.near_duplicates(df).where("vec_id >= 24000").collect()
    got = np.zeros(300, int)
    for r in rows:
        got[r.vec_id - 24_000] = r.n_links
    assert want.sum() > 100 and np.array_equal(got, want) and rows[0].audit_recall >= neargraph.ENOUGH


def test_tiers_and_guests_in_many_small_shards(spark, monkeypatch):
    """Labels of several tiers, with shards so small that nodes have several homes."""
    monkeypatch.setattr(neargraph, "SHARD", 40)
    rng = np.random.default_rng(10)
    sizes = {"a": 700, "b": 130, "c": 30}
    label = np.repeat(list(sizes), list(sizes.values()))
    x = rng.normal(size=(len(label) // 5, 8)).repeat(5, 0) + rng.normal(size=(len(label), 8)) * 0.2
    df = spark.createDataFrame([(i, str(a), v.tolist()) for i, (a, v) in enumerate(zip(label, x))], "vec_id long, label string, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= neargraph.COSINE) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r.n_links for r in neargraph.near_duplicates(df).collect()}
    for a in sizes:
        at = np.flatnonzero(label == a)
        assert sum(got[i] for i in at) >= 0.95 * true[at].sum() > 0
    assert all(got[i] <= true[i].sum() for i in range(len(x)))
