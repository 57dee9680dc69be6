"""Operator 6's hot shards: many fingerprints that share their bits, cut into blocks, with the same links as brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import simhash
from strandline.llm.common import components


def dense(n: int) -> np.ndarray:
    """Two thirds of the fingerprints agree with one centre in all bits but the last 14, the others are random."""
    rng = np.random.default_rng(n)
    hot = np.uint64(0x1234567890 << 14) ^ rng.integers(0, 1 << 14, 2 * n // 3, np.int64).astype(np.uint64)
    near = hot[: n // 12] ^ np.uint64(1) ^ np.uint64(1 << 60)
    return np.unique(np.concatenate([hot, near, rng.integers(0, 1 << 63, n // 4, np.int64).astype(np.uint64)]))


def frame(spark, fps):
    return spark.createDataFrame([(int(x), (False, int(x), int(x), 0, 0)) for x in fps.view(np.int64)], f"fp bigint, node {simhash.NODE}")


@pytest.mark.parametrize("cut", [{"most": 64, "block": 100, "share": 4}, {"most": 200, "block": 64, "share": 1}])
def test_hot_shards_in_blocks(spark, cut):
    fps = dense(900)
    df = frame(spark, fps)
    hot = simhash.hot_shards(df, 5, simhash.RADIUS, cut["most"], cut["block"], cut["share"]).collect()
    assert hot and all(r.blocks >= 2 for r in hot)
    got = {r.node.fp: r.component.fp for r in components(simhash.links(df, blocks=5, **cut)).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= simhash.RADIUS
    root = np.arange(len(fps))
    while (root != (new := np.where(near, root[None], len(fps)).min(1))).any():
        root = new
    signed = fps.view(np.int64)
    assert near.sum() > 2 * len(fps)
    for k in set(root.tolist()):
        of = [int(x) for x in signed[root == k]]
        assert {got.get(x, x) for x in of} == {min(of)}


def test_a_hot_shard_is_no_single_task(spark):
    """No group of blocks holds more than a small share of the hot fingerprints, and each sees every two blocks once."""
    fps = dense(3000)
    df = frame(spark, fps)
    hot = simhash.hot_shards(df, 5, simhash.RADIUS, 500, 100, 1)
    cut = simhash.shards(df, 5).join(hot, "shard").withColumn("own", F.pmod(F.xxhash64(F.lit(6), "fp"), "blocks"))
    most = cut.groupBy("shard", "own").count().agg(F.max("count")).first()[0]
    assert most < 0.1 * len(fps)
