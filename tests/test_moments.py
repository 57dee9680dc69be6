"""Components from moments of batches in any order, against one pass of numpy."""

import itertools

import numpy as np
from strandline.operators import moments


def test_batches_in_any_order(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 7)) @ np.diag([5, 3, 2, 1, 1, 0.5, 0.1]) + 1000.0  # far from zero
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [1.0] * 3), (902, [float("nan")] * 7), (903, [float("inf")] * 7), (904, [])]
    df = spark.createDataFrame(rows + odd, "id long, embedding array<double>").repartition(5)
    cuts = {"a": df.where("id < 100 OR id >= 900"), "b": df.where("id >= 100 AND id < 110"), "c": df.where("id >= 110 AND id < 900")}
    mean, cov = x.mean(0), np.cov(x.T)
    values, vectors = np.linalg.eigh(cov)
    for n, order in enumerate(list(itertools.permutations("abc"))[::2]):
        folder = f"{tmp_path}/{n}"
        for name in (*order, order[0]):  # the first batch again takes its own place
            moments.partial_fit(cuts[name], folder, name)
        got, axes, variances = moments.components(moments.merged(moments.held_moments(spark, folder)), 3)
        assert np.allclose(got, mean, rtol=0, atol=1e-9) and np.allclose(variances, values[::-1][:3], rtol=1e-9)
        for axis, true in zip(axes, vectors.T[::-1]):
            assert np.allclose(axis, true * np.sign(true[np.abs(true).argmax()]), atol=1e-9)
    table = {(r.i, r.j): r for r in moments.explained(moments.batch_moments(moments.usable(df, "embedding"))).collect()}
    assert len(table) == 28 and all(abs(table[i, j].covariance - cov[i, j] * 599 / 600) < 1e-9 and table[i, j].n == 600 for i, j in table)


def test_nothing_to_fit(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "id long, embedding array<float>")
    moments.partial_fit(none, f"{tmp_path}/m", "a")
    assert moments.components(moments.merged(moments.held_moments(spark, f"{tmp_path}/m")), 2) == ([], [], [])
    assert moments.held_moments(spark, f"{tmp_path}/none") is None
