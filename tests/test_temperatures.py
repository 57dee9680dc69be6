"""Class-wise temperatures: no gradient is left at the result, bounds hold, and a grid finds nothing better."""

import numpy as np
from strandline.operators import evaluation

Z = ["a", "b", "c"]
ROWS = "a double, b double, c double, y int"


def drawn(inverse, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    z = rng.normal(0, 2, (n, 3))
    p = np.exp(z * inverse)
    p /= p.sum(1, keepdims=True)
    return z, (p.cumsum(1) < rng.random((n, 1))).sum(1)


def nll(z, y, b):
    s = z * b
    return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))


def test_least_value_inside(spark):
    z, y = drawn(np.array([0.5, 2.0, 1.0]))
    rows = [(*map(float, v), int(k)) for v, k in zip(z, y)] + [(1.0, None, 2.0, 0), (1.0, 2.0, 3.0, None), (1.0, 2.0, 3.0, 7)]
    got = evaluation.fit_class_temperatures(spark.createDataFrame(rows, ROWS), Z, "y")
    b = 1 / np.array(got["temperature"])
    assert np.abs(got["gradient"]).max() < 1e-10 and got["steps"] < 12
    assert np.isclose(got["nll_before"], nll(z, y, np.ones(3))) and np.isclose(got["nll_after"], nll(z, y, b))
    around = [b + np.array(d) for d in np.ndindex(3, 3, 3) for d in [(np.array(d) - 1) * 0.02]]
    assert min(nll(z, y, x) for x in around) >= got["nll_after"] - 1e-12
    assert np.allclose(b, [0.5, 2.0, 1.0], atol=0.25)


def test_bounds_and_no_rows(spark):
    z, _ = drawn(np.ones(3), 400)
    best = [(*map(float, v), int(np.argmax(v))) for v in z]  # always right: colder is better
    worst = [(*map(float, v), int(np.argmin(v))) for v in z]
    cold = evaluation.fit_class_temperatures(spark.createDataFrame(best, ROWS), Z, "y")
    hot = evaluation.fit_class_temperatures(spark.createDataFrame(worst, ROWS), Z, "y")
    for got in (cold, hot):  # no gradient, or one that pushes against the bound
        for t, g in zip(got["temperature"], got["gradient"]):
            assert evaluation.COOLEST <= t <= evaluation.HOTTEST
            assert abs(g) < 1e-9 or (t == evaluation.COOLEST and g < 0) or (t == evaluation.HOTTEST and g > 0)
    assert evaluation.COOLEST in cold["temperature"] and evaluation.HOTTEST in hot["temperature"]
    assert cold["nll_after"] < cold["nll_before"] and hot["nll_after"] < hot["nll_before"]
    none = evaluation.fit_class_temperatures(spark.createDataFrame([], ROWS), Z, "y")
    assert none["temperature"] == [1.0] * 3 and none["nll_after"] is None
