"""How much work alignment does: sequences are made once, poor hits are left early, and many tables are filled in side by side with the results of one at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandline.operators import alignment

code = lambda x: np.frombuffer(x.encode(), np.uint8)


def changed(rng, text, rate):
    return "".join("" if (x := rng.random()) < rate / 3 else rng.choice("ACGT") if x < rate * 2 / 3 else c + rng.choice("ACGT") if x < rate else c for c in text)


def test_sequences_are_made_once(spark):
    rng = random.Random(2)
    made = spark.sparkContext.accumulator(0)

    def make(text):
        made.add(1)
        return text

    train = [(f"t{i}", "".join(rng.choices("ACGT", k=500))) for i in range(20)]
    test = [(f"q{i}", changed(rng, train[i][1], 0.05)) for i in range(10)]
    df, base = (spark.createDataFrame(x, "id string, seq string").withColumn("seq", F.udf(make, "string")("seq")) for x in (test, train))
    assert {(r.id, r.target) for r in alignment.paralogs(df, base, "id", "seq").collect()} == {(f"q{i}", f"t{i}") for i in range(10)}
    assert made.value == len(test) + len(train)


def test_poor_hits_are_left_before_their_gaps_are_aligned(monkeypatch):
    rng = random.Random(5)
    word = "".join(rng.choices("ACGT", k=40))
    far = lambda: word.join("".join(rng.choices("ACGT", k=300)) for _ in range(5))
    query, target = far(), far()
    at = [query.index(word, i * 340) for i in range(4)], [target.index(word, i * 340) for i in range(4)]
    whole = alignment.hit(query, target, *map(np.array, at))
    assert whole[4] / whole[5] < 0.8
    assert alignment.hit(query, target, *map(np.array, at), identity=whole[4] / whole[5], coverage=whole[5] / len(query)) == whole
    asked = []
    monkeypatch.setattr(alignment, "all_aligned", lambda pairs: asked.extend(pairs) or [])
    assert alignment.hit(query, target, *map(np.array, at), identity=0.8) is None and not asked


def plain_chain(q, t, k=15, gap=1000, back=64):
    score, came = [float(k)] * len(q), [-1] * len(q)
    for i in range(len(q)):
        best = k
        for j in range(max(0, i - back), i):
            dq, dt = q[i] - q[j], t[i] - t[j]
            if 0 < dq <= gap and 0 < dt <= gap and score[j] + min(dq, dt, k) - 0.01 * abs(dq - dt) > best:
                score[i], came[i] = (best := score[j] + min(dq, dt, k) - 0.01 * abs(dq - dt)), j
    return came, score.index(max(score))


@pytest.mark.parametrize("seed", range(3))
def test_side_by_side_is_as_one_at_a_time(seed):
    rng = random.Random(seed)
    groups = []
    for _ in range(60):
        q = sorted(rng.randrange(rng.choice([60, 900, 6000])) for _ in range(rng.choice([3, 4, 9, 70, 150])))
        groups.append(sorted((x, max(0, x + rng.choice([0, 0, 5, -3, 400, -1500]))) for x in q))
    sizes = np.array([len(g) for g in groups])
    starts = np.cumsum(sizes) - sizes
    q, t = (np.array([x[side] for g in groups for x in g]) for side in (0, 1))
    came, last = alignment.best_chains(q, t, starts, sizes)
    for g, a, n, end in zip(groups, starts, sizes, last):
        assert (came[a : a + n].tolist(), end) == plain_chain(*zip(*g))
    pairs = []
    for _ in range(80):
        a = "".join(rng.choices("ACGT", k=rng.randrange(rng.choice([5, 60, 400]))))
        pairs.append((code(a), code(changed(rng, a, rng.choice([0, 0.05, 0.3])) + "".join(rng.choices("ACGT", k=rng.randrange(rng.choice([5, 300])))))))
    assert alignment.all_extended(pairs) == [alignment.extended(*x) for x in pairs]
    assert alignment.all_aligned(pairs) == [alignment.aligned(*x) for x in pairs]
    assert [alignment.distance(*x) for x in pairs] == [columns - matches for matches, columns in alignment.all_aligned(pairs)]
