"""Paralogs by seeds and chains against whole alignments of every pair."""

import random

import numpy as np
from strandline.operators import alignment

TURN = str.maketrans("ACGT", "TGCA")


def changed(rng, text, rate, insert=0):
    out = [rng.choice("ACGT") if rng.random() < rate else c for c in text]
    at = rng.randrange(len(out))
    return "".join(out[:at]) + "".join(rng.choices("ACGT", k=insert)) + "".join(out[at:])


def whole(a, b):
    code = lambda x: np.frombuffer(x.encode(), np.uint8)
    m, n = max((alignment.aligned(code(x), code(b)) for x in (a, a.translate(TURN)[::-1])), key=lambda r: r[0] / r[1])
    return m / n


def test_planted_families(spark):
    rng = random.Random(8)
    train = {f"t{i}": "".join(rng.choices("ACGT", k=rng.randint(400, 900))) for i in range(30)}
    test, made = {}, {}
    for i in range(24):
        of = f"t{i}"
        seq = changed(rng, train[of], [0.0, 0.05, 0.12][i % 3], [0, 40, 20][i % 3])
        test[f"q{i}"], made[f"q{i}"] = (seq if i % 2 else seq.translate(TURN)[::-1]), of
    test |= {f"x{i}": "".join(rng.choices("ACGT", k=600)) for i in range(12)}
    test |= {"copy": test["q3"], "short": "ACGT", "none": None, "part": train["t5"][:300] + "".join(rng.choices("ACGT", k=900)), "letters": "N" * 500, "odd": "é" * 60 + train["t6"]}
    frame = lambda d, extra: spark.createDataFrame([*d.items(), *extra], "id string, seq string").repartition(3)
    df, base = frame(test, [(None, train["t1"])]), frame(train, [("again", train["t2"].lower()), ("q4", test["q4"])])
    found = {r.id: r for r in alignment.paralogs(df, base, "id", "seq").collect()}
    assert set(found) == {*made, "copy", "odd"}
    assert all(found[q].target == t for q, t in made.items() if q != "q2") and found["q2"].target in ("again", "t2")
    for q, t in made.items():  # the whole alignment has the ends too, which may be less alike
        assert -0.02 < found[q].identity - whole(test[q], train[t]) < 0.1 and found[q].coverage > 0.8
    far = max(whole(test[f"x{i}"], train[f"t{j}"]) for i in range(3) for j in range(3))
    assert far < 0.7
    looser = {r.id for r in alignment.paralogs(df, base, "id", "seq", coverage=0.2).collect()}
    assert looser == {*found, "part"}
    every = alignment.hits(df, base, "id", "seq").where("query = 'q1' AND target = 't1'").first()
    assert every.forward and (every.q_end - every.q_start + 1) <= len(test["q1"]) and every.t_end <= len(train["t1"])
    assert alignment.paralogs(df.limit(0), base, "id", "seq").count() == 0


def test_alignment_of_least_cost():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ("".join(rng.choices("AC", k=rng.randint(0, 9))) for _ in range(2))
        best = [[(i + j, 0) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                c, m = best[i - 1][j - 1]
                same = a[i - 1] == b[j - 1]
                best[i][j] = min((best[i - 1][j][0] + 1, best[i - 1][j][1]), (best[i][j - 1][0] + 1, best[i][j - 1][1]), (c + (not same), m - same))
        cost, matches = best[-1][-1]
        assert alignment.aligned(*(np.frombuffer(x.encode(), np.uint8) for x in (a, b))) == (-matches, cost - matches)


def test_extension_stops_where_likeness_does():
    rng = random.Random(6)
    code = lambda x: np.frombuffer(x.encode(), np.uint8)
    same = "".join(rng.choices("ACGT", k=300))
    far, other = ("".join(rng.choices("ACGT", k=400)) for _ in range(2))
    matches, columns, a, b = alignment.extended(code(changed(rng, same, 0.1) + far), code(same + other))
    assert abs(a - 300) < 25 and abs(b - 300) < 25 and 0.86 < matches / columns < 0.94
    assert alignment.extended(code(same), code(same)) == (300, 300, 300, 300)
    assert alignment.extended(code("AC"), code("")) == (0, 0, 0, 0) == alignment.extended(code(""), code("AC"))
    assert alignment.extended(code("A" * 40 + "CC" + "A" * 40), code("A" * 80))[:2] == (80, 82)


def test_seeds_are_of_both_strands():
    rng = random.Random(1)
    text = "".join(rng.choices("ACGT", k=500))
    h, at, forward = alignment.minimizers(text)
    h2, at2, forward2 = alignment.minimizers(text.translate(TURN)[::-1])
    assert sorted(zip(h.tolist(), at.tolist(), forward.tolist())) == sorted((x, 500 - 15 - p, not f) for x, p, f in zip(h2.tolist(), at2.tolist(), forward2.tolist()))
    assert 500 / 10 < len(h) < 500 / 3 and alignment.minimizers("ACGT")[0].size == 0 and alignment.minimizers("N" * 99)[0].size == 0


def test_pairs_of_seeds_are_not_shuffled_as_rows(spark):
    """Train minimizers that no test sequence has stay where they are, and texts follow only chains that are long enough; a full sieve changes nothing."""
    rng = random.Random(4)
    train = [(f"t{i}", "".join(rng.choices("ACGT", k=500))) for i in range(40)]
    test = [("q0", changed(rng, train[0][1], 0.03)), ("q1", train[1][1][:60] + "".join(rng.choices("ACGT", k=600)))]
    df, base = (spark.createDataFrame(x, "id string, seq string") for x in (test, train))
    seen = df.selectExpr("xxhash64(seq) AS class", "seq AS sequence")
    asked = alignment.seeds(seen, 15, 10)
    posted = alignment.seeds(base.selectExpr("xxhash64(seq) AS class", "seq AS sequence"), 15, 10, alignment.sieve_of(asked, 1 << 20))
    every = alignment.seeds(base.selectExpr("xxhash64(seq) AS class", "seq AS sequence"), 15, 10)
    assert posted.count() < every.count() / 10 and posted.join(asked, "hash").count() == every.join(asked, "hash").count()
    before = alignment.hits(df, base, "id", "seq").collect()
    keep, alignment.SIEVE = alignment.SIEVE, 64
    try:
        assert sorted(alignment.hits(df, base, "id", "seq").collect()) == sorted(before) != []
    finally:
        alignment.SIEVE = keep
    assert alignment.chain(np.array([0, 20, 40]), np.array([5, 25, 45]), 600, 15, 0.25) is None
