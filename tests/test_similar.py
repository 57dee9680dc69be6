"""Pairs of similar sequences against brute force."""

import random

from strandline.operators import transcripts


def test_similar_sequences_loses_no_pair(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(60)]
    texts = [" ".join(rng.sample(words, rng.randint(1, 9))) for _ in range(150)]
    texts += texts[:20] + [texts[0]] * 5 + ["ab", "", None, "abc", "abcde", "cdefg"]
    got = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    sets = {i: {t[x : x + 3] for x in range(len(t) - 2)} for i, t in enumerate(texts) if t and len(t) >= 3}
    for distance in (0.8, 0.4):
        true = {}
        for a, x in sets.items():
            for b, y in sets.items():
                if a < b and len(x & y) / len(x | y) >= 1 - distance - 1e-9:
                    true[a, b] = round(1 - len(x & y) / len(x | y), 9)
        rows = transcripts.similar_sequences(got, "item_id", "text", 3, distance).collect()
        assert len(rows) == len(true)
        assert {(r.a, r.b): round(r.distance, 9) for r in rows} == true
