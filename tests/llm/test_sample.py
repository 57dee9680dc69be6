"""The quality classifier's training sample on a table with one text in many copies."""

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import quality


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    texts = [f"A plain sentence number {i} about rivers, boats and the weather of the coast." for i in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    low = df.orderBy(F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(1 << 30))).first().text
    docs = df.unionByName(spark.createDataFrame([(low,)] * 200, "text string"))
    seen, fit = [], quality.fit_logistic
    monkeypatch.setattr(quality, "fit_logistic", lambda x, y, *rest: seen.append((len(x), *rest)) or fit(x, y, *rest))
    quality.train(docs, 50)
    assert seen[0][0] == 50
    assert np.isclose(seen[0][1].max() / seen[0][1].min(), 1 + np.log(201))
    got = quality.draw(docs, 50)
    assert sorted(got["n"])[-2:] == [1, 201] and got["h"].is_unique
    assert len(quality.draw(docs, 1000)) == 400
