"""Counters kept as a stream's state over two restarts, with late genes and a batch that runs twice, against the batch query."""

import random

from pyspark.sql import functions as F
from strandline.operators import evaluation
from strandline.streaming import metrics

CLASSES = ["d", "a", "n"]
ROWS = "gene string, position long, y int, d double, a double, n double"


def some(seed, genes, n):
    rng = random.Random(seed)
    return [(rng.choice(genes), rng.randrange(10_000), rng.choice([0, 1, 2, 2, 2, None]), rng.random(), rng.choice([0.0, 1.0, rng.random()]), rng.choice([None, rng.random(), rng.random()])) for _ in range(n)]


def test_two_restarts_and_late_genes(spark, tmp_path):
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    given = [some(1, ["g1", "g2"], 500), some(2, ["g3"], 400), some(3, ["g1", "g4", "g2", None], 300)]  # g1 and g2 come again, late
    provider = spark.conf.get(metrics.PROVIDER)
    for rows in given:
        spark.createDataFrame(rows, ROWS).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 5).parquet(source)
        metrics.accumulate(stream, out, checkpoint, "y", CLASSES, "gene", shards=4)
    assert spark.conf.get(metrics.PROVIDER) == provider
    got = metrics.totals(spark, out)
    whole = spark.createDataFrame([r for rows in given for r in rows], ROWS).where("y IS NOT NULL").dropna(subset=CLASSES)
    true = {r.class_index: (r.n_true, r.tp, r.fp, r.fn) for r in evaluation.confusion_by_class(whole, "y", CLASSES).collect()}
    assert {r.class_index: (r.n_true, r.tp, r.fp, r.fn) for r in got.collect()} == true
    assert {r.n_rows for r in got.collect()} == {whole.count()}
    sweep = {(r.class_index, round(r.threshold, 2)): (r.tp, r.fp, r.fn, r.precision) for r in metrics.swept(got).collect()}
    assert len(sweep) == 300
    for i, c in enumerate(CLASSES):
        for r in evaluation.threshold_sweep(whole.select((F.col("y") == i).cast("int").alias("hit"), F.floor(F.col(c) * 100).alias("s")), "hit", "s", [0, 17, 50, 99]).collect():
            assert sweep[i, round(r.threshold / 100, 2)] == (r.tp, r.fp, r.fn, r.precision)
    assert {r.class_index: r.recall for r in metrics.class_metrics(got).collect()} == {r.class_index: r.recall for r in evaluation.with_rates(got).collect()}

    # Nothing new: nothing changes. A batch whose folder is written again, as after a failure, counts once.
    metrics.accumulate(spark.readStream.schema(ROWS).parquet(source), out, checkpoint, "y", CLASSES, "gene", shards=4)
    again = metrics.totals(spark, out)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
