"""Negatives of a quota against many copies of few real positions."""

from pyspark.sql import functions as F
from strandline.operators import labels


def test_real_positions_are_joined_once_each(spark):
    c = spark.range(200).select(F.col("id").alias("position"), F.lit("easy").alias("kind"))
    real = spark.range(4000).select((F.col("id") % 50).alias("position"))
    got = labels.stratified_negatives(c, real, ["position"], "kind", "position", {"easy": 1000})
    assert sorted(r.position for r in got.collect()) == list(range(50, 200))
    assert "Aggregate [position" in got._jdf.queryExecution().optimizedPlan().toString()
