"""Side-by-side comparisons and browsing."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import roc_auc, with_rates
from .labels import key_hash
from .windows import running_totals


def compare_models(df: DataFrame, label: str, scores: dict[str, str], threshold=0.5) -> DataFrame:
    """A row a model: counts and rates at the threshold, from one scan."""
    each = df.select(F.col(label).alias("_y"), F.explode(F.create_map(*(x for name, c in scores.items() for x in (F.lit(name), F.col(c))))).alias("model", "_s"))
    hit, true = F.col("_s") >= threshold, F.col("_y") == 1
    n = lambda c: F.sum(c.cast("long"))
    return with_rates(each.groupBy("model").agg(n(hit & true).alias("tp"), n(hit & ~true).alias("fp"), n(~hit & true).alias("fn")))


def reduction(compared: DataFrame, base: str, other: str) -> DataFrame:
    """By how much the other model has fewer misses and false alarms."""
    of = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    cut = lambda c: F.when(of(base, c) > 0, 1 - of(other, c) / of(base, c)).otherwise(F.lit(0.0))
    return compared.agg(cut("fn").alias("fn_reduction"), cut("fp").alias("fp_reduction"))


def outside(evaluated: DataFrame, reference: DataFrame, on: list[str]) -> DataFrame:
    """Rows at sites that the reference annotation lacks."""
    return evaluated.join(reference, on, "left_anti")


def rank_correlations(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Spearman's correlation of each pair. Values are ranked once each (ties share their mean rank), range by range."""
    ranks = df.select(key)
    for c in columns:
        n = df.groupBy(c).agg(F.count("*").alias("_n"))
        ranked = running_totals(n, c, ["_n"]).select(c, (F.col("_n_upto") - (F.col("_n") - 1) / 2).alias("_r"))
        ranks = ranks.join(df.select(key, c).join(ranked, c).select(key, F.col("_r").alias(c)), key)
    wide = ranks.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in combinations(columns, 2)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("spearman")) for a, b in combinations(columns, 2)))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def rescue(df: DataFrame, label: str, base: str, channels: list[str], threshold: float) -> DataFrame:
    """Each channel's ROC-AUC of positives that the base score leaves under the threshold, and of all positives, against all negatives."""
    unsure = (F.col(label) == 0) | (F.col(base) < threshold)
    parts = F.array_compact(F.array(F.lit("all"), F.when(unsure, "uncertain")))
    per = F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("_value")) for c in channels))
    long = df.select(F.col(label).cast("int").alias("_label"), F.explode(parts).alias("_part"), per.alias("_per")).select("_label", "_part", F.explode("_per").alias("r")).select("_label", "_part", "r.*")
    of = lambda part, c: F.max(F.when(F.col("_part") == part, F.col(c))).alias(f"{c}_{part}")
    counts = long.groupBy("channel").agg(F.sum(F.when(F.col("_part") == "uncertain", F.col("_label"))).alias("n_uncertain"))
    areas = roc_auc(long, "_label", "_value", ["channel", "_part"]).groupBy("channel").agg(of("uncertain", "roc_auc"), of("all", "roc_auc"))
    return counts.join(areas, "channel")


def incremental_auc(df: DataFrame, label: str, base: list[str], groups: dict[str, list[str]], key: str, train_share=0.7, seed=42) -> DataFrame:
    """ROC-AUC on held-out rows of a logistic regression (classes of equal weight) on the base columns, and its lift with each group's columns. Null values count as 0."""
    held = key_hash(key, 1000, seed) >= round(train_share * 1000)
    every = list(dict.fromkeys([*base, *(c for cs in groups.values() for c in cs)]))
    rows = df.select(F.col(label).cast("double").alias("_label"), held.alias("_held"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in every))
    n, pos = rows.where(~F.col("_held")).agg(F.count("*"), F.sum("_label")).first()
    if not n or not pos or n == pos:
        raise ValueError("the training rows need both classes")
    weighed = rows.withColumn("_weight", F.when(F.col("_label") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))))
    found = []
    for name, columns in {"base": base, **{k: [*base, *v] for k, v in groups.items()}}.items():
        model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="_label", weightCol="_weight")]).fit(weighed.where(~F.col("_held")))
        scores = model.transform(weighed.where("_held")).select("_label", vector_to_array("rawPrediction")[1].alias("_score"))
        found.append(roc_auc(scores, "_label", "_score").select(F.lit(name).alias("features"), "roc_auc"))
    got = reduce(DataFrame.unionByName, found)
    return got.withColumn("lift", F.col("roc_auc") - F.max(F.when(F.col("features") == "base", F.col("roc_auc"))).over(Window.partitionBy()))  # a row a group of columns


def browse(genes: DataFrame, words: str, columns: list[str], page: int, size: int, order: str) -> tuple[DataFrame, DataFrame]:
    """A page of the rows in which one of the columns holds the words (case ignored), and (total, pages)."""
    low = F.lit(words.lower())
    found = genes
    if words:
        condition = F.lit(False)
        for c in columns:
            condition = condition | F.coalesce(F.lower(c).contains(low), F.lit(False))
        found = genes.where(condition)
    total = found.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    return found.orderBy(order).offset((page - 1) * size).limit(size), total


def status_summary(manifest: DataFrame, status="status") -> DataFrame:
    """Rows by status, most first."""
    return manifest.groupBy(status).agg(F.count("*").alias("n")).orderBy(F.desc("n"), status)


def random_common(a: DataFrame, b: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N keys that both annotations have, by least hash."""
    return a.select(key).intersect(b.select(key)).orderBy(key_hash(key, 1 << 31, seed), key).limit(n)
