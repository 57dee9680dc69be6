"""Importance resampling: the documents whose words look most like a target's, drawn without replacement.

Features are the runs of 1 to `max_n` consecutive words, hashed into BUCKETS buckets by crc32. A bucket's gain is the log of its share in the
target texts over its share in the corpus, in thousandths. A document's weight is the sum of its features' gains; with Gumbel noise from a hash of its id
added, the documents of the highest scores are a sample in proportion to exp(weight).

Scoring explodes nothing: higher-order functions make each document's array of buckets, which is written, and the weight is an aggregate over
it that looks up a literal array of BUCKETS gains. Of the corpus only counts a bucket are shuffled (BUCKETS rows a task, whatever its size), and they are what
the driver gets. The order of the draw comes from one range sort of (score, id) rows; a row's rank is its place in its range and the counts of the
ranges before it, so no task sees them all.

Edge cases: a null, empty or wordless text has no features and weight 0; with fewer than `least_words` words a document isn't drawn; a null id is
hashed like the empty string and is last among ties; equal rows tie and are drawn one by one; no target texts or an empty table: gains from the counts there are, no rows
of an empty table; other columns are left alone.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, row_keys, written
from .mixing import chunks

#: Fixed by the contract: what separates words once A-Z are lower-cased, the number of buckets, the seed, the share drawn in percent.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, SEED, PERCENT, LEAST_WORDS, MAX_N = 10_000, "2024", 10, 20, 1
SCALE = 1000


def words(text: Column) -> Column:
    """The text's words in order, repeats included; none of a null."""
    return F.filter(F.split(F.coalesce(ascii_lower(text), F.lit("")), GAP), lambda w: w != "")


def runs(of: Column, max_n: int) -> Column:
    """All runs of 1 to max_n consecutive words, joined by one space."""
    longer = lambda n: F.when(F.size(of) >= n, F.transform(F.sequence(F.lit(1), F.size(of) - (n - 1)), lambda i: F.array_join(F.slice(of, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(of, *(longer(n) for n in range(2, max_n + 1))) if max_n > 1 else of


def bucketed(df: DataFrame, *keep, max_n: int = MAX_N) -> DataFrame:
    """(keep..., n_words, buckets) of every row of df: the bucket of each of its features."""
    split = df.select(*keep, words(F.col("text")).alias("_words"))
    each = F.transform(runs(F.col("_words"), max_n), lambda w: (F.crc32(w.cast("binary")) % BUCKETS).cast("int"))
    return split.select(*keep, F.size("_words").alias("n_words"), each.alias("buckets"))


def totals(rows: DataFrame) -> np.ndarray:
    """Features in each bucket. Each task adds up its own, so BUCKETS rows a task are shuffled at most, and as many come here."""
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """Thousandths of the log of each bucket's share in the target over its share in the corpus, with one more feature in each bucket."""
    s_all, t_all = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return [math.floor(SCALE * math.log(float(t + 1) * s_all / (float(s + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())]


def literal(values: list[int]) -> Column:
    """An array column of constants; folded to one literal, so it is made once and not per row."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def noise(doc_id: Column) -> Column:
    """Thousandths of a Gumbel variate from the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -float(SCALE)).cast("long")


def scored(docs: DataFrame, target: DataFrame, *keep, max_n: int = MAX_N) -> DataFrame:
    """(doc_id, keep..., n_words, n_features, weight, score) of every row of docs; target has a column text. keep: columns of docs."""
    rows = written(bucketed(docs, "doc_id", *keep, max_n=max_n), "importance-buckets")
    gain = literal(gains(totals(rows), totals(bucketed(target, max_n=max_n))))
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(gain, b + 1))
    weighed = rows.select("doc_id", *keep, "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    return weighed.select("*", (F.col("weight") + noise(F.col("doc_id"))).alias("score"))


def ranked(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scores with `rank`: 1, 2, 3... of the rows drawn, by falling score, then id; null for others.

    Rows are sorted by ranges; a row's place in its range is the lower 33 bits of monotonically_increasing_id(), the range its upper bits. The table is written, so both
    are settled before the ranges' sizes (a row each) are added up. A last column tells equal rows apart, so that they can lie in several ranges.
    """
    may = F.col("n_words") >= least_words
    some = written(scores.withColumn("_may", may), "importance-scores").withColumn("_tie", F.monotonically_increasing_id())
    order = [F.desc("_may"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_tie")]
    at = F.monotonically_increasing_id()
    placed = written(some.repartitionByRange(*order).sortWithinPartitions(*order).select(*scores.columns, "_may", F.shiftright(at, 33).alias("_range"), at.bitwiseAND((1 << 33) - 1).alias("_place")), "importance-order")
    sizes = {r["_range"]: (r["n"], r["may"]) for r in placed.groupBy("_range").agg(F.count("*").alias("n"), F.sum(F.col("_may").cast("long")).alias("may")).collect()}
    before, offsets = 0, []
    for k in sorted(sizes):
        offsets.append((k, before))
        before += sizes[k][0]
    drawn = percent * sum(may for _, may in sizes.values()) // 100
    ranges = placed.sparkSession.createDataFrame(offsets, "_range bigint, _before bigint")
    rank = F.col("_before") + F.col("_place") + 1
    return placed.join(F.broadcast(ranges), "_range").select(*scores.columns, F.when(F.col("_may") & (rank <= drawn), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents drawn, with the columns of docs."""
    a, b, copies, copy = (fresh(docs, x) for x in ("_k1", "_k2", "_copies", "_copy"))
    k1, k2 = row_keys(docs)
    keyed = docs.select("doc_id", "text", k1.alias("_k1"), k2.alias("_k2"))
    drawn = ranked(scored(keyed, target, "_k1", "_k2", max_n=max_n), percent, least_words).where("rank IS NOT NULL")
    drawn = drawn.groupBy(F.col("_k1").alias(a), F.col("_k2").alias(b)).agg(F.count("*").alias(copies))
    one = docs.withColumns({a: k1, b: k2}).dropDuplicates([a, b])
    return chunks(one.join(drawn, [a, b]), copies, copy).select(*(f"`{c}`" for c in docs.columns))
