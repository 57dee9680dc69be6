"""A quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad or nothing on a text. Expectation-maximisation over the counts of vote patterns
(of all documents; at most 3**labellers patterns, whatever the corpus) estimates how often each labeller gives each vote to
good and to each kind of bad texts, hence its accuracy, and gives each pattern a posterior. The posteriors of a bounded sample (at most SAMPLE distinct texts, by hash
of the text; n copies weigh 1 + log(n)) train a hashed linear scorer, and the scorer's probability decides: documents under THRESHOLD are rejected.

The scorer sees the text's words and characters (hashed) and none of the labellers' measures. It therefore judges texts on which the labellers are silent or wrong, such as
short ones: tests/llm/test_quality.py holds it against "any labeller votes bad" on labelled documents that it wasn't trained on.
Labels that the corpus has are not used for training; they serve to test.

Edge cases: a null, empty or blank text gets no votes and score 0, and is rejected; repeated rows get equal results; an empty table gives
an empty result; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, text_batches
from .hashed import fit_logistic, ngrams, word_hashes

BITS = 12
SAMPLE = 5000
THRESHOLD = 0.5
PRIOR_BAD = 0.15
#: name, what it measures, good up to, bad from (or good from, bad up to, where bad is lower).
LABELLERS = (
    ("symbols", "symbol_share", 0.04, 0.12),
    ("runs", "run_share", 0.02, 0.10),
    ("capitals", "capital_share", 0.15, 0.40),
    ("echo", "echo_share", 0.03, 0.15),
    ("bare", "bare_share", 0.04, 0.15),
    ("variety", "top_share", 0.12, 0.30),
    ("lines", "line_echo", 0.30, 0.60),
)
#: Shares are taken as if a text had so many more clean bytes or words: one odd word in a short text says little.
FEW_BYTES, FEW_WORDS = 40, 8
#: A labeller that measures words or lines says nothing on fewer than so many of them.
LEAST = {"echo": 6, "bare": 3, "variety": 25, "lines": 8}

UPPER, LOWER, DIGIT, SPACE, PLAIN, HIGH = (np.zeros(256, bool) for _ in range(6))
UPPER[65:91] = LOWER[97:123] = DIGIT[48:58] = HIGH[128:] = True
SPACE[[9, 10, 11, 12, 13, 32]] = True
PLAIN[[ord(c) for c in ".,;:'\"()-?!"]] = True
#: Bytes as the character n-grams see them: digits fold together, and white space; letters and signs stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[DIGIT], FOLD[SPACE] = ord("0"), ord(" ")
#: Character n-grams, and how much the words and their repetition weigh beside them.
SIZES, WORDS, MARKS = (1, 2, 3), 1.0, 2.0


def measures(data: np.ndarray, words: np.ndarray) -> dict[str, float]:
    """What the labellers look at, and how many words and lines there are."""
    n = len(data)
    sign = ~(UPPER | LOWER | DIGIT | SPACE | HIGH)[data]
    odd = sign & ~PLAIN[data]
    same = (data[1:] == data[:-1]) & sign[1:]
    upper, lower = int(UPPER[data].sum()), int((LOWER | HIGH)[data].sum())
    letters = np.concatenate([[0], np.cumsum((UPPER | LOWER | HIGH)[data])])
    dark = np.concatenate([[False], ~SPACE[data], [False]])
    edge = np.flatnonzero(dark[1:] != dark[:-1])
    starts, ends = edge[::2], edge[1::2]
    k = len(words)
    counts = np.unique(words, return_counts=True)[1] if len(words) else np.zeros(1, int)
    cut = np.concatenate([[0], np.flatnonzero(data == 10) + 1, [len(data)]])
    lines = [bytes(data[a:b]).strip() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    lines = [x for x in lines if x]
    return {
        "symbol_share": odd.sum() / (n + FEW_BYTES), "run_share": same.sum() / (n + FEW_BYTES), "capital_share": upper / (upper + lower + FEW_BYTES),
        "echo_share": (words[1:] == words[:-1]).sum() / (k + FEW_WORDS), "bare_share": (letters[ends] == letters[starts]).sum() / (k + FEW_WORDS),
        "top_share": counts.max() / (k + FEW_WORDS), "line_echo": 1 - len(set(lines)) / max(1, len(lines)), "words": len(words), "lines": len(lines),
    }


def votes(m: dict[str, float]) -> list[int]:
    """1 good, 2 bad, 0 nothing; a labeller each."""
    if not m["words"]:
        return [0] * len(LABELLERS)
    out = []
    for name, of, good, bad in LABELLERS:
        if m["lines" if name == "lines" else "words"] < LEAST.get(name, 1):
            out.append(0)
        else:
            out.append(1 if m[of] <= good else 2 if m[of] >= bad else 0)
    return out


def features(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashed into 2**BITS, each as the root of its share: character n-grams; words; and two marks a word, that it equals the one before, and that it came earlier in the text."""
    size = 1 << BITS
    x = np.sqrt(ngrams(FOLD[data], SIZES, BITS) / max(1, len(data)), dtype=np.float32)
    at = (words * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)
    x += WORDS * np.sqrt(np.bincount(at, minlength=size) / max(1, len(words)), dtype=np.float32)
    for k, n in enumerate(((words[1:] == words[:-1]).sum(), len(words) - len(np.unique(words)))):
        x[(k * 7919 + 11) % size] += MARKS * np.sqrt(n / max(1, len(words)))
    return x


def look(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's bytes and the hashes of its words."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    return data, word_hashes(data)


def pattern(v: list[int]) -> int:
    return sum(x * 3**k for k, x in enumerate(v))


def fit_votes(counts: dict[int, int], rounds: int = 100) -> dict:
    """EM: each pattern's chance of good, the share of good texts, and each labeller's accuracy where it votes.

    Bad texts are of several kinds, and most labellers see one kind only, so that votes depend on one another within "bad". The latent
    classes are therefore good and one kind of bad a labeller, which starts as what that labeller alone calls bad; within a
    class votes are independent. No vote is no evidence: it comes from a text's length or a value between the bounds. Every chance is estimated, false votes on good texts too;
    pseudo-counts (a thousandth of the texts) keep them above zero.
    """
    keys = np.array(sorted(counts), np.int64)
    n = np.array([counts[int(k)] for k in keys], float)
    v = np.stack([keys // 3**k % 3 for k in range(len(LABELLERS))], 1)
    bad = v == 2
    post = np.zeros((1 + len(LABELLERS), len(keys)))
    post[0] = np.where(bad.any(1), 0.1, 0.95)
    post[1:] = np.where(bad.any(1), 0.9 * bad.T / np.maximum(1, bad.sum(1)), 0.05 / len(LABELLERS))
    few = max(1.0, 0.001 * n.sum())
    kinds = np.eye(len(LABELLERS), dtype=bool)
    chance = np.ones((1 + len(LABELLERS), len(LABELLERS), 3))
    share = np.full(1 + len(LABELLERS), PRIOR_BAD / len(LABELLERS))
    share[0] = 1 - PRIOR_BAD
    prior = share.copy()
    for _ in range(rounds):
        share = few * prior + post @ n
        share /= share.sum()
        for c in range(len(chance)):
            for k in range(len(LABELLERS)):
                start = [0.99, 0.01] if c == 0 else [0.1, 0.9] if kinds[c - 1, k] else [0.7, 0.3]
                got = np.array([(n * post[c])[v[:, k] == x].sum() for x in (1, 2)]) + few * np.array(start)
                chance[c, k, 1:] = got / got.sum()
        log = np.log(share)[:, None] + sum(np.log(chance[:, k, v[:, k]]) for k in range(len(LABELLERS)))
        new = np.exp(log - log.max(0, initial=-1e9))
        new /= np.maximum(1e-300, new.sum(0))
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        if done:
            break
    right = share[0] * chance[0, :, 1] + share[1:] @ chance[1:, :, 2]
    voted = right + share[0] * chance[0, :, 2] + share[1:] @ chance[1:, :, 1]
    return {"share_good": float(share[0]), "accuracy": {x[0]: float(a) for x, a in zip(LABELLERS, right / voted)}, "posterior": dict(zip(keys.tolist(), post[0].tolist()))}


@F.pandas_udf(T.IntegerType())
def vote_pattern(text: pd.Series) -> pd.Series:
    return pd.Series([pattern(votes(measures(*look(x)))) for x in text], dtype="int32")


@F.pandas_udf(T.StructType([T.StructField("pattern", T.IntegerType()), T.StructField("x", T.BinaryType())]))
def vectors(text: pd.Series) -> pd.DataFrame:
    rows = [look(x) for x in text]
    return pd.DataFrame({"pattern": [pattern(votes(measures(*r))) for r in rows], "x": [features(*r).astype(np.float16).tobytes() for r in rows]})


def draw(texts: DataFrame, sample: int) -> pd.DataFrame:
    """(h, n, pattern, x) of the `sample` distinct texts of least hash; n: the copies of each. Copies are counted on the map side and never gathered."""
    hashed = texts.select("text", F.xxhash64(F.lit(3), "text").alias("h"))
    distinct = hashed.agg(F.approx_count_distinct("h", 0.01)).first()[0]
    share = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    drawn = hashed.where(share < min(1.0, 1.1 * sample / max(1, distinct))).groupBy("h", "text").agg(F.count("*").alias("n"))  # a tenth more, as the count is approximate
    got = drawn.select("h", "n", vectors("text").alias("v")).select("h", "n", "v.*").toPandas()
    return got.assign(at=got["h"] % (1 << 30)).sort_values(["at", "h"], ignore_index=True).drop(columns="at").head(sample)


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The labellers' model from all documents, and the scorer from at most `sample` distinct texts."""
    text_batches(docs.sparkSession)
    texts = docs.select("text").where(F.length(F.trim("text")) > 0)
    counts = {r["pattern"]: r["n"] for r in texts.groupBy(vote_pattern("text").alias("pattern")).agg(F.count("*").alias("n")).collect()}  # at most 3**labellers rows
    total = sum(counts.values())
    weak = fit_votes(counts)
    if not total:
        return {"weak": weak, "w": np.zeros((1 << BITS, 1), np.float32), "b": np.zeros(1, np.float32)}
    got = draw(texts, sample)
    if not len(got):
        return {"weak": weak, "w": np.zeros((1 << BITS, 1), np.float32), "b": np.full(1, 3, np.float32)}
    y = np.array([weak["posterior"].get(p, weak["share_good"]) for p in got["pattern"]], np.float32).reshape(-1, 1)
    x = np.stack([np.frombuffer(v, np.float16) for v in got.pop("x")]).astype(np.float32)  # draw() gives them in one order
    weight = 1 + np.log(got["n"].to_numpy(float))  # copies count, but no text outweighs the others
    w, b = fit_logistic(x, y, weight / weight.mean())
    return {"weak": weak, "w": w, "b": b}


def scorer(model: dict):
    """A column function: text -> score."""
    w, b = model["w"][:, 0], float(model["b"][0])

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        out = np.zeros(len(text))
        for i, t in enumerate(text):
            data, words = look(t)
            if len(words):
                out[i] = 1 / (1 + np.exp(-np.clip(features(data, words) @ w + b, -30, 30)))
        return pd.Series(out)

    return score


def classify(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, accepted) of every row."""
    score = scorer(train(docs, sample))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), score("text").alias("score")).withColumn("accepted", F.col("score") >= threshold)


def accepted(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that the classifier rejects."""
    score = scorer(train(docs, sample))
    name = fresh(docs, "_score")
    return docs.withColumn(name, score("text")).where(F.col(name) >= threshold).select(*docs.columns)
