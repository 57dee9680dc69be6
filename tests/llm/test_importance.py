"""Importance resampling against plain Python and its SQL."""

import hashlib
import math
import random
import re
import zlib

from oracle import compare
from strandline.llm import importance, queries

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, rank string, _k1 int, _may string, n_words int, `a.b` string"


def features(text, max_n=1):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, max_n=1):
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [text for _, text in rows]), (t, target)):
        for text in texts:
            for b in features(text, max_n)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    out, able = [], []
    for doc, text in rows:
        words, found = features(text, max_n)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words) >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: 10 * len(able) // 100], 1):
        r[4] = k
    return sorted(map(tuple, out), key=repr)


def random_rows():
    rng = random.Random(12)
    bag = ["the", "The", "of", "straße", "ÉTÉ", "été", "x1y2", "a-b", "c_d", "zebra", "\x00nul", "日本", "don't"]
    rows = [(i, " ".join(rng.choices(bag, k=rng.choice([0, 3, 19, 20, 21, 60])))) for i in range(400)]
    rows += [(None, "no id " * 15), (None, "no id " * 15), (900, None), (901, ""), (902, "... --- !"), (903, "w " * 60_000)] + [(777, "one text that is repeated often in this table " * 4)] * 150
    return rows, ["zebra zebra the 日本 x1y2", None, "Été of été"]


def test_against_plain_python(spark, tmp_path):
    rows, target = random_rows()
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op12_importance_resampling(spark, str(tmp_path))
    assert [k for _, k in got.dtypes] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, target)


def test_longer_runs_and_the_draw_itself(spark):
    rows, target = random_rows()
    docs = spark.createDataFrame([(*r, "r", 1, "m", 2, "ab") for r in rows], DOCS)
    texts = spark.createDataFrame([(t,) for t in target], "text string")
    true = brute(rows, target, 3)
    found = importance.ranked(importance.scored(docs.select("doc_id", "text"), texts, max_n=3)).drop("n_words")
    assert sorted(map(tuple, found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == true
    drawn = importance.resample(docs, texts, max_n=3)
    assert drawn.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in drawn.collect()) == sorted(r[0] or -1 for r in true if r[4])


def test_empty_tables(spark, tmp_path):
    for name, rows in (("documents", []), ("benchmark", [])):
        spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    assert queries.op12_importance_resampling(spark, str(tmp_path)).collect() == []


def test_sql(spark):
    compare(spark, "op12_importance_resampling", queries.op12_importance_resampling, queries.OP12_SQL, SF)
