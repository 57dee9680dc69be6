"""Line dedup against plain Python and its SQL."""

import hashlib
import random

from oracle import compare
from strandline.llm import lines, queries
from strandline.llm.common import ascii_lower

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, n_lines string, _places string, t1 string, _id int, `a.b` string"


def brute(rows, least_docs=2, least_chars=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        mine = (text or "").split("\n")
        stay = []
        for line in mine:
            of = holders[key(line)]
            first = min((d for d in of if d is not None), default=None)
            if len(key(line)) < least_chars or len(of) < least_docs or doc == first:
                stay.append(line)
        out.append((doc, len(mine), len(mine) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def random_rows():
    rng = random.Random(11)
    some = ["A shared line of text", " a SHARED line of text\t", "short one", "Ünïcode LINE ONE", "ünïcode line one", "Ünïcode line one", "", "  ", "\x0bframed line here\x0c", "framed line here", "𝒳 astral ten", "123456789", "1234567890"]
    rows = [(i, "\n".join(rng.choices(some + [f"own line of document {i}"], k=rng.randint(0, 9)))) for i in range(300)]
    rows += [(None, "A shared line of text\nonly without an id"), (None, "only without an id\n1234567890"), (5, "own line twice\nown line twice"), (5, "own line twice"), (7, None), (8, ""), (9, "\n"), (9, "\n")]
    return rows + [(400, "\n".join(f"line number {k} of many" for k in range(30_000))), (399, "\n".join(f"line number {k} of many" for k in range(0, 30_000, 3)))]


def test_against_plain_python(spark, tmp_path):
    rows = random_rows()
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_line_dedup(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert got.dtypes == [("doc_id", "bigint"), ("n_lines", "bigint"), ("n_dropped", "bigint"), ("kept_sha256", "string")]


def test_texts_and_threshold(spark):
    """The operator itself: texts put together again, other columns as they were, a higher threshold."""
    rows = [(i, "the line of three here\nthe line of two here" if i < 2 else "the line of three here", "n", "p", "t", i, "ab") for i in range(3)]
    got = lines.dedup(spark.createDataFrame(rows, DOCS), least_docs=3)
    assert got.columns == ["doc_id", "text", "n_lines", "_places", "t1", "_id", "a.b"]
    assert sorted((r.doc_id, r.text, r._id) for r in got.collect()) == [(0, rows[0][1], 0), (1, "the line of two here", 1), (2, "", 2)]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_line_dedup(spark, str(tmp_path)).collect() == []


def test_sql(spark):
    compare(spark, "op11_line_dedup", queries.op11_line_dedup, queries.OP11_SQL, SF)


def test_ascii_lower_leaves_other_letters(spark):
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([("".join(map(chr, points[k : k + 999])),) for k in range(0, len(points), 999)], "x string")
    for r in rows.select("x", ascii_lower(rows.x).alias("y")).collect():
        assert r.y == r.x.translate(LOW)
