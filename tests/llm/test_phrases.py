"""Phrase collocations against plain Python and their SQL."""

import random
import re
from collections import Counter

import pytest
from oracle import compare
from strandline.llm import phrases, queries

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, max_n=4, least=30, most=2000, covered=80):
    f = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang or "und", tuple(w[i : i + n])) for n in range(1, max_n + 1) for i in range(len(w) - n + 1))
    total = Counter()
    for (lang, w), k in f.items():
        total[lang] += k * (len(w) == 1)
    some = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in some.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                if 100 * a >= covered * some[lang, w[i : i + n]]:
                    gone.add((lang, w[i : i + n]))
    found = {}
    for (lang, w), a in some.items():
        if (lang, w) not in gone:
            score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, k, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for lang, xs in found.items() for k, x in enumerate(sorted(xs)[:most], 1))


def random_rows(seed=13, n=500):
    rng = random.Random(seed)
    bag = ["the", "The", "of", "a", "new", "york", "city", "ÉTÉ", "été", "a\x0bb"[:1], "nbsp word", "𝒳", "ﬀ", "rare%d"]
    fixed = ["new york city hall", "New York", "of the", "united states of america", "the the the the the"]
    rows = []
    for i in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(bag) for _ in range(rng.randint(0, 30))]
        words = [w % i if "%d" in w else w for w in words]
        rows.append((rng.choice([" ", "  ", "\t", ". ", "\n", " - "]).join(words), rng.choice(["en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "en"), ("...", None), ("lone word lone word " * 20_000, "xx"), ("copy of this text here", "en")] + [("copy of this text here", "en")] * 60


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1) for r in random_rows()], "text string, lang string, f int").repartition(6)


def test_against_plain_python(docs):
    got = phrases.collocations(docs)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string")] + [(c, "bigint") for c in ("a", "l", "r", "n", "score")]
    true = brute(random_rows())
    assert len(true) > 50 and sorted(map(tuple, got.collect())) == true


def test_other_bounds_and_a_full_sieve(docs, monkeypatch):
    """A sieve of 64 bits lets nearly all through: more rows, equal results. Few ranks: hashed groups come first."""
    monkeypatch.setattr(phrases, "BITS", 6)
    for max_n, least, most, covered in ((2, 5, 7, 80), (5, 12, 20, 50), (3, 40, 2000, 101)):
        assert sorted(map(tuple, phrases.collocations(docs, max_n, least, most, covered).collect())) == brute(random_rows(), max_n, least, most, covered)


def test_empty_and_without_candidates(spark, docs):
    assert phrases.collocations(docs.limit(0)).collect() == []
    assert phrases.collocations(spark.createDataFrame([("two words", None)], "text string, lang string")).collect() == []


def test_sql(spark):
    assert compare(spark, "op13_phrase_collocations", queries.op13_phrase_collocations, queries.OP13_SQL, "/root/testdata/sf0.01") > 200
