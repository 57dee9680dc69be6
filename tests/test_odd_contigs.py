"""Spans of documents without text, of one id, without an id and with a letter that lower case makes two of, against the SQL."""

import random

import pytest
from oracle import compare
from strandline.operators import sequences
from strandline.plans import registry

rng = random.Random(5)
TEXTS = ["".join(rng.choices("abcdeorisulEORISUL é\n", k=n)) for n in (1, 29, 300, 900)]
ODD = {
    "empty": [(1, ""), (2, TEXTS[1]), (3, ""), (4, TEXTS[0]), (5, None)],
    "one id": [(1, TEXTS[2]), (1, TEXTS[3]), (2, TEXTS[3]), (2, TEXTS[3]), (3, ""), (3, "")],
    "no id": [(None, TEXTS[2]), (None, ""), (-4, TEXTS[3])],
    "letters": [(1, "İstanbul ros " * 9), (2, "ΣΑΣ K ſ \U0001f600 oris\x00"), (3, "İ")],
}


@pytest.mark.parametrize("odd", ODD)
def test_spans_of_odd_documents(spark, tmp_path, odd):
    import pandas as pd

    for t in ("region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations").split():
        pd.DataFrame({"x": [1]}).to_parquet(tmp_path / f"{t}.parquet")
    spark.createDataFrame(ODD[odd], "doc_id long, text string").toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    rows = compare(spark, "fetched_spans", registry.queries()["fetched_spans"], registry.oracle_sql()["fetched_spans"], str(tmp_path))
    assert rows == 4 * sum(text is not None for _, text in ODD[odd])


def test_empty_sequence_is_not_an_unknown_one(spark):
    blocks = sequences.blocks(spark.createDataFrame([("chr1", ""), ("2", "ACGT"), ("2", "ACGT"), ("gone", None)], "name string, bases string"), "name", "bases", 2)
    asked = spark.createDataFrame([("1", 1, 5), ("chr1", 1, 5), ("chr2", 2, 3), ("gone", 1, 5)], "chrom string, start long, end long")
    assert sorted(map(tuple, sequences.fetch(asked, blocks, size=2).collect()), key=repr) == [("1", 1, 5, ""), ("chr1", 1, 5, ""), ("chr2", 2, 3, "CG"), ("gone", 1, 5, None)]
