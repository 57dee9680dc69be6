"""The quality scorer against its labellers, on labelled documents that it wasn't trained on."""

from strandline.llm import quality
from strandline.llm.quality import look, measures, votes


def test_scorer_beats_any_vote(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("text IS NOT NULL")
    docs = docs.dropDuplicates(["text"])
    train, held = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")
    score = quality.scorer(quality.train(train))
    rows = held.select("text", "quality", score("text").alias("score")).collect()
    good = [r.quality == 1 for r in rows]
    scorer = [r.score >= quality.THRESHOLD for r in rows]
    vote = [2 not in votes(measures(*look(r.text))) for r in rows]
    wrong = lambda said: sum(a != b for a, b in zip(said, good))
    assert len(rows) > 1000 and scorer != vote and wrong(scorer) < wrong(vote)
    assert sum(g and not s for g, s in zip(good, scorer)) == 0  # no clean document goes
