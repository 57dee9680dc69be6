"""The pipeline's stages one by one, each against what its operator says of its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from strandline.llm import langid, mixing, quality, simhash
from strandline.llm.common import written
from strandline.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "language_id", "simhash_near_dedup", "mix_sources", "best_fit_packing"]
    told = {
        "quality_classifier": lambda d: {r.doc_id for r in quality.classify(d).where("accepted").collect()},
        "language_id": lambda d: {r.doc_id for r in langid.identify(d).where("lang_pred <> 'und' AND NOT ambiguous").collect()},
        "simhash_near_dedup": lambda d: {r.doc_id for r in simhash.near_duplicates(d).where("doc_id = component_id").collect()},
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        if name in told:
            assert {r.doc_id for r in out.collect()} == told[name](docs)
        else:
            plan = {r.doc_id: r.copies for r in mixing.mix_plan(docs).collect()}
            assert {r.doc_id: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {k: v for k, v in plan.items() if v}
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == docs.count()


def test_stages_on_awkward_rows(spark):
    """Null and long texts, repeated rows and ids, null ids and clashing columns go through every stage."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _k1 string, _score int, _group int"
    good = "the river runs down to the sea and the boats go out in the morning light of the coast"
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, good, "en", "a"), (3, good, "en", "a"), (None, good + " again and again", "en", None), (4, (good + " ") * 3000, "en", "b"), (5, "12 34", "en", "b")]
    docs = spark.createDataFrame([(*r, 1, "x", 1, 1) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
        if name == "simhash_near_dedup":
            kept = [(r.doc_id, len(r.text)) for r in docs.collect()]
            assert len(kept) == len(set(kept)) and (3, len(good)) in kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 1


def test_run_and_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracles(spark, name):
    from oracle import compare

    compare(spark, name, queries()[name], oracle_sql()[name], SF)
