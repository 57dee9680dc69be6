"""Reports over scores and channels, and files in tiers, on cases whose answers are known."""

import pytest
from strandline.operators import compare, evaluation, labels
from strandline.sources import readers


def test_groups_of_one_class_are_null(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), ("b", 0, 0.5), ("c", 1, 0.5)], "g string, y int, p double")
    roc = {r["g"]: r["roc_auc"] for r in evaluation.roc_auc(df, "y", "p", ["g"]).collect()}
    ap = {r["g"]: r["average_precision"] for r in evaluation.average_precision(df, "y", "p", ["g"]).collect()}
    area = {r["g"]: r["pr_auc"] for r in evaluation.pr_auc(df, "y", "p", ["g"]).collect()}
    assert roc == {"a": 1.0, "b": None, "c": None}
    assert ap == {"a": 1.0, "b": None, "c": 1.0} and area == {"a": 1.0, "b": None, "c": 1.0}


def test_incremental_auc(spark):
    """The base column knows nothing, one group decides and the other knows nothing."""
    rows = [(i, i % 2, float(i * 31 % 97), float(i % 2) + (i * 7 % 10) / 20, None if i % 5 == 0 else float(i * 13 % 89)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, y int, base double, good double, noise double")
    got = {r["features"]: r for r in compare.incremental_auc(df, "y", ["base"], {"good": ["good"], "noise": ["noise"]}, "id").collect()}
    assert got["good"]["roc_auc"] == pytest.approx(1.0) and got["base"]["lift"] == 0.0
    assert got["good"]["lift"] > 0.3 and abs(got["noise"]["lift"]) < 0.15
    with pytest.raises(ValueError):
        compare.incremental_auc(df.where("y = 1"), "y", ["base"], {}, "id")


def test_rescue_without_uncertain_sites(spark):
    df = spark.createDataFrame([(1, 0.9, 2.0), (0, 0.2, 1.0)], "y int, base double, x double")
    row = compare.rescue(df, "y", "base", ["x"], 0.5).first()
    assert (row["n_uncertain"], row["roc_auc_uncertain"], row["roc_auc_all"]) == (0, None, 1.0)


def test_drawn_positions_keep_the_margin(spark):
    genes = spark.createDataFrame([(1000, 2000), (5000, 5300), (None, 7000)], "start long, end long")
    got = [r["position"] for r in labels.drawn_positions(genes, 50).collect()]
    assert 0 < len(got) <= 20 and all(1100 <= p < 1900 for p in got)


def test_prediction_files_in_tiers(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.prediction_files(spark, str(tmp_path))
    (tmp_path / "predictions_chunk_1.tsv").write_text("chrom\tposition\n1\t5\n")
    (tmp_path / "predictions_chunk_2.tsv").write_text("chrom\tposition\n2\t6\n")
    assert sorted(map(tuple, readers.prediction_files(spark, str(tmp_path)).collect())) == [("1", 5), ("2", 6)]
    (tmp_path / "predictions.tsv").write_text("seqname\tposition\n3\t7\n")
    assert [tuple(r) for r in readers.prediction_files(spark, str(tmp_path)).collect()] == [("3", 7)]
    for name in ("chr22", "21"):
        spark.createDataFrame([(name, 9)], "chrom string, position long").coalesce(1).write.parquet(str(tmp_path / f"predictions_{name}.parquet"))
    spark.createDataFrame([("x", 1)], "chrom string, position long").write.parquet(str(tmp_path / "predictions_chunk_1.parquet"))
    assert sorted(tuple(r) for r in readers.prediction_files(spark, str(tmp_path)).collect()) == [("21", 9), ("chr22", 9)]


def test_sample_tissues(spark, tmp_path):
    (tmp_path / "samples.tsv").write_text("SAMPID\tAGE\tSMTSD\ns1\t3\tLung\ns2\t4\t\ns1\t3\tLung\n")
    assert [tuple(r) for r in readers.sample_tissues(spark, str(tmp_path / "samples.tsv")).collect()] == [("s1", "Lung")]
