"""Sources, sinks and small operators that no query reaches: files written here and read back."""

import json

import pytest
from pyspark.sql import functions as F
from strandline.functions import scores
from strandline.operators import intervals, selection
from strandline.plans import scorers, templates
from strandline.sources import readers, sinks
from strandline.streaming import incremental


def test_artifacts_push_down(spark, tmp_path):
    """Columns and chromosomes reach the scan; large chromosomes are several files."""
    df = spark.createDataFrame([(f"chr{i % 3}", i, i / 10, "x") for i in range(90)], "chrom string, position long, phylop double, extra string")
    sinks.by_chromosome(df, f"{tmp_path}/a", rows_a_file=7)
    got = readers.artifacts(spark, f"{tmp_path}/a", ["chrom", "position", "phylop"], ["chr1"])
    assert sorted(got.collect()) == sorted(df.where("chrom = 'chr1'").select("chrom", "position", "phylop").collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ilters: [isnotnull(chrom" in plan and "ReadSchema: struct<position:bigint,phylop:double>" in plan
    assert len(list((tmp_path / "a" / "chrom=chr1").glob("*.parquet"))) >= 30 / 7
    sinks.by_chromosome(df.where("chrom = 'chr2' AND position < 10"), f"{tmp_path}/a")  # one chromosome is replaced, others stay
    assert {r.chrom: r["count"] for r in spark.read.parquet(f"{tmp_path}/a").groupBy("chrom").count().collect()} == {"chr0": 30, "chr1": 30, "chr2": 3}


def test_variant_tables(spark):
    """S18, S19, S20, U3."""
    v = readers.variant_strings(spark.createDataFrame([('"1-55-A-GT"',), ("X-7-C-T",), ("bad",), (None,)], "hg38 string"), "hg38")
    assert [tuple(r)[1:] for r in v.collect()] == [("1", 55, "A", "GT"), ("X", 7, "C", "T"), ("bad", None, None, None), (None,) * 4]
    e = readers.effect_table(spark.createDataFrame([("chr1:10-15", "Exon Skipping seen"), ("chr2:8-8", "gain of a site"), ("odd", None)], "locus string, effect string"))
    assert [(r.chrom, r.position, r.effect_type) for r in e.collect()] == [("chr1", 12, "exon_skipping"), ("chr2", 8, "site_gain"), (None, None, "other")]
    rows = [("v1", "Top1:CD;-12;35%|Top2:ES;2-3;20%|Top3:CA;4;1.5%"), ("v1", "Top1:CD;-12;35%|Top2:ES;2-3;20%|Top3:CA;4;1.5%"), ("v2", None)]
    d = readers.distinct_events(spark.createDataFrame(rows, "variant string, events string"), ["variant"], "events", 2.0)
    assert [(r.variant, r.kind, r.offset, r.freq_pct) for r in d.collect()] == [("v1", "CD", "-12", 35.0)]


def test_splicing_tables_and_runs(spark, tmp_path):
    """Many files of one kind, with what their names and folders say."""
    (tmp_path / "r").mkdir()
    for rbp, fdr in (("SRSF1", 0.001), ("PTBP1", 0.5)):
        (tmp_path / "r" / f"{rbp}_SE.MATS.JCEC.txt").write_text(f"ID\tFDR\tIncLevelDifference\n1\t{fdr}\t-0.2\n2\t{fdr}\t0.01\n")
    assert [(r.ID, r.rbp) for r in readers.splicing_tables(spark, f"{tmp_path}/r").collect()] == [(1, "SRSF1")]
    for run, score in (("m1", 0.5), ("m2", 0.7)):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "metrics.json").write_text(json.dumps({"pr_auc": score, "per_class": {"donor": score / 2}}, indent=1))
    got = readers.metric_runs(spark, f"{tmp_path}/runs").orderBy("run")
    assert [(r.run, r.pr_auc, r.per_class.donor) for r in got.collect()] == [("m1", 0.5, 0.25), ("m2", 0.7, 0.35)]
    (tmp_path / "p").mkdir()
    for k in range(2):
        (tmp_path / "p" / f"predictions_chunk_{k}.tsv").write_text(f"seqname\tposition\tdonor_prob\nchr{k}\t{k}\t0.5\n")
    assert sorted((r.chrom, r.position) for r in readers.prediction_files(spark, f"{tmp_path}/p").collect()) == [("chr0", 0), ("chr1", 1)]
    with pytest.raises(FileNotFoundError):
        readers.prediction_files(spark, f"{tmp_path}/r")
    a, b = spark.createDataFrame([(1, "x")], "k int, c string"), spark.createDataFrame([("y", 2)], "c string, k int")
    assert sorted(map(tuple, readers.union_files(a, b).collect())) == [(1, "x"), (2, "y")]


def test_rows_and_columns(spark):
    """P7, P16, G5, G1's union of counters, Q7, M20."""
    kinds = spark.createDataFrame([("TP",), ("FP",), ("FN",), (None,)], "pred_type string")
    assert sorted(r.pred_type for r in scorers.errors(kinds).collect()) == ["FN", "FP"]
    df = spark.createDataFrame([(1, 5, 6)], "k int, p int, q int")
    again = incremental.refresh(df, ["p", "q", "none"], lambda d: d.withColumns({"p": F.lit(7), "q": F.lit(8)}))
    assert again.columns == ["k", "p", "q"] and again.first() == (1, 7, 8)
    a, b = spark.createDataFrame([(0, 5, 1), (1, 2, 2)], "c int, tp long, fp long"), spark.createDataFrame([(1, 1, 1), (2, 9, 0)], "c int, tp long, fp long")
    assert sorted(map(tuple, incremental.merge_counters(a, b, ["c"]).collect())) == [(0, 5, 1), (1, 3, 3), (2, 9, 0)]
    assert set(templates.describe()) == set(templates.TEMPLATES) and all(templates.describe().values())
    x, y = spark.createDataFrame([(1, 0.75, None), (2, 0.5, 0.5)], "k int, d double, a double"), spark.createDataFrame([(1, 0.25, 0.5), (3, 1.0, 1.0)], "k int, d double, a double")
    assert [tuple(r) for r in scores.deltas(x, y, ["k"], ["d", "a"]).collect()] == [(1, 0.5, None)]


def test_report_of_artifacts(spark):
    """V7."""
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("b", 3)], "Chrom string, position long")
    report = selection.artifact_report({"odd": df, "whole": df.where("position = 3"), "none": df.limit(0), "lacking": df.select("Chrom")}, ["chrom", "position"], ["chrom", "position"])
    assert {r.artifact: tuple(r)[1:] for r in report.collect()} == {"odd": (4, 1, 1, "", False), "whole": (1, 0, 0, "", True), "none": (0, 0, 0, "", False), "lacking": (4, None, None, "position", False)}


def test_sites_with_a_null_keep_their_score(spark):
    """J24."""
    sites = spark.createDataFrame([("g", 10, None), ("g", 10, "x"), ("g", 10, "x"), (None, 10, "y"), ("g", 90, None)], "gene string, position long, kind string")
    near = spark.createDataFrame([("g", 11, 0.5), ("g", 9, 0.5), ("g", 12, 0.25), (None, 10, 0.9)], "gene string, position long, score double")
    got = intervals.best_in_window(sites, near, ["gene"], 2)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [("g", 10, None, 0.5, -1), ("g", 10, "x", 0.5, -1), ("g", 10, "x", 0.5, -1), (None, 10, "y", None, None), ("g", 90, None, None, None)]))


def test_symbolic_alleles_are_skipped(spark):
    """R3."""
    alleles = [("A", "T"), ("A", "<DEL>"), ("A", "*"), ("A", "."), ("<DUP>", "A"), ("AC", "A")]
    records = spark.createDataFrame([(i, "chr1", 100, r, a) for i, (r, a) in enumerate(alleles)], "variant int, chrom string, position long, ref_allele string, alt_allele string")
    scored = spark.createDataFrame([(i, al, 0, 0.1 if al == "ref" else 0.9, 0.0) for i in range(6) for al in ("ref", "alt")], "variant int, allele string, offset int, donor double, acceptor double")
    assert sorted(r.variant for r in selection.record_deltas(records, scored).collect()) == [0, 5]
