"""Micro-cases: coordinates, sequences, annotations, edges of intervals, ties, events."""

import math
import random

import pytest
from pyspark.sql import functions as F
from strandline.functions import arrays, coords, scores, text
from strandline.operators import evaluation, intervals, junctions, labels, relations, variants, verify, windows
from strandline.plans.pipeline import Features, Modality


def one(spark, expr, **values):
    cols = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint' if isinstance(v, int) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], cols).select(expr.alias("x")).first()[0]


def test_relative_positions(spark):
    for strand, position, relative in (("+", 41196312, 1), ("+", 41196313, 2), ("-", 41277500, 1), ("-", 41277499, 2)):
        v = {"p": position, "s": 41196312, "e": 41277500, "t": strand}
        assert one(spark, coords.to_relative("p", "s", "e", "t"), **v) == relative
        assert one(spark, coords.to_absolute("p", "s", "e", "t"), **(v | {"p": relative})) == position


def test_chromosome_names(spark):
    assert one(spark, coords.for_build("c", False), c="chr21") == "21" and one(spark, coords.for_build("c", True), c="22") == "chr22"
    assert one(spark, coords.standard("c"), c="chr1") and not one(spark, coords.standard("c"), c="chr19_MU273384v1_fix")
    assert one(spark, coords.on_chromosomes("c", ["chr21"]), c="21")
    assert [one(spark, coords.natural_order("c"), c=c) for c in ("chr2", "chrX", "Y", "chrM", "chrUn")] == [2, 23, 24, 25, 1000]


def test_attributes(spark):
    gtf = 'gene_id "ENSG00000223972"; gene_name "DDX11L1";'
    gff = "ID=gene-OR4F5;Name=OR4F5;description=olfactory receptor"
    assert one(spark, text.attribute(F.col("a"), "gene_id"), a=gtf) == "ENSG00000223972"
    assert one(spark, text.attribute(F.col("a"), "description"), a=gff) == "olfactory receptor"
    assert one(spark, text.first_attribute(F.col("a"), "gene_name", "gene", "Name"), a=gff) == "OR4F5"
    assert one(spark, text.attribute(F.col("a"), "absent"), a=gtf) is None
    j = text.junction_parts(F.col("a"))
    assert [one(spark, j[k], a="chr1_12058_12178") for k in ("chrom", "start", "end")] == ["chr1", 12058, 12178]
    h = text.hgvs_alleles(F.col("a"))
    assert [one(spark, h[k], a="NM_1:c.100+2A>G") for k in ("coding_position", "intron_offset", "ref_allele", "alt_allele")] == [100, 2, "A", "G"]


def test_sequences(spark):
    assert one(spark, text.reverse_complement(F.col("s")), s="AACGTN") == "NACGTT"
    assert one(spark, text.window(F.col("s"), F.col("p"), 3), s="acgtacgt", p=2) == "NNACGT"
    assert one(spark, text.window(F.col("s"), F.col("p"), 3), s="acgtacgt", p=7) == "TACGTN"
    assert math.isclose(one(spark, text.cpg_density(F.col("s")), s="CGCG"), 2 / 3)
    assert one(spark, text.mutate(F.col("s"), F.col("p").cast("int"), F.lit("G"), F.lit("TT")), s="ACGT", p=3) == "ACTTT"
    assert one(spark, text.intron_dinucleotide(F.col("s"), F.col("p"), F.lit("donor"), F.lit("+")), s="AAGTCC", p=2) == "GT"
    assert one(spark, text.intron_dinucleotide(F.col("s"), F.col("p"), F.lit("donor"), F.lit("-")), s="ACAAGG", p=4) == one(spark, text.reverse_complement(F.col("s")), s="CA")
    got = spark.createDataFrame([("A" * 23,)], "s string")
    kept = text.chunks(got, "s", 10, 4).orderBy("chunk").collect()
    assert kept[0].keep_start == 0 and kept[-1].keep_end == 23 and all(a.keep_end == b.keep_start for a, b in zip(kept, kept[1:]))


def test_splice_sites_of_both_strands(spark):
    rows = [("t1", "+", 10, 20), ("t1", "+", 30, 40), ("t2", "-", 10, 20), ("t2", "-", 30, 40), ("t3", "+", 1, 5)]
    df = spark.createDataFrame(rows, "transcript_id string, strand string, start bigint, end bigint")
    got = {(r.transcript_id, r.splice_type, r.position) for r in windows.splice_sites(df).collect()}
    assert got == {("t1", "donor", 20), ("t1", "acceptor", 30), ("t2", "donor", 30), ("t2", "acceptor", 20)}


def test_junction_edges(spark):
    rows = [(1, 9, "a", 5), (2, 8, "a", 4), (2, 7, "a", 4), (3, 6, "a", 3), (3, 6, "b", 9)]
    ends = spark.createDataFrame(rows, "position bigint, partner bigint, tissue string, reads bigint")
    single = {r.position: r for r in junctions.single_index(ends, ["position"]).collect()}
    assert single[1].psi is None and single[1].entropy == 0 and single[2].psi == 0.5 and single[2].entropy == 1
    tissue = {r.position: r for r in junctions.tissue_index(ends, ["position"]).collect()}
    assert tissue[1].tissue_variance == 0 and tissue[1].psi_variance is None and tissue[3].tissue_variance == 18 and tissue[3].tissue_max == 9


def test_interval_ends(spark):
    points = spark.createDataFrame([("c", 10), ("c", 20), ("c", 19)], "chrom string, position bigint")
    peaks = spark.createDataFrame([("c", 10, 20, "A", "K", 1.0, 2.0), ("c", 10, 20, "A", "H", 3.0, 2.0)], "chrom string, start bigint, end bigint, rbp string, cell_line string, signal_value double, neg_log10_pvalue double")
    hits = intervals.points_in_intervals(points, peaks, ["chrom"], width=7, closed=False)
    got = {r.position: r.n_bound for r in relations.peak_features(hits, ["chrom", "position"]).collect()}
    assert got == {10: 1, 19: 1}
    closed = intervals.points_in_intervals(points, peaks, ["chrom"], width=7)
    assert closed.count() == 6


def test_overlaps_meet_once(spark):
    df = spark.createDataFrame([("c", i, 5 * i, 5 * i + 100) for i in range(30)], "chrom string, id bigint, start bigint, end bigint")
    got = {r.id: (r.n_overlaps, r.overlaps) for r in intervals.overlap_summary(df, ["chrom"], "id").collect()}
    for i in range(30):
        near = [j for j in range(30) if j != i and abs(i - j) <= 20]
        assert got[i] == (len(near), ",".join(map(str, near[:10])))


@pytest.mark.parametrize("closed", [True, False])
def test_peak_features_at_points_are_those_of_hits(spark, closed):
    """every hit was a row, and four for its distinct counts. The same features, with nulls and pieces that cover each other over borders of bins."""
    rng = random.Random(10)
    peaks = []
    for _ in range(250):
        a = rng.randrange(-20, 60)
        peaks.append((rng.choice(["c", "d", None]), a, a + rng.choice([-1, 0, 1, 2, 5, 30]), rng.choice([None, *range(6)]), rng.choice([None, "x", "y", "z"]), rng.choice([None, 1.5, 2.0, 4.25]), rng.choice([None, 0.5, 3.0])))
    peaks += [("d", 200, 203, None, None, None, None)]
    df = spark.createDataFrame(peaks, "chrom string, start bigint, end bigint, rbp int, cell_line string, signal_value double, neg_log10_pvalue double")
    points = spark.createDataFrame([(c, x) for c in ("c", "d", None) for x in (*range(-25, 95), 201)], "chrom string, position bigint")
    names = {"regulators": [1, 2], "sr": [3, 4], "hnrnp": [5]}
    hits = intervals.points_in_intervals(points, df, ["chrom"], width=8, closed=closed)
    for given in (names, {}):
        true = relations.peak_features(hits, ["chrom", "position"], **given)
        got = relations.peak_features_at(points, df, ["chrom"], width=8, closed=closed, **given)
        assert got.dtypes == true.dtypes
        assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r)) for r in true.collect())
        assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_classification(spark):
    truth = spark.createDataFrame([("g", 100), ("g", 200), ("h", 5)], "gene_id string, position bigint")
    preds = spark.createDataFrame([("g", 98, 0.6), ("g", 103, 0.7), ("g", 101, 0.4)], "gene_id string, position bigint, score double")
    got = {(r.gene_id, r.position, r.pred_type, r.score) for r in evaluation.classify_sites(truth, preds, ["gene_id"]).collect()}
    assert got == {("g", 100, "TP", 0.6), ("g", 200, "FN", 0.0), ("h", 5, "FN", 0.0), ("g", 103, "FP", 0.7)}
    m = evaluation.site_metrics(evaluation.classify_sites(truth, preds, ["gene_id"])).first()
    assert (m.tp, m.fp, m.fn, m.precision, m.recall, m.f1) == (1, 1, 2, 0.5, 0.3333, 0.4)


def test_classification_makes_no_row_an_offset(spark):
    """Sites were exploded to 2 * width + 1 rows. Against brute force, over borders of bins, with null keys and repeated scores."""
    rng = random.Random(8)
    place = lambda: (rng.choice(["g", "h", None]), rng.choice([None, *range(99_950, 100_050, 3), 7]))
    truth = [place() for _ in range(40)]
    preds = [(*place(), rng.choice([None, 0.0, 0.25, 0.5, 0.75])) for _ in range(60)] + [("g", 99_998, 0.75)] * 2
    near = lambda a, b, w=4: None not in (*a, *b[:2]) and a[0] == b[0] and abs(a[1] - b[1]) <= w
    best = {t: max([0.0, *(p[2] for p in preds if near(t, p) and p[2] is not None)]) for t in truth}
    true = [(*t, "TP" if s >= 0.5 else "FN", s) for t, s in best.items()] + [(*p[:2], "FP", p[2]) for p in preds if (p[2] or 0) >= 0.5 and not any(near(t, p) for t in truth)]
    t = spark.createDataFrame(truth, "gene_id string, position int")
    p = spark.createDataFrame(preds, "gene_id string, position bigint, score double")
    got = evaluation.classify_sites(t, p, ["gene_id"], 0.5, 4)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, true))
    found = intervals.best_in_window(t, p.where("score IS NOT NULL"), ["gene_id"], 4)
    first = lambda t: min(((-p[2], p[1] - t[1]) for p in preds if near(t, p) and p[2] is not None), default=None)
    assert found.dtypes == [("gene_id", "string"), ("position", "int"), ("best_score", "double"), ("best_offset", "int")]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr((*t, f and -f[0], f and f[1])) for t in truth for f in [first(t)])
    assert not any("sequence(" in df._jdf.queryExecution().optimizedPlan().toString() for df in (got, found))


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.1), (1, 0.999), (1, 1.0)], "y int, p double")
    assert {r.bin: r.n for r in evaluation.calibration_bins(df, "y", "p").collect()} == {0: 1, 1: 1, 9: 2}


def test_average_precision_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, p double")
    assert math.isclose(evaluation.average_precision(df, "y", "p").first()[0], 0.5 * 0.5 + 0.5 * 2 / 3)
    assert math.isclose(evaluation.roc_auc(df, "y", "p").first()[0], 0.625)


def test_split_keeps_families_apart(spark):
    train = spark.createDataFrame([("g1", "F1"), ("g2", None)], "gene string, family string")
    test = spark.createDataFrame([("g3", "F1"), ("g4", "F2"), ("g5", None)], "gene string, family string")
    assert {r.gene for r in labels.without_shared_families(test, train, "family").collect()} == {"g4", "g5"}


def test_events_are_strict(spark):
    d = spark.createDataFrame([(1, 0.1, -0.1), (2, 0.11, -0.2)], "position bigint, delta_donor double, delta_acceptor double")
    got = {(r.position, r.channel, r.direction) for r in variants.detect_events(d, ["position"]).collect()}
    assert got == {(2, "donor", "gain"), (2, "acceptor", "loss")}


def test_pairing_takes_each_gain_once(spark):
    rows = [("v", "donor", 100, -0.9, "loss"), ("v", "donor", 110, -0.5, "loss"), ("v", "donor", 105, 0.8, "gain"), ("v", "donor", 2000, 0.7, "gain")]
    e = spark.createDataFrame(rows, "variant string, channel string, position bigint, delta double, direction string")
    assert {(r.loss_position, r.gain_position) for r in variants.pair_events(e, "variant").collect()} == {(100, 105), (110, None)}


def test_nearest_site(spark):
    p = spark.createDataFrame([("g", 10), ("g", 500)], "gene string, position bigint")
    m = spark.createDataFrame([("g", 8), ("g", 12), ("g", 60)], "gene string, mark bigint")
    assert {r.position: r.mark_distance for r in intervals.nearest_of(p, m, ["gene"]).collect()} == {10: -2, 500: None}


def test_checks(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 1.2), (-3, None)], "position bigint, p double")
    got = {r.check_name: (r.violations, r.passed) for r in verify.report(df, ["position"], "position", ["p"]).collect()}
    assert got == {"position_null": (0, True), "position_negative": (1, False), "p_range": (1, False), "p_nulls": (1, False), "duplicate_keys": (1, False)}
    assert verify.missing_columns(df, {"m": ["p", "q"], "n": ["p"]}) == {"m": ["q"]}
    flags = spark.createDataFrame([(True,), (False,)], "f boolean")
    assert verify.motif_share(flags, "f", 0.5).first()[0] == 0.5
    with pytest.raises(Exception, match="canonical share"):
        verify.motif_share(flags, "f", 0.9).collect()


def test_entropy_and_vectors(spark):
    df = spark.createDataFrame([([4, 4],), ([7],), ([0, 0],)], "r array<bigint>")
    assert [r[0] for r in df.select(arrays.entropy_bits(F.col("r"))).collect()] == [1.0, 0.0, 0.0]
    v = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert tuple(v.select(arrays.norm(F.col("a")), arrays.cosine(F.col("a"), F.col("b"))).first()) == (5.0, None)


def test_context_weights():
    assert scores.context_weights(2) == [0.1, 0.2, 0.4, 0.2, 0.1]
    assert math.isclose(sum(scores.context_weights(5)), 1)


def test_modalities_run_in_order(spark):
    f = Features()
    f.register(Modality("z_first", ("a",), lambda d: d.withColumn("a", F.col("x") + 1), needs=("x",)))
    f.register(Modality("b_second", ("b",), lambda d: d.withColumn("b", F.col("a") * 2), needs=("a",)))
    f.register(Modality("a_free", ("c",), lambda d: d.withColumn("c", F.lit(0))))
    assert [m.name for m in f.order(["b_second", "z_first", "a_free"])] == ["a_free", "z_first", "b_second"]
    assert f.run(spark.createDataFrame([(1,)], "x int"), ["b_second", "z_first"]).first().b == 4
    f.register(Modality("loop1", ("p",), lambda d: d, needs=("q",)))
    f.register(Modality("loop2", ("q",), lambda d: d, needs=("p",)))
    with pytest.raises(ValueError, match="circle"):
        f.order(["loop1", "loop2"])


def test_scorers(spark):
    from strandline.plans import scorers

    df = spark.createDataFrame([("g", 1, "AG", "CC"), ("g", 2, "CC", "gt"), ("g", 3, "CC", "CC")], "gene_id string, position bigint, before string, after string")
    got = {r.position: r for r in scorers.predict_mean(df, ["motif"], ["gene_id", "position"]).collect()}
    assert got[1].acceptor_prob > 0.6 and got[2].donor_prob > 0.6 and math.isclose(sum(got[3][c] for c in scorers.CHANNELS), 1)
    assert {r.position for r in scorers.high_confidence(scorers.predict(df, "motif", ["position"]), 0.6).collect()} == {1, 2}


def test_running_totals(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", float(i), i % 7) for i in range(500)], "k string, x double, v bigint")
    for by, down in (([], False), (["k"], True)):
        got = {r.x: r for r in windows.running_totals(df, "x", ["v"], by, down, parts=8).collect()}
        for x in (0.0, 77.0, 250.0, 499.0):
            mine = [i for i in range(500) if not by or bool(i % 3) == bool(int(x) % 3)]
            assert got[x].v_upto == sum(i % 7 for i in mine if (i >= x if down else i <= x)) and got[x].v_all == sum(i % 7 for i in mine)
