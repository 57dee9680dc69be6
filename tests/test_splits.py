"""Inputs that are cut: FASTA over many splits, running totals with null keys."""

from pyspark.sql import functions as F
from strandline.operators import windows
from strandline.sources import readers


def test_fasta_over_splits(spark, tmp_path):
    contigs = {"chr1": "ACGTN" * 700, "chr2": "gattaca" * 123, "chrM": "T"}
    with open(tmp_path / "g.fa", "w") as f:
        for name, bases in contigs.items():
            f.write(f">{name} some words\n" + "\n".join(bases[i : i + 60] for i in range(0, len(bases), 60)) + "\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        got = readers.fasta(spark, str(tmp_path / "g.fa"), block=97).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    for name, bases in contigs.items():
        rows = sorted((r.block_start, r.sequence) for r in got if r.chrom == name)
        assert rows == [(i + 1, bases[i : i + 97].upper()) for i in range(0, len(bases), 97)]


def test_running_totals_of_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 10), (None, 2, 20), ("a", 3, 5)], "g string, o int, v int")
    got = {(r.g, r.o): (r.v_upto, r.v_all) for r in windows.running_totals(df, "o", ["v"], ["g"]).collect()}
    assert got == {(None, 1): (10, 30), (None, 2): (30, 30), ("a", 3): (5, 5)}


def test_junction_sums_match_lists(spark):
    from strandline.operators import junctions

    df = spark.createDataFrame([("a", p, r) for p, r in ((1, 4), (2, 4), (3, 8))] + [("b", 1, 7), ("c", 1, 0), ("c", 2, 0)], "k string, partner int, reads int")
    got = {r.k: (r.entropy, r.psi) for r in junctions.single_index(df, ["k"]).select("k", F.round("entropy", 9).alias("entropy"), "psi").collect()}
    assert got == {"a": (1.5, 0.5), "b": (0.0, None), "c": (0.0, None)}


def test_profiles():
    from strandline.plans.pipeline import Features, Modality

    f = Features()
    for n in ("base", "junction", "track"):
        f.register(Modality(n, (n,), lambda df: df))
    profiles = {"small": {"modalities": ["base"]}, "full": {"extends": "small", "modalities": ["junction", "track", "base"]}, "no_track": {"extends": "full", "excludes": ["track"]}}
    assert f.profile(profiles, "no_track") == ["base", "junction"] and f.profile(profiles, "small") == ["base"]


def test_halo_windows_match_whole_windows(spark):
    import random

    from pyspark.sql import Window
    from strandline.operators import intervals

    rng = random.Random(4)
    rows = [(i % 2, rng.choice([None, *range(-3000, 3000)]) if i % 9 == 0 else rng.randrange(-3000, 3000), rng.random() < 0.02, rng.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, p int, f boolean, v double").withColumn("i", F.monotonically_increasing_id())
    w = Window.partitionBy("g").orderBy("p").rangeBetween(-40, 40)
    want = {r.i: r.m for r in df.select("i", F.max("v").over(w).alias("m")).collect()}
    near = {r.i: r.m for r in df.select("i", (F.max(F.col("f").cast("int")).over(w) == 1).alias("m")).collect()}
    halo = windows.with_halo(df, "p", 40, 100).withColumn("m", F.max("v").over(Window.partitionBy("g", "_bin").orderBy("p").rangeBetween(-40, 40))).where("_core")
    assert {r.i: r.m for r in halo.collect()} == want and halo.count() == 900
    assert {r.i: r.is_near for r in intervals.near_flagged(df, "f", "p", ["g"], 40).collect()} == near
