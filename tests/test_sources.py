"""Readers, sinks, datasets and incremental work on small files."""

import gzip

import pytest
from pyspark.sql import functions as F
from strandline.sources import readers, sinks
from strandline.sources.dataset import Dataset, open_dataset
from strandline.streaming import incremental


def put(path, content):
    (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")).write(content)
    return str(path)


def test_gtf(spark, tmp_path):
    attributes = 'gene_id "g1"; transcript_id "t1"; gene_name "N";'
    lines = ["#c", "short\tline", *(f"chr1\ts\t{f}\t{a}\t{b}\t.\t+\t.\t{attributes}" for f, a, b in (("transcript", 5, 90), ("exon", 5, 20), ("exon", 60, 90))), f"chr2\ts\texon\t1\t2\t.\t-\t.\t{attributes}"]
    path = tmp_path / "a.gtf.gz"
    with gzip.open(path, "wt") as f:
        f.write("\n".join(lines))
    records = readers.gtf(spark, str(path), chroms=["1"])
    g = readers.genes(records).first()
    assert (g.gene_id, g.start, g.end, g.gene_name) == ("g1", 5, 90, "N")
    exons = readers.exon_table(records)
    assert {(r.exon_id, r.exon_number) for r in exons.collect()} == {("t1:5-20", 0), ("t1:60-90", 0)}
    assert readers.gene_table_with_exons(exons).first().exon_start == "5,60"


def test_junction_forms(spark, tmp_path):
    with open(tmp_path / "sj.tab", "w") as f:
        f.write("chr1\t11\t20\t1\t1\t0\t7\t0\t30\nchr1\t31\t40\t2\t1\t1\t1\t0\t9\n")
    got = [tuple(r) for r in readers.star_junctions(spark, str(tmp_path / "sj.tab"), least=3).collect()]
    assert got == [("chr1", 10, 21, "+", 7, 0)]
    df = spark.createDataFrame([("chr1", 11, 20, 4)], "chrom string, start bigint, end bigint, count bigint")
    assert readers.aggregated_junctions(df, True).select("donor_pos", "acceptor_pos", "reads").first() == (10, 21, 4)
    assert readers.aggregated_junctions(df.drop("count"), False).select("donor_pos", "acceptor_pos", "reads").first() == (11, 20, 1)


def test_matrix_and_peaks(spark, tmp_path):
    with gzip.open(tmp_path / "m.gct.gz", "wt") as f:
        f.write("#1.2\n2\t2\nName\tDescription\tS1\tS2\nj1\tx\t3\t0\nj2\tx\t1\t5\n")
    got = {tuple(r) for r in readers.gct(spark, str(tmp_path / "m.gct.gz")).collect()}
    assert got == {("j1", "S1", 3), ("j1", "S2", 0), ("j2", "S1", 1), ("j2", "S2", 5)}
    with open(tmp_path / "U2AF2_K562_rep1.bed", "w") as f:
        f.write("chr1\t5\t9\tp\t1000\t+\t2.5\t3.0\t-1\t-1\n")
    r = readers.narrow_peaks(spark, str(tmp_path / "U2AF2_K562_rep1.bed")).first()
    assert (r.rbp, r.cell_line, r.neg_log10_pvalue) == ("U2AF2", "K562", 3.0)


def test_fasta_and_vcf(spark, tmp_path):
    with open(tmp_path / "g.fa", "w") as f:
        f.write(">chr1 x\nacgt\nACGTAC\n>chr2\nGG\n")
    assert [tuple(r) for r in readers.fasta(spark, str(tmp_path / "g.fa"), block=4).orderBy("chrom", "block_start").collect()] == [("chr1", 1, "ACGT"), ("chr1", 5, "ACGT"), ("chr1", 9, "AC"), ("chr2", 1, "GG")]
    with open(tmp_path / "v.vcf", "w") as f:
        f.write("##h\n#CHROM\n1\t7\trs\tA\tG,TT\t.\tPASS\tGENE=X;N=2\n")
    got = {(r.position, r.alt_allele, r.variant_type, r["info"]["GENE"]) for r in readers.vcf(spark, str(tmp_path / "v.vcf")).collect()}
    assert got == {(7, "G", "SNV", "X"), (7, "TT", "insertion", "X")}


def test_separators():
    assert readers.separator("a.tsv.gz") == "\t" and readers.separator("a.csv") == "," and readers.separator("a.dat", "x;y;z,1") == ";" and readers.separator("a.dat", "x") == ","


def test_export_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("chr1", 1), ("chr2", 2)], "chrom string, x bigint")
    for fmt in ("csv", "tsv", "parquet", "json"):
        sinks.export(df, f"{tmp_path}/o.{fmt}", fmt)
    with pytest.raises(ValueError):
        sinks.export(df, f"{tmp_path}/o.x", "x")
    sinks.write_json(spark, f"{tmp_path}/m", {"a": 1})
    assert sinks.read_json(spark, f"{tmp_path}/m") == {"a": 1}
    before = sinks.file_manifest(spark, f"{tmp_path}/o.json").collect()
    then = spark.createDataFrame([(r.path, r.sha256 if i else "other") for i, r in enumerate(before)], "path string, sha256 string")
    assert "changed" in {r.status for r in sinks.stale(sinks.file_manifest(spark, f"{tmp_path}/o.json"), then).collect()}


def test_bed(spark):
    df = spark.createDataFrame([("c", 100, "+", 0.9, 0.1), ("c", 100, "-", 0.9, 0.1), ("c", 100, "+", 0.1, 0.8)], "chrom string, position bigint, strand string, donor_prob double, acceptor_prob double")
    assert sorted((r.start, r.end, r.name, r.strand) for r in sinks.bed(df).collect()) == [(97, 99, "acceptor", "+"), (97, 99, "donor", "-"), (100, 102, "donor", "+")]


def test_dataset(spark, tmp_path):
    with open(tmp_path / "d.csv", "w") as f:
        f.write("gene,count,created_date\nBRCA1,42,2020-01-02\nTP53,67,never\n")
    d = open_dataset(spark, f"{tmp_path}/d.csv")
    assert d.query("SELECT max(count) AS m FROM data").first().m == 67 and d.summary()["rows"] == 2
    p = {r.column_name: r for r in d.profile().collect()}
    assert (p["count"].min_value, p["count"].max_value, p["gene"].n_distinct) == (42, 67, 2)
    t = Dataset(spark.createDataFrame([("2020-01-02",), ("never",)], "created_date string")).with_times().df.collect()
    assert t[0][0] is not None and t[1][0] is None
    assert '"gene":"BRCA1"' in d.records().first().record
    with pytest.raises(ValueError):
        open_dataset(spark, "x.bin")


def test_resume_and_augment(spark, tmp_path):
    work = spark.createDataFrame([("a",), ("b",)], "chrom string")
    path, made = f"{tmp_path}/r", []

    def make(df):
        made.append(sorted(r.chrom for r in df.collect()))
        return df.withColumn("x", F.lit(1))

    incremental.resume(spark, work.where("chrom = 'a'"), path, "chrom", make)
    assert incremental.resume(spark, work, path, "chrom", make).count() == 2 and made == [["a"], ["b"]]
    df = spark.createDataFrame([(1, 2)], "k int, p int")
    assert incremental.augment(df, "m", ["p", "q"], lambda d: d.withColumns({"p": F.lit(7), "q": F.lit(8)})).first() == (1, 7, 8)
    assert incremental.augment(df, "m", ["p"], None) is df


def test_stream_goes_on(spark, tmp_path):
    src, out, ck = (f"{tmp_path}/{x}" for x in ("src", "out", "ck"))
    for k in range(2):
        spark.createDataFrame([(k, "a"), (k, "b")], "n int, c string").write.mode("append").parquet(src)
        incremental.run_available(incremental.stream_table(spark, src, "n int, c string"), out, ck)
        assert spark.read.parquet(out).count() == 2 * (k + 1)
