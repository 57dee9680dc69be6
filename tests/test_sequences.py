"""Spans read from blocks and labels a base, against plain Python."""

import random

import pytest
from strandline.operators import sequences
from strandline.plans import registry
from strandline.sources import readers

SF = "/root/testdata/sf0.001"
TURN = str.maketrans("ACGTN", "TGCAN")


def test_fetch(spark):
    rng = random.Random(4)
    held = {"chr1": "".join(rng.choices("ACGT", k=1003)), "2": "".join(rng.choices("ACGT", k=10)), "chrX": "".join(rng.choices("ACGTN", k=64)), "X": "ACGT"}
    rows = [(rng.choice(["1", "chr1", "chr2", "2", "chrX", "X"]), a, a + rng.choice([-3, 0, 1, 31, 32, 33, 200, 2000]), rng.choice("+-")) for a in (rng.randrange(-80, 1100) for _ in range(400))]
    rows += [("chr1", 1, 1003, "+")] * 3 + [("none", 1, 5, "+"), (None, 1, 5, "+"), ("2", None, 5, "+"), ("2", 1, None, "+"), ("2", 3, 4, None), ("2", -(1 << 40), 1 << 40, "-")]
    whole = spark.createDataFrame([*held.items(), ("empty", ""), ("gone", None)], "name string, bases string")
    blocks = sequences.blocks(whole, "name", "bases", 32)
    assert {r.chrom: (r.length, r.n_blocks, r.n_missing) for r in sequences.index(blocks).collect()} == {k: (len(v), -(-len(v) // 32), 0) for k, v in held.items()}
    got = sequences.fetch(spark.createDataFrame(rows, "chrom string, start long, end long, strand string"), blocks, strand="strand", size=32)
    true = []
    for chrom, a, b, strand in rows:
        other = chrom and (chrom[3:] if chrom.startswith("chr") else f"chr{chrom}")
        seq = held.get(chrom, held.get(other)) if chrom else None
        found = None if seq is None or a is None or b is None else seq[max(a, 1) - 1 : max(b, 0)]
        true.append((chrom, a, b, strand, found and found.translate(TURN)[::-1] if strand == "-" else found))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, true))
    plus = sequences.fetch(spark.createDataFrame([("2", 2, 5)], "chrom string, s int, e int"), blocks, "s", "e", size=32, name="q")
    assert plus.columns == ["chrom", "s", "e", "q"] and plus.first().q == held["2"][1:5]
    assert sequences.fetch(plus.drop("q").limit(0), blocks, "s", "e", size=32).count() == 0
    assert [r.q for r in sequences.fetch(plus.drop("q"), blocks.limit(0), "s", "e", size=32, name="q").collect()] == [None]


def test_labels_on_both_strands(spark):
    """An intron GT...AG on the plus strand, the same turned round, a base that is an acceptor and a donor, and a gene without introns."""
    bases = "AAAAGTCCCCAGAAAA"
    genes = [("p", "1", 101, 116, "+"), ("m", "2", 1, 16, "-"), ("one", "1", 101, 104, "+"), ("lost", "9", 1, 5, "+")]
    held = spark.createDataFrame([("1", 1, "T" * 100 + bases), ("2", 1, bases.translate(TURN)[::-1])], "chrom string, block_start long, sequence string")
    exons = [("p", "t", 101, 104), ("p", "t", 113, 116), ("m", "t", 1, 4), ("m", "t", 13, 16), ("one", "t", 101, 104), ("p", "short", 101, 102), ("p", "short", 105, 105), ("p", "short", 108, 109)]
    g = spark.createDataFrame(genes, "gene_id string, chrom string, start long, end long, strand string")
    e = spark.createDataFrame(exons, "gene_id string, transcript_id string, start long, end long")
    got = {r.gene_id: (r.sequence, r.labels) for r in sequences.genes_with_labels(g, e, held, size=1 << 16).collect()}
    label = "0002000000001000"
    assert got == {"p": (bases, label), "m": (bases, label), "one": ("AAAA", "0000"), "lost": (None, None)}
    every = {r.gene_id: r.labels for r in sequences.genes_with_labels(g, e, held, canonical=False, checked=False, size=1 << 16).collect()}
    assert every["p"] == "".join({1: "2", 3: "2", 4: "2", 7: "1", 12: "1"}.get(i, "0") for i in range(16))  # base 4 is an acceptor, then a donor


@pytest.mark.parametrize("texts", [{"a.fa": ">one\nACGT\n>one\nGG\n"}, {"a.fa": ">one\nACGT\n", "b.fa": ">two\nAC\n>one\nACG\n"}])
def test_two_contigs_of_one_name_are_an_error(spark, tmp_path, texts):
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    with pytest.raises(Exception, match="two contigs have the name one"):
        readers.fasta(spark, str(tmp_path), block=4).collect()


def test_labels_are_not_all_zero(spark):
    rows = registry.queries()["gene_base_labels_checked"](spark, SF).collect()
    assert sum(r.n_donors for r in rows) > 0 and sum(r.n_acceptors for r in rows) > 0


def test_introns_carry_no_bases(spark):
    """Motifs on the borders of pieces are seen, and the plan explodes rows without the gene's sequence."""
    n = 3 * sequences.PIECE
    bases = list("A" * n)
    bases[255:257], bases[510:512] = "GT", "AG"  # donor at 254, acceptor at 512
    genes = spark.createDataFrame([("g", 1, n, "+", "".join(bases))], "gene_id string, start long, end long, strand string, sequence string")
    exons = spark.createDataFrame([("g", "t", 1, 255), ("g", "t", 513, n), ("g", "u", 1, 256), ("g", "u", 513, n)], "gene_id string, transcript_id string, start long, end long")
    got = sequences.site_offsets(genes, exons)
    assert sorted((r.offset, r.label) for r in got.collect()) == [(254, 2), (512, 1)]
    made = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line]
    assert len(made) == 1 and "_introns" in made[0]


def test_bases_are_made_for_blocks_alone(spark):
    """Once for the blocks and once for their lengths, not again for the spans."""
    plan = registry.queries()["fetched_spans"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("length(lower(") >= 2 and 0 < plan.count("AS bases") <= 4
