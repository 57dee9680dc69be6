"""Rows that repeat an id, have none, or hold no letter: one defined result in any row order."""

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import langid, mixing, queries, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _k1 string, _from int"
A = "the quick brown fox jumps over the lazy dog near the river bank"
B = "completely different words stand here in this other longer document text"


def test_repeated_ids_in_any_order(spark):
    """Of (5, A), (5, B), (3, B) document A stays under 5 and B under 3."""
    rows = [(5, A, "en", "s", 1, "x", 1), (5, B, "en", "s", 1, "x", 1), (3, B, "en", "s", 1, "x", 1), (None, B, "en", "s", 1, "x", 1)]
    for order in (rows, rows[::-1], [rows[1], rows[3], rows[0], rows[2]]):
        kept = simhash.deduplicate(spark.createDataFrame(order, DOCS).coalesce(1))
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, B), (5, A)]


def test_vantage_points_tell_bands_apart():
    """Random fingerprints have hardly more shard mates in a tree than share its bits."""
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, 60_000, np.int64).astype(np.uint64)
    _, *points = simhash.vantage_points(64)
    for blocks, bits in ((5, 8), (6, 12)):  # fewer bits than a tree's own, so that 60,000 fill the bands
        mask = sum(1 << b for b in rng.choice(64, bits, replace=False).tolist())
        rings = np.stack([np.bitwise_count((fp ^ np.uint64(p)) & np.uint64(mask)) for p in points[: simhash.vantages(mask)]], 1)
        shards = np.unique(rings, axis=0, return_inverse=True)[1]
        mates, band = (np.mean(np.bincount(x)[x]) for x in (shards.ravel(), np.unique(fp & np.uint64(mask), return_inverse=True)[1]))
        assert band <= mates <= 1.6 * band


def test_numerals_are_no_letters(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = [(900001, "\u00bd \u00b2", "en"), (900002, "\u2163 \u2460 12 !", None), (900003, "\u00bd a", None), (900004, "\u4e2d\u6587", None), (900005, "_ _", None)]
    got = {r.doc_id: r for r in langid.identify(d.unionByName(spark.createDataFrame(odd, d.schema))).where("doc_id > 900000").collect()}
    assert [got[900000 + i].lang_pred == "und" for i in range(1, 6)] == [True, True, False, False, True] and got[900001].score == 0
    assert not langid.has_letter("") and langid.has_letter("1\u00aa")


def test_known_language_rejects_by_prediction(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    kept = langid.known_language(d, languages=["en"])
    said = {r.doc_id for r in langid.identify(d).where("lang_pred = 'en' AND NOT ambiguous").collect()}
    assert {r.doc_id for r in kept.collect()} == said and 0 < len(said) < d.count()
    mixed = spark.createDataFrame([(1, "zq xv kj qqz wvx", None), (2, "12 34", None)], "doc_id bigint, text string, lang string")
    assert [r.doc_id for r in langid.known_language(mixed).collect()] == [1]  # nothing learned: only texts without letters go


def test_mix_without_ids_and_with_repeats(spark):
    """Documents without ids are rounded one by one, and a row repeated many times as a whole: both near their targets."""
    rows = [(None, f"{'w ' * 49}n{i}", "en", "a", 0, "x", 1) for i in range(40)] + [(7, "same text again", "en", "b", 0, "x", 1)] * 300 + [(i, "word " * (i % 9), "en", "c", 0, "x", 1) for i in range(200)]
    d = spark.createDataFrame(rows, DOCS)
    got = mixing.taken(d).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    total, target = {}, {}
    for r in got:
        total[r.source], target[r.source] = total.get(r.source, 0) + r.taken, r.target
    assert all(abs(total[s] - target[s]) <= 51 for s in total)
    again = mixing.taken(d.repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    mix = mixing.mix(d)
    assert mix.columns == d.columns
    assert {r.source: r.n for r in mix.groupBy("source").agg(F.sum(mixing.words()).alias("n")).collect()} == total


def test_rows_that_differ_in_a_map_are_two(spark):
    d = spark.sql("SELECT 1L AS doc_id, 'a b c' AS text, 'en' AS lang, 's' AS source, map('k', v) AS m, named_struct('n', map(1, v)) AS s FROM VALUES ('x'), ('y'), (NULL), ('y') t(v)")
    mix = mixing.mix(d, total=2.0).collect()
    assert sorted((str(r.m["k"]), str(r.s.n[1])) for r in mix) == [("None", "None")] * 2 + [("x", "x")] * 2 + [("y", "y")] * 4


def test_many_languages_are_all_learned(spark):
    """More than the 256 that were once the most: each has its own words, and texts that were held out get theirs."""
    rng = np.random.default_rng(1)
    own = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(12)] for _ in range(300)]
    rows = [(i, " ".join(rng.choice(own[i % 300], 30)), f"l{i % 300:03d}") for i in range(6000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.train(d)["langs"]) == 300
    told = langid.identify(d).where("held_out").join(d, "doc_id")
    assert told.select("lang_pred").distinct().count() > 256
    assert told.where("lang_pred = lang").count() > 0.6 * told.count()
    code = langid.codebook(300)
    assert code.shape[1] > langid.codebook(200).shape[1] and len({tuple(c) for c in code.tolist()}) == 300


def test_one_doc_id_is_many_files(spark, tmp_path):
    """Rows of one id are dealt by their text, and read back as they were."""
    from strandline.llm import tokenfile

    d = spark.createDataFrame([(7, f"text number {i} of one id " * 3) for i in range(400)] + [(None, f"none {i}") for i in range(50)], "doc_id long, text string").repartition(8)
    few = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(few, "false")
    try:
        manifest = tokenfile.write_tokens(d)
    finally:
        spark.conf.unset(few)
    got = tokenfile.read_tokens(manifest).collect()
    assert manifest.count() > 1 and len(got) == 450 and [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None] * 50 + [7] * 400
    assert len({r.ids_crc32 for r in got}) == 450


def test_hot_unit_is_shared_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 50)
    d = spark.createDataFrame([(7, "same text again", "en", "b", 0, "x", 1)] * 120, DOCS)
    assert mixing.taken(d).count() == 120 and mixing.mix(d).count() == 180


def test_empty_and_awkward_queries(spark, tmp_path):
    """Each document query on a table of awkward rows, and on an empty one."""
    rows = [(1, None, "en", "a", 1, "x", 1), (2, "", None, None, 1, "x", 1), (None, A, "en", "a", 1, "x", 1), (4, B, "en", "b", 1, "x", 1), (4, B, "en", "b", 1, "x", 1), (5, "w " * 60_000, "de", "b", 1, "x", 1)]
    for name, some in (("rows", rows), ("none", [])):
        spark.createDataFrame(some, DOCS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for op in ("op2_token_files", "op3_quality_classifier", "op5_best_fit_packing", "op6_simhash_near_dedup", "op7_language_id", "op8_mix_sources"):
            n = queries.QUERIES[op](spark, f"{tmp_path}/{name}").count()
            assert n == len(some) if op[2] != "5" else n >= len(some), op
