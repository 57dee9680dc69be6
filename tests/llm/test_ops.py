"""Each operator against brute force, a round trip or held-out labels, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandline.llm import ann, chat, langid, mixing, neargraph, packing, quality, simhash, tokenfile, tokens, warc
from strandline.llm.common import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, copies int, _copy string, component_id string, h string, _score string"


def awkward(spark, rows=True):
    long = "lorem ipsum dolor sit amet " * 40_000
    data = [
        (1, None, "en", "a"), (2, "", None, None), (3, "   \n\t", "en", "a"), (4, long, "en", "b"), (5, "the same text here and now", "en", "b"),
        (5, "the same text here and now", "en", "b"), (None, "no id at all in this row", "de", "a"), (7, "the same text here and now", "de", None), (8, "1234 5678 !!!", "de", "c"), (9, "x", None, "c"),
    ]
    return spark.createDataFrame([(i, t, l, s, 0, 1, "x", "y", "z", "w") for i, t, l, s in data] if rows else [], DOCS)


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# mixing


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, pool = {}, set(names), 1.5 * sum(sizes.values())
    while left:
        share = {s: pool * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            pool -= target[s]
            left.discard(s)
    return target


def test_mixing(spark):
    d = docs(spark)
    got = mixing.mix_plan(d).collect()
    sizes = {}
    for r in d.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    want = brute_targets(sizes)
    most = {}
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert 0 <= r.copies <= 2 * r.n and abs(r.copies - r.n * r.target / r.source_size) < 1
        most[r.source] = max(most.get(r.source, 0), r["size"])
    for s in sizes:
        assert abs(sum(r.copies * r["size"] for r in got if r.source == s) - want[s]) <= most[s] / 2 + 1
    again = {(r.doc_id, r.copies) for r in mixing.mix_plan(d.repartition(7)).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}


def test_mixing_is_fair(spark):
    """Over seeds, a document's copies average its expectation."""
    d = spark.createDataFrame([(i, "w " * (1 + i % 7), "en", "ab"[i % 3 == 0], 0) for i in range(60)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    seen = {}
    for seed in range(12):
        for r in mixing.mix_plan(d, seed=seed).collect():
            seen.setdefault((r.source, r.target / r.source_size), []).append(r.copies / r.n)
    for (_, expected), copies in seen.items():
        assert abs(np.mean(copies) - expected) < 0.15


def test_mixing_awkward(spark):
    d = awkward(spark)
    plan = mixing.mix_plan(d).collect()
    assert sum(r.n for r in plan) == d.count()
    out = mixing.mix(d)
    assert out.columns == d.columns
    assert out.count() == sum(r.copies for r in plan)
    assert mixing.mix_plan(awkward(spark, False)).count() == 0


# tokens and token files


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_tokenizer(name):
    e = tokens.Encoder(tokens.tokenizer_path(name))
    rng = random.Random(4)
    bits = ["the", " ", "  ", "\n", "\t", "\n\n ", "Don't", "it's", "É", "ß", "İ", "naïve", "x²", "½", "٣", "日本", "é", "\x1c", "!!", "***", "_", "a_b", "<|endoftext|>", "<|", "99", "1a", " ", "’", "'S", "ﬁ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001).astype("<u4")
    data = tokenfile.pack_bits(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (tokenfile.unpack_bits(data, 1001, bits) == ids).all()


def test_token_file_random_access(tmp_path):
    from pyarrow import fs

    rng = np.random.default_rng(1)
    rows = [rng.integers(0, 50_000, n).astype("<u4") for n in (0, 5, 3000, 1, 0, 700)]
    f, path = fs.FileSystem.from_uri(f"file://{tmp_path}/x.tok")
    with f.open_output_stream(path) as sink:
        w = tokenfile.Writer(sink, 17, 64)
        for i, ids in enumerate(rows):
            w.add(None if i == 3 else i, ids)
        w.close()
    whole = np.concatenate(rows)
    with f.open_input_file(path) as source:
        r = tokenfile.Reader(source)
        for a, n in ((0, len(whole)), (63, 2), (64, 64), (3000, 10), (5, 0), (len(whole) - 1, 1)):
            assert (r.ids(a, n) == whole[a : a + n]).all()
        assert r.docs[3] == tokenfile.NO_ID


def want_tokens(rows, name, end):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(tokens.tokenizer_path(name)), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files(spark):
    for d in (docs(spark), awkward(spark)):
        got = tokenfile.read_tokens(tokenfile.write_tokens(d), at_once=1000).collect()
        want = want_tokens([(r.doc_id, r.text) for r in d.collect()], "byte_bpe_50k.json", 2)
        assert sorted((r.start, r.n_tokens, r.ids_crc32, r.doc_id) for r in got if r.doc_id is not None) == sorted((s, n, c, i) for i, s, n, c in want if i is not None)
    assert tokenfile.read_tokens(tokenfile.write_tokens(awkward(spark, False))).count() == 0


# packing


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for of in by.values():
        at = 0
        for offset, length in sorted(of):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark):
    for d in (docs(spark), awkward(spark)):
        rows = packing.packed_documents(d).collect()
        assert check_packed(rows, 2048) <= math.ceil(sum(r.length for r in rows) / 2048) + 2
        ids = {}
        for r in sorted(rows, key=lambda r: r.piece):
            if r.doc_id != 5:
                ids[r.doc_id] = ids.get(r.doc_id, b"") + bytes(r.ids)
        for i, _, n, crc in want_tokens([(r.doc_id, r.text) for r in d.collect()], "word_bpe_49k.json", 0):
            if i != 5:
                assert len(ids[i]) == 4 * n and zlib.crc32(ids[i]) == crc
    assert packing.packed_documents(awkward(spark, False)).count() == 0


def test_sequences_hold_the_pieces(spark):
    packed = packing.packed_documents(docs(spark))
    seqs = packing.sequences(packed).collect()
    assert all(len(r.ids) == 4 * r.n_tokens <= 4 * 2048 for r in seqs)
    assert sum(r.n_tokens for r in seqs) == packed.agg(F.sum("length")).first()[0]


def optimum(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in dict.fromkeys(bins):
            if b >= items[i]:
                k = bins.index(b)
                go(i + 1, [*bins[:k], b - items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, capacity - items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


def test_dominance_keeps_the_optimum():
    """What the reduction fixes leaves an instance whose optimum is the rest of the whole optimum."""
    rng = random.Random(3)
    for _ in range(300):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        counts = {x: items.count(x) for x in items}
        fixed, left = packing.reduce_by_dominance(counts, 20)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (optimum(rest, 20) if rest else 0) == optimum(items, 20), items
        runs, bins = packing.plan(counts, 20)
        assert optimum(items, 20) <= bins <= optimum(items, 20) + 1


def test_best_fit_is_best_fit():
    rng = random.Random(5)
    for _ in range(200):
        items = sorted((rng.randint(1, 30) for _ in range(rng.randint(1, 60))), reverse=True)
        bins = []
        for x in items:
            fit = [b for b in bins if b >= x]
            if fit:
                bins.remove(min(fit))
                bins.append(min(fit) - x)
            else:
                bins.append(30 - x)
        assert sum(n for _, n in packing.best_fit({x: items.count(x) for x in items}, 30)) == len(bins)


# archive


def test_archive(spark, tmp_path):
    big = "x" * 200
    pages = [(5, "u5", big), (3, "u3", big), (9, None, big), (1, "u1", "small"), (2, "u2", "small"), (4, "u4", None), (6, "u6", "ä" * 100), (6, "u6", "ä" * 100), (None, "u", big)]
    df = spark.createDataFrame([(*p, "t") for p in pages], "page_id bigint, url string, html string, digest string")
    folder = warc.write_archive(df)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_index(spark, folder).collect()), key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(5, 200, sha(big), "revisit", 3), (3, 200, sha(big), "response", None), (9, 200, sha(big), "revisit", 3), (1, 5, sha("small"), "response", None), (2, 5, sha("small"), "response", None), (4, 0, sha(""), "response", None), (6, 200, sha("ä" * 100), "response", None), (6, 200, sha("ä" * 100), "revisit", 6), (None, 200, sha(big), "revisit", 3)]
    assert got == sorted(want, key=repr)
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    original = sorted(((r.page_id, bytes(r.payload).decode()) for r in warc.records(spark, folder).collect()), key=repr)
    assert original == sorted(((i, h or "") for i, _, h in pages), key=repr)
    files = warc.export_warc(spark, folder, f"file://{tmp_path}/out", roll=200)
    assert files.agg({"n_records": "sum"}).first()[0] == df.count() and files.count() > 1
    assert warc.read_warc(spark, files).count() == df.count()
    back = warc.read_warc(spark, f"file://{tmp_path}/out").collect()
    assert len(back) == len(pages) and all(r.header.startswith("WARC/1.1\r\n") for r in back)
    assert sorted(bytes(r.body).decode() for r in back if "revisit" not in r.header) == sorted(["small", "small", "", big, "ä" * 100])
    assert warc.read_index(spark, warc.write_archive(df.limit(0))).count() == 0


def test_damaged_payload_fails(spark):
    df = spark.createDataFrame([(1, "u", "y" * 300)], "page_id bigint, url string, html string")
    folder = warc.write_archive(df)
    spark.createDataFrame([(hashlib.sha256(b"y" * 300).hexdigest(), b"z" * 300)], "digest string, payload binary").write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_index(spark, folder).collect()


# chat


def test_chat_grammar():
    rng = random.Random(2)
    bits = ["\\", "#", "###", "<", "</turn>", " ", "\n", ":", "### A: ", "a", "</turn>\n", "\\#", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        role = "".join(rng.choice(["\\", "#", ":", "a", "B", "\n", "<", ";", "x41;"]) for _ in range(rng.randint(0, 4)))
        turn, a, b = chat.render(role, text)
        assert [x[:2] for x in chat.parse(turn + turn)] == [(role, text)] * 2 and chat.unescape(turn[a:b]) == text


def test_chat(spark):
    rows = [(1, 0, "user", "hi ### there"), (1, 1, "assistant", "a\\b </turn>"), (1, 2, "assistant", None), (2, None, None, None), (None, 0, "assistant", "x"), (2, 0, "user", "z" * 3_000_000), (2, 1, "assistant", "é"), (2, 1, "assistant", "é")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.read_back(chat.write_formatted(df)).collect()}
    for conv in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(t or "" for _, _, r, t in mine if r == "assistant")
        assert got[conv].n_turns == len(mine) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in mine).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.write_formatted(df.limit(0))).count() == 0


# simhash


def brute_fingerprint(text):
    import xxhash

    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, near):
    lab = np.arange(len(ids))
    while True:
        new = np.array([lab[near[i]].min() for i in range(len(ids))])
        if (new == lab).all():
            return lab
        lab = new


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_simhash_links(spark, blocks):
    rng = np.random.default_rng(blocks)
    centre = rng.integers(0, 1 << 63, 60, np.int64).astype(np.uint64)
    fps = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), False))) for c in centre for _ in range(12)]
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(x), (False, int(x), int(x), 0, 0)) for x in fps.view(np.int64)], f"fp bigint, node {simhash.NODE}")
    got = {r.node.fp: r.component.fp for r in components(simhash.links(df, blocks=blocks)).collect()}
    lab = brute_components(fps, np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)
    signed = fps.view(np.int64)
    groups = {}
    for i, root in enumerate(lab):
        groups.setdefault(root, []).append(int(signed[i]))
    for of in groups.values():
        assert {got.get(x, x) for x in of} == {min(of)}


def test_simhash(spark):
    for d in (docs(spark), awkward(spark)):
        rows = [(r.doc_id, r.text) for r in d.collect()]
        got = simhash.near_duplicates(d).withColumn("x", simhash.hex16(F.col("fp"))).collect()
        assert len(got) == len(rows)
        fp = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
        lab = brute_components(rows, np.bitwise_count(fp[:, None] ^ fp[None]) <= 4)
        least = {root: min((rows[i][0] for i in range(len(rows)) if lab[i] == root and rows[i][0] is not None), default=None) for root in set(lab)}
        want = sorted((repr(i), f"{int(f):016x}", repr(least[k])) for (i, _), f, k in zip(rows, fp, lab))
        assert sorted((repr(r.doc_id), r.x, repr(r.component_id)) for r in got) == want
        kept = simhash.deduplicate(d)
        assert kept.columns == d.columns
        assert kept.count() == len(set(lab))
    assert simhash.near_duplicates(awkward(spark, False)).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000), (1399, 1400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1401)) and 5000 not in got


# classifiers


def test_quality(spark):
    d = docs(spark)
    got = quality.classify(d).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    right = [r.accepted == (r.quality == 1) for r in got]
    assert np.mean(right) >= 0.95
    bad = {r.doc_id: r for r in quality.classify(awkward(spark)).collect()}
    assert not bad[1].accepted and not bad[2].accepted and not bad[3].accepted and bad[5].accepted
    assert quality.accepted(awkward(spark)).columns == awkward(spark).columns
    assert quality.classify(awkward(spark, False)).count() == 0


def test_votes_em():
    """Two independent labellers of known accuracy and one that sees another kind."""
    rng = random.Random(1)
    k, counts, truth = len(quality.LABELLERS), {}, {}
    for _ in range(5000):
        kind = rng.choice([None] * 8 + [0, 3])
        v = [1 if rng.random() < 0.999 else 2 for _ in range(k)]
        if kind is not None:
            v[kind] = 2
            v[(kind + 1) % k] = 2 if rng.random() < 0.5 else 1
        p = quality.pattern(v)
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(kind is None)
    model = quality.fit_votes(counts)
    right = sum((model["posterior"][p] >= 0.5) == g for p, of in truth.items() for g in of)
    assert right / 5000 > 0.98 and 0.7 < model["share_good"] < 0.9


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.97
    for r in got:
        assert zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1
    odd = {r.doc_id: r for r in langid.identify(awkward(spark)).collect()}
    assert odd[1].lang_pred == odd[2].lang_pred == odd[8].lang_pred == "und" and odd[5].lang_pred in ("en", "de")
    assert langid.known_language(awkward(spark)).columns == awkward(spark).columns
    assert langid.identify(awkward(spark, False)).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 5, 9, 20])
def test_codewords_differ(k):
    code = langid.codebook(k)
    apart = (code.shape[1] - code @ code.T) / 2 + 99 * np.eye(k)
    assert code.shape[0] == k and apart.min() >= (1 if k <= 2 else 2)


# vectors


def vectors(spark, n=1500):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 16))
    x[200:300] = x[0] + rng.normal(size=(100, 16)) * 0.1
    x[300:320] = x[1]
    x[320:330] = x[2] * 2
    rows = [(i, x[i].tolist(), int(i % 3 if i >= 330 or i < 3 else 0)) for i in range(n)]
    bad = [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, [1.0], 0), (n + 4, [None] + [1.0] * 15, 1), (n + 5, x[1].tolist(), None), (n + 6, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame([(*r, "q", 5) for r in rows + bad], "vec_id bigint, embedding array<float>, label int, cid string, n int")
    return df, np.array([np.float32(v) for v in x]).astype(np.float64), rows


def test_nearest(spark):
    df, x, rows = vectors(spark)
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hit = total = 0
    for q in range(0, len(rows), 50):
        mine = sorted(by[q], key=lambda r: r["rank"])
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(abs(d[r.vec_id] - r.score) < 1e-12 and r.vec_id != q for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        true = [i for i in np.lexsort((np.arange(len(d)), d)) if i != q][:10]
        hit, total = hit + len({r.vec_id for r in mine} & set(true)), total + 10
    assert hit / total >= 0.9 and len(by) == len(rows) // 50
    found = ann.nearest(df, F.col("vec_id") % 50 == 0)
    assert abs(ann.recall(df.where("vec_id < 1500"), F.col("vec_id") % 50 == 0, found) - hit / total) < 1e-9
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert sorted(r.vec_id for r in ann.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()) == [1, 2, 3]


def test_embedding_near_duplicates(spark):
    df, x, rows = vectors(spark)
    got = {r.vec_id: r for r in neargraph.near_duplicates(df).collect()}
    assert len(got) == len(rows) + 7
    u, label = x / np.linalg.norm(x, axis=1, keepdims=True), np.array([r[2] for r in rows])
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, True)
    want = near.sum(1) - 1
    mine = np.array([got[i].n_links for i in range(len(rows))])
    assert (mine <= want).all() and mine.sum() >= 0.9 * want.sum()
    lab = brute_components(rows, near)
    assert np.mean([got[i].component_id == lab[i] for i in range(len(rows))]) >= 0.99
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(len(rows), len(rows) + 7))
    assert got[0].audit_recall >= 0.9
    assert neargraph.near_duplicates(df.limit(0)).count() == 0
