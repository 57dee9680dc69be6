"""SimHash near-duplicates: exact pairs within a Hamming radius, by vantage-point trees over shards.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes of the text's 4-word shingles. Documents link at
RADIUS or fewer differing bits; a component is what links reach.

In 64 bits a radius of 4 bounds little: random fingerprints lie at 32 +- 4 from any vantage point, so |d(x,v) - d(y,v)| <= 4
keeps over half of all pairs at every level. The tree therefore begins on parts of the bits, where the bound is sharp. The
bits are cut into `blocks` parts; of two fingerprints within RADIUS, at least blocks - RADIUS parts agree wholly. Each choice
of that many parts is a tree of its own under the Hamming distance on these bits, in which such a pair is at distance 0: by the
triangle bound both lie at the same distance from every vantage point, so the rings around a first set of points are
shards that no pair crosses. A tree has half as many such points as bits and some more: their distances together tell nearly all values of these bits apart
(tests/llm/test_rows.py), so a shard holds about as many fingerprints as share the bits: of 134 million random ones, some 60 in each of 15 trees. Last, rings of WIDTH around one more point under the full distance split each shard; here a pair may
lie across a boundary, so a fingerprint within RADIUS of the next ring also visits that ring's shard. Inside a shard the
fingerprints are sorted by distance to a local vantage point and each is compared with those within RADIUS of its own distance
only. Every pair within RADIUS meets in at least one shard, so the links are exact. A shard of over MOST fingerprints, as a share of a SHARE-th of them tells,
is cut into blocks by hash, and every two of its blocks are a group of their own: no task holds such a shard, whatever its size, and all its pairs still meet. The
estimate decides how the work is cut, and not the result.

A shard gives back a spanning forest of its links, not its pairs, so a group of n near copies costs n rows. Equal
fingerprints are one node whatever the number of documents. `blocks` grows with the number of distinct fingerprints (5 to 8); it
changes the cost and not the result.

Edge cases: a null, empty or blank text has fingerprint zero, linked like any other; fewer than four words are one shingle; a null
doc_id has its fingerprint, and takes its component's smallest doc_id (null if there is none); repeated rows are returned as
often as they occur; an empty table gives an empty result; other columns are left alone. deduplicate() keeps the row of the component's smallest
doc_id (null last), then smallest fingerprint, then smallest hash of the whole row, so rows that repeat a doc_id are told apart and reruns agree.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, row_keys, text_batches, written

SHINGLE, SEED, RADIUS = 4, 42, 4
WIDTH = 8
#: Distinct fingerprints up to which the bits are cut into so many blocks.
BLOCKS = ((5, 1 << 22), (6, 1 << 27), (7, 1 << 32), (8, 1 << 62))
#: Rows that a Python group of shards has, about.
GROUP_ROWS = 4000
#: A shard of over MOST fingerprints is cut into blocks of about BLOCK; shards are counted on one of SHARE fingerprints.
MOST, BLOCK, SHARE = 32_768, 16_384, 16


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z alone are lowered, ASCII white space alone splits
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = sum(np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for k in range(0, len(h), 65536))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, fp): fp is the fingerprint's 64 bits as a signed long; k1 and k2 are row_keys()."""

    def of(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(fps.view(np.int64))], names=["doc_id", "k1", "k2", "fp"])

    text_batches(docs.sparkSession)
    k1, k2 = row_keys(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), "text").mapInArrow(of, "doc_id long, k1 long, k2 long, fp long")


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def views(blocks: int, radius: int = RADIUS) -> list[int]:
    """Bit masks, one a tree: every choice of blocks - radius of the blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(of) for of in combinations(masks, blocks - radius)]


def vantage_points(n: int) -> list[int]:
    """Fixed random 64-bit points."""
    return [int(x) for x in np.random.default_rng(64).integers(0, 1 << 63, n, np.int64)]


def forest(n: int, link: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n, over links (pairs of indices)."""
    parent = np.arange(n)
    while len(link):
        a, b = parent[link[:, 0]], parent[link[:, 1]]
        open_ = a != b
        if not open_.any():
            break
        link, a, b = link[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent != (up := parent[parent])).any():
            parent = up
    return parent


def search(fp: np.ndarray, visits: np.ndarray, radius: int = RADIUS, rows: int = 512) -> np.ndarray:
    """A shard's links as a spanning forest: pairs (index, root). Two visitors needn't meet: they do in their own shard."""
    n = len(fp)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    d = np.bitwise_count(fp ^ fp[0]).astype(np.int64)
    order = np.argsort(d, kind="stable")
    d, x, v = d[order], fp[order], visits[order]
    parent = np.arange(n)
    for i in range(0, n, rows):
        j = min(n, i + rows)
        end = int(np.searchsorted(d, d[j - 1] + radius, "right"))
        for k in range(i, end, 1 << 15):
            to = min(end, k + (1 << 15))
            near = (np.bitwise_count(x[i:j, None] ^ x[None, k:to]) <= radius) & ~(v[i:j, None] & v[None, k:to])
            a, b = np.nonzero(near)
            a, b = a + i, b + k
            some = b > a
            pairs = np.stack([parent[a[some]], parent[b[some]]], 1)
            if len(pairs):
                step = forest(n, np.unique(pairs, axis=0))
                parent = step[parent]
    linked = np.flatnonzero(parent != np.arange(n))
    return np.stack([order[linked], order[parent[linked]]], 1)


def vantages(mask: int) -> int:
    """How many points a tree on the mask's bits has."""
    return -(-mask.bit_count() // 2) + 6


def shards(fps: DataFrame, blocks: int, radius: int = RADIUS) -> DataFrame:
    """(shard, visits, fp, node): every fingerprint in its own shard of each tree, and as a visitor across the last boundary. fps: (fp, node), node anything that goes along."""
    masks = views(blocks, radius)
    last, *points = vantage_points(1 + max(map(vantages, masks)))
    trees = []
    for k, mask in enumerate(masks):
        rings = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(signed(mask)))) for p in points[: vantages(mask)]]
        trees.append(F.xxhash64(F.lit(k), *rings))
    return (
        fps.select("fp", "node", F.bit_count(F.col("fp").bitwiseXOR(F.lit(last))).alias("_d"), F.explode(F.array(*trees)).alias("tree"))
        .select("fp", "node", "tree", F.explode(F.array_distinct(F.array(F.floor(F.col("_d") / WIDTH), F.floor((F.col("_d") + radius) / WIDTH)))).alias("ring"), "_d")
        .select(F.xxhash64("tree", "ring").alias("shard"), (F.col("ring") > F.floor(F.col("_d") / WIDTH)).alias("visits"), "fp", "node")
    )


#: A fingerprint's node: in this order the least node of a component is the row that stands for it.
NODE = "struct<none:boolean,doc_id:bigint,fp:bigint,k1:bigint,k2:bigint>"


def hot_shards(nodes: DataFrame, blocks: int, radius: int, most: int, block: int, share: int) -> DataFrame:
    """(shard, blocks) of the shards of over `most` fingerprints, about: counted on one of `share` fingerprints, by hash."""
    some = shards(nodes.where(F.pmod(F.xxhash64(F.lit(5), "fp"), F.lit(share)) == 0), blocks, radius)
    sizes = some.groupBy("shard").agg((F.count("*") * share).alias("size")).where(F.col("size") > most)
    return written(sizes.select("shard", F.greatest(F.lit(2), F.ceil(F.col("size") / block)).cast("int").alias("blocks")), "simhash-hot")


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int | None = None, most: int = MOST, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """(src, dst): links between nodes of distinct fingerprints that connect all those that a chain of links connects. nodes: (fp, node)."""
    n = nodes.count()
    blocks = blocks or next(k for k, most_ in BLOCKS if n <= most_)
    dealt = shards(nodes, blocks, radius)
    groups = max(1, round(1.5 * n * len(views(blocks, radius)) / GROUP_ROWS))

    def of(got):
        got = got.sort_by([("shard", "ascending"), ("fp", "ascending")])
        shard, node = got.column("shard").to_numpy(), got.column("node")
        fp, visits = got.column("fp").to_numpy().view(np.uint64), got.column("visits").to_numpy()
        ends = np.append(np.flatnonzero(np.diff(shard)) + 1, len(shard))
        out, a = [], 0
        for b in ends.tolist():
            if b - a > 1:
                out.append(search(fp[a:b], visits[a:b], radius) + a)
            a = b
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pa.table({"src": node.take(pa.array(pairs[:, 0])), "dst": node.take(pa.array(pairs[:, 1]))})

    def whole(df):
        return df.groupBy(F.pmod("shard", F.lit(groups)).alias("group")).applyInArrow(lambda key, got: of(got), f"src {NODE}, dst {NODE}")

    hot = hot_shards(nodes, blocks, radius, most, block, share)
    if hot.isEmpty():
        return whole(dealt)
    cut = dealt.join(hot, "shard").withColumn("own", F.pmod(F.xxhash64(F.lit(6), "fp"), "blocks").cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> other")  # two of a block meet in each of its groups
    cut = cut.select("shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", "visits", "node")
    across = cut.groupBy("shard", "low", "high").applyInArrow(lambda key, got: of(got), f"src {NODE}, dst {NODE}")
    return whole(dealt.join(hot, "shard", "left_anti")).unionByName(across)


def groups_of(docs: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, fp) of every row, and (fp, node, component) of every fingerprint: its own node and the least node of its component."""
    rows = written(fingerprints(docs), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2"))
    nodes = rows.groupBy("fp").agg(best.alias("b")).select("fp", F.struct("b.none", "b.doc_id", "fp", "b.k1", "b.k2").cast(NODE).alias("node"))
    nodes = written(nodes, "fingerprint-nodes")
    found = components(links(nodes, radius, blocks), "simhash").select(F.col("node.fp").alias("fp"), "component")
    return rows, written(nodes.join(found, "fp", "left").select("fp", "node", F.coalesce("component", "node").alias("component")), "simhash-named")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    rows, named = groups_of(docs, radius, blocks)
    return rows.select("doc_id", "fp").join(named.select("fp", F.col("component.doc_id").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """docs with one row of each component: of the smallest doc_id (null last), then the smallest fingerprint, then the smallest hash of the row."""
    _, named = groups_of(docs, radius, blocks)
    a, b = fresh(docs, "_k1"), fresh(docs, "_k2")
    k1, k2 = row_keys(docs)
    stay = named.where(F.col("node.fp") == F.col("component.fp")).select(F.col("node.k1").alias(a), F.col("node.k2").alias(b))
    return docs.withColumns({a: k1, b: k2}).join(stay, [a, b], "left_semi").dropDuplicates([a, b]).select(*docs.columns)
