"""Embedding near-duplicates over a robust-pruned flat graph built on overlapping cluster shards.

1. Rows with the same label and an equal vector are one node with a count. Vectors are compared with those of their own length only.
2. Shards: labels fall into tiers by their size, four times as large a label a tier; a label of up to SHARD nodes is one shard. A tier has centres of its own, as many as give its
   largest label shards of about SHARD nodes; all tiers together are fitted on about FIT nodes (a documented bound, by hash). Every node joins the shards of its
   `overlap` nearest centres, within its label. Over FLAT centres the nearest ones are looked up in two levels.
3. Cores: nodes within half the threshold's angle of their nearest centre lie, by the triangle inequality, within the threshold of each
   other. Their links are counted by one aggregate a core, without any comparison: a dense group of n near copies costs n rows.
4. In a shard each node's nearest candidates are pruned: a candidate is dropped if one already taken is nearer to it, by ALPHA, than
   the node is. What is left, both ways, is the shard's adjacency; a node's lists from all its shards are joined together.
5. Search over the joined lists: every node is a query in each of its shards. Nodes that a shard's lists reach within the range but that aren't in the shard
   come along as guests, so that walks cross the shards' borders. A best-first walk starts from the shard's medoid (and from the
   query's own place in the graph) and takes `expand` steps; steps within the range (cosine - SLACK or more) don't count, so
   the walk goes on for as long as it finds nodes in range.
6. Verified: a pair is linked only if its cosine, in double precision on the original vectors, reaches the threshold. A pair counts in
   the first shard alone that its nodes share, so that a shard gives back a row a node (its links and the smallest node that they
   reach) and no pairs. The few pairs across a border that share no shard are rows of their own.
   A shard of over `most` nodes isn't walked: its nodes are cut by hash into blocks, its core apart, and every two blocks that
   aren't both of the core are a group of their own in which all pairs are verified. No task holds such a shard whole.
7. Audit: the true links of AUDIT nodes are counted by brute force over all nodes of their labels. The draw doesn't look at the result, and goes through the labels in turn, so
   that a small label has as much say as a large one. Where fewer than LINKED of these nodes have links, WIDE nodes are drawn instead. If less than ENOUGH of the true links
   was found, the work is done again with twice the overlap and four times the steps, and after that exactly, by blocks of each label.
   The share found is given with the result. It is null where no audited node has a link: on tables of up to WIDE nodes, all of them are audited, and there is no link at all; on a larger
   one it says nothing.

Edge cases: unusable vectors (vectors.usable), null labels: no links, component_id is the
row's own vec_id; a null vec_id has no links and a null component; rows that repeat vec_id, label and vector count as others of
each other; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import logging
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, written
from .simhash import forest
from .vectors import lengths, matrix, parts, usable

COSINE = 0.93
FIT, SHARD, FLAT, LOOK = 100_000, 1000, 1024, 8
DEGREE, ALPHA, SLACK = 24, 1.2, 0.05
GROUP_ROWS, AUDIT, LINKED, WIDE, ENOUGH = 8192, 512, 64, 8192, 0.95
#: A shard of over MOST nodes is cut into blocks of about BLOCK.
MOST, BLOCK = 2048, 2048
#: (overlap, expand) of each attempt; the one after them is exact.
ATTEMPTS = ((4, 24), (8, 96))
NONE = -1


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on the sample; an empty centre keeps its place."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(rounds if k > 1 else 0):
        at = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, at, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), c)
    return c


class Centres(NamedTuple):
    """Unit vectors, and over FLAT of them a coarse level: its centres and each one's members (padded with -1)."""

    all: np.ndarray
    coarse: np.ndarray | None
    members: np.ndarray | None


def fit_centres(sample: np.ndarray, k: int) -> Centres:
    if k <= FLAT:
        return Centres(centres(sample, k).astype(np.float32), None, None)
    fine = sample[np.linspace(0, len(sample) - 1, k).astype(int)].astype(np.float32)
    coarse = centres(fine[:: max(1, k // 20_000)], int(np.sqrt(k))).astype(np.float32)
    of = np.concatenate([(fine[i : i + 4096] @ coarse.T).argmax(1) for i in range(0, k, 4096)])
    order, n = np.argsort(of, kind="stable"), np.bincount(of, minlength=len(coarse))
    members = np.full((len(coarse), n.max()), -1)
    members[of[order], np.arange(k) - np.repeat(np.cumsum(n) - n, n)] = order
    return Centres(fine, coarse, members)


def nearest_centres(x: np.ndarray, c: Centres, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m nearest centres of unit vectors, nearest first, and the cosines to them."""
    if c.coarse is None:
        value = x @ c.all.T
        at = np.argpartition(-value, m - 1, 1)[:, :m]
        value = np.take_along_axis(value, at, 1)
    else:
        at, value = np.zeros((len(x), m), np.int64), np.zeros((len(x), m), np.float32)
        for i in range(0, len(x), 64):
            part = x[i : i + 64]
            cells = np.argpartition(-(part @ c.coarse.T), LOOK - 1, 1)[:, :LOOK]
            some = c.members[cells].reshape(len(part), -1)
            v = np.where(some >= 0, np.einsum("ij,ikj->ik", part, c.all[some]), -2)
            best = np.argpartition(-v, m - 1, 1)[:, :m]
            at[i : i + 64], value[i : i + 64] = np.take_along_axis(some, best, 1), np.take_along_axis(v, best, 1)
    order = np.argsort(-value, 1, kind="stable")
    return np.take_along_axis(at, order, 1), np.take_along_axis(value, order, 1)


def build(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, pool: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The pruned graph of a shard's unit vectors: (from, to), both directions."""
    n = len(x)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pool = min(pool, n - 1)
    a, b = [], []
    for i in range(0, n, 256):
        s = x[i : i + 256] @ x.T
        rows = np.arange(len(s))
        s[rows, rows + i] = -2
        near = np.argpartition(-s, pool - 1, 1)[:, :pool]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), 1, kind="stable"), 1)
        far = 2 - 2 * np.take_along_axis(s, near, 1)  # squared distances
        apart = 2 - 2 * np.einsum("ijk,ilk->ijl", x[near], x[near])
        alive, taken = np.ones(near.shape, bool), np.zeros(near.shape, bool)
        for _ in range(min(degree, pool)):
            first = alive.argmax(1)
            some = alive[rows, first]
            taken[rows[some], first[some]] = True
            alive[rows, first] = False
            alive &= ~(some[:, None] & (alpha * alpha * apart[rows, first] <= far))
        r, c = np.nonzero(taken)
        a.append(r + i)
        b.append(near[r, c])
    a, b = np.concatenate(a), np.concatenate(b)
    return np.concatenate([a, b]), np.concatenate([b, a])


def range_search(x: np.ndarray, asks: int, lists: np.ndarray, lowest: float, steps: int, at_once: int = 4):
    """For a few of the first `asks` rows at a time, (first row, which rows of x their walks reach with a cosine of `lowest` or more). lists: neighbours, padded with -1."""
    n = len(x)
    medoid = int((x @ unit(x.mean(0, keepdims=True) + 1e-12)[0]).argmax())
    chunk = int(np.clip(4_000_000 // max(1, n), 16, 256))
    for a in range(0, asks, chunk):
        q = x[a : min(asks, a + chunk)]
        rows = np.arange(len(q))
        seen = np.full((len(q), n), -2, np.float32)
        open_ = np.zeros((len(q), n), bool)
        for start in (np.full(len(q), medoid), rows + a):
            seen[rows, start] = (q * x[start]).sum(1)
            open_[rows, start] = True
        left = np.full(len(q), steps)
        while True:
            value = np.where(open_, seen, -3)
            k = min(at_once, n)
            best = np.argpartition(-value, k - 1, 1)[:, :k] if n > k else np.tile(np.arange(n), (len(q), 1))
            v = np.take_along_axis(value, best, 1)
            goes = (v > -3) & ((v >= lowest) | (left[:, None] > 0))
            if not goes.any():
                break
            left -= (goes & (v < lowest)).sum(1)
            r, c = np.nonzero(goes)
            node = best[r, c]
            open_[r, node] = False
            to = lists[node]
            at = np.repeat(r, to.shape[1])
            to = to.ravel()
            new = (to >= 0) & (seen[at, np.maximum(to, 0)] == -2)
            at, to = at[new], to[new]
            if len(to):
                flat = np.unique(at * n + to)
                at, to = flat // n, flat % n
                for s in range(0, len(at), 1 << 16):
                    seen[at[s : s + (1 << 16)], to[s : s + (1 << 16)]] = np.einsum("ij,ij->i", q[at[s : s + (1 << 16)]], x[to[s : s + (1 << 16)]])
                open_[at, to] = True
        yield a, seen >= lowest


def shard_links(full: np.ndarray, asks: int, count: np.ndarray, homes: np.ndarray, core: np.ndarray, shard: int, lists: np.ndarray, cosine: float, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of a shard's nodes (the first `asks` rows; the others are guests): how many vectors it links to, and the smallest node that its links here reach; and the linked pairs (node, guest) that share no shard.

    What walks reach is kept as bits, both ways; pairs are unpacked for a block of nodes at a time, verified in double precision, and counted
    in the first shard alone that the two nodes share. Pairs of one core are counted elsewhere.
    """
    n = len(full)
    size = np.linalg.norm(full, axis=1)
    reached = np.concatenate([np.packbits(found, axis=1) for _, found in range_search((full / size[:, None]).astype(np.float32), asks, lists, cosine - SLACK, steps)])
    linked, parent, far = np.zeros(n, np.int64), np.arange(n), [np.zeros((0, 2), np.int64)]
    block = int(np.clip(2_000_000 // max(1, n) // 8 * 8, 8, 256))
    for a in range(0, asks, block):
        b = min(asks, a + block)
        near = np.unpackbits(reached[a:b], axis=1, count=n).astype(bool)
        near[:, :asks] |= np.unpackbits(reached[:, a // 8 : -(-b // 8)], axis=1, count=b - a).astype(bool).T
        i, j = np.nonzero(near)
        i += a
        i, j = i[i != j], j[i != j]
        for k in range(0, len(i), 1 << 17):
            p, q = i[k : k + (1 << 17)], j[k : k + (1 << 17)]
            other = (core[p] != core[q]) | (core[p] == NONE)
            p, q = p[other], q[other]
            ok = np.einsum("ij,ij->i", full[p], full[q]) / (size[p] * size[q]) >= cosine
            p, q = p[ok], q[ok]
            both = (homes[p][:, :, None] == homes[q][:, None, :]).any(2)
            first = np.where(both, homes[p], np.iinfo(np.int64).max).min(1)
            far.append(np.stack([p, q], 1)[first == np.iinfo(np.int64).max])
            p, q = p[first == shard], q[first == shard]
            np.add.at(linked, p, count[q])
            if len(p):
                pairs = np.unique(parent[p] * n + parent[q])
                parent = forest(n, np.stack([pairs // n, pairs % n], 1))[parent]
    return linked, parent, np.concatenate(far)


def block_links(full: np.ndarray, count: np.ndarray, homes: np.ndarray, core: np.ndarray, shard: int, cut: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """shard_links of two blocks of a shard, nodes 0 to cut - 1 and the others, for pairs across; with no others, of the pairs in the one block.

    All pairs are verified; as there, a pair counts in the first shard alone that its nodes share, and not within a core.
    """
    n, one = len(full), cut == len(full)
    v, first, second = unit(full), slice(0, cut), slice(0 if one else cut, n)
    before = np.unique(homes[homes < shard])
    at = np.zeros((n, len(before)), np.float32)
    for k in range(homes.shape[1]):
        some = np.flatnonzero(homes[:, k] < shard)
        at[some, np.searchsorted(before, homes[some, k])] = 1
    linked, ok = np.zeros(n, np.int64), np.zeros((cut, second.stop - second.start), bool)
    times = count.astype(np.float64)
    for a in range(0, cut, 512):
        b = min(cut, a + 512)
        near = (v[a:b] @ v[second].T >= cosine) & (at[a:b] @ at[second].T == 0) & ((core[a:b, None] != core[None, second]) | (core[a:b, None] == NONE))
        if one:
            near[np.arange(b - a), np.arange(a, b)] = False
        ok[a:b] = near
        linked[a:b] += (near @ times[second]).astype(np.int64)
        if not one:
            linked[second] += (times[a:b] @ near).astype(np.int64)
    root = np.arange(n)
    new = linked > 0
    for start in np.flatnonzero(new):
        if not new[start]:
            continue
        new[start] = False
        front = np.array([start])
        while len(front):  # every node is in one front
            reach = np.zeros(n, bool)
            reach[second] = ok[front[front < cut]].any(0)
            if not one:
                reach[first] = ok[:, front[front >= cut] - cut].any(1)
            front = np.flatnonzero(reach & new)
            new[front] = False
            root[front] = start
    return linked, root


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that take part, with the hash of (label, embedding); and the nodes (cid, label, v, n)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).withColumn("h", F.xxhash64("label", "embedding"))
    return rows, rows.groupBy("h", "label", "embedding").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n"))


LINKS = "cid long, m long, root long"


def by_blocks(spread: DataFrame, cosine: float) -> DataFrame:
    """Links of large shards, all pairs verified. spread: (shard, blocks, cores, homes, core, cid, v, n): the first `cores` of a shard's blocks hold its core."""
    own = F.when(F.col("core") == F.col("shard"), F.pmod(F.xxhash64(F.lit(7), "cid"), "cores")).otherwise(F.col("cores") + F.pmod(F.xxhash64(F.lit(7), "cid"), F.col("blocks") - F.col("cores"))).cast("int")
    spread = spread.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.when(F.col("own") < F.col("cores"), F.col("cores")).otherwise(0).cast("int"), F.col("blocks") - 1)))
    spread = spread.select("shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("second"), "homes", "core", "cid", "v", "n")

    def blocks(key, got):
        got = got.sort_by([("second", "ascending"), ("cid", "ascending")])
        second, cid = got.column("second").to_numpy(), got.column("cid").to_numpy()
        cut = len(cid) - int(second.sum())
        if not cut or (cut == len(cid) and key[1].as_py() != key[2].as_py()):  # one of the two blocks is empty
            return pa.table({name: np.zeros(0, np.int64) for name in ("cid", "m", "root")})
        linked, root = block_links(matrix(got.column("v"), np.float64), got.column("n").to_numpy(), matrix(got.column("homes"), np.int64), got.column("core").to_numpy(), key[0].as_py(), cut, cosine)
        some = np.flatnonzero(linked)
        return pa.table({"cid": cid[some], "m": linked[some], "root": cid[root[some]]})

    return spread.groupBy("shard", "low", "high").applyInArrow(blocks, LINKS)


def exact_links(nodes: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """links() by all pairs of blocks of each label."""
    shard = F.xxhash64("label").alias("shard")
    one = written(nodes.select(shard, F.array(shard).alias("homes"), F.lit(NONE).cast("long").alias("core"), "cid", F.col("embedding").alias("v"), "n"), "graph-labels")
    sizes = one.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).withColumn("cores", F.lit(0))
    return by_blocks(one.join(sizes, "shard"), cosine)


def links(nodes: DataFrame, cosine: float = COSINE, most: int = MOST, block: int = BLOCK, overlap: int = ATTEMPTS[0][0], expand: int = ATTEMPTS[0][1]) -> DataFrame:
    """(cid, m, root): for each node and shard (or two blocks of a large one, or core) in which it has links, the vectors linked there and the smallest node reached. nodes: a written table (cid, label, embedding, n)."""
    spark, kind = nodes.sparkSession, dict(nodes.dtypes)["embedding"]
    sizes = nodes.groupBy("label").agg(F.count("*").alias("m"))
    tier = F.when(F.col("m") <= SHARD, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.log(4.0, F.col("m") * overlap / SHARD)))).cast("int").alias("tier")
    sizes = written(sizes.select("label", "m", tier), "graph-sizes")
    tiers = {r["tier"]: r for r in sizes.groupBy("tier").agg(F.sum("m").alias("nodes"), F.max("m").alias("largest")).collect()}  # a row a fourfold size
    n = sum(r["nodes"] for r in tiers.values())
    if not n:
        return spark.createDataFrame([], LINKS)
    tiered = nodes.join(sizes.select("label", "tier"), "label")
    want = {t: max(256, FIT * 4**t // sum(4**u for u in tiers)) for t in tiers}
    share = F.create_map(*(F.lit(x) for t, r in tiers.items() for x in (t, min(1.0, want[t] / r["nodes"]))))[F.col("tier")]
    drawn = tiered.where((F.pmod(F.xxhash64(F.lit(11), "cid"), F.lit(1 << 30)) / float(1 << 30)) < share).select("cid", "tier", "embedding").toPandas().sort_values("cid")  # about FIT rows
    c, dim = {}, len(nodes.first()["embedding"])
    for t, r in tiers.items():
        of = drawn.loc[drawn["tier"] == t, "embedding"]
        sample = unit(np.stack(of.to_numpy()).astype(np.float64)) if len(of) else np.eye(1, dim)
        c[t] = fit_centres(sample, 1 if t == 0 else int(min(max(1, r["largest"] * overlap // SHARD), max(1, len(of) // 4))))
    overlap = min(overlap, max(len(x.all) for x in c.values()))
    inner = np.cos(np.arccos(cosine) / 2) + 1e-4  # half the angle, less what single precision may err

    def deal(batches):
        for batch in batches:
            x, tier = unit(matrix(batch.column("embedding"), np.float64)).astype(np.float32), batch.column("tier").to_numpy()
            near, core = np.zeros((len(x), overlap), np.int64), np.full(len(x), NONE, np.int64)
            for t in np.unique(tier).tolist():
                some = np.flatnonzero(tier == t)
                at, value = nearest_centres(x[some], c[t], min(overlap, len(c[t].all)))
                near[some] = np.pad(at, ((0, 0), (0, overlap - at.shape[1])), mode="edge")  # a centre may stand twice
                core[some] = np.where(value[:, 0] >= inner, at[:, 0], NONE)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), overlap).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([lists, pa.array(core), *batch.drop_columns(["tier"]).columns], names=["centres", "inner", "cid", "label", "embedding", "n"])

    dealt = tiered.select("cid", "label", "embedding", "n", "tier").mapInArrow(deal, f"centres array<long>, inner long, cid long, label {dict(nodes.dtypes)['label']}, embedding {kind}, n long")
    homes = F.transform("centres", lambda x: F.xxhash64("label", x)).alias("homes")
    core = F.when(F.col("inner") == NONE, F.lit(NONE).cast("long")).otherwise(F.xxhash64("label", "inner")).alias("core")
    placed = written(dealt.select("cid", homes, core, F.col("embedding").alias("v"), "n"), "graph-nodes-placed")
    cores = placed.where(F.col("core") != NONE).groupBy("core").agg(F.sum("n").alias("all"), F.min("cid").alias("root"))
    inside = placed.select("cid", "core", "n").join(cores, "core").select("cid", (F.col("all") - F.col("n")).alias("m"), "root").where("m > 0")

    dealt = placed.select(F.explode(F.array_distinct("homes")).alias("shard"), "*")
    some = dealt.groupBy("shard").agg(F.count("*").alias("size"), F.count_if(F.col("core") == F.col("shard")).alias("in_core")).where(F.col("size") > most)
    part = lambda x: F.ceil(x / block).cast("int")
    some = some.select("shard", (part(F.col("in_core")) + part(F.greatest(F.col("size") - F.col("in_core"), F.lit(1)))).alias("blocks"), part(F.col("in_core")).alias("cores"))
    large = written(some, "graph-large")
    across = by_blocks(dealt.join(large, "shard"), cosine)
    dealt = dealt.join(large.select("shard"), "shard", "left_anti")
    groups = max(1, n * overlap // GROUP_ROWS)
    group = F.pmod("shard", F.lit(groups)).alias("group")

    def adjacency(key, got):
        got = got.sort_by([("shard", "ascending"), ("cid", "ascending")])
        cid, x, out = got.column("cid").to_numpy(), unit(matrix(got.column("v"), np.float64)).astype(np.float32), []
        for s, e in parts(got.column("shard").to_numpy()):
            i, j = build(x[s:e])
            out.append((cid[s:e][i], cid[s:e][j], np.einsum("ij,ij->i", x[s:e][i], x[s:e][j]) >= cosine - SLACK))
        return pa.table({name: np.concatenate([o[i] for o in out]) for i, name in enumerate(("cid", "to", "close"))})

    edges = dealt.select(group, "shard", "cid", "v").groupBy("group").applyInArrow(adjacency, "cid long, to long, close boolean")
    joined = written(edges.groupBy("cid").agg(F.collect_set("to").alias("near"), F.collect_set(F.when(F.col("close"), F.col("to"))).alias("close")), "graph-lists")
    walked = dealt.select("shard", "cid")
    guests = walked.join(joined.select("cid", F.explode("close").alias("to")), "cid").select("shard", F.col("to").alias("cid")).distinct().join(walked, ["shard", "cid"], "left_anti")
    both = dealt.withColumn("guest", F.lit(False)).unionByName(guests.join(placed, "cid").withColumn("guest", F.lit(True)))

    def search(key, got):
        got = got.sort_by([("shard", "ascending"), ("guest", "ascending"), ("cid", "ascending")])
        cid, count, guest, core = (got.column(name).to_numpy() for name in ("cid", "n", "guest", "core"))
        full, homes, near = matrix(got.column("v"), np.float64), matrix(got.column("homes"), np.int64), got.column("near").combine_chunks()
        near = pa.concat_arrays(near.chunks) if isinstance(near, pa.ChunkedArray) else near
        offsets, flat = near.offsets.to_numpy(), near.values.to_numpy(zero_copy_only=False)
        shard, out = got.column("shard").to_numpy(), []
        for s, e in parts(shard):
            ids, to = cid[s:e], flat[offsets[s] : offsets[e]]
            by = np.argsort(ids, kind="stable")
            of = np.repeat(np.arange(e - s), np.diff(offsets[s : e + 1]))
            place = by[np.minimum(np.searchsorted(ids[by], to), len(ids) - 1)]
            here = ids[place] == to
            of, place = of[here], place[here]
            width = int(np.bincount(of, minlength=1).max(initial=0))
            lists = np.full((e - s, max(1, width)), -1, np.int64)
            lists[of, np.arange(len(of)) - np.searchsorted(of, of)] = place
            linked, root, far = shard_links(full[s:e], int((~guest[s:e]).sum()), count[s:e], homes[s:e], core[s:e], shard[s], lists, cosine, expand)
            some = np.flatnonzero(linked)
            out.append((ids[some], linked[some], ids[root[some]], np.zeros(len(some), bool)))
            for p, q in (far.T, far.T[::-1]):
                out.append((ids[p], count[s:e][q], ids[q], np.ones(len(p), bool)))
        return pa.table({name: np.concatenate([o[i] for o in out]) for i, name in enumerate(("cid", "m", "root", "far"))})

    ready = both.join(joined.select("cid", "near"), "cid", "left").select(group, "shard", "guest", "homes", "core", "cid", "v", "n", F.coalesce("near", F.array().cast("array<long>")).alias("near"))
    found = written(ready.groupBy("group").applyInArrow(search, f"{LINKS}, far boolean"), "graph-found")
    far = found.where("far").select("cid", "m", "root").dropDuplicates(["cid", "root"])
    return found.where("NOT far").select("cid", "m", "root").unionByName(far).unionByName(across).unionByName(inside)


def audited_nodes(nodes: DataFrame, n: int) -> DataFrame:
    """(cid, label, embedding) of n nodes by hash, the labels in turn: one of each, then a second one, and so on; all nodes, if no more.

    A label's nodes fall into 4 n hash buckets, of each of which the least is kept, so that a window sees at most 4 n rows a label."""
    h = F.xxhash64(F.lit(23), "cid")
    few = nodes.groupBy("label", F.pmod(h, F.lit(4 * n)).alias("bucket")).agg(F.min(F.struct(h.alias("h"), "cid")).alias("a")).select("label", "a.*")
    turns = few.withColumn("turn", F.row_number().over(Window.partitionBy("label").orderBy("h", "cid")))
    drawn = turns.orderBy("turn", "h", "cid").limit(n).select("cid")
    return nodes.join(drawn, "cid", "left_semi").select("cid", "label", "embedding")


def audit(nodes: DataFrame, linked: DataFrame, cosine: float = COSINE, draws: tuple[int, ...] = (AUDIT, WIDE), enough: int = LINKED) -> tuple[float | None, int]:
    """The share of the true links of audited_nodes that was found, and the number of these nodes that have true links; no share if none has. linked: (cid, m). The next draw is taken where fewer than `enough` nodes have links."""
    nodes = nodes.withColumn("label", F.col("label").cast("string"))
    share, some = None, 0
    for n in draws:
        asked = audited_nodes(nodes, n).toPandas()
        if not len(asked):
            break
        q, qid, of_label = unit(np.stack(asked["embedding"].to_numpy()).astype(np.float64)), asked["cid"].to_numpy(), asked.groupby("label").indices

        def run(batches, q=q, qid=qid, of_label=of_label):
            total = np.zeros(len(qid), np.int64)
            for batch in batches:
                ids, times = batch.column("cid").to_numpy(), batch.column("n").to_numpy()
                x = unit(matrix(batch.column("embedding"), np.float64))
                for label, rows in pd.Series(np.arange(len(ids))).groupby(batch.column("label").to_pandas()).indices.items():
                    a = of_label.get(label, np.zeros(0, np.int64))
                    for s in range(0, len(rows) if len(a) else 0, 512):
                        b = rows[s : s + 512]
                        total[a] += ((q[a] @ x[b].T >= cosine) & (qid[a][:, None] != ids[b][None])) @ times[b]
            yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(total)], names=["cid", "m"])

        true = nodes.select("cid", "label", "embedding", "n").mapInArrow(run, "cid long, m long").groupBy("cid").agg(F.sum("m").alias("true"))
        all_, hit, some = true.join(linked, "cid", "left").agg(F.sum("true"), F.sum(F.least(F.coalesce("m", F.lit(0)), F.col("true"))), F.count_if(F.col("true") > 0)).first()
        share = hit / all_ if all_ else None
        if some >= enough or len(asked) < n:
            break
    return share, some


def audited_links(nodes: DataFrame, cosine: float = COSINE, enough: float = ENOUGH, attempts=ATTEMPTS) -> tuple[DataFrame, float | None]:
    """links() (cid, m, root), written, with an audited recall of `enough`: of the first attempt that reaches it, or exact."""
    for overlap, expand in attempts:
        found = written(links(nodes, cosine, overlap=overlap, expand=expand), "graph-links")
        recall, some = audit(nodes, found.groupBy("cid").agg(F.sum("m").alias("m")), cosine)
        logging.getLogger(__name__).info("overlap %d, %d steps: recall %s over %d nodes with links", overlap, expand, recall, some)
        if recall is None or recall >= enough:
            return found, recall
    return written(exact_links(nodes, cosine), "graph-links"), 1.0


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) of every row."""
    rows, made = nodes_of(vectors)
    nodes = written(made, "graph-nodes")
    of_length = [audited_links(written(nodes.where(F.size("embedding") == d), "graph-length"), cosine) for d in lengths(nodes)]
    found = reduce(DataFrame.unionByName, [x for x, _ in of_length]) if of_length else vectors.sparkSession.createDataFrame([], LINKS)
    recall = min((x for _, x in of_length if x is not None), default=None)
    linked = found.groupBy("cid").agg(F.sum("m").alias("m"))
    reach = components(found.select(F.col("cid").alias("src"), F.col("root").alias("dst")), "graph").withColumnRenamed("node", "cid")
    of = nodes.join(linked, "cid", "left").join(reach, "cid", "left").select("h", "label", "embedding", (F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    inside = rows.join(of, ["h", "label", "embedding"]).select("vec_id", "n_links", "component_id")
    taken = rows.select("vec_id", "h").distinct()
    outside = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64("label", "embedding").alias("h")).join(taken, ["vec_id", "h"], "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = inside.unionByName(outside)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(recall).cast("double").alias("audit_recall"))
