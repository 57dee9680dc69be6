"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all of them, exact reranking.

Trees. A tree has a random direction a level and splits each node at its members' median. The medians come from at most about FIT vectors (a
documented bound, by hash of vec_id): node by node down to cells of about CELL sampled vectors, and below that by the cell's median along each further
level's direction. So the model's size is bounded, while the depth grows with the table: a leaf has about LEAF members at any size.
Every vector is routed to its leaf in each tree.

Queue. A split's cost for the side that a query isn't on is the logistic loss of its margin, in units of the node's spread; a leaf's cost
is the sum on its path. The leaves of all trees are in one queue by cost, held as a beam of WIDER x `visits` nodes a level.
The members of a query's first `visits` leaves are its candidates; their Euclidean distances are taken in double precision on
the original vectors, and the K best are merged over leaves.

How many leaves. `visits` isn't a share of the table. The true neighbours of AUDIT queries (by hash) are found by brute force, and `visits` is the least number
that reaches TARGET of them, so it is as small as the vectors' structure allows: clustered vectors need few leaves, and vectors that
are uniform on the sphere (the test tables are nearly that, the worst case for any index) a share of the table that falls as it grows.
The measured recall is logged and given by plan(). A query that meets fewer than K candidates is answered from all leaves of one tree, exactly.

Equal vectors are one member with the K + 1 smallest vec_ids, which is all that a result can hold of them; equal queries are
searched once. Leaves of over BLOCK members are dealt into blocks that all their visitors see, so no leaf is one task's work.

Edge cases: unusable vectors (see vectors.usable) take no part, as queries or candidates; vectors are compared with those of their own length
(one search a length); fewer than K candidates are all returned; rows that repeat a vec_id are candidates of their own, a query
leaves out one row of its own id; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import logging
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import lengths, matrix, parts, usable

K, TREES, LEAF = 10, 16, 64
FIT, CELL, BLOCK, GROUP_ROWS = 20_000, 40, 4096, 8192
AUDIT, TARGET, WIDER = 64, 0.94, 4
#: Margins of one spread cost as much as a log-odds of SHARP.
SHARP = 1.5
RESULT = "query_id long, rank int, vec_id long, score double"


class Forest(NamedTuple):
    """ways [trees, depth, dimensions]; cut and spread of the upper levels' nodes [trees, 2**upper - 1], and of each cell on the further levels [trees, 2**upper, depth - upper]."""

    depth: int
    upper: int
    ways: np.ndarray
    cuts: np.ndarray
    spreads: np.ndarray
    cell_cuts: np.ndarray
    cell_spreads: np.ndarray


def halves(p: np.ndarray, node: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """The median and the spread of p in each of so many nodes."""
    n = np.bincount(node, minlength=nodes)
    order = np.lexsort((p, node))
    cut = np.where(n > 0, p[order[np.minimum(np.cumsum(n) - n + np.maximum(n - 1, 0) // 2, len(p) - 1)]], 0)
    mean = np.bincount(node, p, nodes) / np.maximum(1, n)
    square = np.bincount(node, p.astype(np.float64) ** 2, nodes) / np.maximum(1, n)
    return cut, np.sqrt(np.maximum(square - mean**2, 1e-12))


def fit(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 9) -> Forest:
    rng = np.random.default_rng(seed)
    ways = rng.normal(size=(trees, depth, sample.shape[1])).astype(np.float32)
    ways /= np.linalg.norm(ways, axis=2, keepdims=True)
    upper = min(depth, int(np.log2(max(1, len(sample) / CELL))))
    cuts, spreads = (np.zeros((trees, 2**upper - 1), np.float32) for _ in range(2))
    cell_cuts, cell_spreads = (np.zeros((trees, 2**upper, depth - upper), np.float32) for _ in range(2))
    for t in range(trees):
        p, node = sample @ ways[t].T, np.zeros(len(sample), np.int64)
        for level in range(upper):
            here = slice(2**level - 1, 2 ** (level + 1) - 1)
            cuts[t, here], spreads[t, here] = halves(p[:, level], node, 2**level)
            node = 2 * node + (p[:, level] > cuts[t, here][node])
        for level in range(upper, depth):
            cell_cuts[t, :, level - upper], cell_spreads[t, :, level - upper] = halves(p[:, level], node, 2**upper)
    return Forest(depth, upper, ways, cuts, spreads, cell_cuts, cell_spreads)


def split(f: Forest, level: int, tree, node) -> tuple[np.ndarray, np.ndarray]:
    """Cut and spread of nodes of a level."""
    if level < f.upper:
        return f.cuts[tree, 2**level - 1 + node], f.spreads[tree, 2**level - 1 + node]
    cell = node >> (level - f.upper)
    return f.cell_cuts[tree, cell, level - f.upper], f.cell_spreads[tree, cell, level - f.upper]


def route(x: np.ndarray, f: Forest) -> np.ndarray:
    """The leaf of each row in each tree, as tree << 40 | leaf: [rows, trees]."""
    out = np.zeros((len(x), len(f.ways)), np.int64)
    for t in range(len(f.ways)):
        p, node = x @ f.ways[t].T, np.zeros(len(x), np.int64)
        for level in range(f.depth):
            node = 2 * node + (p[:, level] > split(f, level, t, node)[0])
        out[:, t] = t << 40 | node
    return out


def queue(x: np.ndarray, f: Forest, visits: int) -> np.ndarray:
    """The leaves of all trees that each row visits, cheapest first: [rows, visits or all there are]."""
    trees, beam, out = len(f.ways), max(len(f.ways), WIDER * visits), []
    step = int(np.clip((1 << 20) // beam, 1, 512))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        rows = np.arange(len(part))[:, None]
        p = (part @ f.ways.reshape(trees * f.depth, f.ways.shape[2]).T).reshape(len(part), trees, f.depth)
        tree = np.tile(np.arange(trees), (len(part), 1))
        node, cost = np.zeros_like(tree), np.zeros(tree.shape, np.float32)
        for level in range(f.depth):
            cut, spread = split(f, level, tree, node)
            z = SHARP * (p[rows, tree, level] - cut) / spread
            right = np.logaddexp(0, -z)
            tree, node, cost = np.tile(tree, 2), np.concatenate([2 * node, 2 * node + 1], 1), np.concatenate([cost + right + z, cost + right], 1)
            if tree.shape[1] > beam:
                best = np.argpartition(cost, beam - 1, 1)[:, :beam]
                tree, node, cost = tree[rows, best], node[rows, best], cost[rows, best]
        best = np.lexsort((tree << 40 | node, cost))[:, :visits]
        out.append((tree << 40 | node)[rows, best])
    return np.concatenate(out) if out else np.zeros((0, visits), np.int64)


def rerank(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, the k nearest rows of x (ties to smaller ids) and their distances, both in double precision."""
    out, x2 = [], (x * x).sum(1)
    for a in range(0, len(q), 256):
        part = q[a : a + 256]
        rough = x2[None] - 2 * part @ x.T + (part * part).sum(1)[:, None]
        near = np.partition(rough, k - 1, 1)[:, k - 1] if len(x) > k else np.full(len(part), np.inf)
        size = x2.max(initial=0) + (part * part).sum(1)
        for i in range(len(part)):
            at = np.flatnonzero(rough[i] <= near[i] + 1e-12 * size[i])
            d = np.sqrt(((x[at] - part[i]) ** 2).sum(1))
            best = np.lexsort((ids[at], d))[:k]
            out.append((at[best], d[best]))
    return out


def brute(vectors: DataFrame, q: np.ndarray, qid: np.ndarray, k: int) -> DataFrame:
    """(qid, cid, score): for a bounded number of queries, the k nearest of all rows (cid, v); each task keeps its own best and gives them once."""

    def run(batches):
        best = {int(i): [] for i in qid}
        for batch in batches:
            ids = batch.column("cid").to_numpy()
            for i, (at, dist) in zip(qid.tolist(), rerank(q, matrix(batch.column("v"), np.float64), ids, k)):
                best[i] = sorted([*best[i], *zip(dist.tolist(), ids[at].tolist())])[:k]
        rows = [(i, c, d) for i, of in best.items() for d, c in of]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["qid", "cid", "score"])

    place = F.row_number().over(Window.partitionBy("qid").orderBy("score", "cid"))
    return vectors.select("cid", "v").mapInArrow(run, "qid long, cid long, score double").withColumn("_n", place).where(F.col("_n") <= k).drop("_n")


def plan(classes: DataFrame, asked: DataFrame, f: Forest, k: int = K, target: float = TARGET, audit: int = AUDIT) -> tuple[int, float]:
    """How many leaves to visit, and the recall measured with it: the least number that finds `target` of the true neighbours of `audit` queries (qid, v)."""
    leaves = len(f.ways) << f.depth
    drawn = asked.orderBy(F.xxhash64(F.lit(29), "qid"), "qid").limit(audit).select("qid", "v").toPandas()
    if not len(drawn):
        return 1, 1.0
    q, qid = np.stack(drawn["v"].to_numpy()).astype(np.float64), drawn["qid"].to_numpy()
    true = brute(classes, q, qid, k + 1)
    near = classes.join(F.broadcast(true), "cid").select("qid", "cid", "v").where("qid <> cid").toPandas()  # at most (k + 1) x audit rows
    if not len(near):
        return 1, 1.0
    to = route(np.stack(near["v"].to_numpy()).astype(np.float32), f)
    at = np.searchsorted(np.sort(qid), near["qid"].to_numpy())
    q = q[np.argsort(qid)].astype(np.float32)
    width = 64
    while True:
        width = min(leaves, 4 * width)
        seen = queue(q, f, width)
        place = np.array([np.isin(seen[i], x).argmax() if np.isin(seen[i], x).any() else width for i, x in zip(at, to)])
        visits = int(np.sort(place)[int(np.ceil(target * len(place))) - 1]) + 1
        if visits <= width // 2 or width == leaves:
            visits = int(np.clip(visits, min(leaves, len(f.ways)), leaves))
            return visits, float((place < visits).mean())


def nearest(vectors: DataFrame, queries, k: int = K, trees: int = TREES, leaf: int = LEAF, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of vectors (vec_id, embedding) that the condition `queries` takes."""
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable() & F.col("vec_id").isNotNull()).withColumn("h", F.xxhash64("embedding"))
    found = [nearest_of_length(some.where(F.size("embedding") == d), queries, k, trees, leaf, target) for d in lengths(some)]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], RESULT)


def nearest_of_length(some: DataFrame, queries, k: int, trees: int, leaf: int, target: float) -> DataFrame:
    """nearest() among vectors of one length. some: (vec_id, embedding, h), h a hash of the vector."""
    spark, kind = some.sparkSession, dict(some.dtypes)["embedding"]
    first = F.row_number().over(Window.partitionBy("h", "embedding").orderBy("vec_id"))
    classes = some.withColumn("_n", first).where(F.col("_n") <= k + 1).groupBy("h", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = written(classes.select(F.col("ids")[0].alias("cid"), "ids", "h", F.col("embedding").alias("v")), "ann-classes")
    n = classes.count()
    drawn = classes.where((F.pmod(F.xxhash64(F.lit(5), "cid"), F.lit(1 << 30)) / float(1 << 30)) < min(1.0, FIT / max(1, n))).select("cid", "v").toPandas()  # about FIT rows
    if not len(drawn):
        drawn = classes.orderBy("cid").limit(1).select("cid", "v").toPandas()
    f = fit(np.stack(drawn.sort_values("cid")["v"].to_numpy()).astype(np.float32), max(0, round(np.log2(n / leaf))), trees)
    # a query is asked once for each class of equal vectors, under the class's id
    asked = some.where(queries)
    distinct = written(asked.groupBy("h", "embedding").agg(F.count("*").alias("_n")).join(classes.select("h", F.col("v").alias("embedding"), "cid"), ["h", "embedding"]).select(F.col("cid").alias("qid"), F.col("embedding").alias("v")), "ann-queries")
    visits, recall = plan(classes, distinct, f, k, target)
    logging.getLogger(__name__).info("%d vectors, depth %d, %d of %d leaves visited, recall %.3f", n, f.depth, visits, trees << f.depth, recall)

    def to_leaves(batches):
        for batch in batches:
            flat = pa.array(route(matrix(batch.column("v")), f).ravel())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * trees, flat), *batch.columns], names=["leaves", *batch.schema.names])

    def to_visits(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                to = queue(matrix(part.column("v")), f, visits)
                at = np.repeat(np.arange(part.num_rows), to.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(to.ravel()), *(c.take(pa.array(at)) for c in part.columns)], names=["leaf", *part.schema.names])

    routed = written(classes.select("cid", "ids", "v").mapInArrow(to_leaves, f"leaves array<long>, cid long, ids array<long>, v {kind}"), "ann-leaves")
    sizes = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("m"))
    large = written(sizes.where(F.col("m") > BLOCK).select("leaf", F.ceil(F.col("m") / BLOCK).alias("blocks")), "ann-large")
    groups = max(1, n * trees // GROUP_ROWS)
    group = F.pmod(F.xxhash64("leaf", "block"), F.lit(groups)).alias("group")
    in_block = F.pmod(F.xxhash64("cid"), F.coalesce("blocks", F.lit(1).cast("long")))

    def search(left, right):
        best: dict[int, dict[int, tuple[float, int]]] = {}
        left, right = (x.sort_by([("leaf", "ascending"), ("block", "ascending")]) for x in (left, right))
        lk, rk = ([*zip(x.column("leaf").to_pylist(), x.column("block").to_pylist())] for x in (left, right))
        asks: dict[tuple[int, int], list[int]] = {}
        for i, key in enumerate(rk):
            asks.setdefault(key, []).append(i)
        cid, x, q, qid = left.column("cid").to_numpy(), matrix(left.column("v"), np.float64), matrix(right.column("v"), np.float64), right.column("qid").to_numpy()
        ends = [0, *(i for i in range(1, len(lk)) if lk[i] != lk[i - 1]), len(lk)]
        for a, b in zip(ends[:-1], ends[1:]):
            who = asks.get(lk[a]) if lk else None
            if not who:
                continue
            for i, (at, dist) in zip(qid[who].tolist(), rerank(q[who], x[a:b], cid[a:b], k + 1)):
                mine = best.setdefault(i, {})
                for j, e in zip((at + a).tolist(), dist.tolist()):
                    mine[int(cid[j])] = (e, j)
        rows = [(i, c, e, j) for i, mine in best.items() for e, c, j in sorted((e, c, j) for c, (e, j) in mine.items())[: k + 1]]
        columns = list(zip(*rows)) or [[], [], [], []]
        return pa.table({"qid": pa.array(columns[0], pa.int64()), "cid": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64()), "ids": left.column("ids").take(pa.array(columns[3], pa.int64()))})

    def candidates(seekers: DataFrame, of: DataFrame) -> DataFrame:
        """(qid, cid, score, ids): the k + 1 nearest classes among the members of the leaves that each seeker visits."""
        members = of.join(large, "leaf", "left").select("leaf", in_block.alias("block"), "cid", "ids", "v").select(group, "*")
        visitors = seekers.join(large, "leaf", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1).cast("long")) - 1))).select(group, "leaf", "block", "qid", "v")
        found = members.groupBy("group").cogroup(visitors.groupBy("group")).applyInArrow(search, "qid long, cid long, score double, ids array<long>")
        place = F.row_number().over(Window.partitionBy("qid").orderBy("score", "cid"))
        return found.groupBy("qid", "cid").agg(F.min("score").alias("score"), F.first("ids").alias("ids")).withColumn("_n", place).where(F.col("_n") <= k + 1).drop("_n")

    members = routed.select(F.explode("leaves").alias("leaf"), "cid", "ids", "v")
    top = written(candidates(distinct.mapInArrow(to_visits, f"leaf long, qid long, v {kind}"), members), "ann-top")
    enough = top.groupBy("qid").agg(F.count("*").alias("_n")).where(F.col("_n") >= min(k + 1, n)).select("qid")
    short = written(distinct.join(enough, "qid", "left_anti"), "ann-short")
    if n_short := short.count():  # few leaves with few members: these queries see all leaves of one tree
        every = routed.select(F.col("leaves")[0].alias("leaf"), "cid", "ids", "v")
        blocks = written(every.select("leaf").distinct(), "ann-all").withColumn("_part", F.explode(F.array([F.lit(i) for i in range(16)])))
        dealt = short.withColumn("_part", F.pmod(F.xxhash64("qid"), F.lit(16)).cast("int"))
        logging.getLogger(__name__).info("%d queries met fewer than %d candidates", n_short, k)
        top = top.join(short.select("qid"), "qid", "left_anti").unionByName(candidates(dealt.join(blocks, "_part").select("leaf", "qid", "v"), every))
    each = top.select("qid", "score", F.posexplode("ids").alias("_k", "vec_id"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("score", "vec_id", "_k"))
    lists = written(each.withColumn("_n", place).where(F.col("_n") <= k + 1).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("near")), "ann-lists")
    who = asked.join(classes.select("h", F.col("v").alias("embedding"), F.col("cid").alias("qid")), ["h", "embedding"]).select(F.col("vec_id").alias("query_id"), "qid").join(lists, "qid")
    own = F.array_position(F.transform("near", lambda s: s["vec_id"]), F.col("query_id"))
    rest = F.filter("near", lambda s, i: (i + 1) != own)
    out = who.select("query_id", F.posexplode(F.slice(rest, 1, k)).alias("_at", "_s"))
    return out.select("query_id", (F.col("_at") + 1).alias("rank"), "_s.vec_id", "_s.score")


def recall(vectors: DataFrame, queries, found: DataFrame, k: int = K, most: int = 1024) -> float:
    """The share of the true neighbours that found (of nearest()) has, by brute force for at most `most` queries (by hash)."""
    some = vectors.select(F.col("vec_id").cast("long").alias("cid"), F.col("embedding").alias("v")).where(usable("v") & F.col("cid").isNotNull())
    hit = total = 0
    for d in lengths(some.withColumnRenamed("v", "embedding")):
        mine = some.where(F.size("v") == d)
        asked = vectors.where(queries & (F.size("embedding") == d)).select(F.col("vec_id").cast("long").alias("qid"), F.col("embedding").alias("v")).orderBy(F.xxhash64(F.lit(31), "qid"), "qid").limit(most).toPandas()
        if len(asked):
            true = brute(mine, np.stack(asked["v"].to_numpy()).astype(np.float64), asked["qid"].to_numpy(), k + 1).where("qid <> cid").withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("score", "cid"))).where(F.col("_n") <= k)
            met = true.join(found, (F.col("qid") == F.col("query_id")) & (F.col("cid") == F.col("vec_id")), "left").agg(F.count("*"), F.count("query_id")).first()
            total, hit = total + met[0], hit + met[1]
    return hit / total if total else 1.0
