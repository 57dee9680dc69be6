"""Best-fit packing of token pieces into sequences, after a Martello-Toth dominance reduction.

A packing instance is decided by how many pieces there are of each length, and there are at most `capacity` lengths.
So one aggregation counts the lengths, the plan is made from these at most `capacity` numbers, whatever the number of
documents, and pieces take their places by rank within their length. The plan:

1. Reduction. For the longest length j that is left: if nothing fits beside it, {j} is fixed; if the longest piece k
   that fits fills the sequence, or every set that fits beside j is no longer than k, {j, k} dominates all sets with j;
   if at most two fit and a pair (k, b) covers every other pair piece by piece, {j, k, b} does. Such sets are in some
   optimal packing, so they are fixed for good, as often as the counts allow, and leave the instance.
2. Best fit, longest first, packs what is left: each piece goes to the fullest sequence that still has room.

Sequences of the same content are one pattern with a count, so the work depends on the lengths, not on the pieces.

Ranks within a length don't gather a length in one task: a length's pieces are dealt by hash into groups of about RANK_ROWS,
ranked there, and moved on by the sizes of the groups before. The hash is of all columns, so pieces without an id, or of a repeated one, are spread too;
only rows that are equal in all columns share a group.

Edge cases: a null or empty text is one piece of the end id alone; an empty table gives no rows; repeated rows are
packed as often as they occur; a null doc_id is packed like any other; other columns are left alone.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import fresh, row_keys, text_batches, written
from .tokens import encoder, tokenizer_path

CAPACITY = 2048
END = 0
RANK_ROWS = 2000

PIECES = "doc_id long, piece int, start long, length int, ids binary"


def pieces(docs: DataFrame, tokenizer: str | None = None, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids): each text's ids and the end id, cut into pieces of `capacity` where longer. ids: little-endian unsigned 32-bit."""

    def cut(batches):
        enc = encoder(tokenizer or tokenizer_path("word_bpe_49k.json"))
        last = int(end).to_bytes(4, "little")
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary())])
        for batch in batches:
            rows, held = [[] for _ in schema], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py()) + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc, k, at // 4, len(part) // 4, part)):
                        column.append(value)
                held += len(ids)
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
                    rows, held = [[] for _ in schema], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


class Lengths:
    """A multiset of lengths, with the longest that is at most x."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v}
        self.keys = sorted(self.n)

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            self.keys.pop(bisect_left(self.keys, length))

    def at_most(self, x: int) -> int:
        i = bisect_left(self.keys, x + 1)
        return self.keys[i - 1] if i else 0

    def smallest(self, k: int) -> list[int]:
        out: list[int] = []
        for length in self.keys:
            out += [length] * min(self.n[length], k - len(out))
            if len(out) == k:
                break
        return out


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """The sets fixed for good, each with a count, and the counts that are left."""
    left, fixed, open_ = Lengths(counts), [], []

    def fix(lengths: tuple[int, ...]) -> None:
        n = min(left.n[x] // lengths.count(x) for x in set(lengths))
        fixed.append((lengths, n))
        for x in set(lengths):
            left.take(x, n * lengths.count(x))

    for j in sorted(counts, reverse=True):
        while left.n.get(j):
            left.n[j] -= 1  # beside one j: another j counts as any other
            if not left.n[j]:
                left.keys.pop(bisect_left(left.keys, j))
            room = capacity - j
            k, least = left.at_most(room), left.smallest(3)
            case: tuple[int, ...] | None = None
            if not k:
                case = (j,)
            elif k == room or len(least) < 2 or least[0] + least[1] > room:
                case = (j, k)
            elif len(least) < 3 or sum(least) > room:  # at most two fit
                pairs = [(x, min(x, left.at_most(room - x))) for x in left.keys if x + least[0] <= room and left.at_most(room - x)]
                if max(a + b for a, b in pairs) <= k:
                    case = (j, k)
                elif b := left.at_most(room - k):
                    if (b != k or left.n[k] > 1) and b >= max(y for _, y in pairs):
                        case = (j, k, b)
            if not left.n[j]:
                insort(left.keys, j)
            left.n[j] += 1
            if case is None:
                break
            fix(case)
        if left.n.get(j):
            open_.append(j)
    return fixed, dict(left.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit, longest first, over counts. A pattern is ((length, how many), ...), with the number of its sequences."""
    by_room: dict[int, dict[tuple, int]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple, n: int) -> None:
        if not n:
            return
        if room not in by_room:
            by_room[room] = {}
            insort(rooms, room)
        by_room[room][pattern] = by_room[room].get(pattern, 0) + n

    for length in sorted(counts, reverse=True):
        c = counts[length]
        while c:
            i = bisect_left(rooms, length)
            room = rooms[i] if i < len(rooms) else capacity
            each = room // length
            if i < len(rooms):
                pattern, n = next(iter(by_room[room].items()))
            else:
                pattern, n = (), -(-c // each)
            full = min(n, c // each)
            some = 1 if full < n and c > full * each else 0
            if i < len(rooms):
                del by_room[room][pattern]
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(i)
                put(room, pattern, n - full - some)
            put(room - each * length, pattern + ((length, each),), full)
            c -= full * each
            if some:
                put(room - c * length, pattern + ((length, c),), 1)
                c = 0
    return [(pattern, n) for of in by_room.values() for pattern, n in of.items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[str, np.ndarray], int]:
    """Runs of ranks of each length and where they go; the number of sequences."""
    fixed, left = reduce_by_dominance(counts, capacity)
    patterns = [(tuple((x, lengths.count(x)) for x in dict.fromkeys(lengths)), n) for lengths, n in fixed] + best_fit(left, capacity)
    runs, used, first = [], dict.fromkeys(counts, 0), 0
    for pattern, n in patterns:
        offset = 0
        for length, each in pattern:
            runs.append((length, used[length], first, each, offset))
            used[length] += n * each
            offset += length * each
        first += n
    assert used == dict(counts), "the plan places every piece once"
    runs.sort()
    return {k: np.array([r[i] for r in runs], np.int64) for i, k in enumerate(("length", "start", "first", "each", "offset"))}, first


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces, each with sequence_id and offset. pieces: a written table with doc_id, piece, length (1 to capacity)."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if any(not 1 <= x <= capacity for x in counts):
        raise ValueError(f"a piece is not of 1 to {capacity} tokens")
    runs, _ = plan(counts, capacity)
    many, group, n, before, place, rank = (fresh(pieces, x) for x in ("_many", "_group", "_n", "_before", "_place", "_rank"))
    groups = spark.createDataFrame([(k, -(-n_ // RANK_ROWS)) for k, n_ in counts.items()], f"length int, {many} int")
    dealt = pieces.join(F.broadcast(groups), "length").withColumn(group, F.pmod(F.xxhash64(*row_keys(pieces)), F.col(many)))
    sizes = dealt.groupBy("length", group).agg(F.count("*").alias(n))
    sums = sizes.select("length", group, (F.sum(n).over(Window.partitionBy("length").orderBy(group)) - F.col(n)).alias(before))
    within = F.row_number().over(Window.partitionBy("length", group).orderBy("doc_id", "piece"))
    ranked = dealt.withColumn(place, within).join(sums, ["length", group]).withColumn(rank, F.col(before) + F.col(place) - 1)

    names = [c for c in pieces.columns]
    out = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def assign(batches):
        key = runs["length"] << 44 | runs["start"]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            ranks = batch.column(rank).to_numpy()
            i = np.searchsorted(key, length << 44 | ranks, "right") - 1
            k = ranks - runs["start"][i]
            sequence, offset = runs["first"][i] + k // runs["each"][i], runs["offset"][i] + k % runs["each"][i] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, rank).mapInArrow(assign, out)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences themselves. A group is one sequence, so it is bounded by the capacity."""
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_of")).select("sequence_id", "n_tokens", F.aggregate("_of", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def packed_documents(docs: DataFrame, tokenizer: str | None = None, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack: a row a piece, with its ids."""
    return pack(written(pieces(docs, tokenizer, end, capacity), "pieces"), capacity)
