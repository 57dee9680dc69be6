"""Paralogs by alignment: minimizer seeds, colinear chains, identity and coverage of a hit.

Each distinct sequence is sampled into minimizers (of `w` neighbouring k-mers those of least hash, of either strand). Train minimizers that no test sequence can have are left out by a bit array of fixed
size; the rest meet in a join on the hash, and a minimizer that occurs in the train sequences more than `most` times is no seed, as in the aligners that this follows. The seeds of a test sequence
are one group, which its length and `most` bound: those of a pair and strand are chained there, without the texts, and pairs with few seeds or a short chain go. A chain is the best run of seeds
that rise in both. Between neighbouring seeds of the best chain the bases are aligned exactly (unit costs), and beyond its ends as far as matches outweigh the rest; identity is matches / columns, and coverage columns / length of the test sequence. Equal sequences are aligned once, and all
members of their classes get the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import reverse_complement
from ..streaming.metrics import shared_folder

K, W = 15, 10
#: A minimizer of more train occurrences is no seed; a pair needs so many seeds; neighbours in a chain are at most so far apart; a seed looks back at so many.
MOST, LEAST_SEEDS, GAP, BACK = 500, 3, 1000, 64
CODE = np.full(256, 4, np.uint8)
CODE[[ord(c) for c in "ACGTacgt"]] = [0, 1, 2, 3] * 2
#: Bits of the array of test minimizers. A full one lets more rows pass, with the same result.
SIEVE = 1 << 26
PACKED = 1 << 13


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 2-bit k-mers that no two share, so that the least is no run of one letter."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def codes(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-mers of a sequence of 2-bit bases as numbers, and their reverse complements; from runs of 1, 2, 4 ... bases."""
    run, held, size, done = (code.astype(np.uint64), np.uint64(3) - code.astype(np.uint64)), None, 1, 0

    def joined(a, m, b, n):
        size = min(len(a[0]) - m, len(b[0]) - m)
        return a[0][:size] << np.uint64(2 * n) | b[0][m : m + size], a[1][:size] | b[1][m : m + size] << np.uint64(2 * m)

    while True:
        if k & size:
            held, done = (joined(held, done, run, size) if done else run), done + size
        if 2 * size > k:
            return held[0][: len(code) - k + 1], held[1][: len(code) - k + 1]
        run, size = joined(run, size, run, size), 2 * size


def sliding(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f (minimum or maximum) of each w neighbours."""
    size = 1
    while 2 * size <= w:
        x, size = f(x[:-size], x[size:]), 2 * size
    return f(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def minimizers(sequence: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, 0-based places, whether the forward strand's) of a sequence. k-mers with another letter than A, C, G and T, and those that are their own reverse complement, are none."""
    code = CODE[np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)]
    n = len(code) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    one, other = codes(code & 3, k)
    odd = np.concatenate([[0], np.cumsum(code > 3)])
    forward = one < other
    h = mixed(np.where(forward, one, other)) >> np.uint64(1)
    h[(odd[k:] != odd[:-k]) | (one == other)] = np.uint64(1 << 63)
    # A k-mer is a minimizer if it is the least of any window that holds it: the largest of these windows' least ones.
    w = min(w, n)
    edge = np.zeros(w - 1, np.uint64)
    most = sliding(np.concatenate([edge, sliding(h, w, np.minimum), edge]), w, np.maximum)
    at = np.flatnonzero((h == most) & (h < np.uint64(1 << 63)))
    return h[at].astype(np.int64), at.astype(np.int32), forward[at]


def seeds(sequences: DataFrame, k: int, w: int, sieve: Broadcast | None = None) -> DataFrame:
    """(class, length, hash, seed) of (class, sequence); seed: twice the position, plus 1 on the forward strand. sieve: minimizers that its bits lack are left out."""

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = sieve.value if sieve else None
        for part in parts:
            rows: list[tuple] = []
            for name, text in zip(part["class"], part["sequence"]):
                h, at, forward = minimizers(text, k, w)
                if bits is not None:
                    low = h & (len(bits) * 64 - 1)
                    there = (bits[low >> 6] >> (low & 63)) & 1 == 1
                    h, at, forward = h[there], at[there], forward[there]
                rows.append((np.full(len(h), name, np.int64), np.full(len(h), len(text), np.int32), h, at * 2 + forward))
                if sum(len(r[2]) for r in rows[-64:]) > 1 << 18 or len(rows) == 64:
                    yield pd.DataFrame(dict(zip(("class", "length", "hash", "seed"), map(np.concatenate, zip(*rows)))))
                    rows = []
            if rows:
                yield pd.DataFrame(dict(zip(("class", "length", "hash", "seed"), map(np.concatenate, zip(*rows)))))

    return sequences.mapInPandas(find, "class bigint, length int, hash bigint, seed int")


def sieve_of(posted: DataFrame, bits: int) -> Broadcast:
    """A bit array (as signed words) of the low bits of all hashes; a task sends a row a word at most, and the driver gets the array in PACKED words a row."""
    low = F.col("hash").bitwiseAND(bits - 1)
    words = posted.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(hash & 63 AS INT))")).alias("bits"))

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(PACKED, np.int64)
        out[part["word"].to_numpy(np.int64) % PACKED] = part["bits"].to_numpy(np.int64)
        return pd.DataFrame({"at": [int(part["word"].iloc[0]) // PACKED], "bits": [out.tobytes()]})

    out = np.zeros(-(-bits // (64 * PACKED)) * PACKED, np.int64)
    for at, some in words.groupBy(F.floor(F.col("word") / PACKED)).applyInPandas(packed, "at bigint, bits binary").collect():
        out[at * PACKED : (at + 1) * PACKED] = np.frombuffer(some, np.int64)
    return posted.sparkSession.sparkContext.broadcast(out[: bits // 64].copy())


def best_chains(q: np.ndarray, t: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int = K, gap: int = GAP, back: int = BACK) -> tuple[np.ndarray, np.ndarray]:
    """Of each group of seeds (rising q, then t) the best chain: most bases covered, less a hundredth of a base for each base that the two gaps differ by. (the seed before or -1, the chain's last seed), as places in the group.

    Groups of like size are filled in side by side, a seed of each at a time; what a step gives and costs is found for many seeds at once.
    """
    came, last = np.full(len(q), -1, np.int32), np.zeros(len(sizes), np.int64)
    order = np.argsort(sizes, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and hi - lo < 512 and sizes[order[hi]] <= 8 + 1.25 * sizes[order[lo]] and (hi + 1 - lo) * sizes[order[hi]] <= 1 << 18:
            hi += 1
        of = order[lo:hi]
        n, m = int(sizes[of[-1]]), hi - lo
        look = min(back, n)
        there = np.arange(n) < sizes[of][:, None]
        at = np.where(there, starts[of][:, None] + np.arange(n), 0)
        # `look` places before the first seed are too far from any, and places after the last one are before all.
        a, b = (np.concatenate([np.full((m, look), -1e12), np.where(there, x[at], -1e12)], 1) for x in (q, t))
        score, best, beside = np.full((m, look + n), float(k)), np.zeros((m, n), np.int64), np.arange(m)
        block = max(1, (1 << 17) // (look * m))
        for i in range(0, n, block):
            stop = min(i + block, n)
            dq, dt = (x[:, look + i : look + stop, None] - np.lib.stride_tricks.sliding_window_view(x[:, i : look + stop - 1], look, 1) for x in (a, b))
            near, far = np.minimum(dq, dt), np.maximum(dq, dt)
            loss = 0.01 * (far - near)
            loss[(near <= 0) | (far > gap)] = np.inf
            gain = np.minimum(near, k, out=near)
            for j in range(i, stop):
                got = score[:, j : j + look] + gain[:, j - i]
                got -= loss[:, j - i]
                top = got.argmax(1)
                best[:, j] = top
                np.maximum(got[beside, top], k, out=score[:, look + j])
        score = score[:, look:]
        prior = np.where(score > k, np.arange(n) - look + best, -1)
        last[of] = np.where(there, score, -1.0).argmax(1)
        came[at[there]] = prior[there]
        lo = hi
    return came, last


def best_chain(q: np.ndarray, t: np.ndarray, k: int = K, gap: int = GAP, back: int = BACK) -> np.ndarray:
    """The places of the seeds (rising q, then t) of the best chain of one group."""
    came, last = best_chains(q, t, np.zeros(1, np.int64), np.array([len(q)]), k, gap, back)
    return traced(came, int(last[0]))


def traced(came: np.ndarray, i: int) -> np.ndarray:
    path = []
    while i >= 0:
        path.append(i)
        i = int(came[i])
    return np.array(path[::-1])


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(matches, columns) of a global alignment of least unit costs, with most matches among these."""
    return all_aligned([(a, b)])[0]


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """a and b without the ends that are equal, and how many bases these are. To match them is never worse."""
    same = equal(a, b)
    a, b = a[same:], b[same:]
    after = equal(a[::-1], b[::-1])
    return a[: len(a) - after], b[: len(b) - after], same + after


def all_aligned(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """aligned() of pairs, those of like length side by side, a row of their tables at a time."""
    cut = [trimmed(a, b) if len(a) <= len(b) else trimmed(b, a) for a, b in pairs]
    out = [(same, same + len(b)) for _, b, same in cut]
    order = sorted((i for i, (a, b, _) in enumerate(cut) if len(a)), key=lambda i: (len(cut[i][1]), len(cut[i][0])))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and hi - lo < 256 and len(cut[order[hi]][1]) <= 8 + 1.25 * len(cut[order[lo]][1]) and (hi + 1 - lo) * len(cut[order[hi]][1]) <= 1 << 15:
            hi += 1
        of = order[lo:hi]
        rows, width = max(len(cut[i][0]) for i in of), len(cut[of[-1]][1])
        kind, big = (np.int32, 1 << 15) if width < 1 << 15 else (np.int64, 1 << 32)
        x, y = np.zeros((len(of), rows), np.uint8), np.full((len(of), width), 255, np.uint8)
        for p, i in enumerate(of):
            x[p, : len(cut[i][0])], y[p, : len(cut[i][1])] = cut[i][:2]
        sizes, ends = np.array([len(cut[i][0]) for i in of]), np.array([len(cut[i][1]) for i in of])
        j = np.arange(width + 1, dtype=kind) * kind(big)
        row, step = np.repeat(j[None], len(of), 0), np.empty((len(of), width + 1), kind)
        for i in range(1, rows + 1):
            step[:, 0] = i * big
            np.minimum(row[:, 1:] + kind(big), row[:, :-1] + np.where(y == x[:, i - 1 : i], kind(-1), kind(big)), out=step[:, 1:])
            row = np.minimum.accumulate(step - j, axis=1) + j
            for p in np.flatnonzero(sizes == i).tolist():
                last = int(row[p, ends[p]])
                cost, same = -(-last // big), cut[of[p]][2]
                out[of[p]] = (cost * big - last + same, cost * big - last + same + cost)
        lo = hi
    return out


def equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many letters a and b begin with in common."""
    n = min(len(a), len(b))
    other = a[:n] != b[:n]
    at = int(other.argmax()) if n else 0
    return at if n and other[at] else n


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """The least unit costs of a global alignment, by bits of one number a row (Myers, Hyyro): what aligned() takes longer to find with the matches."""
    a, b, _ = trimmed(a, b)
    if not len(a) or not len(b):
        return max(len(a), len(b))
    a, b = a.tolist(), b.tolist()
    ones, top, cost = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    at: dict[int, int] = {}
    for x in set(a):
        at[x] = int("".join("1" if y == x else "0" for y in reversed(a)), 2)
    up, down = ones, 0
    for x in b:
        eq = at.get(x, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (ones & ~(d0 | up)), d0 & up
        if rise & top:
            cost += 1
        elif fall & top:
            cost -= 1
        rise, fall = (rise << 1 | 1) & ones, (fall << 1) & ones
        up, down = fall | (ones & ~(d0 | rise)), d0 & rise
    return cost


#: Beyond a chain's ends: a match counts 1, any other column 2 less; the band beside the diagonal, and how far under its best an extension may fall.
LOSS, BAND, DROP = 2, 200, 60


#: Rows of the tables of so many extensions are filled in side by side; after so many rows those that ended are taken out.
SIDE, ROWS = 64, 64


def extended(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """(matches, columns, bases of a, bases of b) of the best alignment that begins where a and b begin; none, if no match pays."""
    return all_extended([(a, b)])[0]


def all_extended(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, int]]:
    """extended() of pairs. What two begin with in common is matched without a table, which is never worse."""
    cut = [(a[same:], b[same:], same) for a, b, same in ((a, b, equal(a, b)) for a, b in pairs)]
    out = [(same, same, same, same) for _, _, same in cut]
    left = sorted((i for i, (a, _, _) in enumerate(cut) if len(a)), key=lambda i: len(cut[i][0]))
    big, none = 1 << 32, -(1 << 61)
    off = np.arange(-BAND, BAND + 1)
    drop = LOSS * big * off  # what gaps along a row lose
    for lo in range(0, len(left), SIDE):
        of = np.array(left[lo : lo + SIDE])
        sizes, ends = np.array([len(cut[i][0]) for i in of]), np.array([len(cut[i][1]) for i in of])
        row = np.where((off >= 0) & (off <= ends[:, None]), -drop, none)
        best, at, ended = np.zeros(len(of), np.int64), np.zeros((len(of), 2), np.int64), np.zeros(len(of), bool)
        i = 0
        while len(of):
            x, beside = np.zeros((len(of), ROWS), np.uint8), np.full((len(of), ROWS + 2 * BAND + 1), 255, np.uint8)  # a[i:], b[i - BAND :]
            for p, o in enumerate(of.tolist()):
                a, b = cut[o][0][i : i + ROWS], cut[o][1][max(0, i - BAND) : i + ROWS + BAND + 1]
                x[p, : len(a)], beside[p, max(0, BAND - i) : max(0, BAND - i) + len(b)] = a, b
            for r in range(ROWS):
                i += 1
                ended |= (i > sizes) | (i - BAND > ends)
                if ended.all():
                    break
                step = row + np.where(beside[:, r : r + 2 * BAND + 1] == x[:, r : r + 1], big + 1, -LOSS * big)
                np.maximum(step[:, :-1], row[:, 1:] - LOSS * big, out=step[:, :-1])
                if i <= BAND:
                    step[:, : BAND - i], step[:, BAND - i] = none, -LOSS * big * i
                beyond = off + i > ends[:, None] if i + BAND > ends.min() else None
                if beyond is not None:
                    step[beyond] = none
                step += drop
                row = np.maximum.accumulate(step, axis=1)
                row -= drop
                if i <= BAND:
                    row[:, : BAND - i] = none
                if beyond is not None:
                    row[beyond] = none
                k = row.argmax(1)
                top = row[np.arange(len(of)), k]
                up = ~ended & (top > best)
                best[up], at[up, 0], at[up, 1] = top[up], i, i + k[up] - BAND
                ended |= top < best - DROP * big
            for p in np.flatnonzero(ended).tolist():
                score, matches, same = int(best[p]) >> 32, int(best[p]) & (big - 1), cut[of[p]][2]
                out[of[p]] = (matches + same, matches + same + (matches - score) // LOSS, int(at[p, 0]) + same, int(at[p, 1]) + same)
            on = ~ended
            of, sizes, ends, row, best, at, ended = of[on], sizes[on], ends[on], row[on], best[on], at[on], ended[on]
    return out


def chain(q: np.ndarray, t: np.ndarray, length: int, k: int = K, span: float = 0.0) -> tuple[np.ndarray, np.ndarray] | None:
    """The seeds at q and t, both on one strand, of the best chain; none, if it spans less than a share of the query's length."""
    if q.max() + k - q.min() < span * length:
        return None
    order = np.lexsort((t, q))
    q, t = q[order].astype(np.int64), t[order].astype(np.int64)
    path = best_chain(q, t, k)
    q, t = q[path], t[path]
    return None if q[-1] + k - q[0] < span * length else (q, t)


def hit(query: str, target: str, q: np.ndarray, t: np.ndarray, k: int = K, identity: float = 0.0, coverage: float = 0.0) -> tuple[int, int, int, int, int, int] | None:
    """(first and last base of the query, of the target, matches, columns) of a chain of seeds at q and t, both on one strand; none, if it can't reach the identity and coverage."""
    return all_hits([(query, target, q, t, identity, coverage)], k)[0]


def all_hits(pairs: list[tuple[str, str, np.ndarray, np.ndarray, float, float]], k: int = K) -> list[tuple[int, int, int, int, int, int] | None]:
    """hit() of pairs: the ends of all, then the gaps of those that can still reach what is asked."""
    code = lambda x: np.frombuffer(x.upper().encode("ascii", "replace"), np.uint8)
    text = [(code(query), code(target)) for query, target, *_ in pairs]
    place = [(int(q[0]), int(t[0]), int(q[-1]) + k, int(t[-1]) + k) for _, _, q, t, *_ in pairs]
    ends = all_extended([x for (a, b), (q0, t0, q1, t1) in zip(text, place) for x in ((a[:q0][::-1], b[:t0][::-1]), (a[q1:], b[t1:]))])
    out: list[tuple | None] = [None] * len(pairs)
    gaps, of = [], []
    for i, ((_, _, q, t, identity, coverage), (a, b), (q0, t0, q1, t1), before, after) in enumerate(zip(pairs, text, place, ends[::2], ends[1::2])):
        dq, dt = np.diff(q), np.diff(t)
        plain = (dq == dt) & (dq <= k)
        matches = k + int(dq[plain].sum()) + before[0] + after[0]
        columns = k + int(dq[plain].sum()) + before[1] + after[1]
        between = [(a[q[x] + k : q[x + 1] + k], b[t[x] + k : t[x + 1] + k]) for x in np.flatnonzero(~plain).tolist()]
        surely = matches / (columns + int(np.maximum(dq, dt)[~plain].sum())) >= identity and columns / len(a) >= coverage
        if not surely:
            # The columns that don't match are a gap's costs, and matches at most half of what these leave of both sides.
            most, others = matches + int(np.minimum(dq, dt)[~plain].sum()), columns - matches + int(np.abs(dq - dt)[~plain].sum())
            for x, y in between:
                if most / (most + others) < identity:
                    break
                cost = distance(x, y)
                most, others = most + (len(x) + len(y) - cost) // 2 - min(len(x), len(y)), others + cost - abs(len(x) - len(y))
            if most / (most + others) < identity or (most + others) / len(a) < coverage:
                continue
        gaps += between
        of += [i] * len(between)
        out[i] = (q0 - before[2], q1 + after[2] - 1, t0 - before[3], t1 + after[3] - 1, matches, columns)
    for i, (m, n) in zip(of, all_aligned(gaps)):
        out[i] = (*out[i][:4], out[i][4] + m, out[i][5] + n)
    return out


def chains(met: DataFrame, k: int, span: float) -> DataFrame:
    """(q_class, t_class, forward, alone, q, t) of the best chain of each pair and strand with enough seeds; alone: the pair's other strand has none. met: a row a test seed, with the train seeds of its hash as two arrays."""

    def find(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table["seeds"].combine_chunks() if table["seeds"].num_chunks != 1 else table["seeds"].chunk(0)
        many = np.diff(lists.offsets.to_numpy())
        targets = np.concatenate([c.flatten().to_numpy() for c in table["targets"].chunks])
        t = lists.flatten().to_numpy()
        q = np.repeat(table["seed"].to_numpy(), many)
        name, length = table["class"][0].as_py(), table["length"][0].as_py()
        names, group = np.unique(targets, return_inverse=True)
        same = (q & 1) == (t & 1)
        group = group * 2 + same
        enough = np.bincount(group, minlength=1)[group] >= LEAST_SEEDS
        kinds = [("q_class", pa.int64()), ("t_class", pa.int64()), ("forward", pa.bool_()), ("alone", pa.bool_()), ("q", pa.list_(pa.int32())), ("t", pa.list_(pa.int32()))]
        if not enough.any():
            return pa.schema(kinds).empty_table()
        group, same, q, t = group[enough], same[enough], q[enough] >> 1, t[enough] >> 1
        q = np.where(same, q, length - k - q)
        order = np.lexsort((t, q, group))
        group, q, t = group[order], q[order].astype(np.int64), t[order].astype(np.int64)
        new = np.concatenate([[True], group[1:] != group[:-1]])
        starts, sizes = np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(group)))
        # A chain has no step over GAP, so that one of a group's runs without such a step is to be long enough.
        part = np.flatnonzero(new | (np.diff(q, prepend=0) > GAP))
        long = q[np.append(part[1:], len(q)) - 1] + k - q[part] >= span * length
        fit = np.isin(group[starts], group[part[long]])
        starts, sizes = starts[fit], sizes[fit]
        came, last = best_chains(q, t, starts, sizes, k)
        rows = []
        for i in np.flatnonzero(q[starts + last] + k - q[starts] >= span * length).tolist():
            path = starts[i] + traced(came[starts[i] : starts[i] + sizes[i]], int(last[i]))
            if q[path[-1]] + k - q[path[0]] >= span * length:
                rows.append((int(group[starts[i]]), q[path], t[path]))
        found = {g for g, _, _ in rows}
        columns = [[name] * len(rows), [int(names[g >> 1]) for g, _, _ in rows], [g & 1 == 1 for g, _, _ in rows], [g ^ 1 not in found for g, _, _ in rows], [r[1] for r in rows], [r[2] for r in rows]]
        return pa.table({c: pa.array(values, kind) for values, (c, kind) in zip(columns, kinds)}, pa.schema(kinds))

    dealt = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), "class")  # few bytes are much work here too
    return dealt.groupBy("class").applyInArrow(find, "q_class bigint, t_class bigint, forward boolean, alone boolean, q array<int>, t array<int>")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder that driver and executors share, and read again."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def hits(test: DataFrame, train: DataFrame, key: str, sequence: str, k: int = K, w: int = W, most: int = MOST, span: float = 0.0, identity: float = 0.0, coverage: float = 0.0) -> DataFrame:
    """(query, target, forward, q_start, q_end, t_start, t_end, matches, columns, identity, coverage) of each pair of test and train sequences with enough seeds, the better strand's; 1-based, of the query's strand.

    span: chains over less than that share of the query are no hits, and their bases aren't aligned. identity, coverage: hits below these may be left out, where they are the pair's only one. Sequences, with their classes, are written once.
    Null keys and sequences, and those shorter than k, have no hit; a key that is in both tables isn't paired with itself.
    """
    grouped = lambda df: df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.upper(F.col(sequence)).alias("sequence")).withColumn("class", F.xxhash64("sequence"))
    # A condition on the length before they are written would make each sequence twice.
    tests, trains = (kept(grouped(df), name).where(F.length("sequence") >= k) for df, name in ((test, "tests"), (train, "trains")))
    one = F.when(F.min("sequence") == F.max("sequence"), F.min("sequence")).otherwise(F.raise_error("two sequences have one hash"))
    texts = lambda df: df.groupBy("class").agg(one.alias("sequence"))
    asked = kept(seeds(texts(tests), k, w), "minimizers")
    posted = seeds(texts(trains), k, w, sieve_of(asked, SIEVE)).drop("length").repartition("hash")
    # All columns are asked for here, so that this and the join have one exchange; without, each would make the minimizers again.
    common = posted.groupBy("hash").agg(F.count("*").alias("_n"), F.max("class").alias("_c"), F.max("seed").alias("_s")).where(f"_n <= {most} AND _c IS NOT NULL AND _s IS NOT NULL").select("hash")
    listed = posted.join(common, "hash").groupBy("hash").agg(F.collect_list("class").alias("targets"), F.collect_list("seed").alias("seeds"))
    both = kept(chains(asked.join(listed, "hash").drop("hash"), k, span), "chains")
    text = lambda df, side: df.join(both.select(F.col(f"{side}_class").alias("class")).distinct(), "class", "left_semi").groupBy(F.col("class").alias(f"{side}_class")).agg(F.min("sequence").alias(f"{side}_text"))
    both = both.join(text(tests, "q"), "q_class").join(text(trains, "t"), "t_class")
    both = both.withColumn("q_text", F.when(F.col("forward"), F.col("q_text")).otherwise(reverse_complement(F.col("q_text"))))

    @F.pandas_udf("q_start int, q_end int, t_start int, t_end int, matches int, columns int")
    def align(q_text: pd.Series, t_text: pd.Series, alone: pd.Series, q: pd.Series, t: pd.Series) -> pd.DataFrame:
        # A pair's better strand is told by its matches, so both are aligned where there are two.
        asked = [(a, b, np.asarray(x), np.asarray(y), *((identity, coverage) if only else (0.0, 0.0))) for a, b, only, x, y in zip(q_text, t_text, alone, q, t)]
        found = [h for i in range(0, len(asked), 256) for h in all_hits(asked[i : i + 256], k)]
        rows = [(None,) * 6 if h is None else (h[0] + 1, h[1] + 1, h[2] + 1, h[3] + 1, *h[4:]) for h in found]
        return pd.DataFrame(rows, columns=["q_start", "q_end", "t_start", "t_end", "matches", "columns"], dtype="Int32")

    # Few bytes are much work here, so that partitions aren't merged; and the function runs once a row.
    dealt = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), "q_class", "t_class")
    found = dealt.select("q_class", "t_class", "forward", F.length("q_text").alias("_length"), align.asNondeterministic()("q_text", "t_text", "alone", "q", "t").alias("h")).select("q_class", "t_class", "forward", "_length", "h.*")
    found = found.where("matches IS NOT NULL")
    found = found.withColumn("identity", F.col("matches") / F.col("columns")).withColumn("coverage", F.col("columns") / F.col("_length"))
    names = [c for c in found.columns if c not in ("q_class", "t_class", "_length")]
    better = found.groupBy("q_class", "t_class").agg(F.max_by(F.struct(*names), F.struct("matches", -F.col("columns"), "forward")).alias("h")).select("q_class", "t_class", "h.*")
    out = better.join(tests.select(F.col("class").alias("q_class"), F.col("_key").alias("query")), "q_class").join(trains.select(F.col("class").alias("t_class"), F.col("_key").alias("target")), "t_class")
    return out.where(F.col("query") != F.col("target")).select("query", "target", *names)


def paralogs(test: DataFrame, train: DataFrame, key: str, sequence: str, identity: float = 0.8, coverage: float = 0.5, **how) -> DataFrame:
    """The keys of test sequences with a hit of the identity and coverage in the train sequences, and the hit of most matches (the smaller target, on ties)."""
    good = hits(test, train, key, sequence, **{"span": coverage / 2, "identity": identity, "coverage": coverage} | how).where((F.col("identity") >= identity) & (F.col("coverage") >= coverage))
    top = good.groupBy("query").agg(F.max("matches").alias("matches"))
    good = good.join(top, ["query", "matches"])
    best = F.min_by(F.struct("target", "identity", "coverage"), "target").alias("h")
    return good.groupBy(F.col("query").alias(key)).agg(best).select(key, "h.*")
