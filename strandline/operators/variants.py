"""Variant effects (R1, R2, R4-R8, R10-R12, J25; R3 is in selection.py): events from deltas, their classes, pairs and consequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import nearest_of


def detect_events(deltas: DataFrame, keys: list[str], channels=("donor", "acceptor"), threshold=0.1) -> DataFrame:
    """R2: a row for each channel whose delta is strictly beyond the threshold: channel, delta, direction."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(f"delta_{c}").alias("delta")) for c in channels))).alias("_e")
    got = deltas.select(*keys, each).select(*keys, "_e.*").where((F.col("delta") > threshold) | (F.col("delta") < -threshold))
    return got.withColumn("direction", F.when(F.col("delta") > 0, "gain").otherwise("loss"))


def delta_summary(deltas: DataFrame, by: list[str], distance: str, radius: int, channels=("donor", "acceptor")) -> DataFrame:
    """The largest gain and loss of each channel, and the largest change within the radius."""
    near = F.abs(F.col(distance)) <= radius
    return deltas.groupBy(*by).agg(*(x for c in channels for x in (F.greatest(F.max(f"delta_{c}"), F.lit(0.0)).alias(f"max_{c}_gain"), F.least(F.min(f"delta_{c}"), F.lit(0.0)).alias(f"max_{c}_loss"), F.max(F.when(near, F.abs(f"delta_{c}"))).alias(f"max_{c}_near"))))


def annotate(events: DataFrame, sites: DataFrame, on: list[str], canonical=2, shifted=50, position="position", mark="mark") -> DataFrame:
    """Canonical within 2 of a site of the kind, shifted within 50, else cryptic."""
    d = F.abs("mark_distance")
    return nearest_of(events, sites, on, position, mark, shifted).withColumn("event_class", F.when(d <= canonical, "canonical").when(d <= shifted, "shifted").otherwise("cryptic"))


def pair_events(events: DataFrame, variant: str, most: int = 500) -> DataFrame:
    """Each loss, strongest first, takes the strongest gain of its channel within `most` bases that is still free.

    The choice depends on the ones before, so events are handled in order in one group: a chain of a variant's events of one channel. An empty
    stretch of `most` positions or more closes a chain, as no pair crosses it. In a chain of n events a choice takes log(n) steps. Most chains are
    of a few events, so tasks stream through their chains and take those of an Arrow batch at once; only a chain that is longer is held across batches.
    """
    width = max(1, most)
    own = events.select(F.col(variant).alias("_variant"), "channel", F.col("position").cast("bigint").alias("position"), F.col("delta").cast("double").alias("delta"), "direction").withColumn("_bin", F.floor(F.col("position") / width))
    bins = own.select(F.col("_variant").alias("_v"), F.col("channel").alias("_c"), F.col("_bin").alias("_b")).distinct()
    w = Window.partitionBy("_v", "_c").orderBy("_b")  # a row a bin
    opens = F.when(F.col("_b") - F.lag("_b").over(w) <= 1, 0).otherwise(1)
    chains = bins.withColumn("_new", opens).withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    held = own.join(chains, F.col("_variant").eqNullSafe(F.col("_v")) & F.col("channel").eqNullSafe(F.col("_c")) & F.col("_bin").eqNullSafe(F.col("_b")))
    size = F.nanvl(F.abs("delta"), F.lit(None).cast("double"))
    strongest = Window.partitionBy("_variant", "channel", "_chain").orderBy(F.desc_nulls_last(size), F.asc_nulls_last("position"))
    ordered = held.select("_variant", "channel", "position", "delta", "direction", F.row_number().over(strongest).alias("_k"))  # a task has chain after chain, each from _k = 1

    def paired(batches):
        parts = []  # of the chain that may go on
        for batch in batches:
            first = np.flatnonzero(batch.column("_k").to_numpy() == 1)
            if len(first):
                if whole := [*parts, *([batch.slice(0, first[-1])] if first[-1] else [])]:
                    yield from pair_chains(whole, most, names)
                parts = []
            parts.append(batch.slice(first[-1]) if len(first) else batch)
        if parts:
            yield from pair_chains(parts, most, names)

    kind = dict(events.dtypes)
    names = [variant, "channel", "loss_position", "loss_delta", "gain_position", "gain_delta"]
    return ordered.mapInArrow(paired, f"`{variant}` {kind[variant]}, channel string, loss_position bigint, loss_delta double, gain_position bigint, gain_delta double")


def pair_chains(parts: list[pa.RecordBatch], most: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The losses of whole chains with their gains. Chains are laid out more than `most` apart, so one pass over all of them pairs within each."""
    t = pa.Table.from_batches(parts)
    if not len(t):
        return
    at, known = t["position"].fill_null(0).to_numpy(), t["position"].is_valid().to_numpy()
    new = t["_k"].to_numpy() == 1
    start, chain = np.flatnonzero(new), np.cumsum(new) - 1
    low = np.minimum.reduceat(at, start)
    room = np.maximum.reduceat(at, start) - low + most + 1
    at = at - low[chain] + (np.cumsum(room) - room)[chain]
    is_kind = lambda k: pc.fill_null(pc.equal(t["direction"], k), False).to_numpy()
    gains, losses = np.flatnonzero(is_kind("gain") & known), np.flatnonzero(is_kind("loss"))
    taken = np.full(len(losses), -1)
    taken[known[losses]] = strongest_free(at[gains], at[losses[known[losses]]], most)
    gain = pa.array(np.append(gains, -1)[taken], mask=taken < 0)
    loss = t.take(pa.array(losses))
    yield from pa.table([loss["_variant"], loss["channel"], loss["position"], loss["delta"], t["position"].take(gain), t["delta"].take(gain)], names=names).to_batches()


def strongest_free(gains: np.ndarray, losses: np.ndarray, most: int) -> np.ndarray:
    """For each loss in turn, the place of the first free gain within `most` of it, or -1. gains, losses: positions, strongest first.

    A tree over the gains in the order of position holds the least free place of each node.
    """
    n = len(gains)
    order = np.argsort(gains, kind="stable")
    at = gains[order]
    low, high = np.searchsorted(at, losses - most, "left").tolist(), np.searchsorted(at, losses + most, "right").tolist()
    size = 1 << max(0, n - 1).bit_length()
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    level = np.concatenate([order, np.full(size - n, n)])
    levels = [level]
    while len(level) > 1:
        level = level.reshape(-1, 2).min(1)
        levels.append(level)
    tree, out = [n, *np.concatenate(levels[::-1]).tolist()], np.full(len(losses), -1)
    for k, (a, b) in enumerate(zip(low, high)):
        best, a, b = n, a + size, b + size
        while a < b:
            if a & 1:
                best = min(best, tree[a])
                a += 1
            if b & 1:
                b -= 1
                best = min(best, tree[b])
            a, b = a >> 1, b >> 1
        if best < n:
            out[k] = best
            a = int(where[best]) + size
            tree[a] = n
            while a > 1:
                a >>= 1
                tree[a] = min(tree[2 * a], tree[2 * a + 1])
    return out


def consequence(events: DataFrame, variant: str) -> DataFrame:
    """The first rule that holds: skip, shift, destruction, retention, cryptic, complex, none."""
    flag = lambda direction, channel=None, cls=None: F.bool_or((F.col("direction") == direction) & (F.lit(True) if channel is None else F.col("channel") == channel) & (F.lit(True) if cls is None else F.col("event_class") == cls))
    got = events.groupBy(variant).agg(
        flag("loss", "donor", "canonical").alias("ld"), flag("loss", "acceptor", "canonical").alias("la"), flag("gain", cls="shifted").alias("gs"), flag("gain", cls="cryptic").alias("gc"), flag("gain").alias("g"), F.max(F.abs("delta")).alias("max_abs_delta"), F.count("*").alias("n_events"),
    )
    lost = F.col("ld") | F.col("la")
    name = F.when(F.col("ld") & F.col("la") & ~F.col("g"), "exon_skipping").when(lost & F.col("gs"), "site_shift").when(lost & ~F.col("g"), "site_destruction").when(lost & F.col("gc"), "intron_retention").when(F.col("gc"), "cryptic_exon").otherwise("complex")
    return got.select(variant, name.alias("consequence"), "max_abs_delta", confidence(F.col("max_abs_delta")).alias("confidence"), "n_events")


def confidence(size: Column, high=0.5, moderate=0.2) -> Column:
    """R8."""
    return F.when(size >= high, "HIGH").when(size >= moderate, "MODERATE").otherwise("LOW")


def call_sites(df: DataFrame, donor="donor", acceptor="acceptor", threshold=0.5, least=0.0) -> DataFrame:
    """The site that a position is called as."""
    d, a = F.col(donor), F.col(acceptor)
    return df.withColumn("call", F.when((d >= threshold) & (d >= a) & (d >= least), "donor").when((a >= threshold) & (a >= least), "acceptor").otherwise("none"))


def corrections(df: DataFrame, base: str, meta: str, label: str, threshold=0.5) -> DataFrame:
    """Where the second model mends or breaks what the first said."""
    b, m, y = F.col(base) >= threshold, F.col(meta) >= threshold, F.col(label) == 1
    return df.withColumn("change", F.when(y & ~b & m, "fn_fixed").when(~y & b & ~m, "fp_fixed").when(y & b & ~m, "fn_new").when(~y & ~b & m, "fp_new").otherwise("same"))


def affected_exons(events: DataFrame, exons: DataFrame, on: list[str], variant: str, exon="exon_number", within=2, position="position", start="start", end="end") -> DataFrame:
    """The exons with a boundary within 2 bases of an event, in order."""
    edges = exons.select(*on, exon, F.explode(F.array(start, end)).alias("_edge"))
    probe = events.withColumn("_edge", F.explode(F.sequence(F.col(position) - within, F.col(position) + within)))
    return probe.join(edges, [*on, "_edge"]).groupBy(variant).agg(F.array_sort(F.collect_set(exon)).alias("exons"))


def kd_gained_boundary(event: Column, strand: Column, dpsi: Column, first: Column, second: Column) -> Column:
    """Of an event's two boundaries, the one gained on knock-down, by kind of event, strand and sign of the change."""
    a5 = event == "A5SS"
    forward = (strand == "+") == (dpsi > 0)
    return F.when(a5, F.when(forward, first).otherwise(second)).otherwise(F.when(forward, second).otherwise(first))


def evaluation_summary(df: DataFrame, pathogenic: str, detected: str) -> DataFrame:
    """Detection rate among pathogenic, false alarms among benign, accuracy."""
    y, d = F.col(pathogenic) == 1, F.col(detected)
    n = lambda c: F.sum(c.cast("long"))
    return df.agg(F.count("*").alias("n"), (n(y & d) / n(y)).alias("detection_rate"), (n(~y & d) / n(~y)).alias("false_positive_rate"), (n(y == d) / F.count("*")).alias("accuracy"))
