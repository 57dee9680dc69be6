"""Range joins by binning (J5, J6, J8, J20-J24, E18's offsets): an equi-join on (key, bin) with the range as residual filter.

An interval is exploded into the bins it touches and a point lies in one bin, so the join is a plain shuffle hash or sort-merge
join that adaptive execution can split, never a nested loop. An interval and a point meet in one bin only. Overlaps of intervals with each other are counted and listed
without making pairs, and nearest marks at any distance are found by scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .scans import PARTS, ranges, scan
from .windows import with_halo


def binned(intervals: DataFrame, start: str, end: str, width: int, name="_bin") -> DataFrame:
    """A row for each bin that [start, end] touches."""
    return intervals.where(F.col(start) <= F.col(end)).withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def points_in_intervals(points: DataFrame, intervals: DataFrame, on: list[str], position="position", start="start", end="end", width=10_000, closed=True) -> DataFrame:
    """Every (point, interval) with start <= position <= end (< end where not closed). Column names must not clash but for `on`."""
    cut = binned(intervals, start, end, width)
    inside = (F.col(position) >= F.col(start)) & ((F.col(position) <= F.col(end)) if closed else (F.col(position) < F.col(end)))
    return points.withColumn("_bin", F.floor(F.col(position) / width)).join(cut, [*on, "_bin"]).where(inside).drop("_bin")


def overlap_counts(intervals: DataFrame, on: list[str], key: str, start="start", end="end") -> DataFrame:
    """(on, key, n_overlaps) of closed intervals: how many others overlap, as the starts up to its end less the ends before its start, and itself.

    Both are running sums over the ends of all intervals, so no pair is made. `key` is unique within `on`; intervals with a null, and those that end before they start, go.
    """
    ends = F.explode(F.array(F.struct(F.col(start).alias("_p"), F.lit(0).alias("_kind")), F.struct(F.col(end).alias("_p"), F.lit(1).alias("_kind"))))
    is_end = F.col("_kind") == 1  # at one position starts are before ends, as closed intervals that touch overlap
    run = scan(proper(intervals, on, key, start, end).select(*on, key, ends.alias("_e")).select(*on, key, "_e.*"), on, ["_p", "_kind"], _starts=("sum", 1 - F.col("_kind")), _ends=("sum", "_kind"))
    return run.groupBy(*on, key).agg((F.max(F.when(is_end, F.col("_starts"))) - F.max(F.when(~is_end, F.col("_ends"))) - 1).alias("n_overlaps"))


def proper(intervals: DataFrame, on: list[str], key: str, start: str, end: str) -> DataFrame:
    got = intervals.where(F.col(start) <= F.col(end)).select(*on, key, F.col(start).cast("bigint").alias(start), F.col(end).cast("bigint").alias(end))
    return got.dropna(subset=[*on, key])


def cover_nodes(start: Column, end: Column, levels: int) -> Column:
    """The least nodes (level, number) of a binary tree over positions that together are [start, end]: at most two a level, a node of level j being 2**j positions."""
    found = []
    for j in range(levels + 1):
        low, high = -F.shiftright(-start, j), F.shiftright(end + 1, j)
        node = lambda at: F.struct(F.lit(j).alias("level"), at.alias("node"))  # noqa: E731, B023
        found += [F.when((low < high) & (low % 2 != 0), node(low)), F.when((low < high) & (high % 2 != 0), node(high - 1))]
    return F.array_compact(F.array(*found))


#: Nodes of the upper levels of the tree are few, so that those who ask are dealt to copies of them: the topmost to 2**SPREAD.
SPREAD = 6


def first_covering(intervals: DataFrame, on: list[str], key: str, start="start", end="end", most=10) -> DataFrame:
    """(on, start, covering) of each distinct start: the first `most` intervals that hold it, by (start, key), as an array of structs.

    Each interval is posted at the nodes that make it up, of which each keeps its first `most`; a position asks the nodes above it, one a level. So what a position
    gets is bounded, however many intervals hold it.
    """
    widest = intervals.agg(F.max(F.col(end) - F.col(start) + 1)).first()[0] or 1
    levels = int(widest).bit_length() - 1
    item = F.struct(F.col(start).alias("start"), F.col(key).alias("key"))
    posted = intervals.select(*on, item.alias("item"), F.explode(cover_nodes(F.col(start), F.col(end), levels)).alias("n")).select(*on, "n.*", "item")
    best = posted.withColumn("_k", F.row_number().over(Window.partitionBy(*on, "level", "node").orderBy("item"))).where(F.col("_k") <= most)
    lists = best.groupBy(*on, "level", "node").agg(F.collect_list("item").alias("items"))
    copies = F.expr(f"shiftleft(1, greatest(level - {max(0, levels - SPREAD)}, 0))")
    asked = intervals.select(*on, start).distinct().select(*on, start, F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    asked = asked.withColumns({"node": F.expr(f"shiftright(`{start}`, level)"), "copy": F.pmod(F.xxhash64(start), copies)})
    found = asked.join(lists.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), (copies - 1).cast("bigint")))), [*on, "level", "node", "copy"])
    return found.groupBy(*on, start).agg(F.slice(F.array_sort(F.flatten(F.collect_list("items"))), 1, most).alias("covering"))


def next_started(intervals: DataFrame, on: list[str], key: str, start="start", most=10, parts: int = PARTS) -> DataFrame:
    """intervals with `following`: the next `most` by (start, key) of the same `on`, as an array of structs.

    Within a range of starts by a window of `most` rows; at its end by the first `most` rows of the ranges after it.
    """
    at = [*on, "_at"]
    cut = intervals.withColumn("_at", ranges(intervals, [start, key], parts)).withColumn("_item", F.struct(F.col(start).alias("start"), F.col(key).alias("key")))
    here = Window.partitionBy(*at).orderBy(start, key)
    near = cut.withColumn("_near", F.collect_list("_item").over(here.rowsBetween(1, most)))
    heads = cut.withColumn("_k", F.row_number().over(here)).where(F.col("_k") <= most).groupBy(*at).agg(F.array_sort(F.collect_list("_item")).alias("_head"))
    later = F.slice(F.flatten(F.collect_list("_head").over(Window.partitionBy(*on).orderBy("_at").rowsBetween(1, most))), 1, most)  # no range is empty
    return near.join(heads.select(*at, later.alias("_later")), at).withColumn("following", F.slice(F.concat("_near", "_later"), 1, most)).drop("_at", "_item", "_near", "_later")


def overlap_summary(intervals: DataFrame, on: list[str], key: str, start="start", end="end", most=10) -> DataFrame:
    """How many others overlap, and the first `most` of them in (start, key) order, joined by commas; 0 and '' for none.

    Those that start before it are the first of the intervals that hold its start; those that start after it are the next in order. `key` is unique within `on`; an interval with a null or that ends before it
    starts overlaps none.
    """
    some = proper(intervals, on, key, start, end)
    own = F.struct(F.col(start).alias("start"), F.col(key).alias("key"))
    before = F.filter("covering", lambda x: x < own)
    after = F.filter("following", lambda x: x["start"] <= F.col(end))
    got = next_started(some, on, key, start, most).join(overlap_counts(some, on, key, start, end), [*on, key]).join(first_covering(some, on, key, start, end, most), [*on, start])
    names = F.array_join(F.transform(F.slice(F.concat(before, after), 1, most), lambda x: x["key"].cast("string")), ",")
    found = got.select(*on, key, "n_overlaps", names.alias("overlaps"))
    return intervals.join(found, [*on, key], "left").withColumn("n_overlaps", F.coalesce("n_overlaps", F.lit(0))).withColumn("overlaps", F.coalesce("overlaps", F.lit("")))


def near_flagged(df: DataFrame, flag: str, position: str, by: list[str], width: int) -> DataFrame:
    """Whether a flagged row of the group lies within `width` positions (the row itself included)."""
    w = Window.partitionBy(*by, "_bin").orderBy(position).rangeBetween(-width, width)
    return with_halo(df, position, width).withColumn("is_near", F.max(F.col(flag).cast("int")).over(w) == 1).where("_core").drop("_bin", "_core")


def beside(sites: DataFrame, scores: DataFrame, on: list[str], width: int, position="position", score="score") -> tuple[DataFrame, WindowSpec]:
    """Sites and scores as rows of one table (`_site` says which; `_score`, `_keyed`, `_core`), and the window of what lies within `width` positions of a row.

    Keep `_core` rows; a value counts where `_keyed`, as a null key or position is near nothing. Each row is shuffled once, whatever the width; a frame holds the rows of
    2 * width + 1 positions.
    """
    both = sites.withColumn("_site", F.lit(True)).unionByName(scores.select(*on, position, F.col(score).alias("_score"), F.lit(False).alias("_site")), allowMissingColumns=True)
    keyed = reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in (*on, position)))
    return with_halo(both, position, width).withColumn("_keyed", keyed), Window.partitionBy(*on, "_bin").orderBy(position).rangeBetween(-width, width)


def best_in_window(sites: DataFrame, scores: DataFrame, on: list[str], width: int, position="position", score="score") -> DataFrame:
    """Each site with the largest score within `width` positions and where it lies (the first, on ties); null where none is."""
    rows, near = beside(sites, scores, on, width, position, score)
    item = F.when(F.col("_keyed") & ~F.col("_site"), F.struct(F.col("_score").alias("score"), (-F.col(position)).alias("at")))
    got = rows.withColumn("_best", F.max(item).over(near)).where("_core AND _site")
    return got.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in sites.schema), F.col("_best.score").alias("best_score"), (-F.col("_best.at") - F.col(position)).cast("int").alias("best_offset"))


def nearest_of(points: DataFrame, marks: DataFrame, on: list[str], position="position", mark="mark", within: int = 50) -> DataFrame:
    """Each point's nearest mark of the same key within `within` positions: signed distance (ties to the smaller mark); null beyond.

    Marks are cut into bins of `within`; a point looks in its own bin and the two beside it.
    """
    cut = marks.select(*on, F.col(mark).alias("_mark"), F.floor(F.col(mark) / within).alias("_bin")).distinct()
    keyed = points.withColumn("_row", F.struct(*points.columns))
    probe = keyed.withColumn("_bin", F.explode(F.array(*(F.floor(F.col(position) / within) + d for d in (-1, 0, 1)))))
    d = F.col("_mark") - F.col(position)
    best = probe.join(cut, [*on, "_bin"]).where(F.abs(d) <= within).groupBy("_row").agg(F.min_by(d, F.struct(F.abs(d), F.col("_mark"))).alias("mark_distance"))
    return points.withColumn("_row", F.struct(*points.columns)).join(best, "_row", "left").drop("_row")


def nearest_at_any_distance(points: DataFrame, marks: DataFrame, on: list[str], position="position", mark="mark") -> DataFrame:
    """Each point's signed distance to the nearest mark of the same key, however far; ties to the smaller mark; null where the key has none, or the position is null.

    An as-of join both ways: points and marks are put in one order, and the last mark before and the first after come from a scan over ranges of it.
    Every row of points stays, repeated ones too; a null key is a key.
    """
    one = marks.where(F.col(mark).isNotNull()).select(*on, F.col(mark).alias("_mark")).distinct()
    both = points.withColumn("_kind", F.lit(1)).unionByName(one.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("_at", F.coalesce("_mark", position))  # at one position the mark is before the points
    got = scan(both, on, ["_at", "_kind"], _before=("last", "_mark"), _after=("next", "_mark")).where("_kind = 1")
    low, high = F.col("_before") - F.col(position), F.col("_after") - F.col(position)
    nearest = F.when(F.col(position).isNull(), F.lit(None)).when(low.isNull() | (high < -low), high).otherwise(low)
    return got.withColumn("mark_distance", nearest).select(*(f"`{c}`" for c in points.columns), "mark_distance")


def with_offsets(sites: DataFrame, lowest: int, highest: int, position="position") -> DataFrame:
    """Each site at every offset of a range."""
    return sites.withColumn("offset", F.explode(F.sequence(F.lit(lowest), F.lit(highest)))).withColumn("shifted", F.col(position) + F.col("offset"))
