"""Running values over an order without a task a key: an associative scan over ranges.

Rows are cut into ranges of their order at approximate quantiles of the table. Each (key, range) is summed up by one aggregate; these few rows are run up per key, and every row
then combines what the ranges before (or after) it hold with its own range's running value. So a window sees a key's range, at most about
one in `parts` of all rows, even where one key has most of the table. A value of the first order column that many rows share is a range of its own, which the second
order column cuts further.
"""

from __future__ import annotations

import math
import os
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a column, about; more than there can be.
PARTS, SUB = 64, 1 << 16


def number(df: DataFrame, name: str) -> Column:
    """A column as a double that doesn't fall where the column rises: times in seconds, texts by the six bytes after what all of them begin with."""
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind == "string":
        low, high = (bytes(x or b"") for x in df.agg(F.min(c).cast("binary"), F.max(c).cast("binary")).first())
        same = len(os.path.commonprefix([low, high]))
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), same + 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.unix_date(c).cast("double") if kind == "date" else (c.cast("timestamp") if kind.startswith("timestamp") else c).cast("double")


def place(x: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are at most x, by bisection; null counts none, NaN all."""
    if not bounds:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>")  # a constant, folded once
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(held, at + step - 1) <= x, F.lit(False)), at + step).otherwise(at))


def quantiles(df: DataFrame, x: Column, parts: int) -> list[float]:
    found = df.select(x.alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 1 / (4 * parts))
    return [b for b in found if b is not None and math.isfinite(b)]


def ranges(df: DataFrame, order: list[str], parts: int = PARTS) -> Column:
    """A number that rises with the order: the range of the first order column times SUB, plus that of the second one where many rows share the first's value."""
    x = number(df, order[0])
    found = quantiles(df, x, parts)
    heavy = sorted(v for v, n in Counter(found).items() if n > 1)
    bounds = sorted({*found, *(math.nextafter(v, math.inf) for v in heavy)})
    sub = F.lit(0)
    if heavy and len(order) > 1:
        y = number(df, order[1])
        sub = F.when(x.isin(heavy), place(y, sorted(set(quantiles(df.where(x.isin(heavy)), y, parts))))).otherwise(sub)
    return place(x, bounds) * SUB + sub


def meet(left: list[str], right: list[str]) -> Column:
    """Keys that are equal, null to null; the last, a range, is never null."""
    on = F.col(left[-1]) == F.col(right[-1])
    for a, b in zip(left[:-1], right[:-1]):
        on &= F.col(a).eqNullSafe(F.col(b))
    return on


def scan(df: DataFrame, by: list[str], order: list[str], within: Column | None = None, parts: int = PARTS, **values: tuple[str, str | Column]) -> DataFrame:
    """df with a running value for each name: (kind, column).

    sum: of the rows up to this one. max_before: of the rows before this one. last: the last value that isn't null, up to this row. next: the first that isn't null, from this
    row on. Null keys are a key; rows that tie in the whole order are in any order. within: ranges(), if already made (of the same order).
    """
    cut = df.withColumns({**{f"_scan_k{i}": F.col(f"`{c}`") for i, c in enumerate(by)}, "_scan_at": ranges(df, order, parts) if within is None else within})
    keys, at = [f"_scan_k{i}" for i in range(len(by))], [*(f"_scan_k{i}" for i in range(len(by))), "_scan_at"]
    cut = cut.withColumns({f"_scan_{n}": F.col(c) if isinstance(c, str) else c for n, (_, c) in values.items()})
    ordered = F.struct(*order)
    first = {"sum": lambda v: F.sum(v), "max_before": lambda v: F.max(v), "last": lambda v: F.max_by(v, F.when(v.isNotNull(), ordered)), "next": lambda v: F.min_by(v, F.when(v.isNotNull(), ordered))}
    sums = cut.groupBy(*at).agg(*(first[kind](F.col(f"_scan_{n}")).alias(f"_of_{n}") for n, (kind, _) in values.items()))
    key = Window.partitionBy(*keys).orderBy("_scan_at")
    ahead, behind = key.rowsBetween(Window.unboundedPreceding, -1), key.rowsBetween(1, Window.unboundedFollowing)
    beyond = {"sum": lambda v: F.sum(v).over(ahead), "max_before": lambda v: F.max(v).over(ahead), "last": lambda v: F.last(v, True).over(ahead), "next": lambda v: F.first(v, True).over(behind)}
    sums = sums.select(*(F.col(c).alias(f"{c}_of") for c in at), *(beyond[kind](F.col(f"_of_{n}")).alias(f"_by_{n}") for n, (kind, _) in values.items()))
    here = Window.partitionBy(*at).orderBy(*order)
    upto, before, on = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(0, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = {
        "sum": lambda v, b: zero(b) + zero(F.sum(v).over(upto)), "max_before": lambda v, b: F.greatest(b, F.max(v).over(before)),
        "last": lambda v, b: F.coalesce(F.last(v, True).over(upto), b), "next": lambda v, b: F.coalesce(F.first(v, True).over(on), b),
    }
    got = cut.join(sums, meet(at, [f"{c}_of" for c in at]))
    return got.select(*(f"`{c}`" for c in df.columns), *(joined[kind](F.col(f"_scan_{n}"), F.col(f"_by_{n}")).alias(n) for n, (kind, _) in values.items()))


def top_k(df: DataFrame, score: str, k: Column, by: list[str], tiebreak: list[str], parts: int = PARTS) -> DataFrame:
    """The k rows of the largest scores of each group with their `rank`, ties by the tiebreak ascending; null scores are last. k may differ from group to group.

    Rows are counted by (group, range of scores) first. Ranges under the one that holds a group's cut are left out, and rows are ranked within their range, after
    those of the ranges above it; so no group is sorted whole.
    """
    at = [*(f"_at{i}" for i in range(len(by))), "_at"]
    # Ranges of the tiebreak rise and those of the score fall: the key counts down in the one and up in the other.
    r = ranges(df, [score, *tiebreak], parts)
    falling = F.when(F.col(score).isNull(), F.lit(2 * SUB).cast("bigint") * SUB).otherwise((F.lit(SUB) - F.floor(r / SUB)) * SUB) + r % SUB
    cut = df.withColumns({**{f"_at{i}": F.col(f"`{c}`") for i, c in enumerate(by)}, "_at": falling})
    counts = cut.groupBy(*at).agg(F.count("*").alias("_rows"), F.max(k).alias("_k"))
    above = F.coalesce(F.sum("_rows").over(Window.partitionBy(*at[:-1]).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = counts.select(*(F.col(c).alias(f"{c}_of") for c in at), F.col("_k"), above.alias("_above")).where(F.col("_above") < F.col("_k"))
    here = Window.partitionBy(*at).orderBy(F.desc_nulls_last(score), *tiebreak)
    ranked = cut.join(held, meet(at, [f"{c}_of" for c in at])).withColumn("rank", F.col("_above") + F.row_number().over(here)).where(F.col("rank") <= F.col("_k"))
    return ranked.select(*(f"`{c}`" for c in df.columns), "rank")
