"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

A source's target divided by its size is the number of copies wanted of each of its documents: a whole part and a
fractional rest. The rests are rounded together. Two documents meet, mass (in words) moves from one to the other, in
either direction with the chances that keep both expectations, until one of them is wholly in or wholly out; the other
goes on to meet the next. The words taken of a source therefore keep their sum exactly until one document is left,
which is rounded to the nearer side: a source's mix is within half a document of its target. Large documents meet first, so that
the one left is usually a small one.

The meetings form a reduction tree: documents are dealt by hash into buckets of about FAN, each bucket leaves one
document undecided, and FAN buckets' leftovers meet in the next level, until one bucket a source is left. Every level is
a groupBy on (source, bucket), so a source with a third of all rows is as many tasks' work as its share. Chance comes
from hashes of ids, so reruns agree.

Rows that are equal in all columns are one unit of n rows: its copies are n times the whole part, the whole part of n times the rest, and a last
row's rest, which is rounded like any other document's. So a row that is repeated without end, or many rows without an id, come as near to their target as others.

Edge cases: a null text or one of white space has size 0, takes no part in the transfers, and its own hash decides its
copies; a null source is a source; a null doc_id is an id like others; an empty table gives an empty result; other columns are left alone (they
tell units apart).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, let, row_keys, written

#: Weights by the source's rank in code-point order (null last), repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Share of all words that the mix holds, and the most copies of a source's words.
TOTAL, CAP = 1.5, 2.0
#: Documents in a bucket, about.
FAN = 64
#: Sources up to which their table is broadcast; beyond it the join is a shuffle that adaptive execution may split.
BROADCAST_SOURCES = 50_000

#: Rows or copies of one unit that a task writes at most.
CHUNK = 10_000

KEY = ("k1", "k2", "doc_id", "size", "n", "base", "extra")
UNIT = "struct<o:bigint,h:bigint,k1:bigint,k2:bigint,doc_id:bigint,size:bigint,n:bigint,base:bigint,extra:bigint,s:double,mass:double>"
DONE = "array<struct<k1:bigint,k2:bigint,doc_id:bigint,size:bigint,n:bigint,base:bigint,extra:bigint>>"


def words(text="text"):
    """Runs of anything but ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def chance(seed: int, *cols):
    """A number between 0 and 1 from a hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def targets(sized: DataFrame, weights=WEIGHTS, total=TOTAL, cap=CAP) -> DataFrame:
    """(source, source_size, units, target): weight shares of `total` x all words, none above `cap` x its source.

    With t = least(cap x size, level x weight), the level is the largest over the sources, in order of cap / weight,
    of (what is to be given - caps before) / (weights from here on). The table has a row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.select("*", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).alias("weight"))
    per = per.select("*", (F.col("source_size") * float(cap)).alias("most"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("most")
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.select("*", ((F.sum("source_size").over(all_rows) * float(total) - before) / rest).alias("level"))
    level = F.greatest(F.max("level").over(all_rows), F.lit(0.0))
    return per.select("source", "source_size", "units", F.least(F.col("most"), level * F.col("weight")).alias("target"))


def meet(acc, x, seed: int):
    """One step of a bucket: the undecided document meets x."""
    p = acc["pend"]

    def moved(g):
        d1, d2 = g["d1"], g["d2"]
        to_x = chance(seed, p["k1"], x["k1"]) * (d1 + d2) < d2
        mp = F.when(to_x, F.when(d1 == p["mass"], F.lit(0.0)).otherwise(p["mass"] - d1)).otherwise(F.when(d2 == p["s"] - p["mass"], p["s"]).otherwise(p["mass"] + d2))
        mx = F.when(to_x, F.when(d1 == x["s"] - x["mass"], x["s"]).otherwise(x["mass"] + d1)).otherwise(F.when(d2 == x["mass"], F.lit(0.0)).otherwise(x["mass"] - d2))
        return let(F.struct(mp.alias("p"), mx.alias("x")), decided)

    def decided(m):
        with_mass = lambda u, mass: F.struct(*(u[c].alias(c) for c in ("o", "h", *KEY, "s")), mass.alias("mass"))
        settled = lambda u, mass: (mass <= 0) | (mass >= u["s"])
        out = lambda u, mass: F.when(settled(u, mass), F.array(F.struct(*(u[c].alias(c) for c in KEY[:-1]), (u["extra"] + F.when(mass >= u["s"], 1).otherwise(0)).cast("long").alias("extra")))).otherwise(F.array().cast(DONE))
        pend = F.when(~settled(p, m["p"]), with_mass(p, m["p"])).when(~settled(x, m["x"]), with_mass(x, m["x"]))
        return F.struct(pend.cast(UNIT).alias("pend"), F.concat(acc["done"], out(p, m["p"]), out(x, m["x"])).cast(DONE).alias("done"))

    room = let(F.struct(F.least(p["mass"], x["s"] - x["mass"]).alias("d1"), F.least(x["mass"], p["s"] - p["mass"]).alias("d2")), moved)
    return F.when(p.isNull(), F.struct(x.cast(UNIT).alias("pend"), acc["done"].alias("done"))).otherwise(room)


def round_level(units: DataFrame, seed: int) -> DataFrame:
    """units: source, bucket, u. A row a bucket: what is decided, and the one document that isn't."""
    start = F.struct(F.lit(None).cast(UNIT).alias("pend"), F.array().cast(DONE).alias("done"))
    met = F.aggregate(F.array_sort(F.collect_list("u")), start, lambda acc, x: meet(acc, x, seed))
    return units.groupBy("source", "bucket").agg(met.alias("met")).select("source", "bucket", "met.pend", "met.done")


def chunks(df: DataFrame, times: str, index: str) -> DataFrame:
    """df with each row as often as the column `times` says, numbered from 1 in `index`; a row of many is shared out among tasks."""
    at = fresh(df, "_from")
    many = df.where(F.col(times) > CHUNK).withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(CHUNK).cast("long"))))
    many = many.repartition(at).withColumn(index, F.explode(F.sequence(F.col(at) + 1, F.least(F.col(times), F.col(at) + CHUNK)))).drop(at)
    few = df.where((F.col(times) > 0) & (F.col(times) <= CHUNK)).withColumn(index, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return few.unionByName(many)


def mix_plan(docs: DataFrame, weights=WEIGHTS, total=TOTAL, cap=CAP, seed: int = 17) -> DataFrame:
    """(k1, k2, doc_id, source, size, n, base, extra, copies, source_size, target): a row for each unit of n equal rows, by its key. Each of them is taken `base` times and `extra` of them once more: `copies` in all."""
    k1, k2 = row_keys(docs)
    sized = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), "source", words().alias("size"))
    units = written(sized.groupBy("k1", "k2", "doc_id", "source", "size").agg(F.count("*").alias("n")), "mix-units")
    rows = units.select("source", (F.col("size") * F.col("n")).alias("size"))
    per = written(targets(rows, weights, total, cap), "mix-targets")
    n_sources, most_units = per.agg(F.count("*"), F.coalesce(F.max("units"), F.lit(0))).first()
    per = per.withColumnRenamed("source", "of")
    small = F.broadcast(per) if n_sources <= BROADCAST_SOURCES else per

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = units.join(small, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    u = u.select("*", F.floor(ratio).alias("base"), ((ratio - F.floor(ratio)) * F.col("n")).alias("_more"))
    u = u.select("*", F.floor("_more").alias("extra"), (F.col("_more") - F.floor("_more")).alias("rest"), F.col("size").cast("double").alias("s"), F.xxhash64(F.lit(seed), "k1", "k2").alias("h"))
    meets = (F.col("rest") > 0) & (F.col("s") > 0)
    alone = u.where(~meets).select("source", *KEY[:-1], (F.col("extra") + F.when(chance(seed + 1, "k1", "k2") < F.col("rest"), 1).otherwise(0)).cast("long").alias("extra"))
    one = F.struct((-F.col("size")).alias("o"), "h", *KEY, "s", (F.col("rest") * F.col("s")).alias("mass"))
    level = u.where(meets).select("source", F.pmod("h", F.ceil(F.col("units") / FAN)).alias("bucket"), one.cast(UNIT).alias("u"))

    buckets, parts = -(-int(most_units) // FAN), []
    while True:
        parts.append(now := written(round_level(level, seed + 2 + len(parts)), "mix-level"))
        if buckets <= 1:
            break
        buckets = -(-buckets // FAN)
        level = now.where("pend IS NOT NULL").select("source", F.floor(F.col("bucket") / FAN).alias("bucket"), F.col("pend").alias("u"))
    decided = alone
    for part in parts:
        decided = decided.unionByName(part.select("source", F.explode("done").alias("d")).select("source", "d.*"))
    last = F.col("pend")
    decided = decided.unionByName(parts[-1].where("pend IS NOT NULL").select("source", *(last[k].alias(k) for k in KEY[:-1]), (last["extra"] + F.when(last["mass"] * 2 >= last["s"], 1).otherwise(0)).cast("long").alias("extra")))
    decided = decided.withColumn("copies", F.col("n") * F.col("base") + F.col("extra"))
    return decided.join(small, F.col("source").eqNullSafe(F.col("of"))).drop("of", "units")


def taken(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) of every row of docs; taken: the words of its copies."""
    each = chunks(mix_plan(docs, **how), "n", "_row")
    copies = F.col("base") + F.when(F.col("_row") <= F.col("extra"), 1).otherwise(0)
    return each.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.cast("long").alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs. Equal rows are one row before the join, so no key is hot."""
    a, b, copies, copy = (fresh(docs, x) for x in ("_k1", "_k2", "_copies", "_copy"))
    plan = mix_plan(docs, **how).where("copies > 0").select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("copies").alias(copies))
    k1, k2 = row_keys(docs)
    one = docs.withColumns({a: k1, b: k2}).dropDuplicates([a, b])
    return chunks(one.join(plan, [a, b]), copies, copy).select(*docs.columns)
