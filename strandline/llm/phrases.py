r"""Phrase collocations: word sequences of a language that occur more often together than their parts do apart.

All runs of 1 to max_n words are exploded into rows and counted by hash aggregation, a level after the other: words first, then pairs, then all longer runs. A phrase can only
reach `least` occurrences if each of its words and pairs does, so runs with a word or pair that doesn't are never made rows. What reached it is known to the tasks through a sieve, a
bit array of fixed size (2**BITS bits, two megabytes at 24, whatever the corpus) that hashes into; it lets through all that reached it and few others, and a fuller sieve lets
more through, so results don't depend on it. Pruned or not, the counts of a candidate and of its parts are exact.

Parts are looked up by joins on (language, part), scores are exact decimals, and a candidate inside a longer one that occurs nearly as often goes by an anti-join
on its one-word extensions: what holds of a longer extension holds of the one-word extension inside it, as that occurs at least as often. Ranks are windows per language over
the best rows of hashed groups of a language, so no task sorts a language.

Edge cases: a null or empty text has no words; a null language is `und`; words are what stands between spaces and tabs, of any length; repeated rows count as often
as they occur; an empty table, or one without candidates, gives no rows; other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Fixed by the contract: what ends a piece, and the language of rows that have none.
ENDS, UNKNOWN = r"[.,;:!?\x0A-\x0D]+", "und"
MAX_N, LEAST, MOST, SCALE, COVERED = 4, 30, 2000, 2_000_000, 80
#: The sieve has 2**BITS bits.
BITS = 24


def tokens(text: Column) -> Column:
    """The text's words in order, with "." (no word holds one) wherever a piece ends."""
    return F.split(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), ENDS, " . "), "[ \t]+")


def place(*of) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(1 << BITS))


def sieve(frequent: DataFrame) -> DataFrame:
    """One row: the bits of frequent's (lang, phrase) rows as an array of longs. Its size is fixed, and so is the number of rows that make it."""
    h = place("lang", "phrase")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))
    longs = frequent.select(F.shiftright(h, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    every = frequent.sparkSession.range((1 << BITS) // 64).withColumnRenamed("id", "at").join(longs, "at", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))), lambda x: x["bits"]).alias("sieve"))


def passes(bits: Column, phrase: Column) -> Column:
    """Whether the sieve lets a phrase of the row's language through; null for null."""
    h = place(F.col("lang"), phrase)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))
    return F.get(bits, F.shiftright(h, 6).cast("int")).bitwiseAND(bit) != 0


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "phrase").agg(F.count("*").alias("f"))


def words_of(docs: DataFrame) -> DataFrame:
    """(lang, tokens) of every row."""
    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), tokens(F.col("text")).alias("tokens"))


def sieved_runs(docs: DataFrame, frequent: DataFrame, first: int, last: int) -> DataFrame:
    """(lang, phrase) of every run of `first` to `last` words whose words (pairs, if first is over 2) the sieve lets through.

    A row is made for each word, with the words after it beside it; rows that the sieve stops go before phrases are made of them.
    """
    bits = written(sieve(frequent), "sieve").scalar()
    w = [F.col(f"w{i}") for i in range(last)]
    after = F.arrays_zip(*(F.slice("tokens", i + 1, F.size("tokens")).alias(f"w{i}") for i in range(last)))
    rows = words_of(docs).select("lang", F.inline(after).alias(*(f"w{i}" for i in range(last))))
    word = lambda i: w[i].isNotNull() & ~w[i].isin("", ".")
    if first == 2:
        step = lambda i: passes(bits, w[i])
    else:
        step = lambda i: passes(bits, F.concat_ws(" ", w[i - 1], w[i])) if i else F.lit(True)
    for i in range(first):
        rows = rows.where(word(i))
    for i in range(first):
        rows = rows.where(step(i))
    run, runs = F.lit(True), [F.concat_ws(" ", *w[:first])]
    for n in range(first, last):
        run = run & word(n) & step(n)
        runs.append(F.when(run, F.concat_ws(" ", *w[: n + 1])))
    made = rows.select("lang", F.explode(F.array(*runs)).alias("phrase")) if len(runs) > 1 else rows.select("lang", runs[0].alias("phrase"))
    return made.where("phrase IS NOT NULL")


def frequencies(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f, size) of the runs of 1 to max_n words that occur `least` times or more, and (lang, n): the words of each language."""
    words = words_of(docs).select("lang", F.explode("tokens").alias("phrase")).where(~F.col("phrase").isin("", "."))
    whole = written(counted(words), "phrases-words")
    often = lambda df: df.where(F.col("f") >= least)
    tables = [often(whole)]
    for first, last in ((2, 2), (3, max_n)):
        if first <= last <= max_n:
            so_far = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
            tables.append(written(often(counted(sieved_runs(docs, so_far, first, last))), "phrases-runs"))
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return written(out.withColumn("size", F.size(F.split("phrase", " "))), "phrases-frequent"), whole.groupBy("lang").agg(F.sum("f").alias("n"))


def exact(of) -> Column:
    return (F.col(of) if isinstance(of, str) else of).cast("decimal(18,0)")


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, most: int = MOST, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `most` phrases of 2 to max_n words by score. Columns text and lang are read.

    A candidate occurs a >= least times. Cut after its first k words, its parts occur l and r times; the score is the least floor(SCALE * a / (l + r)), ties to the smaller k.
    Candidates inside a longer one that occurs at least `covered` hundredths as often go.
    """
    frequent, n = frequencies(docs, max_n, least)
    candidates = frequent.where("size >= 2").select("lang", "phrase", F.col("f").alias("a"), "size")
    word = F.split("phrase", " ")
    part = lambda at, k: F.array_join(F.slice(word, at, k), " ")
    # One-word extensions: a longer candidate without its last word, and without its first.
    size = F.col("size")
    inside = frequent.where("size >= 3").select("lang", F.col("f").alias("of_longer"), F.explode(F.array(part(1, size - 1), part(F.lit(2), size - 1))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("of_longer").alias("of_longer")).withColumnsRenamed({"lang": "_lang", "phrase": "_phrase"})
    near = exact("of_longer") * F.lit(100).cast("decimal(3,0)") >= exact("a") * F.lit(covered).cast("decimal(3,0)")
    free = candidates.join(inside, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")) & near, "left_anti")
    cuts = free.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, size - F.col("k")).alias("right"))
    of = lambda name, f: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr(f"CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(18,0)) div CAST(l + r AS DECIMAL(18,0))")  # div is exact on decimals
    cuts = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    scored = written(cuts.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "phrases-scored")

    # The best of hashed groups first: as many groups as leave equal work to both windows.
    groups = math.isqrt(scored.count() // max(1, most)) + 1
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = scored.withColumn("_group", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
    best = best.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_group").orderBy(*order))).where(F.col("_k") <= most)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    top = best.withColumn("rank", rank).where(F.col("rank") <= most)
    return top.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
