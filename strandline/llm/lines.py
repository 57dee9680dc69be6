"""Line dedup: lines that several documents hold are dropped from all but the first of them.

A text is split at line feeds, and each line is normalised (white space off both ends, A-Z lower-cased) and hashed to 128 bits. The hashes are exploded
and the distinct documents of each are counted: partial sums meet, so a line that is in every document costs a row a task. Hashes of `least_docs` documents
or more are few; they are written with the first document that holds them and joined back to the exploded hashes (both sides
of that join are plain shuffles, so a hot line is split by adaptive execution). What comes out are the places of the lines that go; they meet their document
once, and it is put together again by position from the lines that stay.

Only hashes, ids and places are exploded. The text itself is shuffled once, as a whole row, and a document's places are bounded by its own lines.

Edge cases: a null or empty text is one empty line; a key shorter than `least_chars` code points is never dropped; rows with one doc_id are
one document, in which a line may be repeated (it then stays or goes in all of them); rows without an id are together one document, the last in order; equal rows
get equal results; an empty table gives an empty one; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, written

#: Fixed by the contract: white space that is stripped from a line's ends.
BLANK = " \t\n\x0b\x0c\r"
LEAST_DOCS, LEAST_CHARS = 2, 10


def lines(text: Column) -> Column:
    """The text's lines in order; a null text has one, the empty one."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def exploded(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, t1, t2, position, h1, h2) of every line with a key of `least_chars` or more: t1 and t2 tell texts apart, h1 and h2 keys."""
    keys = F.transform(lines(ascii_lower(F.col("text"))), lambda x: F.btrim(x, F.lit(BLANK)))
    key = F.col("_key")
    rows = docs.select("doc_id", *(F.xxhash64(F.lit(k), "text").alias(f"t{k}") for k in (1, 2)), F.posexplode(keys).alias("position", "_key"))
    return rows.where(F.char_length(key) >= least_chars).select("doc_id", "t1", "t2", "position", *(F.xxhash64(F.lit(k), key).alias(f"h{k}") for k in (1, 2)))


def repeated(rows: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(h1, h2, n_docs, first_doc) of the keys that `least_docs` documents or more hold. first_doc is the least id (null is the last)."""
    n = F.countDistinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    return rows.groupBy("h1", "h2").agg(n.alias("n_docs"), F.min("doc_id").alias("first_doc")).where(F.col("n_docs") >= least_docs)


def dropped(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, t1, t2, places) of the texts that lose lines: the sorted positions of these, from 0."""
    rows = exploded(docs, least_chars)
    busy = written(repeated(rows, least_docs), "lines")
    gone = rows.join(busy, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    return gone.groupBy("doc_id", "t1", "t2").agg(F.array_sort(F.collect_set("position")).alias("places"))


def kept(text: Column, places: Column) -> Column:
    """The text without the lines at the sorted places: as many trues as lines stay before each place, and a false for it; then lines and flags side by side."""
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(places, i - 1))
    flags = F.flatten(F.transform(places, lambda at, i: F.concat(F.array_repeat(F.lit(True), at - before(i) - 1), F.array(F.lit(False)))))
    stay = F.zip_with(lines(text), flags, lambda line, flag: F.when(F.coalesce(flag, F.lit(True)), line))
    return F.when(places.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(stay, "\n"))


def dedup(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """docs with the text that stays; with the columns n_lines (before dropping) and n_dropped too, if names are given for them."""
    key = [fresh(docs, f"_{x}") for x in ("id", "t1", "t2", "places")]
    gone = dropped(docs.select("doc_id", "text"), least_docs, least_chars).toDF(*key)
    marked = docs.withColumns({key[1]: F.xxhash64(F.lit(1), "text"), key[2]: F.xxhash64(F.lit(2), "text")})
    gone = gone.withColumnsRenamed({key[1]: f"{key[1]}_of", key[2]: f"{key[2]}_of"})
    on = F.col("doc_id").eqNullSafe(F.col(key[0])) & (F.col(key[1]) == F.col(f"{key[1]}_of")) & (F.col(key[2]) == F.col(f"{key[2]}_of"))
    found, places = marked.join(gone, on, "left"), F.col(key[3])
    extra = {n_lines: F.size(lines(F.col("text"))).cast("long"), n_dropped: F.coalesce(F.size(places), F.lit(0)).cast("long")}
    texts = {"text": kept(F.col("text"), places)}
    return found.select(*(texts.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns), *(v.alias(k) for k, v in extra.items() if k))
