"""A content-addressed WARC archive: payloads once by SHA-256, exact record headers apart, records rebuilt by a join.

write_archive() stores two tables: `headers` (page_id, the record's exact header block, payload digest) and `payloads`
(digest, bytes), each payload once whatever its number of pages. Both digest and length of a stored payload are verified
against its header when an archive is read; a difference fails the job.

Only small rows (page_id, url, digest, length) are shuffled to choose responses and revisits. The digest's first page is an
aggregate with a map-side part, joined back, so a payload of a third of all pages makes no hot task. Payload bytes are
shuffled once, after each map task has dropped its own copies.

records() rebuilds each record by a join on the digest, salted where over MANY records have one payload, and verifies it; read_index() gives
the records' fields. export_warc() writes them as .warc.gz files of one gzip member a record and about ROLL bytes, read_warc() reads such files as a stream.

Edge cases: null html is an empty payload; payloads under REVISIT_FROM bytes are all responses (stored once all the same); a null
url is left out of the header; a url with line breaks, or an empty one, stands there in hexadecimal digits too, so that it comes back as it was; rows that repeat page_id, url and html are records of their own, and count as ties of which
the first is the response; null page_ids come last; an empty table gives an empty archive; other columns are left alone.
"""

from __future__ import annotations

import gzip
import io
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, shared_dir, written

REVISIT_FROM = 100
#: Records of one payload that a task rebuilds, about; bytes of an exported file, about.
MANY, ROLL = 1000, 1 << 30
#: Payloads of over MANY records up to which their table is broadcast (a digest and a number each).
BROADCAST = 50_000
#: Fixed value: the profile that WARC 1.1 names for revisits of identical payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed so that an archive of the same pages has the same bytes.
DATE = "2024-01-01T00:00:00Z"


def record_id(page, ordinal):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), ordinal.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, folder: str | None = None, revisit_from: int = REVISIT_FROM, date: str = DATE) -> str:
    """Archive every row of pages (page_id, url, html); gives the folder."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(html, "UTF-8").alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("n"))

    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{folder}/payloads")

    same = rows.groupBy("page_id", "url", "digest", "n").agg(F.count("*").cast("int").alias("times"))
    each = same.withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).drop("times")
    each = each.withColumn("place", F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "ordinal"))
    # a payload of one page needs no join: only digests met more than once come back
    firsts = each.where(F.col("n") >= revisit_from).groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("met")).where("met > 1").drop("met")
    each = each.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("place"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("ordinal"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), F.lit("")),
        F.when(F.col("url").rlike(r"^$|[\r\n]"), line("X-Target-URI-Hex", F.concat(F.lit("x"), F.hex(F.encode("url", "UTF-8"))))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("first.page_id"), F.col("first.ordinal"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("WARC-Payload-Length", F.col("n").cast("string")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"),
    )
    each.select("page_id", "digest", header.alias("header")).write.option("compression", "zstd").parquet(f"{folder}/headers")
    return folder


def field(header, name: str):
    """A header's value; null where the header lacks it."""
    found = F.regexp_extract(header, f"(?:^|\n){name}: ([^\r]*)\r", 1)
    return F.when(found != "", found)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """payloads (digest, payload), each verified against the digest that it is kept under."""
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    ok = F.sha2("payload", 256) == F.col("digest")
    return payloads.withColumn("payload", F.when(ok, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary")))


def records(spark: SparkSession, folder: str, facts: dict | None = None) -> DataFrame:
    """(page_id, header, payload): each original record, its payload joined back by digest (revisits too). A record without its whole payload fails the job.

    With facts (name -> function of the payload column), these stand in place of the payload: they are taken where the payload lies, so that only they cross the join.
    """
    headers = spark.read.schema("page_id long, digest string, header string").parquet(f"{folder}/headers")
    busy = written(headers.groupBy("digest").agg(F.count("*").alias("times")).where(F.col("times") > MANY).select("digest", F.ceil(F.col("times") / MANY).alias("salts")), "warc-busy")
    busy = F.broadcast(busy) if busy.count() <= BROADCAST else busy
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    left = headers.join(busy, "digest", "left").withColumn("salt", F.pmod(F.xxhash64("header"), salts)).drop("salts")
    of = {name: f(F.col("payload")).alias(name) for name, f in (facts or {"payload": lambda x: x}).items()}
    right = stored(spark, folder).select("digest", F.length("payload").cast("long").alias("_bytes"), *of.values())
    right = right.join(busy, "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    whole = F.col("_bytes") == field(F.col("header"), "WARC-Payload-Length").cast("long")
    header = F.when(whole, F.col("header")).otherwise(F.raise_error(F.concat(F.lit("no whole payload for "), F.col("header"))).cast("string"))
    return left.join(right, ["digest", "salt"], "left").select("page_id", header.alias("header"), *of)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """A row a record, from records(): page_id, payload_bytes, payload_digest (both of the payload itself), record_type, refers_to, record_id, url."""
    h = F.col("header")
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+):[0-9]+>$', 1) AS bigint)")
    url = F.coalesce(F.decode(F.unhex(F.substring(field(h, "X-Target-URI-Hex"), 2, 1 << 30)), "UTF-8"), field(h, "WARC-Target-URI")).alias("url")
    found = records(spark, folder, {"payload_bytes": lambda x: F.length(x).cast("long"), "payload_digest": lambda x: F.sha2(x, 256)})
    parsed = found.select(field(h, "WARC-Record-ID").alias("record_id"), url, field(h, "WARC-Type").alias("record_type"), field(h, "WARC-Refers-To").alias("refers"), "payload_bytes", "payload_digest")
    return parsed.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers").alias("refers_to"), "record_id", "url")


def export_warc(spark: SparkSession, archive: str, folder: str, roll: int = ROLL) -> DataFrame:
    """The archive as .warc.gz files of a gzip member a record; gives the manifest (path, n_records), which Spark commits: only files that it lists count."""

    def write(batches):
        out, n, size = None, 0, 0
        for batch in batches:
            for header, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    fs, at = file_system(path)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out, n, size = fs.open_output_stream(at, compression=None), 0, 0
                body = b"" if "\r\nWARC-Type: revisit\r\n" in header else payload.as_py()
                member = gzip.compress(header.encode() + body + b"\r\n\r\n", mtime=0)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= roll:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n_records"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n_records"])

    return written(records(spark, archive).select("header", "payload").mapInArrow(write, "path string, n_records long"), "warc-manifest")


def read_warc(spark: SparkSession, files: str | DataFrame) -> DataFrame:
    """(path, header, body) of every record of .warc.gz files: a manifest with their paths, or a folder. Each is read as a stream of records."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = file_system(path)
                with fs.open_input_stream(at, compression=None) as raw:
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw))
                    while stream.peek(1):
                        header = b"".join(iter(stream.readline, b"\r\n")).decode() + "\r\n"
                        length = next(int(x.partition(":")[2]) for x in header.split("\r\n") if x.lower().startswith("content-length:"))
                        body = stream.read(length)
                        stream.read(4)
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([header]), pa.array([body], pa.binary())], names=["path", "header", "body"])

    paths = files if isinstance(files, DataFrame) else spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(files)
    return paths.select("path").mapInArrow(read, "path string, header string, body binary")
