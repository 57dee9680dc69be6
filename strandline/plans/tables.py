"""The supplied tables as the shapes that the operators work on. SQL twins are in views(), which oracles put before their query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as positions of a gene (user) with three class scores that sum to 1; position is whole minutes since 2020 or so."""
    return scored_events(table(spark, sf_dir, "events"))


def scored_events(e: DataFrame) -> DataFrame:
    a = F.pmod(F.col("event_id") * 7919, F.lit(997)) / 997.0
    b = F.pmod(F.col("event_id") * 104729, F.lit(991)) / 991.0
    c = F.pmod(F.col("event_id") * 1299709, F.lit(983)) / 983.0 + 0.5
    t = a + b + c
    return e.select("event_id", "user_id", "event_type", "value", "ts", F.floor(F.unix_timestamp("ts") / 60).cast("bigint").alias("position"), (a / t).alias("donor"), (b / t).alias("acceptor"), (c / t).alias("neither"))


SCORED = """
scored AS (SELECT event_id, user_id, event_type, value, ts, position, a / (a + b + c) AS donor, b / (a + b + c) AS acceptor, c / (a + b + c) AS neither FROM (
  SELECT *, CAST(floor(epoch(ts) / 60) AS BIGINT) AS position, ((event_id * 7919) % 997) / 997.0::DOUBLE AS a, ((event_id * 104729) % 991) / 991.0::DOUBLE AS b,
    ((event_id * 1299709) % 983) / 983.0::DOUBLE + 0.5 AS c FROM events))"""


def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as junctions: donor is the part, acceptor the supplier, tissue the return flag, reads the quantity."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("donor_pos"), F.col("l_suppkey").alias("acceptor_pos"), F.col("l_returnflag").alias("tissue"), F.col("l_linestatus").alias("status"), F.col("l_quantity").cast("bigint").alias("reads"))


JUNCTIONS = """
junctions AS (SELECT l_partkey AS donor_pos, l_suppkey AS acceptor_pos, l_returnflag AS tissue, l_linestatus AS status, CAST(l_quantity AS BIGINT) AS reads FROM lineitem),
ends AS (SELECT tissue, status, reads, donor_pos AS position, acceptor_pos AS partner, 'donor' AS side FROM junctions
  UNION ALL SELECT tissue, status, reads, acceptor_pos, donor_pos, 'acceptor' FROM junctions)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score: truth is quality."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(q, "doc_id").select("doc_id", "lang", "source", "quality", "toxic", (F.pmod(F.col("doc_id") * 7919 + F.col("n_chars"), F.lit(1000)) / 1000.0).alias("score"))


JUDGED = """
judged AS (SELECT d.doc_id, lang, source, quality, toxic, ((d.doc_id * 7919 + n_chars) % 1000) / 1000.0::DOUBLE AS score FROM documents d JOIN labels q ON d.doc_id = q.doc_id)"""


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as exons of a transcript (customer): 2-day intervals in days since 1990, strand by parity."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("bigint")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("exon"), F.col("o_custkey").alias("transcript_id"), day.alias("start"), (day + F.pmod(F.col("o_orderkey"), F.lit(5)) + 1).alias("end"), F.when(F.col("o_custkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("o_orderstatus").alias("biotype"))


EXONS = """
exons AS (SELECT o_orderkey AS exon, o_custkey AS transcript_id, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS start,
  CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + o_orderkey % 5 + 1 AS "end", CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand, o_orderstatus AS biotype FROM orders)"""
