"""The corpus pipeline: quality, language, near duplicates, mixture, packing.

Each stage takes all documents that the one before it kept, decides on them by its operator, and gives the documents it keeps
with the columns of `documents` (the last gives packed pieces). Every stage's result is written as Parquet and read again, so a
lost executor costs at most one stage's tasks. A stage's own intermediate tables are deleted when its result is written. An empty table
passes through all stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import langid, mixing, packing, quality, simhash
from strandline.llm.common import save, scope, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (operator 3). Null, empty and blank texts go; repeated rows go or stay together; null ids stay; other columns are left alone."""
    return quality.accepted(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the decoder tells without ambiguity (operator 7), in any learned language. Null texts and texts without a letter go; where no row has a language, only these go; repeated rows go or stay together."""
    return langid.known_language(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 6): of the least doc_id (null last), then fingerprint, then hash of the row. Texts without words are one group; of equal rows one stays."""
    return simhash.deduplicate(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it (operator 8). Texts without words have size 0 and are taken by their own hash; a null source is a source."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences (operator 5): doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is one piece; copies that the mixture made are packed one by one."""
    pieces = written(packing.pieces(docs), "pieces")
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests).withColumn("length", F.col("length").cast("long"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("mix_sources", mixture_stage),
    ("best_fit_packing", packing_stage),
]

#: Learned models, XXH64 and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope():
            docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
