"""SQL templates (Q1-Q7) and their queries: a template is a statement over a view of one name, with a description."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords
from .registry import query
from .tables import table

TEMPLATES = {
    "high_activity": ("keys with many distinct partners, most rows first", """
        SELECT l_partkey AS item, COUNT(*) AS n_rows, COUNT(DISTINCT l_suppkey) AS n_partners, MAX(CAST(l_quantity AS BIGINT)) AS max_quantity, ROUND(AVG(l_quantity), 6) AS avg_quantity
        FROM lineitem GROUP BY l_partkey HAVING n_partners > 1 ORDER BY n_rows DESC, item LIMIT 20"""),
    "distribution_view": ("rows by place and kind, in natural order", """
        SELECT o_orderpriority AS place, CASE WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderpriority LIKE '2%' THEN 2 ELSE 9 END AS place_order,
          CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_donor, CAST(SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n_acceptor, COUNT(*) AS n_all
        FROM orders GROUP BY o_orderpriority"""),
    "complexity": ("the largest item number of each key", """
        SELECT l_orderkey AS item, MAX(CAST(l_linenumber AS INT)) AS max_number, COUNT(*) AS n_rows FROM lineitem GROUP BY l_orderkey HAVING max_number > 3 ORDER BY max_number DESC, n_rows DESC, item LIMIT 30"""),
    "strand_bias": ("rows by two keys", """
        SELECT l_returnflag AS kind, l_linestatus AS strand, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus"""),
    "diversity": ("keys of more than one kind", """
        SELECT c_mktsegment AS segment, COUNT(DISTINCT o_custkey) AS n_transcripts, COUNT(*) AS n_sites FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY c_mktsegment HAVING n_transcripts > 1 ORDER BY n_transcripts DESC, segment LIMIT 20"""),
}


def describe() -> dict[str, str]:
    """Q7: the templates and what they give."""
    return {k: v[0] for k, v in TEMPLATES.items()}


def run_template(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Q1: a template over views of the tables that it names."""
    sql = TEMPLATES[name][1]
    for t in ("lineitem", "orders", "customer"):
        if t in sql:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


for _name, (_, _sql) in TEMPLATES.items():
    query(f"template_{_name}", _sql)(lambda spark, sf_dir, name=_name: run_template(spark, sf_dir, name))


@query("natural_chromosome_order", """
WITH c AS (SELECT c_custkey, 'chr' || CASE c_custkey % 27 WHEN 23 THEN 'X' WHEN 24 THEN 'Y' WHEN 25 THEN 'M' WHEN 26 THEN 'Un_1' WHEN 0 THEN '22' ELSE CAST(c_custkey % 27 AS VARCHAR) END AS chrom FROM customer)
SELECT chrom, CASE chrom WHEN 'chrX' THEN 23 WHEN 'chrY' THEN 24 WHEN 'chrM' THEN 25 ELSE coalesce(TRY_CAST(replace(chrom, 'chr', '') AS INTEGER), 1000) END AS chrom_order, chrom <> 'chrUn_1' AS is_standard, count(*) AS n
FROM c GROUP BY chrom""")  # fmt: skip
def natural_chromosome_order(spark, sf_dir):
    k = F.col("c_custkey") % 27
    chrom = F.concat(F.lit("chr"), F.when(k == 23, "X").when(k == 24, "Y").when(k == 25, "M").when(k == 26, "Un_1").when(k == 0, "22").otherwise(k.cast("string")))
    c = table(spark, sf_dir, "customer").select(chrom.alias("chrom"))
    return c.groupBy("chrom").agg(F.count("*").alias("n")).select("chrom", coords.natural_order("chrom").alias("chrom_order"), coords.standard("chrom").alias("is_standard"), "n")
