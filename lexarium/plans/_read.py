"""Tables and the shared stand-ins for papers, references and actors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, ref: an order cites the parts on its lines."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("ref"))


def authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, key, year, cited: an order's actors are its suppliers' nations."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("cited"))
    j = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("o_orderkey").alias("doc"), F.col("n_name").alias("key"), "year", "cited").distinct()


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, year, topic, cited: orders, their priority being the topic."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("topic"), F.col("o_totalprice").alias("cited"))


REFS = "refs AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS ref FROM lineitem)"
AUTHORS = """au AS (SELECT DISTINCT o_orderkey AS doc, n_name AS key, CAST(year(o_orderdate) AS INT) AS year, o_totalprice AS cited FROM lineitem
 JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey)"""
PAPERS = "papers AS (SELECT o_orderkey AS doc, CAST(year(o_orderdate) AS INT) AS year, o_orderpriority AS topic, o_totalprice AS cited FROM orders)"
DENSE = PAPERS + """, cnt AS (SELECT year, topic, count(*) AS n FROM papers GROUP BY ALL),
grid AS (SELECT year, topic FROM (SELECT unnest(range((SELECT min(year) FROM cnt), (SELECT max(year) FROM cnt) + 1)) AS year) CROSS JOIN (SELECT DISTINCT topic FROM cnt)),
dense AS (SELECT CAST(g.year AS INT) AS year, g.topic, CAST(coalesce(n, 0) AS BIGINT) AS n FROM grid g LEFT JOIN cnt c ON g.year = c.year AND g.topic = c.topic)"""
