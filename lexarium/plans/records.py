"""Queries on references, duplicate records, aliases and groups' profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexarium.functions import text as T
from lexarium.operators import references as R
from lexarium.plans._read import table

TOPICS = 10


def _tokens(spark, d):
    """Lines of orders as references: work ids, DOIs and free text by turns."""
    part = F.col("l_partkey").cast("string")
    token = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("https://openalex.org/W"), part)).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("Roe J, 2020, DOI 10.1000/AB."), part)).otherwise(F.concat(F.lit("Doe "), part))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), token.alias("token"))


def shared_references(spark, d):
    return R.joined(R.shared(_tokens(spark, d)), "refs")


def resolved_references(spark, d):
    part = F.col("p_partkey")
    corpus = table(spark, d, "part").select(part.alias("id"), F.when(F.col("p_size") > 10, F.concat(F.lit("W"), part)).alias("key"), F.concat(F.lit("https://doi.org/10.1000/ab."), part).alias("doi"))
    found = R.resolve(_tokens(spark, d), corpus)
    return found.groupBy("doc").agg(F.count("target").alias("resolved"), F.count_if(F.col("target").isNull()).alias("unresolved"), F.sum("target").alias("targets"))


def dedup_records(spark, d):
    docs = table(spark, d, "documents")
    title = T.title_key(F.split("text", "\n")[0])
    return R.first_of_keys(docs, "doc_id", F.md5("text"), title).select("doc_id")


def unique_aliases(spark, d):
    return R.aliases(table(spark, d, "part"), F.lower("p_name"), F.col("p_partkey"))


def document_types(spark, d):
    return R.by_type(table(spark, d, "orders"), "o_orderpriority")


def group_profiles(spark, d):
    orders = table(spark, d, "orders").select("o_orderpriority", F.year("o_orderdate").alias("year"))
    return R.profiles(orders, "o_orderpriority", "year")


def topic_similarity(spark, d):
    e = table(spark, d, "embeddings")
    out = R.column_cosines(e, {f"t{i}": F.col("embedding")[i] for i in range(TOPICS)})
    return out.withColumn("cosine", F.round("cosine", 8))


def topic_similarity_all(spark, d):
    """The same of all columns of the vectors."""
    return R.vector_cosines(table(spark, d, "embeddings"), "embedding").withColumn("cosine", F.round("cosine", 8))


QUERIES = {f.__name__: f for f in (shared_references, resolved_references, dedup_records, unique_aliases, document_types, group_profiles, topic_similarity, topic_similarity_all)}

_TOK = """tok AS (SELECT l_orderkey AS doc, l_linenumber AS pos, l_partkey AS part, CASE l_linenumber % 3 WHEN 0 THEN 'https://openalex.org/W' || l_partkey
WHEN 1 THEN 'Roe J, 2020, DOI 10.1000/AB.' || l_partkey ELSE 'Doe ' || l_partkey END AS token FROM lineitem)"""

ORACLE = {
    "shared_references": f"""WITH {_TOK}, n AS (SELECT token FROM tok GROUP BY token HAVING count(*) >= 2)
SELECT doc, string_agg(token, '; ' ORDER BY pos, token) AS refs FROM tok WHERE token IN (SELECT token FROM n) GROUP BY doc""",
    "resolved_references": f"""WITH {_TOK}, r AS (SELECT doc, CASE WHEN pos % 3 = 0 AND p_size > 10 OR pos % 3 = 1 THEN p_partkey END AS target FROM tok LEFT JOIN part ON p_partkey = part)
SELECT doc, count(target) AS resolved, count(*) - count(target) AS unresolved, CAST(sum(target) AS BIGINT) AS targets FROM r GROUP BY doc""",
    "dedup_records": """WITH k AS (SELECT doc_id, text, coalesce(substr(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]', '', 'g'), 1, 90), '') AS t FROM documents),
r AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS d, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS n FROM k) SELECT doc_id FROM r WHERE n = 1 AND (d = 1 OR text IS NULL)""",
    "unique_aliases": "SELECT lower(p_name) AS norm, min(p_partkey) AS key FROM part WHERE p_name <> '' GROUP BY ALL HAVING count(DISTINCT p_partkey) = 1",
    "document_types": "SELECT coalesce(o_orderpriority, 'UNKNOWN') AS kind, count(*) AS n FROM orders GROUP BY ALL",
    "group_profiles": "SELECT o_orderpriority, count(*) AS n, CAST(floor(quantile_cont(year(o_orderdate), 0.5)) AS INT) AS median_year, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year FROM orders GROUP BY ALL",
    "topic_similarity": f"""WITH x AS (SELECT vec_id, unnest(range(1, {TOPICS + 1})) AS i, unnest(CAST(embedding[1:{TOPICS}] AS DOUBLE[])) AS v FROM embeddings)
SELECT 't' || (a.i - 1) AS a, 't' || (b.i - 1) AS b, round(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 8) AS cosine FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY ALL""",
    "topic_similarity_all": """WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings)
SELECT 't' || (a.i - 1) AS a, 't' || (b.i - 1) AS b, round(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 8) AS cosine FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY ALL""",
}
