"""Queries on records, seeds, answers, reviews and costs: parts, orders, events and documents stand in."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexarium.functions import replies as J
from lexarium.functions import text as T
from lexarium.operators import cost as M
from lexarium.operators import ranking as R
from lexarium.operators import seeds as S
from lexarium.plans._read import PAPERS, papers, table
from lexarium.sources import wos_records as W

#: A record of the extended JSON; %1$d is the part's key, %2$s its name, %3$s its brand, %4$d its size.
RECORD = (
    '{"UID": "WOS:%1$d", "static_data": {"summary": {"titles": {"title": [{"type": "source", "content": "J of %3$s"}, {"type": "item", "content": "On %2$s"}]},'
    ' "pub_info": {"pubyear": %5$d}, "doctypes": {"doctype": "Article"}, "languages": {"language": {"type": "primary", "content": "English"}},'
    ' "names": {"name": {"role": "author", "display_name": "Doe, J", "daisng_id": %1$d}}},'
    ' "fullrecord_metadata": {"keywords": {"keyword": ["%3$s", "k"]}, "abstracts": {"abstract": {"abstract_text": {"p": ["a %2$s", "b"]}}},'
    ' "addresses": {"address_name": [{"address_spec": {"country": "Peoples R China", "organizations": {"organization": ["x", {"content": "Univ %3$s", "pref": "Y"}]}}}]}}},'
    ' "dynamic_data": {"citation_related": {"tc_list": {"silo_tc": [{"coll_id": "WOK", "local_count": 1}, {"coll_id": "WOS", "local_count": %4$d}]}},'
    ' "cluster_related": {"identifiers": {"identifier": {"type": "doi", "value": "10.1/%1$d"}}}}}'
)


def wos_json(spark, d):
    year = (F.col("p_partkey") % 30 + 1990).cast("int")
    p = table(spark, d, "part").select(F.format_string(RECORD, "p_partkey", "p_name", "p_brand", "p_size", year).alias("value"))
    r = W.from_records(p)
    return r.select("id", "title", "journal", "abstract", "author_keywords", "doi", "language", "document_type", F.col("year").cast("int").alias("year"), F.col("cited_by").cast("int").alias("cited_by"), F.col("actors.authors")[0]["key"].alias("author"), F.col("actors.institutions")[0]["name"].alias("institution"), F.col("actors.countries")[0].alias("country"))


#: Answers by event_id % 6: a list, an envelope after words, one object in a fence, one cut off, one that is broken, one without JSON.
ANSWERS = (
    '[{"evaluation": %1$d, "reasoning": "r"}, {"evaluation": "%2$d"}]',
    'Here: {"evaluations": [{"evaluation": %1$d, "reasoning": "a } b"}]}',
    '```json\n{"evaluation": %1$d.7, "reasoning": "r"}\n```',
    '{"evaluations": [{"evaluation": %1$d, "reasoning": "r"}, {"evaluation": ',
    '{"evaluation": %1$d "reasoning"}',
    "score %1$d of %2$d",
)


def model_answers(spark, d):
    """Status, number and sum of the scores of each event's answer."""
    one, two = (F.col("event_id") % 5 + 1).cast("int"), (F.col("user_id") % 5 + 1).cast("int")
    answer = F.element_at(F.array(*[F.format_string(a, one, two) for a in ANSWERS]), (F.col("event_id") % 6 + 1).cast("int"))
    e = table(spark, d, "events").select("event_id", answer.alias("answer"))
    e = e.select("event_id", J.status(F.col("answer")).alias("status"), J.evaluations(F.col("answer")).alias("items"))
    total = F.aggregate("items", F.lit(0).cast("bigint"), lambda s, x: s + x["evaluation"])
    return e.select("event_id", "status", F.size("items").alias("n"), total.alias("total"), J.complete(F.col("items"), 1).alias("single"))


def _works(spark, d):
    o = table(spark, d, "orders")
    name = F.concat(F.lit("W"), "o_orderkey")
    return o.select(name.alias("id"), F.lit(None).cast("string").alias("doi"), F.col("o_comment").alias("title") if "o_comment" in o.columns else F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("abstract"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("cited"))


def _edges(spark, d):
    return table(spark, d, "lineitem").select(F.concat(F.lit("W"), "l_orderkey").alias("src"), F.concat(F.lit("W"), "l_partkey").alias("dst"))


def seed_pool(spark, d):
    """Works with an order key below 30, their citing and cited works, all of them."""
    seeds = table(spark, d, "orders").where("o_orderkey < 30").select(F.concat(F.lit("https://openalex.org/w"), "o_orderkey").alias("seed"))
    pool, _ = S.expand(_works(spark, d), _edges(spark, d), seeds, first=1994, last=1997, most=None)
    return pool


def topic_reviews(spark, d):
    p = papers(spark, d).withColumnRenamed("doc", "id")
    return R.pick_reviews(p, "topic", 1998).select("topic", "cohort", "place", "id")


def _reviewers(spark):
    rows = [(0, "a", "lab/Model-1-20250101", 10, 400, 40, None), (0, "b", "model-2", 1, 350, 110, 100), (1, "c", "model-1", 4, 500, 230, 4000)]
    return spark.createDataFrame(rows, "round int, reviewer string, model_id string, items_per_call int, fixed_tokens int, output_per_item int, max_tokens int")


def _estimate(spark, d):
    prices = spark.createDataFrame([("model-1", 1.0, 5.0), ("model-2", 3.0, 15.0)], "model string, input double, output double")
    return M.estimate(table(spark, d, "documents"), T.heuristic_tokens(F.coalesce("text", F.lit(""))), _reviewers(spark), prices)


def review_cost(spark, d):
    return _estimate(spark, d).select("reviewer", "items", "calls", "tokens_in", "tokens_out", "capped", F.round("cost", 6).alias("cost"))


def review_cost_sweep(spark, d):
    return M.sweep(_estimate(spark, d)).select("items_per_call", "calls", "tokens_in", F.round("cost", 6).alias("cost"), F.round("change", 4).alias("change"))


QUERIES = {f.__name__: f for f in (wos_json, model_answers, seed_pool, topic_reviews, review_cost, review_cost_sweep)}

_COST = """t AS (SELECT count(*) AS n, sum(CAST(floor(length(coalesce(text, '')) / 3.7) AS BIGINT) + 12) AS t FROM documents),
r AS (SELECT * FROM (VALUES (0, 'a', 10, 400, 40, NULL, 1.0, 5.0), (0, 'b', 1, 350, 110, 100, 3.0, 15.0), (1, 'c', 4, 500, 230, 4000, 1.0, 5.0)) v(round, reviewer, k, fixed, per, most, pin, pout)),
i AS (SELECT *, CAST(round_even(n * pow(0.1, round), 0) AS BIGINT) AS items FROM r CROSS JOIN t),
c AS (SELECT *, CAST(ceil(items / k) AS BIGINT) AS calls FROM i WHERE items > 0),
o AS (SELECT *, per * items + 8 * calls AS raw, most * k * calls AS cap, CAST(round_even(calls * fixed + CAST(t AS DOUBLE) * items / n, 0) AS BIGINT) AS tin FROM c),
g AS (SELECT *, CAST(least(raw, coalesce(cap, raw)) AS BIGINT) AS tout, coalesce(raw > cap, false) AS capped FROM o)"""
_PCT = "CASE WHEN count(*) OVER w = 1 THEN 1.0 ELSE (rank() OVER (PARTITION BY topic ORDER BY {0}) + (count(*) OVER (PARTITION BY topic, {0}) - 1) / 2.0 - 1) / (count(*) OVER w - 1) END"

ORACLE = {
    "wos_json": """SELECT 'WOS:' || p_partkey AS id, 'On ' || p_name AS title, 'J of ' || p_brand AS journal, 'a ' || p_name || ' b' AS abstract, p_brand || '; k' AS author_keywords, '10.1/' || p_partkey AS doi,
'English' AS language, 'Article' AS document_type, CAST(p_partkey % 30 + 1990 AS INT) AS year, CAST(p_size AS INT) AS cited_by, 'wos:' || p_partkey AS author, 'Univ ' || p_brand AS institution, 'CN' AS country FROM part""",
    "model_answers": """WITH e AS (SELECT event_id, event_id % 6 AS k, event_id % 5 + 1 AS a, user_id % 5 + 1 AS b FROM events)
SELECT event_id, CASE WHEN k <= 2 THEN 'ok' WHEN k = 3 THEN 'truncated' WHEN k = 4 THEN 'malformed' ELSE 'none' END AS status, CAST(CASE WHEN k = 0 THEN 2 WHEN k <= 2 THEN 1 END AS INT) AS n,
CAST(CASE WHEN k = 0 THEN a + b WHEN k <= 2 THEN a END AS BIGINT) AS total, k IN (1, 2) AS single FROM e""",
    "seed_pool": """WITH s AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey < 30),
f AS (SELECT DISTINCT l_orderkey AS k FROM lineitem JOIN s ON l_partkey = s.k JOIN orders ON o_orderkey = l_orderkey WHERE year(o_orderdate) BETWEEN 1994 AND 1997),
b AS (SELECT DISTINCT l_partkey AS k FROM lineitem JOIN s ON l_orderkey = s.k JOIN orders ON o_orderkey = l_partkey),
u AS (SELECT k FROM s UNION SELECT k FROM f UNION SELECT k FROM b)
SELECT 'W' || k AS id, k IN (SELECT k FROM s) AS is_seed, k IN (SELECT k FROM f) AS by_forward, k IN (SELECT k FROM b) AS by_backward, false AS by_query FROM u""",
    "topic_reviews": f"""WITH {PAPERS}, n AS (SELECT topic, 'recent' AS cohort, row_number() OVER (PARTITION BY topic ORDER BY year DESC, cited DESC, doc) AS place, doc AS id FROM papers WHERE year > 1996),
h AS (SELECT *, cited / (1998 - year + 1) AS cy FROM papers WHERE year <= 1996),
p AS (SELECT topic, doc, {_PCT.format('cy')} AS a, {_PCT.format('cited')} AS b FROM h WINDOW w AS (PARTITION BY topic)),
r AS (SELECT topic, 'ranked' AS cohort, row_number() OVER (PARTITION BY topic ORDER BY (a + b) / 2 DESC, doc) AS place, doc AS id FROM p)
SELECT topic, cohort, CAST(place AS INT) AS place, id FROM (SELECT * FROM n UNION ALL SELECT * FROM r) WHERE place <= 3""",
    "review_cost": f"WITH {_COST} SELECT reviewer, items, calls, tin AS tokens_in, tout AS tokens_out, capped, round((tin * pin + tout * pout) / 1e6, 6) AS cost FROM g",
    "review_cost_sweep": f"""WITH {_COST}, v AS (SELECT unnest([1, 5, 10, 25, 50]) AS v), x AS (SELECT v, CAST(ceil(items / v) AS BIGINT) AS c, tin + (CAST(ceil(items / v) AS BIGINT) - calls) * fixed AS tk, tout, pin, pout, (tin * pin + tout * pout) / 1e6 AS now FROM g CROSS JOIN v)
SELECT CAST(v AS INT) AS items_per_call, CAST(sum(c) AS BIGINT) AS calls, CAST(sum(tk) AS BIGINT) AS tokens_in, round(sum((tk * pin + tout * pout) / 1e6), 6) AS cost, round(100 * (sum((tk * pin + tout * pout) / 1e6) - sum(now)) / sum(now), 4) AS change FROM x GROUP BY v""",
}
