"""Queries on actors, rankings, time and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexarium.operators import actors as A
from lexarium.operators import corpus as C
from lexarium.operators import ranking as R
from lexarium.operators import review as V
from lexarium.operators import temporal as Y
from lexarium.operators import topics as P
from lexarium.plans._read import AUTHORS, DENSE, PAPERS, authorship, papers, table


def rank_actors(spark, d):
    r = A.rank_actors(authorship(spark, d))
    return r.select("key", "papers", F.round("fractional", 6).alias("fractional"), F.round("citations", 2).alias("citations"), "first_year", "last_year", F.round("share", 8).alias("share"), F.round("per_paper", 4).alias("per_paper"))


def collab_summary(spark, d):
    s = A.summary(authorship(spark, d))
    return s.select("papers", "actors", *[F.round(c, 8).alias(c) for c in ("mean_team", "single_share", "shared_share")])


def actor_modal_segment(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_mktsegment")
    return A.mode(c, ["c_nationkey"], "c_mktsegment")


def percentile_average_rank(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return p.select("p_partkey", F.round(R.average_percentile(F.col("p_size"), [F.col("p_brand")]), 8).alias("pct"))


def composite_three_axes(spark, d):
    p = table(spark, d, "part")
    by = [F.col("p_brand")]
    axes = [R.average_percentile(F.col(c), by) for c in ("p_size", "p_retailprice")] + [R.average_percentile(-F.col("p_partkey"), by)]
    p = p.select("p_partkey", *[a.alias(f"x{i}") for i, a in enumerate(axes)])
    cols = [F.col(f"x{i}") for i in range(3)]
    return p.select("p_partkey", F.round(R.aggregate_axes(cols), 6).alias("mean"), F.round(R.aggregate_axes(cols, "gmean"), 6).alias("gmean"), F.round(R.aggregate_axes(cols, "chebyshev"), 6).alias("chebyshev"))


def reading_list(spark, d):
    p = papers(spark, d)
    return R.top_k(p, ["topic"], [F.desc("cited"), F.col("doc")], 10).select("topic", "doc", "rank")


def model_distance(spark, d):
    p = table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("a"), F.stddev_pop("p_size").alias("b"))
    return R.distance_to_ideal(p, {"a": True, "b": False}).select("p_brand", F.round("distance", 6).alias("distance"))


def topic_year_dense(spark, d):
    return Y.dense_counts(papers(spark, d), "year", "topic")


def topic_trajectory(spark, d):
    t = Y.trajectory(topic_year_dense(spark, d))
    return t.select("year", "topic", "n", F.round("rolling", 6).alias("rolling"), F.round("share", 6).alias("share"), "cumulative")


def median_year_low(spark, d):
    return Y.median_year(topic_year_dense(spark, d))


def median_docs_per_year(spark, d):
    return Y.median_per_year(topic_year_dense(spark, d))


def topic_entropy(spark, d):
    return P.entropy(table(spark, d, "embeddings"), "label").select(F.round("entropy", 8).alias("entropy"))


def topic_sizes(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def topic_citations(spark, d):
    """Count, total, mean, and the total of the ten most cited, by topic."""
    p = papers(spark, d)
    top = R.top_k(p, ["topic"], [F.desc("cited"), F.col("doc")], 10).groupBy("topic").agg(F.sum("cited").alias("top10"))
    n = p.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum("cited").alias("total"), F.avg("cited").alias("mean"))
    return n.join(top, "topic").select("topic", "n", *[F.round(c, 2).alias(c) for c in ("total", "mean", "top10")])


def centroid_cosine(spark, d):
    e = P.centroid_cosine(table(spark, d, "embeddings"), "label", "embedding")
    return e.select("vec_id", F.round("cosine", 6).alias("cosine"))


def extract_documents(spark, d):
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    out = C.extract(o, "year", 1998, "o_totalprice", 1000.0, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"], ["2-HIGH"])
    return out.select("o_orderkey", "year", "o_orderpriority")


def community_topic_crosstab(spark, d):
    p = papers(spark, d)
    return p.groupBy("year").pivot("topic", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).agg(F.count(F.lit(1))).na.fill(0).toDF("year", "urgent", "high", "medium")


def community_topic_crosstab_all(spark, d):
    """The same of all topics: a row for each year and topic, 0 where there is none."""
    p = papers(spark, d)
    cells = p.select("year").distinct().crossJoin(F.broadcast(p.select("topic").distinct()))  # topics
    n = p.groupBy("year", "topic").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("c.year").eqNullSafe(F.col("n.year")) & F.col("c.topic").eqNullSafe(F.col("n.topic"))
    return cells.alias("c").join(n.alias("n"), same, "left").select("c.year", "c.topic", F.coalesce(F.col("n.n"), F.lit(0)).alias("n"))


def votes(spark, d):
    """Three reviewers' votes (1 to 5, the last may be missing) for each user's
    events: final scores, whether the next round sees them, inclusion."""
    e = table(spark, d, "events")
    v = F.array((F.col("event_id") % 5 + 1).cast("int"), (F.col("user_id") % 5 + 1).cast("int"), F.when(F.col("event_id") % 2 == 0, (F.length("event_type") % 5 + 1).cast("int")))
    e = e.select("event_id", v.alias("v"))
    return e.select("event_id", V.final_score(F.col("v")).alias("majority"), F.round(V.final_score(F.col("v"), "mean"), 6).alias("mean"), V.escalates(F.col("v")).alias("escalates"), V.escalates(F.col("v"), "mean").alias("escalates_mean"), V.included(F.col("v")).alias("included"))


QUERIES = {f.__name__: f for f in (rank_actors, collab_summary, actor_modal_segment, percentile_average_rank, composite_three_axes, reading_list, model_distance, topic_year_dense, topic_trajectory, median_year_low, median_docs_per_year, topic_entropy, topic_sizes, topic_citations, centroid_cosine, extract_documents, community_topic_crosstab, community_topic_crosstab_all, votes)}


def _pct(value: str) -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY p_brand) = 1 THEN 1.0 ELSE (rank() OVER (PARTITION BY p_brand ORDER BY {value}) + (count(*) OVER (PARTITION BY p_brand, {value}) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY p_brand) - 1) END"


ORACLE = {
    "rank_actors": f"""WITH {AUTHORS}, l AS (SELECT *, count(*) OVER (PARTITION BY doc) AS k FROM au)
SELECT key, count(*) AS papers, round(sum(1.0 / k), 6) AS fractional, round(sum(cited), 2) AS citations, min(year) AS first_year, max(year) AS last_year,
round(count(*) / (SELECT count(DISTINCT doc) FROM au), 8) AS share, round(sum(cited) / count(*), 4) AS per_paper FROM l GROUP BY key""",
    "collab_summary": f"""WITH {AUTHORS}, t AS (SELECT doc, count(DISTINCT key) AS k FROM au GROUP BY doc)
SELECT count(*) AS papers, (SELECT count(DISTINCT key) FROM au) AS actors, round(avg(k), 8) AS mean_team, round(avg(CAST(k = 1 AS DOUBLE)), 8) AS single_share, round(avg(CAST(k >= 2 AS DOUBLE)), 8) AS shared_share FROM t""",
    "actor_modal_segment": """WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r FROM n) SELECT c_nationkey, c_mktsegment FROM r WHERE r = 1""",
    "percentile_average_rank": f"SELECT p_partkey, round({_pct('p_size')}, 8) AS pct FROM part",
    "composite_three_axes": f"""WITH x AS (SELECT p_partkey, {_pct('p_size')} AS a, {_pct('p_retailprice')} AS b, {_pct('(-p_partkey)')} AS c FROM part)
SELECT p_partkey, round((a + b + c) / 3, 6) AS mean, round(exp((ln(greatest(a, 1e-9)) + ln(greatest(b, 1e-9)) + ln(greatest(c, 1e-9))) / 3), 6) AS gmean, round(least(a, b, c) + 0.05 * (a + b + c) / 3, 6) AS chebyshev FROM x""",
    "reading_list": f"WITH {PAPERS}, r AS (SELECT topic, doc, CAST(row_number() OVER (PARTITION BY topic ORDER BY cited DESC, doc) AS INT) AS rank FROM papers) SELECT * FROM r WHERE rank <= 10",
    "model_distance": """WITH p AS (SELECT p_brand, avg(p_retailprice) AS a, stddev_pop(p_size) AS b FROM part GROUP BY p_brand),
m AS (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM p)
SELECT p_brand, round(sqrt(pow(CASE WHEN ha = la THEN 0 ELSE 1 - (a - la) / (ha - la) END, 2) + pow(CASE WHEN hb = lb THEN 0 ELSE (b - lb) / (hb - lb) END, 2)), 6) AS distance FROM p CROSS JOIN m""",
    "topic_year_dense": f"WITH {DENSE} SELECT year, topic, n FROM dense",
    "topic_trajectory": f"""WITH {DENSE} SELECT year, topic, n, round(avg(n) OVER (PARTITION BY topic ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS rolling,
round(CASE WHEN sum(n) OVER (PARTITION BY year) > 0 THEN 100.0 * n / sum(n) OVER (PARTITION BY year) ELSE 0 END, 6) AS share, CAST(sum(n) OVER (PARTITION BY topic ORDER BY year ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM dense""",
    "median_year_low": f"""WITH {DENSE}, c AS (SELECT topic, year, sum(n) OVER (PARTITION BY topic ORDER BY year ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY topic) AS total FROM dense)
SELECT topic, min(year) AS median_year FROM c WHERE run >= total / 2.0 GROUP BY topic""",
    "median_docs_per_year": f"""WITH {DENSE}, f AS (SELECT *, min(CASE WHEN n > 0 THEN year END) OVER (PARTITION BY topic) AS f FROM dense) SELECT topic, quantile_cont(n, 0.5) AS median_per_year FROM f WHERE year >= f GROUP BY topic""",
    "topic_entropy": "WITH n AS (SELECT label, count(*) AS n FROM embeddings WHERE label <> -1 GROUP BY label), t AS (SELECT sum(n) AS t FROM n) SELECT round(sum(-(n / t) * ln(n / t)), 8) AS entropy FROM n CROSS JOIN t",
    "topic_sizes": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
    "topic_citations": f"""WITH {PAPERS}, r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY cited DESC, doc) AS r FROM papers)
SELECT topic, count(*) AS n, round(sum(cited), 2) AS total, round(avg(cited), 2) AS mean, round(sum(cited) FILTER (r <= 10), 2) AS top10 FROM r GROUP BY topic""",
    "centroid_cosine": """WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS c FROM e GROUP BY ALL)
SELECT vec_id, round(sum(CAST(x AS DOUBLE) * c) / sqrt(sum(CAST(x AS DOUBLE) * x) * sum(c * c)), 6) AS cosine FROM e JOIN c ON c.label = e.label AND c.i = e.i GROUP BY vec_id""",
    "extract_documents": "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, o_orderpriority FROM orders WHERE year(o_orderdate) >= 1998 AND o_totalprice >= 1000 AND o_orderpriority IN ('1-URGENT', '3-MEDIUM')",
    "community_topic_crosstab": f"WITH {PAPERS} SELECT year, count(*) FILTER (topic = '1-URGENT') AS urgent, count(*) FILTER (topic = '2-HIGH') AS high, count(*) FILTER (topic = '3-MEDIUM') AS medium FROM papers GROUP BY year",
    "community_topic_crosstab_all": f"""WITH {PAPERS}, t AS (SELECT DISTINCT topic FROM papers), y AS (SELECT DISTINCT year FROM papers), n AS (SELECT year, topic, count(*) AS n FROM papers GROUP BY ALL)
SELECT y.year, t.topic, coalesce(n, 0) AS n FROM y CROSS JOIN t LEFT JOIN n ON n.year IS NOT DISTINCT FROM y.year AND n.topic IS NOT DISTINCT FROM t.topic""",
    "votes": """WITH e AS (SELECT event_id, CAST(event_id % 5 + 1 AS INT) AS a, CAST(user_id % 5 + 1 AS INT) AS b, CASE WHEN event_id % 2 = 0 THEN CAST(length(event_type) % 5 + 1 AS INT) END AS c FROM events),
l AS (SELECT *, list_filter([a, b, c], lambda x: x IS NOT NULL) AS v FROM e),
m AS (SELECT *, list_median(v) AS md, list_avg(v) AS av, len(list_filter(v, lambda x: x > 3)) AS up, len(list_filter(v, lambda x: x < 3)) AS down, len(list_filter(v, lambda x: x = 3)) AS mid FROM l),
f AS (SELECT *, CASE WHEN md = 3 THEN CAST(c AS DOUBLE) ELSE CAST(md AS DOUBLE) END AS majority FROM m)
SELECT event_id, majority, round(av, 6) AS mean, (up = down OR 2 * mid >= len(v)) AS escalates, av = 3 AS escalates_mean, coalesce(majority > 3, false) AS included FROM f""",
}
