"""Queries on graphs: coupling, co-citation, collaboration, connectivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexarium.operators import graph as G
from lexarium.plans._read import AUTHORS, REFS, authorship, references, table


def _coupling(spark, d):
    refs = references(spark, d)
    return G.salton(G.pair_counts(refs, "doc", "ref"), G.degrees(refs, "doc", "ref"))


def coupling_edges(spark, d):
    return _coupling(spark, d).select("src", "dst", "count", F.round("weight", 8).alias("weight"))


def coupling_top_edges(spark, d):
    return G.backbone(_coupling(spark, d), 3).select("src", "dst", F.round("weight", 8).alias("weight"), "rank")


def _often(refs, least):
    return refs.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _cocitation(spark, d, least):
    refs = references(spark, d).distinct()
    kept = refs.join(_often(refs, least).select("ref"), "ref")
    e = G.salton(G.pair_counts(kept, "ref", "doc"), G.degrees(kept, "ref", "doc"))
    return e.select("src", "dst", "count", F.round("weight", 8).alias("weight"))


def cocitation_edges(spark, d):
    """References cited often enough, linked by the papers that cite both."""
    return _cocitation(spark, d, 35)


def cocitation_edges_all(spark, d):
    """The same of all references cited twice or more, the reference's default."""
    return _cocitation(spark, d, 2)


def frequent_references(spark, d):
    return _often(references(spark, d).distinct(), 30)


def frequent_references_all(spark, d):
    return _often(references(spark, d).distinct(), 2)


def coupling_strengths(spark, d):
    return G.strengths(_coupling(spark, d)).select("node", F.round("strength", 6).alias("strength"), "degree")


def _collab(spark, d):
    au = authorship(spark, d)
    return au, G.pair_counts(au, "key", "doc"), G.degrees(au, "key", "doc")


def collab_counts(spark, d):
    return _collab(spark, d)[1]


def collab_salton(spark, d):
    _, e, s = _collab(spark, d)
    return G.salton(e, s).select("src", "dst", F.round("weight", 8).alias("weight"))


def collab_association(spark, d):
    _, e, s = _collab(spark, d)
    return G.association(e, s).select("src", "dst", F.round("weight", 8).alias("weight"))


def collab_backbone(spark, d):
    _, e, s = _collab(spark, d)
    return G.backbone(G.salton(e, s), 3).select("src", "dst", "rank")


def _regions(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("grp"))


def collab_block_means(spark, d):
    _, e, s = _collab(spark, d)
    return G.block_means(G.salton(e, s), _regions(spark, d), 1000.0).select("a", "b", F.round("mean", 6).alias("mean"))


def collab_baseline(spark, d):
    """The mean weight over all pairs of nations, which block means are held against."""
    _, e, s = _collab(spark, d)
    return G.baseline(G.salton(e, s), s.select("node")).select(F.round("baseline", 6).alias("baseline"))


def collab_inout(spark, d):
    """Each region's weight inside and towards the others."""
    _, e, s = _collab(spark, d)
    r = _regions(spark, d)
    return G.inout(G.block_means(G.salton(e, s), r, 1000.0), r).select("grp", F.round("internal", 6).alias("internal"), F.round("outward", 6).alias("outward"))


def collab_enrichment(spark, d):
    _, e, s = _collab(spark, d)
    return G.enrichment(G.salton(e, s), _regions(spark, d)).select("a", "b", F.round("ratio", 6).alias("ratio"))


def collab_modularity(spark, d):
    _, e, s = _collab(spark, d)
    return G.modularity(G.salton(e, s), _regions(spark, d)).select(F.round("q", 8).alias("q"))


def internal_support(spark, d):
    au = authorship(spark, d).select("doc", F.col("key").alias("node"))
    return G.support(au, _regions(spark, d), "doc", "node")


def collab_pagerank(spark, d):
    _, e, s = _collab(spark, d)
    return G.pagerank(G.salton(e, s), 3).select("node", F.round("rank", 8).alias("rank"))


def coupling_communities(spark, d):
    """Label propagation among the nations; no fixed labels to compare with."""
    _, e, s = _collab(spark, d)
    ids = table(spark, d, "nation").select("n_name", F.col("n_nationkey").cast("bigint").alias("id"))
    e = G.salton(e, s).join(ids.toDF("src", "s"), "src").join(ids.toDF("dst", "t"), "dst").select(F.least("s", "t").alias("src"), F.greatest("s", "t").alias("dst"), "weight")
    return G.label_propagation(e, 5)


QUERIES = {f.__name__: f for f in (coupling_edges, coupling_top_edges, cocitation_edges, cocitation_edges_all, frequent_references, frequent_references_all, coupling_strengths, collab_counts, collab_salton, collab_association, collab_backbone, collab_block_means, collab_baseline, collab_inout, collab_enrichment, collab_modularity, internal_support, collab_pagerank, coupling_communities)}

_COUPLING = f"""WITH {REFS}, sz AS (SELECT doc, count(*) AS s FROM refs GROUP BY doc),
e AS (SELECT a.doc AS src, b.doc AS dst, count(*) AS count FROM refs a JOIN refs b ON a.ref = b.ref AND a.doc < b.doc GROUP BY ALL),
w AS (SELECT src, dst, count, count / sqrt(CAST(x.s AS DOUBLE) * y.s) AS weight FROM e JOIN sz x ON x.doc = src JOIN sz y ON y.doc = dst)"""
_COLLAB = f"""WITH {AUTHORS}, sz AS (SELECT key, count(*) AS s FROM au GROUP BY key),
e AS (SELECT a.key AS src, b.key AS dst, count(*) AS count FROM au a JOIN au b ON a.doc = b.doc AND a.key < b.key GROUP BY ALL),
w AS (SELECT src, dst, count, count / sqrt(CAST(x.s AS DOUBLE) * y.s) AS weight, count / (CAST(x.s AS DOUBLE) * y.s) AS raw FROM e JOIN sz x ON x.key = src JOIN sz y ON y.key = dst),
bw AS (SELECT src, dst, weight FROM w UNION ALL SELECT dst, src, weight FROM w),
g AS (SELECT n_name AS node, r_name AS grp FROM nation JOIN region ON n_regionkey = r_regionkey),
st AS (SELECT src AS node, sum(weight) AS strength FROM bw GROUP BY src)"""
_STEP = ", r{0} AS (SELECT q.dst AS node, 0.15 / (SELECT count(*) FROM st) + 0.85 * sum(q.p * r.rank) AS rank FROM q JOIN r{1} r ON r.node = q.src GROUP BY q.dst)"

ORACLE = {
    "coupling_edges": _COUPLING + " SELECT src, dst, count, round(weight, 8) AS weight FROM w",
    "coupling_top_edges": _COUPLING + """, bw AS (SELECT src, dst, weight FROM w UNION ALL SELECT dst, src, weight FROM w),
r AS (SELECT src, dst, weight, CAST(row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS INT) AS rank FROM bw)
SELECT src, dst, round(weight, 8) AS weight, rank FROM r WHERE rank <= 3 AND src < dst""",
    "cocitation_edges": f"""WITH {REFS}, f AS (SELECT ref FROM refs GROUP BY ref HAVING count(*) >= 35), k AS (SELECT doc, ref FROM refs WHERE ref IN (SELECT ref FROM f)),
sz AS (SELECT ref, count(*) AS s FROM k GROUP BY ref), e AS (SELECT a.ref AS src, b.ref AS dst, count(*) AS count FROM k a JOIN k b ON a.doc = b.doc AND a.ref < b.ref GROUP BY ALL)
SELECT src, dst, count, round(count / sqrt(CAST(x.s AS DOUBLE) * y.s), 8) AS weight FROM e JOIN sz x ON x.ref = src JOIN sz y ON y.ref = dst""",
    "frequent_references": f"WITH {REFS} SELECT ref, count(*) AS n FROM refs GROUP BY ref HAVING count(*) >= 30",
    "cocitation_edges_all": f"""WITH {REFS}, f AS (SELECT ref FROM refs GROUP BY ref HAVING count(*) >= 2), k AS (SELECT doc, ref FROM refs WHERE ref IN (SELECT ref FROM f)),
sz AS (SELECT ref, count(*) AS s FROM k GROUP BY ref), e AS (SELECT a.ref AS src, b.ref AS dst, count(*) AS count FROM k a JOIN k b ON a.doc = b.doc AND a.ref < b.ref GROUP BY ALL)
SELECT src, dst, count, round(count / sqrt(CAST(x.s AS DOUBLE) * y.s), 8) AS weight FROM e JOIN sz x ON x.ref = src JOIN sz y ON y.ref = dst""",
    "frequent_references_all": f"WITH {REFS} SELECT ref, count(*) AS n FROM refs GROUP BY ref HAVING count(*) >= 2",
    "coupling_strengths": _COUPLING + ", bw AS (SELECT src, weight FROM w UNION ALL SELECT dst, weight FROM w) SELECT src AS node, round(sum(weight), 6) AS strength, count(*) AS degree FROM bw GROUP BY src",
    "collab_counts": _COLLAB + " SELECT src, dst, count FROM e",
    "collab_salton": _COLLAB + " SELECT src, dst, round(weight, 8) AS weight FROM w",
    "collab_association": _COLLAB + " SELECT src, dst, round(raw / (SELECT avg(raw) FROM w), 8) AS weight FROM w",
    "collab_backbone": _COLLAB + ", r AS (SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS INT) AS rank FROM bw) SELECT src, dst, rank FROM r WHERE rank <= 3 AND src < dst",
    "collab_block_means": _COLLAB + """, n AS (SELECT grp, count(*) AS n FROM g GROUP BY grp), b AS (SELECT least(x.grp, y.grp) AS a, greatest(x.grp, y.grp) AS b, sum(weight) AS t FROM w JOIN g x ON x.node = src JOIN g y ON y.node = dst GROUP BY ALL)
SELECT a, b, round(t / CASE WHEN a = b THEN p.n * (p.n - 1) / 2 ELSE p.n * q.n END * 1000, 6) AS mean FROM b JOIN n p ON p.grp = a JOIN n q ON q.grp = b""",
    "collab_baseline": _COLLAB + """, k AS (SELECT count(DISTINCT key) AS n FROM au) SELECT round(sum(weight) / ((SELECT n FROM k) * ((SELECT n FROM k) - 1) / 2) * 1000, 6) AS baseline FROM w""",
    "collab_inout": _COLLAB + """, n AS (SELECT grp, count(*) AS n FROM g GROUP BY grp), b AS (SELECT least(x.grp, y.grp) AS a, greatest(x.grp, y.grp) AS b, sum(weight) AS t FROM w JOIN g x ON x.node = src JOIN g y ON y.node = dst GROUP BY ALL),
m AS (SELECT a, b, t / CASE WHEN a = b THEN p.n * (p.n - 1) / 2 ELSE p.n * q.n END * 1000 AS mean FROM b JOIN n p ON p.grp = a JOIN n q ON q.grp = b)
SELECT grp, round(coalesce((SELECT sum(mean) FROM m WHERE a = b AND a = n.grp), 0), 6) AS internal, round(coalesce((SELECT sum(mean) FROM m WHERE a <> b AND (a = n.grp OR b = n.grp)), 0) / ((SELECT count(*) FROM n) - 1), 6) AS outward FROM n""",
    "collab_enrichment": _COLLAB + """, s AS (SELECT grp, sum(strength) AS s, sum(strength * strength) AS q FROM st JOIN g ON g.node = st.node GROUP BY grp),
b AS (SELECT least(x.grp, y.grp) AS a, greatest(x.grp, y.grp) AS b, sum(weight) AS seen FROM w JOIN g x ON x.node = src JOIN g y ON y.node = dst GROUP BY ALL), t AS (SELECT sum(strength) AS t FROM st)
SELECT a, b, round(seen / (CASE WHEN a = b THEN (p.s * p.s - p.q) / 2 ELSE p.s * r.s END / t), 6) AS ratio FROM b JOIN s p ON p.grp = a JOIN s r ON r.grp = b CROSS JOIN t""",
    "collab_modularity": _COLLAB + """, m AS (SELECT sum(weight) AS m FROM w), d AS (SELECT grp, sum(strength) AS d FROM st JOIN g ON g.node = st.node GROUP BY grp),
i AS (SELECT x.grp AS grp, sum(weight) AS i FROM w JOIN g x ON x.node = src JOIN g y ON y.node = dst WHERE x.grp = y.grp GROUP BY x.grp)
SELECT round(sum(coalesce(i, 0) / m - (d / (2 * m)) * (d / (2 * m))), 8) AS q FROM d LEFT JOIN i ON i.grp = d.grp CROSS JOIN m""",
    "internal_support": f"""WITH {AUTHORS}, x AS (SELECT doc, r_name AS grp, count(*) AS m FROM au JOIN nation ON n_name = key JOIN region ON n_regionkey = r_regionkey GROUP BY ALL HAVING count(*) >= 2)
SELECT grp, count(*) AS support FROM x GROUP BY grp""",
    "collab_pagerank": _COLLAB + ", q AS (SELECT src, dst, weight / strength AS p FROM bw JOIN st ON st.node = src), r0 AS (SELECT node, 1.0 / (SELECT count(*) FROM st) AS rank FROM st)" + "".join(_STEP.format(i, i - 1) for i in (1, 2, 3)) + " SELECT node, round(rank, 8) AS rank FROM r3",
}
