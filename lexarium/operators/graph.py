"""Graphs as edge tables: built by equi-joins, never as matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_counts(obs: DataFrame, node: str, item: str, least: int = 1) -> DataFrame:
    """src < dst, count: items that both nodes have. Items of one node make no
    pair and go first; the join is on the item alone, so AQE splits hot ones."""
    d = obs.select(F.col(node).alias("n"), F.col(item).alias("i")).where("n is not null and i is not null").distinct()
    live = d.groupBy("i").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).select("i")
    d = d.join(live, "i")
    a, b = d.select("i", F.col("n").alias("src")), d.select("i", F.col("n").alias("dst"))
    out = a.join(b, "i").where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("count"))
    return out.where(F.col("count") >= least) if least > 1 else out


def degrees(obs: DataFrame, node: str, item: str) -> DataFrame:
    return obs.where(F.col(node).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.countDistinct(item).alias("size"))


def salton(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """weight = count / sqrt(size_src * size_dst)."""
    return (
        edges.join(sizes.toDF("src", "size_src"), "src")
        .join(sizes.toDF("dst", "size_dst"), "dst")
        .withColumn("weight", F.col("count") / F.sqrt(F.col("size_src").cast("double") * F.col("size_dst")))
    )


def association(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """count / (size_src * size_dst), over the mean of the cells above nought."""
    raw = salton(edges, sizes).withColumn("raw", F.col("count") / (F.col("size_src").cast("double") * F.col("size_dst")))
    return raw.crossJoin(F.broadcast(raw.agg(F.avg("raw").alias("mean")))).withColumn("weight", F.col("raw") / F.col("mean")).drop("raw", "mean")  # one row


def both_ways(edges: DataFrame, weight: str = "weight") -> DataFrame:
    e = edges.select("src", "dst", F.col(weight).alias("weight"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def backbone(edges: DataFrame, k: int, weight: str = "weight") -> DataFrame:
    """Edges (src < dst) whose dst is among the k strongest of src; an edge that
    is strong for dst alone is not kept."""
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return both_ways(edges, weight).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).where("src < dst")


def strengths(edges: DataFrame, weight: str = "weight") -> DataFrame:
    return both_ways(edges, weight).groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("strength"), F.count(F.lit(1)).alias("degree"))


def support(obs: DataFrame, groups: DataFrame, item: str, node: str) -> DataFrame:
    """Per group: observations that touch at least two of its members."""
    j = obs.select(item, node).distinct().join(groups.toDF(node, "grp"), node)
    two = j.groupBy(item, "grp").agg(F.count(F.lit(1)).alias("members")).where("members >= 2")
    return two.groupBy("grp").agg(F.count(F.lit(1)).alias("support"))


def block_means(edges: DataFrame, groups: DataFrame, scale: float = 1.0, weight: str = "weight") -> DataFrame:
    """a <= b, mean weight over all pairs of the blocks, pairs without an edge
    included (inside a block: pairs of different nodes)."""
    g = groups.toDF("node", "grp")
    n = g.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    e = edges.join(g.toDF("src", "ga"), "src").join(g.toDF("dst", "gb"), "dst")
    total = e.groupBy(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.sum(weight).alias("total"))
    j = total.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    pairs = F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
    return j.select("a", "b", (F.col("total") / pairs * scale).alias("mean"))


def baseline(edges: DataFrame, nodes: DataFrame, scale: float = 1000.0, weight: str = "weight") -> DataFrame:
    """One row: the mean weight over all pairs of different nodes, those without
    an edge included; 0 for fewer than two nodes."""
    n = nodes.agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    total = edges.agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("total"))
    return n.crossJoin(F.broadcast(total)).select(F.when(pairs > 0, F.col("total") / pairs * scale).otherwise(0.0).alias("baseline"))  # one row each


def inout(means: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group: internal (its own cell of `block_means`) and outward (the mean
    of its cells with all other groups, 0 where there is no edge)."""
    all_groups = groups.select(F.col(groups.columns[1]).alias("grp")).distinct()
    n = all_groups.agg(F.count(F.lit(1)).alias("n"))
    own = means.where("a = b").select(F.col("a").alias("grp"), F.col("mean").alias("own"))
    out = means.where("a <> b").select(F.explode(F.array("a", "b")).alias("grp"), "mean").groupBy("grp").agg(F.sum("mean").alias("total"))
    j = all_groups.join(own, "grp", "left").join(out, "grp", "left").crossJoin(F.broadcast(n))  # one row
    outward = F.when(F.col("n") > 1, F.coalesce("total", F.lit(0.0)) / F.when(F.col("n") > 1, F.col("n") - 1)).otherwise(0.0)
    return j.select("grp", F.coalesce("own", F.lit(0.0)).alias("internal"), outward.alias("outward"))


def modularity(edges: DataFrame, groups: DataFrame, resolution: float = 1.0, weight: str = "weight") -> DataFrame:
    """One row: q, of weighted undirected edges."""
    g = groups.toDF("node", "grp")
    s = strengths(edges, weight).join(g, "node").groupBy("grp").agg(F.sum("strength").alias("d"))
    inside = edges.join(g.toDF("src", "ga"), "src").join(g.toDF("dst", "gb"), "dst").where("ga = gb").groupBy(F.col("ga").alias("grp")).agg(F.sum(weight).alias("i"))
    m = edges.agg(F.sum(weight).alias("m"))
    parts = s.join(inside, "grp", "left").crossJoin(F.broadcast(m))  # one row
    return parts.agg(F.sum(F.coalesce("i", F.lit(0.0)) / F.col("m") - resolution * (F.col("d") / (2 * F.col("m"))) ** 2).alias("q"))


def pagerank(edges: DataFrame, steps: int = 20, damping: float = 0.85, weight: str = "weight") -> DataFrame:
    """Weighted, undirected, a fixed number of steps; every 5th one is cut off
    by a checkpoint if a folder is set."""
    e = both_ways(edges, weight)
    out = e.groupBy("src").agg(F.sum("weight").alias("s"))
    e = e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("s")).alias("p")).repartition("src")
    nodes = out.select(F.col("src").alias("node"))
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / n if n else 0.0))
    for i in range(steps):
        got = e.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        rank = got.select("node", (F.lit((1 - damping) / n) + damping * F.col("got")).alias("rank"))
        if i % 5 == 4 and edges.sparkSession.sparkContext.getCheckpointDir():
            rank = rank.checkpoint()
    return rank


def label_propagation(edges: DataFrame, steps: int = 10, weight: str = "weight") -> DataFrame:
    """Synchronous: each node takes the label with most weight around it (its
    own counts as much as its strongest edge), ties to the least label."""
    e = both_ways(edges, weight)
    own = e.groupBy("src").agg(F.max("weight").alias("weight")).select("src", F.col("src").alias("dst"), "weight")
    e = e.unionByName(own)
    label = own.select(F.col("src").alias("node"), F.col("src").alias("label"))
    for _ in range(steps):
        votes = e.join(label.withColumnRenamed("node", "dst"), "dst").groupBy("src", "label").agg(F.sum("weight").alias("w"))
        label = votes.groupBy(F.col("src").alias("node")).agg(F.max_by(F.struct("label"), F.struct("w", (-F.col("label")).alias("o")))["label"].alias("label"))
    return label


def enrichment(edges: DataFrame, groups: DataFrame, weight: str = "weight") -> DataFrame:
    """a <= b: observed block weight over that of the configuration model with
    the same strengths (s_i s_j / sum), 0 where nothing is expected."""
    g = groups.toDF("node", "grp")
    s = strengths(edges, weight).join(g, "node").groupBy("grp").agg(F.sum("strength").alias("s"), F.sum(F.col("strength") ** 2).alias("q"))
    e = edges.join(g.toDF("src", "ga"), "src").join(g.toDF("dst", "gb"), "dst")
    seen = e.groupBy(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.sum(weight).alias("seen"))
    t = strengths(edges, weight).agg(F.sum("strength").alias("t"))
    x, y = s.toDF("a", "sa", "qa"), s.toDF("b", "sb", "qb").drop("qb")
    j = seen.join(x, "a").join(y, "b").crossJoin(F.broadcast(t))  # one row
    expected = F.when(F.col("a") == F.col("b"), (F.col("sa") ** 2 - F.col("qa")) / 2).otherwise(F.col("sa") * F.col("sb")) / F.col("t")
    return j.select("a", "b", F.when(expected > 0, F.col("seen") / expected).otherwise(0.0).alias("ratio"))
