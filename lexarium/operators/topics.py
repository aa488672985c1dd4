"""Topic tables: sizes, entropy, terms, similarity, coherence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entropy(df: DataFrame, topic: str) -> DataFrame:
    """One row: -sum p ln p over topic sizes; topic -1 (the tail) is left out."""
    n = df.where(F.col(topic).isNotNull() & (F.col(topic).cast("string") != "-1")).groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    t = n.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return n.crossJoin(F.broadcast(t)).agg(F.sum(-p * F.ln(p)).alias("entropy"))  # one row


def heaviest(tokens: DataFrame, doc: str, term: str, min_df: int = 1, max_share: float = 1.0) -> DataFrame:
    """doc, top, terms: the largest weight of `tfidf` and the number of terms,
    with one aggregation over the weights; counts are shuffled once."""
    tf = tokens.groupBy(doc, term).agg(F.count(F.lit(1)).alias("tf"))
    n = tf.select(doc).distinct().agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy(term).agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))  # one row
    df = df.where((F.col("df") >= min_df) & (F.col("df") <= max_share * F.col("n")))
    w = tf.join(df, term).select(doc, (F.col("tf") * (F.ln((1.0 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    out = w.groupBy(doc).agg(F.max("w").alias("m"), F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"), F.count(F.lit(1)).alias("terms"))
    return out.select(doc, (F.col("m") / F.col("norm")).alias("top"), "terms")


def tfidf(tokens: DataFrame, doc: str, term: str, n_docs: int, min_df: int = 1, max_share: float = 1.0) -> DataFrame:
    """doc, term, weight: count x (ln((1+n)/(1+df)) + 1), of unit length."""
    tf = tokens.groupBy(doc, term).agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(term).agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_share * n_docs))
    w = tf.join(df, term).withColumn("w", F.col("tf") * (F.ln((1.0 + n_docs) / (1 + F.col("df"))) + 1))
    norm = w.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    return w.join(norm, doc).select(doc, term, (F.col("w") / F.col("norm")).alias("weight"))


def class_tfidf(tokens: DataFrame, topic: str, term: str) -> DataFrame:
    """topic, term, weight: share in the topic x ln(1 + mean topic size / count)."""
    n = tokens.groupBy(topic, term).agg(F.count(F.lit(1)).alias("n"))
    size = n.groupBy(topic).agg(F.sum("n").alias("size"))
    all_ = n.groupBy(term).agg(F.sum("n").alias("total"))
    mean = size.agg(F.avg("size").alias("mean"))
    j = n.join(F.broadcast(size), topic).join(all_, term).crossJoin(F.broadcast(mean))  # topics; one row
    return j.select(topic, term, (F.col("n") / F.col("size") * F.ln(1 + F.col("mean") / F.col("total"))).alias("weight"))


def centroid_cosine(df: DataFrame, topic: str, vec: str) -> DataFrame:
    """Adds `cosine` to the mean vector of the row's topic."""
    parts = df.select(topic, F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x")).groupBy(topic, "i").agg(F.avg("x").alias("c"))
    mean = parts.groupBy(topic).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("mean"))  # one entry a dimension
    v = F.col(vec).cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return df.join(F.broadcast(mean), topic).withColumn("cosine", dot(v, F.col("mean")) / F.sqrt(dot(v, v) * dot(F.col("mean"), F.col("mean")))).drop("mean")
