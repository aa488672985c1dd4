"""Series over years, dense and without gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_counts(df: DataFrame, year: str, topic: str, weight: str | None = None) -> DataFrame:
    """year, topic, n for every year of the span and every topic. The grid has
    years x topics cells, whatever the table's size."""
    n = df.where(F.col(year).isNotNull() & F.col(topic).isNotNull()).groupBy(F.col(year).alias("year"), F.col(topic).alias("topic")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    span = n.agg(F.min("year").alias("a"), F.max("year").alias("b"))
    grid = n.select("topic").distinct().join(F.broadcast(span.select(F.explode(F.sequence("a", "b")).alias("year"))))  # the years
    zero = F.lit(0.0) if weight else F.lit(0).cast("bigint")
    return grid.join(n, ["year", "topic"], "left").select("year", "topic", F.coalesce("n", zero).alias("n"))


def trajectory(dense: DataFrame, window: int = 3) -> DataFrame:
    """Adds the centred rolling mean (window // 2 years before, the rest after),
    the share of the year in percent, and the running total."""
    own = Window.partitionBy("topic").orderBy("year")
    around = own.rowsBetween(-(window // 2), (window - 1) // 2)
    of_year = F.sum("n").over(Window.partitionBy("year"))
    return (
        dense.withColumn("rolling", F.avg("n").over(around))
        .withColumn("share", F.when(of_year > 0, 100.0 * F.col("n") / of_year).otherwise(0.0))
        .withColumn("cumulative", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    )


def median_year(dense: DataFrame) -> DataFrame:
    """Low weighted median: the first year whose running total is half of all."""
    own = Window.partitionBy("topic")
    run = F.sum("n").over(own.orderBy("year").rowsBetween(Window.unboundedPreceding, 0))
    d = dense.withColumn("run", run).withColumn("total", F.sum("n").over(own))
    return d.where("total > 0 and run >= total / 2.0").groupBy("topic").agg(F.min("year").alias("median_year"))


def median_per_year(dense: DataFrame) -> DataFrame:
    """Median of a topic's yearly counts, from its first active year on."""
    first = F.min(F.when(F.col("n") > 0, F.col("year"))).over(Window.partitionBy("topic"))
    return dense.withColumn("first", first).where("year >= first").groupBy("topic").agg(F.percentile("n", 0.5).alias("median_per_year"))
