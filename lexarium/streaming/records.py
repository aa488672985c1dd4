"""Streams of records: late copies are dropped, windows counted. State is
bounded by the watermark; where a checkpoint lies is the writer's choice. The
event time becomes a timestamp with time zone, as a watermark needs one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, at: str, late: str) -> DataFrame:
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def first_seen(df: DataFrame, at: str, key: Column, late: str = "1 hour") -> DataFrame:
    """Rows whose key didn't come within `late` before; rows without one stay
    only once among themselves."""
    return _timed(df.withColumn("_key", key), at, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def window_counts(df: DataFrame, at: str, by: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, the columns `by`, n: rows of each window of event time."""
    counted = _timed(df, at, late).groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), *by, "n")


def drain(df: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that has come to Parquet, each row once even if run again."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
