"""Grids of parameters for sweeps over topic models, and what came of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolution_grid(low: float, high: float, step: float = 0.1) -> list[float]:
    """Values from low to high, both included; only low if the step leads nowhere."""
    if step <= 0 or high < low:
        return [float(low)]
    return [round(low + i * step, 6) for i in range(round((high - low) / step) + 1)]


def size_grid(n: float, band: tuple[int, int], steps: int = 8) -> tuple[int, int, int]:
    """Least and greatest topic size, and the step, for a number of topics in
    `band`: n over the number, never below 2."""
    few, many = band
    low = max(2, round(n / many))
    high = max(low, round(n / few))
    return low, high, max(1, round((high - low) / max(1, steps - 1)))


def setting(c: Column, place: int) -> Column:
    """The whole number at a place (from 0) of a setting `size_samples`."""
    return F.try_element_at(F.split(c, "_"), F.lit(place + 1)).try_cast("int")


def aim_again(results: DataFrame, band: tuple[int, int], steps: int = 8) -> list[int] | None:
    """Topic sizes to try next, from sizes times the most topics each has given;
    their median stands for n. None if nothing gave a topic."""
    best = results.where("nb_topics > 0").groupBy(setting(F.col("hdbscan"), 0).alias("size")).agg(F.max("nb_topics").alias("most"))
    k = best.agg(F.median(F.col("size") * F.col("most"))).first()[0]  # one value
    if not k:
        return None
    low, high, step = size_grid(k, band, steps)
    return list(range(low, high + 1, step))


def has_in_band(results: DataFrame, band: tuple[int, int] | None) -> bool:
    return band is None or not results.where(F.col("nb_topics").between(*band)).isEmpty()


def in_band(results: DataFrame, band: tuple[int, int] | None) -> DataFrame:
    """Models with a number of topics in the band; all, if none has."""
    return results if band is None or not has_in_band(results, band) else results.where(F.col("nb_topics").between(*band))


def unused_samples(best: DataFrame, fitted: DataFrame) -> DataFrame:
    """used, swept: the greatest min_samples of the best models and of all, if of
    three values or more none in the top third was used; else no row."""
    of = lambda d: d.select(setting(F.col("hdbscan"), 1).alias("s"))
    a = of(best).agg(F.max("s").alias("used"))
    b = of(fitted).agg(F.max("s").alias("swept"), F.min("s").alias("low"), F.count_distinct("s").alias("n"))
    return a.crossJoin(b).where("n >= 3 AND used < swept - (swept - low) / 3").select("used", "swept")  # one row each


def tick_step(first: int, last: int) -> int:
    """Years between ticks: 1, 2, 5 or 10, for at most 20 spaces."""
    return next((s for s in (1, 2, 5) if (last - first) / s <= 20), 10)
