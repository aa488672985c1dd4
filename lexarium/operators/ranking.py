"""Percentiles, composite scores, top-k lists and reading budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_percentile(value: Column, by: list[Column]) -> Column:
    """(average rank - 1) / (n - 1) within groups; 1 for a group of one."""
    order, ties = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rank = F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
    return F.when(n == 1, F.lit(1.0)).otherwise((rank - 1) / (n - 1))


def aggregate_axes(axes: list[Column], how: str = "mean", weights: list[float] | None = None) -> Column:
    """Mean, geometric mean (above 1e-9), or the least axis with a twentieth of
    the mean (which heeds no weights)."""
    w = weights or [1.0] * len(axes)
    total = sum(w)
    if how == "mean":
        return sum((a * (x / total) for a, x in zip(axes, w)), F.lit(0.0))
    if how == "gmean":
        return F.exp(sum((F.ln(F.greatest(a, F.lit(1e-9))) * (x / total) for a, x in zip(axes, w)), F.lit(0.0)))
    if how == "chebyshev":
        return F.least(*axes) + 0.05 * sum(axes, F.lit(0.0)) / len(axes)
    raise ValueError(how)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def allocate_budget(pools: list[int], budget: int, floor: int = 0, rule: str = "sqrt", ceiling: int | None = None) -> list[int]:
    """Quotas of topics (a handful, on the driver): shares by the square root (or
    size) of each pool. Shares above a pool or the ceiling are settled there
    first, then those below the floor (or the pool, if less), and the rest is
    dealt anew, whole seats by largest fractions. Floors may exceed the budget."""
    most = [min(p, ceiling) if ceiling else p for p in pools]
    least = [min(floor, m) for m in most]
    weight = [p**0.5 if rule == "sqrt" else float(p) for p in pools]
    out: dict[int, int] = {}
    while live := [i for i in range(len(pools)) if i not in out]:
        left, total = min(budget, sum(most)) - sum(out.values()), sum(weight[i] for i in live)
        if left <= 0 or total <= 0:
            out |= {i: least[i] for i in live}
            break
        share = {i: left * weight[i] / total for i in live}
        bound = {i: most[i] for i in live if share[i] > most[i]} or {i: least[i] for i in live if share[i] < least[i]}
        if not bound:
            bound = {i: int(share[i]) for i in live}
            for i in sorted(live, key=lambda i: bound[i] - share[i])[: left - sum(bound.values())]:
                bound[i] += 1
        out |= bound
    return [out[i] for i in range(len(pools))]


def review_relevance(cited: Column, year: Column, now: int | Column, by: list[Column], how: str = "blend") -> Column:
    """Percentile of citations a year (the current one counts; "cpy"), or its mean
    with the percentile of citations."""
    raw = F.coalesce(cited.cast("double"), F.lit(0.0))
    a_year = average_percentile(raw / F.greatest(F.lit(now) - F.coalesce(year, F.lit(now)) + 1, F.lit(1)), by)
    return a_year if how == "cpy" else (a_year + average_percentile(raw, by)) / 2


def pick_reviews(df: DataFrame, topic: str, now: int, recent: int = 2, most_recent: int = 3, most: int = 3, how: str = "blend") -> DataFrame:
    """Adds `cohort` and `place`, of id, year, cited: the newest reviews of each
    topic (year above now - recent, newest and most cited first), and of the others
    the most relevant. Ties go to the least id."""
    new = F.coalesce(F.col("year") > now - recent, F.lit(False))
    out = df.withColumn("cohort", F.when(new, "recent").otherwise("ranked"))
    by = [F.col(topic), F.col("cohort")]
    out = out.withColumn("_rel", F.when(F.col("cohort") == "ranked", review_relevance(F.col("cited"), F.col("year"), now, by, how)))
    order = [F.desc_nulls_last("_rel"), F.desc(F.when(F.col("cohort") == "recent", F.col("year"))), F.desc(F.when(F.col("cohort") == "recent", F.col("cited"))), F.col("id")]
    out = out.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.where(F.col("place") <= F.when(F.col("cohort") == "recent", most_recent).otherwise(most)).drop("_rel")


def distance_to_ideal(df: DataFrame, metrics: dict[str, bool], how: str = "euclidean") -> DataFrame:
    """Adds `distance`: metrics scaled to 0..1 over the table (True: more is
    better; a constant one is ideal), then the distance from all ones."""
    one = df.agg(*[f(c).alias(f"{n}_{c}") for c in metrics for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(one))  # one row
    gaps = []
    for c, up in metrics.items():
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        s = F.when(hi == lo, 1.0).otherwise((F.col(c) - lo) / F.when(hi != lo, hi - lo))
        gaps.append(F.when(hi == lo, 0.0).otherwise(1 - s if up else s))
    d = F.sqrt(sum((g * g for g in gaps), F.lit(0.0))) if how == "euclidean" else F.greatest(*gaps)
    return out.withColumn("distance", d).select(*df.columns, "distance")
