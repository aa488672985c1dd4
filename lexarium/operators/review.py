"""Votes of reviewers over rounds, and what a review costs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(votes: Column) -> Column:
    return F.filter(votes, lambda v: v.isNotNull())


def escalates(votes: Column, rule: str = "majority") -> Column:
    """Whether the next round sees the row. mean: the mean is 3. majority: as
    many votes above 3 as below, or at least half are 3; no vote is a tie."""
    v = present(votes)
    count = lambda f: F.size(F.filter(v, f))
    if rule == "mean":
        return F.coalesce(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) == 3.0 * F.size(v), F.lit(False)) & (F.size(v) > 0)
    return (count(lambda x: x > 3) == count(lambda x: x < 3)) | (2 * count(lambda x: x == 3) >= F.size(v))


def final_score(votes: Column, rule: str = "majority") -> Column:
    """mean, or the median with 3 settled by the last vote (null if the last
    reviewer saw nothing)."""
    v = F.array_sort(present(votes))
    n = F.size(v)
    if rule == "mean":
        return F.when(n > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2).cast("int") + 1
    median = F.when(n > 0, (F.try_element_at(v, low) + F.try_element_at(v, high)) / 2.0)
    return F.when(median == 3, F.element_at(votes, -1).cast("double")).otherwise(median)


def included(votes: Column, rule: str = "majority") -> Column:
    return F.coalesce(final_score(votes, rule) > 3, F.lit(False))


def estimate(n_docs: int, rounds: list[int], escalation: float, items_per_call: int, fixed: int, per_doc: float, out_tokens: float, price_in: float, price_out: float, batch: bool = False) -> list[dict]:
    """Tokens and cost of each round (reviewers in it), half price in batch."""
    out = []
    for r, reviewers in enumerate(rounds):
        docs = n_docs * escalation**r
        calls = math.ceil(docs / items_per_call)
        tin, tout = reviewers * (calls * fixed + docs * per_doc), reviewers * docs * out_tokens
        out.append({"round": r + 1, "docs": docs, "calls": calls * reviewers, "tokens_in": tin, "tokens_out": tout, "cost": (tin * price_in + tout * price_out) / 1e6 * (0.5 if batch else 1.0)})
    return out
