"""Tokens and prices of a review by language models, as rows of rounds and reviewers.

reviewers: round (from 0), reviewer, model_id, items_per_call, fixed_tokens (of
a call), output_per_item, max_tokens (null: none). prices: model, input, output,
in money a million tokens. Both are short; articles are read once, for two sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium.functions import text as T

ENVELOPE = 8  # tokens of a call's JSON around its items
BATCH = 0.5  # what a batch costs of the price


def model_name(c: Column) -> Column:
    """Lower case, without a provider before the last slash."""
    return F.element_at(F.split(F.lower(F.trim(c)), "/"), -1)


def with_prices(df: DataFrame, prices: DataFrame, model: str = "model_id") -> DataFrame:
    """df with price_in and price_out: of the model's name, else of the name
    without a date of eight digits at its end; null if neither is known."""
    own, bare = model_name(F.col(model)), F.regexp_replace(model_name(F.col(model)), r"-\d{8}$", "")
    p = lambda n: prices.select(F.col("model").alias(f"_{n}"), F.col("input").alias(f"_{n}i"), F.col("output").alias(f"_{n}o"))
    out = df.join(p("a"), own == F.col("_a"), "left").join(p("b"), bare == F.col("_b"), "left")
    return out.select(*df.columns, F.coalesce("_ai", "_bi").alias("price_in"), F.coalesce("_ao", "_bo").alias("price_out"))


def _cost(tokens_in: Column, tokens_out: Column) -> Column:
    return (tokens_in * F.col("price_in") + tokens_out * F.col("price_out")) / 1e6


def estimate(articles: DataFrame, tokens: Column, reviewers: DataFrame, prices: DataFrame, escalation: float = 0.1) -> DataFrame:
    """A row for each reviewer: round r sees escalation**r of all articles, at
    their mean length. Output beyond max_tokens a call's item is cut (capped)."""
    total = articles.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(tokens.cast("double")), F.lit(0.0)).alias("_t"))
    g = reviewers.crossJoin(F.broadcast(total))  # one row
    g = g.withColumn("items", F.bround(F.col("_n") * F.pow(F.lit(escalation), F.col("round"))).cast("bigint")).where("items > 0")
    g = g.withColumn("_k", F.greatest(F.col("items_per_call"), F.lit(1))).withColumn("calls", F.ceil(F.col("items") / F.col("_k")))
    out = F.col("output_per_item") * F.col("items") + ENVELOPE * F.col("calls")
    cap = F.when(F.col("max_tokens") > 0, F.col("max_tokens") * F.col("_k") * F.col("calls"))
    g = g.withColumn("tokens_in", F.bround(F.col("calls") * F.col("fixed_tokens") + F.col("_t") * F.col("items") / F.col("_n")).cast("bigint"))
    g = g.withColumn("capped", F.coalesce(out > cap, F.lit(False))).withColumn("tokens_out", F.least(out, cap).cast("bigint"))
    g = with_prices(g, prices).withColumn("cost", _cost(F.col("tokens_in"), F.col("tokens_out")))
    return g.withColumn("cost_batch", F.col("cost") * BATCH).drop("_n", "_t", "_k")


def sweep(groups: DataFrame, values: tuple[int, ...] = (1, 5, 10, 25, 50)) -> DataFrame:
    """items_per_call, calls, tokens_in, cost, change (in percent of the cost as
    it is): only the calls' fixed tokens depend on how many items a call holds."""
    g = groups.withColumn("_v", F.explode(F.array(*map(F.lit, values))))
    calls = F.ceil(F.col("items") / F.col("_v"))
    tokens = F.col("tokens_in") + (calls - F.col("calls")) * F.col("fixed_tokens")
    g = g.select("_v", calls.alias("calls"), tokens.alias("tokens_in"), _cost(tokens, F.col("tokens_out")).alias("cost"), F.col("cost").alias("now"))
    g = g.groupBy(F.col("_v").alias("items_per_call")).agg(F.sum("calls").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("cost").alias("cost"), F.sum("now").alias("now"))
    return g.select("items_per_call", "calls", "tokens_in", "cost", F.when(F.col("now") > 0, 100 * (F.col("cost") - F.col("now")) / F.col("now")).alias("change"))


def calibrate(reviewed: DataFrame, columns: dict[tuple[str, str], str]) -> DataFrame:
    """round, reviewer, output_per_item (mean tokens of the reasonings, and six of
    JSON), coverage (share of rows with one), from columns {(round, reviewer): name}."""
    rows = F.array(*[F.struct(F.lit(r).alias("round"), F.lit(w).alias("reviewer"), F.col(c).cast("string").alias("said")) for (r, w), c in columns.items()])
    long = reviewed.select(F.inline(rows))
    said = F.col("said") != ""
    g = long.groupBy("round", "reviewer").agg(F.avg(F.when(said, T.heuristic_tokens(F.col("said")))).alias("m"), F.avg(F.coalesce(said, F.lit(False)).cast("int")).alias("coverage"))
    return g.where("m IS NOT NULL").select("round", "reviewer", F.bround(F.col("m") + 6).cast("bigint").alias("output_per_item"), "coverage")


def escalation(calibrated: DataFrame) -> DataFrame:
    """The second round's coverage over the first's; 0 where there is none."""
    c = F.array_sort(F.collect_list(F.struct("round", "coverage")))
    per = calibrated.groupBy("round").agg(F.max("coverage").alias("coverage")).agg(c.alias("c"))
    one, two = F.try_element_at("c", F.lit(1))["coverage"], F.try_element_at("c", F.lit(2))["coverage"]
    return per.select(F.coalesce(F.when(one > 0, F.round(two / one, 4)), F.lit(0.0)).alias("escalation"))
