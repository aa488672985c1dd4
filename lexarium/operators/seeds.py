"""A pool of candidates grown from seed works over a table of citations.

works: id, doi, title, abstract, year, cited. edges: src cites dst. Each arm
gives ids of works once; caps are those of a retrieval, the most cited first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarium.functions import text as T


def normalise_seed(token: Column) -> Column:
    """A work's id, else `doi:` and the DOI; null for any other text."""
    return F.coalesce(T.openalex_id(F.trim(token)), F.concat(F.lit("doi:"), T.normalise_doi(F.trim(token))))


def fetch_seeds(works: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of the works that seeds (a column seed) name, and the seeds that name
    none, as given if they are neither ids nor DOIs."""
    tokens = seeds.select(F.col("seed"), normalise_seed(F.col("seed")).alias("key")).distinct()
    named = works.select("id", F.explode(F.array_compact(F.array(T.openalex_id(F.col("id")), F.concat(F.lit("doi:"), T.normalise_doi(F.col("doi")))))).alias("key"))
    found = tokens.join(named, "key").select("id").distinct()
    missing = tokens.join(named, "key", "left_anti").select(F.coalesce("key", "seed").alias("seed")).distinct()
    return found, missing


def _in_years(works: DataFrame, first: int | None, last: int | None) -> DataFrame:
    if first is not None:
        works = works.where(F.col("year") >= first)
    return works if last is None else works.where(F.col("year") <= last)


def forward(works: DataFrame, edges: DataFrame, seeds: DataFrame, first: int | None = None, last: int | None = None, most: int | None = 600) -> DataFrame:
    """Works that cite a seed: of each seed at most `most`, unless None. Spark
    cuts a seed's rows before they are shuffled, so no seed is gathered whole."""
    citing = edges.join(seeds.select(F.col("id").alias("dst")), "dst", "left_semi")
    citing = citing.select("dst", F.col("src").alias("id")).distinct().join(_in_years(works, first, last).select("id", "cited"), "id")
    if most is not None:
        best = Window.partitionBy("dst").orderBy(F.desc("cited"), "id")
        citing = citing.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= most)
    return citing.select("id").distinct()


def backward(works: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Works that a seed cites."""
    cited = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    return works.select("id").join(cited, "id", "left_semi").distinct()


def search(works: DataFrame, queries: list[str], first: int | None = None, last: int | None = None, most: int | None = 400) -> DataFrame:
    """Works whose title and abstract have all words of a query; words in double
    quotes have to follow each other. Words are compared as they are, not by stem."""
    body = F.concat(F.lit(" "), T.norm_words(F.concat_ws(" ", "title", "abstract")), F.lit(" "))
    base = _in_years(works, first, last).select("id", "cited", body.alias("_b"))

    def hit(query: str) -> Column:
        parts = query.replace(",", " ").split('"')
        terms = [w for i, p in enumerate(parts) for w in ([p] if i % 2 else p.split())]
        found = F.lit(bool(terms))
        for t in terms:
            found = found & F.contains(F.col("_b"), F.concat(F.lit(" "), T.norm_words(F.lit(t)), F.lit(" ")))
        return found

    which = F.array_compact(F.array(*[F.when(hit(q), F.lit(i)) for i, q in enumerate(queries)]))
    found = base.select("id", "cited", F.explode(which).alias("q"))
    if most is not None:
        best = Window.partitionBy("q").orderBy(F.desc("cited"), "id")
        found = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= most)
    return found.select("id").distinct()


def expand(works: DataFrame, edges: DataFrame, seeds: DataFrame, queries: list[str] = (), first: int | None = None, last: int | None = None, use_forward: bool = True, use_backward: bool = True, most: int | None = 600, most_query: int | None = 400) -> tuple[DataFrame, DataFrame]:
    """(id, is_seed, by_forward, by_backward, by_query), a row for each work of
    the pool, and the seeds that name no work. Seeds are in it whatever their year."""
    found, missing = fetch_seeds(works, seeds)
    arms = {"is_seed": found}
    if use_forward:
        arms["by_forward"] = forward(works, edges, found, first, last, most)
    if use_backward:
        arms["by_backward"] = backward(works, edges, found)
    if queries:
        arms["by_query"] = search(works, list(queries), first, last, most_query)
    every = None
    for name, arm in arms.items():
        rows = arm.select("id", F.lit(name).alias("arm"))
        every = rows if every is None else every.unionByName(rows)
    flags = [F.max(F.col("arm") == n).alias(n) for n in ("is_seed", "by_forward", "by_backward", "by_query")]
    return every.groupBy("id").agg(*flags), missing


def counts(pool: DataFrame) -> DataFrame:
    """Works of each arm and of the pool."""
    return pool.agg(*[F.count_if(c).alias(c) for c in ("is_seed", "by_forward", "by_backward", "by_query")], F.count(F.lit(1)).alias("pool"))
