"""References as rows (doc, pos, token), and duplicates of records.

Counts of a token are aggregated before they are joined to the tokens again, so
a token that most documents cite is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium.functions import text as T


def tokens_of(df: DataFrame, doc: str, refs: str) -> DataFrame:
    """doc, pos, token of a column of references joined by `; `."""
    return df.select(F.col(doc).alias("doc"), F.posexplode(T.split_references(F.col(refs))).alias("pos", "token"))


def joined(tokens: DataFrame, name: str) -> DataFrame:
    """doc and its tokens in order, joined by `; `."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "token")))
    return tokens.groupBy("doc").agg(F.array_join(F.transform(rows, lambda x: x["token"].cast("string")), "; ").alias(name))


def shared(tokens: DataFrame, least: int = 2) -> DataFrame:
    """Rows whose token occurs `least` times or more in all rows."""
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("token")
    return tokens.join(often, "token", "left_semi")


def key_of(token: Column) -> Column:
    """A reference's canonical key: work id, else DOI, else the token."""
    bare = T.normalise_doi(token)
    return F.coalesce(T.openalex_id(token), bare, T.embedded_doi(token), F.trim(token))


def resolve(tokens: DataFrame, corpus: DataFrame) -> DataFrame:
    """tokens with `target`, the id of the corpus's record that is meant, else
    null. corpus: id, key (work id or null), doi; an id wins over a DOI, and of
    records with one DOI the least id. A work id and a DOI never look alike, so
    one join on the canonical key finds either."""
    keys = corpus.select("id", F.explode(F.array_compact(F.array(T.openalex_id(F.col("key")), T.normalise_doi(F.col("doi"))))).alias("key"))
    keys = keys.groupBy("key").agg(F.min("id").alias("target"))
    return tokens.withColumn("key", key_of(F.col("token"))).join(keys, "key", "left").select("doc", "pos", "token", "target")


def first_of_keys(df: DataFrame, order: str, doi: Column, title: Column) -> DataFrame:
    """Rows that are the first with their DOI (rows without one are) and the
    first with their title (all rows without one have the same)."""
    out = df.withColumn("_d", doi).withColumn("_t", F.coalesce(title, F.lit("")))
    by_doi = out.where("_d IS NOT NULL").groupBy("_d").agg(F.min(order).alias("_first_d"))
    by_title = out.groupBy("_t").agg(F.min(order).alias("_first_t"))
    out = out.join(by_title, "_t").where(F.col(order) == F.col("_first_t")).join(by_doi, "_d", "left")
    return out.where(F.col("_d").isNull() | (F.col(order) == F.col("_first_d"))).select(*df.columns)


def aliases(df: DataFrame, norm: Column, key: Column) -> DataFrame:
    """norm, key: names that belong to one key only."""
    named = df.select(norm.alias("norm"), key.alias("key")).where("norm <> '' AND key IS NOT NULL")
    return named.groupBy("norm").agg(F.min("key").alias("key"), F.max("key").alias("_most")).where("key = _most").select("norm", "key")


def by_type(df: DataFrame, kind: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(kind), F.lit("UNKNOWN")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def profiles(df: DataFrame, group: str, year: str) -> DataFrame:
    """Rows, median year (its whole part) and range of each group."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.floor(F.median(year)).cast("int").alias("median_year"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))


def column_cosines(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """a, b, cosine of every two columns, all in one pass over the rows."""
    names = list(cols)
    wide = df.select(*[c.cast("double").alias(n) for n, c in cols.items()])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = wide.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs])
    dot = lambda a, b: F.col(f"`{a}*{b}`")
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(dot(a, a) * dot(b, b) > 0, dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))).alias("cosine")) for a, b in pairs if a != b]
    return sums.select(F.inline(F.array(*rows)))


def vector_cosines(df: DataFrame, vec: str) -> DataFrame:
    """a, b, cosine of every two places (t0, t1, ...) of a column of vectors; a
    task hands on one product of all places with all."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((0, 0))
        for batch in batches:
            rows = [r for r in batch.column(0).to_pylist() if r]
            if not rows:
                continue
            x = np.zeros((len(rows), max(map(len, rows))))
            for i, r in enumerate(rows):
                x[i, : len(r)] = [v or 0.0 for v in r]
            more = x.T @ x
            n = max(len(total), len(more))
            both = np.zeros((n, n))
            both[: len(total), : len(total)] += total
            both[: len(more), : len(more)] += more
            total = both
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j], pa.float64())], ["i", "j", "s"])

    dots = df.select(F.col(vec).cast("array<double>")).mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    own = dots.where("i = j")
    out = dots.where("i < j").join(own.select("i", F.col("s").alias("p")), "i").join(own.select("j", F.col("s").alias("q")), "j")
    name = lambda c: F.concat(F.lit("t"), F.col(c).cast("string"))
    return out.select(name("i").alias("a"), name("j").alias("b"), F.when(F.col("p") * F.col("q") > 0, F.col("s") / F.sqrt(F.col("p") * F.col("q"))).alias("cosine"))
