"""Merging, deduplication, extraction, reference keys."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarium.functions import text as T


def keep_first(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """One row a key, the first in this order; rows with a null key all stay."""
    k = df.withColumn("__key", key)
    first = Window.partitionBy("__key").orderBy(*order)
    some = k.where(F.col("__key").isNotNull()).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return some.unionByName(k.where(F.col("__key").isNull())).drop("__key")


def merge_exact(main: DataFrame, other: DataFrame, id_col: str, keys: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows of main and those of other that match none of it, and the aliases
    (dropped, kept). Keys are tried in order; '' and null match nothing, and
    the first row of each side stands for its key."""
    left, gone = other, None
    for key in keys:
        side = lambda d, name: d.select(F.col(id_col).alias(name), key.alias("k")).where("k is not null and k <> ''").groupBy("k").agg(F.min(name).alias(name))  # noqa: B023, E731
        found = side(left, "dropped").join(side(main, "kept"), "k").select("dropped", "kept")
        gone = found if gone is None else gone.unionByName(found)
        left = left.join(found.select(F.col("dropped").alias(id_col)), id_col, "left_anti")
    return main.unionByName(left, allowMissingColumns=True), gone


def extract(df: DataFrame, year: str, least_year: int, cited: str, least_cited: float, type_col: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows of the years, citations and types asked for, once each; null years
    and citations never pass, and exclusion wins."""
    out = df.where((F.col(year) >= least_year) & (F.col(cited) >= least_cited))
    if include is not None:
        out = out.where(F.col(type_col).isin(include) if include else F.lit(False))
    if exclude:
        out = out.where(~F.col(type_col).isin(exclude))
    return out.distinct()


def sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Exactly n rows (all, if fewer), by a seeded hash of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def complete(df: DataFrame, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """Fills null values from a lookup with one row a key."""
    one = lookup.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias("__v"))
    return df.join(one, key, "left").withColumn(value, F.coalesce(value, "__v")).drop("__v")


def shortlist(left: DataFrame, right: DataFrame, id_col: str, text: Column, n: int = 3, most: int = 20, parts: int = 16) -> DataFrame:
    """a, b, overlap: for each row of left the rows of right with most n-grams
    of words in common, ties to the least id. Rows of right that hold the same of
    left's n-grams are one group, which is counted once and hands on its first
    ids; each n-gram's rows are dealt to `parts` parts."""

    def grams(d: DataFrame, name: str) -> DataFrame:
        d = d.select(F.col(id_col).alias(name), F.filter(F.split(text, " "), lambda x: x != "").alias("w"))
        w = F.col("w")
        some = F.when(F.size(w) < n, w).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " ")))
        return d.select(name, F.explode(F.array_distinct(F.when(F.size(w) > 0, some))).alias("g"))

    part = lambda name: F.pmod(F.xxhash64(name), F.lit(parts)).cast("int").alias("part")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    a = grams(left, "a")
    known = grams(right, "b").select("*", part("b")).join(a.select("g").distinct().select("g", every), ["g", "part"], "left_semi")
    sets = known.groupBy("b").agg(F.sort_array(F.collect_list("g")).alias("gs"))  # a row's own n-grams
    sets = sets.withColumn("set", F.md5(F.to_json(F.struct("gs")).cast("binary")))
    first = Window.partitionBy("set").orderBy("b")
    members = sets.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most)
    groups = members.where("nth = 1").select("set", F.col("b").alias("low"), F.explode("gs").alias("g")).select("*", part("set"))
    pairs = a.select("a", "g", every).join(groups, ["g", "part"]).groupBy("a", "set", "low").agg(F.count(F.lit(1)).alias("overlap"))
    # a group after `most` others has none of the first rows
    best = Window.partitionBy("a").orderBy(F.desc("overlap"), "low")
    pairs = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).drop("rank", "low")
    order = Window.partitionBy("a").orderBy(F.desc("overlap"), "b")
    pairs = pairs.join(members.select("set", "b"), "set").select("a", "b", "overlap")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def indel_ratio(a: str, b: str) -> float:
    """100 x (1 - insertions and deletions / characters of both): 200 x the
    longest common subsequence over both lengths, counted in the bits of one
    integer. Two empty texts are equal."""
    if not a and not b:
        return 100.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        u = row & at.get(c, 0)
        row = (row + u | row - u) & every
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def fuzzy_matches(left: DataFrame, right: DataFrame, id_col: str, text: Column, threshold: float = 90.0, n: int = 3, most: int = 20) -> DataFrame:
    """a, b, score: for each row of left the best of its `most` candidates in
    right that share word n-grams, if its ratio reaches the threshold; ties to
    more n-grams in common, then to the least id. Null and empty texts match
    nothing."""
    side = lambda d, name: d.select(F.col(id_col).alias(name), text.alias(f"text_{name}")).where(F.col(f"text_{name}") != "")
    pairs = shortlist(left, right, id_col, text, n, most).select("a", "b", "overlap")
    pairs = pairs.join(side(left, "a"), "a").join(side(right, "b"), "b").select("a", "b", "overlap", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            score = [indel_ratio(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score, pa.float64())], ["a", "b", "overlap", "score"])

    kind = dict(pairs.dtypes)
    scored = pairs.mapInArrow(run, f"a {kind['a']}, b {kind['b']}, overlap bigint, score double").where(F.col("score") >= threshold)
    best = F.struct((-F.col("score")).alias("s"), (-F.col("overlap")).alias("o"), F.col("b"))
    return scored.groupBy("a").agg(F.min(best).alias("m")).select("a", "m.b", (-F.col("m.s")).alias("score"))


def merge_all(sources: list[DataFrame], id_col: str, keys: list[Column], fuzzy: Column | None = None, threshold: float = 90.0) -> tuple[DataFrame, DataFrame]:
    """Sources in order of priority, folded: of rows that match by a key, or by
    a fuzzy text after that, those of the earlier source stay. Also the aliases
    (dropped, kept) of all steps."""
    main, gone = sources[0], None
    for other in sources[1:]:
        before = main
        main, found = merge_exact(before, other, id_col, keys)
        if fuzzy is not None:
            rest = other.join(found.select(F.col("dropped").alias(id_col)), id_col, "left_anti")
            near = fuzzy_matches(rest, before, id_col, fuzzy, threshold).select(F.col("a").alias("dropped"), F.col("b").alias("kept"))
            main = before.unionByName(rest.join(near.select(F.col("dropped").alias(id_col)), id_col, "left_anti"), allowMissingColumns=True)
            found = found.unionByName(near)
        gone = found if gone is None else gone.unionByName(found)
    return main, gone


def strata(df: DataFrame, size: str, key: str, n: int) -> DataFrame:
    """df with `stratum`: n classes of equal count by (size, key). Only the rows
    of the at most n - 1 sizes that a border falls into are ranked; all others
    follow from the counts of each size, of which there are few."""
    count = df.groupBy(size).agg(F.count(F.lit(1)).alias("_m"))
    up_to = Window.orderBy(size).rowsBetween(Window.unboundedPreceding, -1)  # one row a size
    count = count.withColumn("_from", F.coalesce(F.sum("_m").over(up_to), F.lit(0)))
    total = count.agg(F.sum("_m").alias("_n"))
    count = count.crossJoin(F.broadcast(total))  # one row
    each, more = F.floor(F.col("_n") / n), F.col("_n") % n

    def of(rank: Column) -> Column:
        wide = more * (each + 1)
        return F.when(rank < wide, F.floor(rank / (each + 1)) + 1).otherwise(more + F.floor((rank - wide) / F.greatest(each, F.lit(1))) + 1).cast("int")

    count = count.select(F.col(size).alias("_size"), "_from", "_n", of(F.col("_from")).alias("_low"), of(F.col("_from") + F.col("_m") - 1).alias("_high"))
    j = df.join(count, F.col(size).eqNullSafe(F.col("_size")))
    plain = j.where("_low = _high").withColumn("stratum", F.col("_low"))
    nth = F.row_number().over(Window.partitionBy("_size").orderBy(key)) - 1
    split = j.where("_low < _high").withColumn("_nth", nth).withColumn("stratum", of(F.col("_from") + F.col("_nth"))).drop("_nth")
    return plain.unionByName(split).select(*df.columns, "stratum")


def clean_and_drop(df: DataFrame, abstract: str = "abstract", doi: str = "doi", least: int = 2, garbage: tuple[str, ...] = (), most: int | None = None, drop: bool = True) -> DataFrame:
    """Clean DOIs; implausible abstracts become null, others have at most `most`
    characters; rows without an abstract go if `drop`. Row by row, no shuffle."""
    kept = F.when(T.plausible_abstract(F.col(abstract), least, garbage), F.col(abstract))
    out = df.withColumn(doi, T.clean_doi(F.col(doi))).withColumn(abstract, T.truncate(kept, most) if most else kept)
    return out.where(F.col(abstract).isNotNull()) if drop else out
