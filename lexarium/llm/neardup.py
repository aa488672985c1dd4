"""Near-duplicates by DartMinHash.

A document is the multiset of its shingles of five words (digits, letters and
characters outside ASCII, A-Z in lower case); a text of one to four words is
one shingle. A shingle's weight is its count, and similarity is the weighted
Jaccard measure: shared over all occurrences.

Sketch: darts fall on the plane over each weighted element at rate 1, the same
darts for all documents. An element of weight w owns the unit regions 0..w-1; a
region's darts come in the order of their rank by exponential gaps that a hash
gives. A document keeps the darts below a rank chosen so that about
k (ln k + 1) of them fall into its regions, whatever its weight; each dart has
one of k coordinates, and the earliest of each coordinate stays (a document
with an empty coordinate is drawn anew with twice the rank). Two documents
agree in a coordinate with the probability of their similarity. ROWS
coordinates make a band, and bands are joined.

Texts of equal shingles are one class at once. In each bucket of a band every
class is paired with two leaders only, the first in an order of all classes and
the first in the bucket's own order, so pairs grow with the buckets' rows, not
with their square. Pairs are compared over all their shingles (as 32-bit hashes)
and classes linked at SIMILARITY or more are joined into components. Buckets
whose members still lie in several components are then compared whole: all
pairs of different components that their sizes allow. Buckets of up to FEW
members are joined with themselves. The members of a larger one are dealt to
levels of size, wide enough that two classes at SIMILARITY are in one level or
in neighbouring ones, and by hash to blocks of about BLOCK; each two blocks are
one task's matrix product of shared regions, so no pair becomes a row.

Null and empty texts, and texts without words, are near nothing but themselves:
each such row is its own class. Equal (doc_id, text) rows share a class. Rows
with a null doc_id are classed like others, under the least id of their class
(null if none has one). Where ids repeat, two classes may have one least id:
class_key tells them apart (null for texts without words). Ties in leaders'
order go to the smaller hash. Long texts are compared whole; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm._shared import SMALL, estimated_bytes, lean, settle, ship, small, spare, table
from lexarium.llm._words import ALNUM, LOWER, buffers, chunks, find_words, hash_ranges, mix, window_at, windows

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
FEW, BLOCK = 8, 256  # members of a bucket that is joined with itself, and of a block of a larger one
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def cells(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Unit regions of a run of texts, sorted by text and hash: text, hash. The
    c-th occurrence of a shingle is a region of its own."""
    n = len(offs) - 1
    starts, ends, doc = find_words(data, offs, ALNUM)
    h = hash_ranges(data, starts, ends, LOWER)
    at, g = windows(h, doc, k)
    count = np.bincount(doc, minlength=n)
    short = np.flatnonzero((count > 0) & (count < k))
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    of = np.concatenate([doc[at], short])
    g = np.concatenate([g, window_at(h, first[short], count[short])])
    order = np.lexsort((g, of))
    of, g = of[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    start = np.flatnonzero(new)
    nth = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    g = np.where(nth > 0, mix(g + nth.astype(np.uint64) * _GOLD), g)
    order = np.lexsort((g, of))
    return of[order], g[order]


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_min_hash(of: np.ndarray, g: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k hashes of the earliest darts; rows of texts without words are 0."""
    out = np.zeros((n, k), np.uint64)
    weight = np.bincount(of, minlength=n)
    todo, factor = weight > 0, 1.0
    while todo.any():
        limit = np.where(todo, factor * k * (np.log(k) + 1) / np.maximum(weight, 1), 0.0)
        use = todo[of]
        doc, dart = of[use], mix(g[use] ^ _GOLD)
        rank = -np.log(_uniform(dart))
        docs, darts, ranks = [], [], []
        while len(doc):
            low = rank <= limit[doc]
            doc, dart, rank = doc[low], dart[low], rank[low]
            docs.append(doc)
            darts.append(dart)
            ranks.append(rank)
            dart = mix(dart + _GOLD)
            rank = rank - np.log(_uniform(dart))
        doc, dart, rank = np.concatenate(docs), mix(np.concatenate(darts) ^ np.uint64(0xD1B54A32D192ED03)), np.concatenate(ranks)
        place = doc * k + (dart >> np.uint64(33)).astype(np.int64) % k
        best = np.full(n * k, np.inf)
        np.minimum.at(best, place, rank)
        first = rank == best[place]
        held = np.zeros(n * k, np.uint64)
        held[place[first]] = dart[first]
        full = (best < np.inf).reshape(n, k).all(1) & todo
        out[full] = held.reshape(n, k)[full]
        todo &= ~full
        factor *= 2
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands keys of buckets, other ones for each band."""
    out = np.repeat((np.arange(1, bands + 1, dtype=np.uint64) * _GOLD)[None, :], len(sketch), 0)
    for r in range(rows):
        out = mix(out ^ sketch[:, r : bands * rows : rows])
    return out


def _signatures(docs: DataFrame, bands: int, rows: int, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offs = buffers(batch.column(1))
            for a, b, part, o in chunks(data, offs, 1 << 20):
                n = b - a
                of, g = cells(part, o, k)
                size = np.bincount(of, minlength=n)
                keys = band_keys(dart_min_hash(of, g, n, bands * rows), bands, rows)
                run = np.zeros((2, len(g) + 1), np.uint64)
                np.cumsum(mix(g), out=run[0, 1:])
                np.cumsum(mix(g ^ np.uint64(0x5851F42D4C957F2D)), out=run[1, 1:])
                edge = np.concatenate([[0], np.cumsum(size)])
                node = mix((run[0, edge[1:]] - run[0, edge[:-1]]) ^ mix(run[1, edge[1:]] - run[1, edge[:-1]] + size.astype(np.uint64)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(keys.astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(2).slice(a, n), pa.array(node.astype(np.int64)), pa.array(size, pa.int64()), flat], ["doc_id", "tag", "node", "size", "keys"])

    return docs.mapInArrow(lean(run), "doc_id bigint, tag binary, node bigint, size bigint, keys array<bigint>")


def _compare(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) at the similarity or more, by all their regions."""
    a = shingles.select(F.col("node").alias("a"), F.col("body").alias("body_a"))
    b = shingles.select(F.col("node").alias("b"), F.col("body").alias("body_b"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return small(pairs).join(a, "a").join(b, "b").select("a", "b", "body_a", "body_b").mapInArrow(lean(run), "a bigint, b bigint")


def shared_regions(a: list[np.ndarray], b: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """len(a) x len(b) counts of the values that two arrays of distinct values share."""
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.float32)  # exact up to 2**24

    def places(of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row, value = np.repeat(np.arange(len(of)), [len(x) for x in of]), np.concatenate(of)
        at = np.minimum(np.searchsorted(both, value), len(both) - 1)
        found = both[at] == value
        row, at = row[found], at[found]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    if not len(both):
        return out.astype(np.int64)
    sides = [(len(a), *places(a)), (len(b), *places(b))]
    for low in range(0, len(both), step):
        held = []
        for n, row, at in sides:
            x, y = np.searchsorted(at, [low, low + step])
            m = np.zeros((n, min(step, len(both) - low)), np.float32)
            m[row[x:y], at[x:y] - low] = 1
            held.append(m)
        out += held[0] @ held[1].T
    return out.astype(np.int64)


def _compare_blocks(members: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) at the similarity or more in different components, of all
    members (key, node, size, comp) of each bucket."""
    level = F.floor(F.log(F.col("size")) / math.log(1.0001 / similarity)).cast("int")
    members = members.withColumn("level", level)
    count = settle(members.groupBy("key", "level").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks")), "blocks")
    # the blocks of the own level and of both neighbours
    near = count.select("key", F.explode(F.array("level", F.col("level") - 1, F.col("level") + 1)).alias("level"), F.struct(F.col("level").alias("level"), "blocks").alias("other"))
    near = near.groupBy("key", "level").agg(F.collect_list("other").alias("others"))  # three at most
    # counts are broadcast after a size check, so that a large bucket's members stay where they are
    near = settle(near.join(count, ["key", "level"]), "near")
    own = members.join(small(near), ["key", "level"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode("others"))
    own = own.select("key", "node", "comp", "level", "block", F.col("other.level").alias("level2"), F.explode(F.sequence(F.lit(0), F.col("other.blocks") - 1)).alias("block2"))
    one, two = F.struct("level", "block"), F.struct(F.col("level2").alias("level"), F.col("block2").alias("block"))
    own = own.select("key", "node", "comp", F.least(one, two).alias("x"), F.greatest(one, two).alias("y"), (one <= two).alias("first"))

    def run(group: pa.Table) -> pa.Table:
        node, comp, first = (group.column(c).to_numpy() for c in ("node", "comp", "first"))
        bodies = [np.frombuffer(x.as_buffer(), "<u4") for x in group.column("body")]
        a, b = np.flatnonzero(first), np.flatnonzero(~first)
        within = group.column("x")[0] == group.column("y")[0]
        b = a if within else b
        if not len(a) or not len(b):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        both = shared_regions([bodies[i] for i in a], [bodies[i] for i in b])
        size = np.array([len(x) for x in bodies])
        close = (both >= similarity * (size[a][:, None] + size[b] - both)) & (comp[a][:, None] != comp[b])
        i, j = np.nonzero(close)
        i, j = node[a[i]], node[b[j]]
        return pa.table({"a": pa.array(np.minimum(i, j)), "b": pa.array(np.maximum(i, j))})

    own = own.join(shingles, "node")
    return own.groupBy("key", "x", "y").applyInArrow(run, "a bigint, b bigint").distinct()


def _union(batches):
    """node, comp of all edges of one task, by union and find."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    nodes = np.array(list(up), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([top(int(x)) for x in nodes], pa.int64())], ["node", "comp"])


def components(edges: DataFrame, most: int = SMALL) -> DataFrame:
    """node, comp: the least node each node is linked with, directly or not.
    edges (a, b) has each pair once. If the files that edges is read from hold
    at most `most` bytes, one task joins them; of more, labels go to neighbours
    and then jump to their labels' labels."""
    if estimated_bytes(edges) <= most:
        return settle(edges.select("a", "b").coalesce(1).mapInArrow(_union, "node bigint, comp bigint"), "labels")
    both = edges.union(edges.select("b", "a")).toDF("node", "other")
    label = settle(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("comp")), "labels")
    while True:
        near = both.join(label.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        new = label.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = label.toDF("comp", "next")
        new = settle(new.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("next", "comp")).alias("comp")), "labels")
        label = new.select("node", "comp")
        if new.where("was <> comp").isEmpty():
            return label


def merged(comp: DataFrame, more: DataFrame) -> DataFrame:
    """comp after more links between components: only the graph that has the
    linked components as its nodes is searched, then all nodes are renamed.
    A node that comp lacks is a component of its own."""
    held = small(comp)
    named = more.join(held.toDF("a", "x"), "a", "left").join(held.toDF("b", "y"), "b", "left").select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    between = named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    # few links take one task, and repeated ones do no harm there
    between = between.coalesce(1) if estimated_bytes(more) <= SMALL else between.distinct()
    to = components(settle(between, "links"))
    ends = more.select(F.explode(F.array("a", "b")).alias("node"))
    known = comp.union(ends.join(held, "node", "left_anti").distinct().select("node", F.col("node").alias("comp")))
    return settle(known.join(small(to.toDF("comp", "to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")


def _classes(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each row of docs (doc_id, text, tag): doc_id, tag, comp (a node
    of its component, null without words), class_id, class_size, n_links."""
    ship(docs.sparkSession)
    signed = settle(_signatures(docs, bands, rows, k), "signatures")
    worded = signed.where("size > 0")
    classes = settle(worded.groupBy("node").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("keys").alias("keys")), "classes")
    buckets = classes.select("node", "size", F.explode("keys").alias("key"))
    # buckets of one class need no comparison
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    buckets = settle(buckets.join(shared, "key"), "buckets")

    wanted = buckets.select("node").distinct().join(classes.select("node", "low"), "node").select("node", F.col("low").alias("doc_id"))
    # the class's text: rows of its least id (several rows may have it, so regions name their node anew)
    ids = wanted.select(F.col("doc_id").alias("id")).distinct()
    texts = docs.join(ids, docs.doc_id.eqNullSafe(ids.id), "left_semi")

    def regions(batches):
        for batch in batches:
            data, offs = buffers(batch.column(0))
            for a, b, part, o in chunks(data, offs, 1 << 20):
                n = b - a
                of, g = cells(part, o, k)
                size = np.bincount(of, minlength=n)
                edge = np.concatenate([[0], np.cumsum(size)])
                node = []
                for x, y in zip(edge, edge[1:]):
                    one, two = np.add.reduce(mix(g[x:y])), np.add.reduce(mix(g[x:y] ^ np.uint64(0x5851F42D4C957F2D)))
                    node.append(mix(np.array([one], np.uint64) ^ mix(np.array([two + np.uint64(y - x)], np.uint64)))[0])
                body = [np.unique((g[x:y] >> np.uint64(32)).astype("<u4")).tobytes() for x, y in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(node, np.uint64).astype(np.int64)), pa.array(body, pa.binary())], ["node", "body"])

    found = texts.select("text").mapInArrow(lean(regions), "node bigint, body binary")
    shingles = settle(found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "shingles")

    def close(pairs: DataFrame) -> DataFrame:
        """Without pairs whose sizes alone keep them apart."""
        return pairs.where((F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    order = lambda *salt: F.min(F.struct(F.xxhash64("node", *salt).alias("o"), F.col("node"), F.col("size")))
    lead = buckets.groupBy("key").agg(order().alias("l"), order("key").alias("r"))
    led = buckets.select("key", F.col("node").alias("a"), F.col("size").alias("size_a")).join(lead, "key")
    to = F.explode(F.array_distinct(F.array(F.struct("l.node", "l.size"), F.struct("r.node", "r.size")))).alias("to")
    pairs = close(led.select("a", "size_a", to).select("a", "size_a", F.col("to.node").alias("b"), F.col("to.size").alias("size_b")).where("a <> b"))
    edges = settle(_compare(settle(pairs, "pairs"), shingles, similarity), "edges")
    linked = small(components(edges))
    comp = settle(shingles.select("node").join(linked, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "labels")
    placed = buckets.join(small(comp), "node")
    # buckets of one component need no more
    mixed = placed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key", "m")
    placed = settle(placed.join(mixed, "key"), "mixed")
    few, many = placed.where(F.col("m") <= FEW), placed.where(F.col("m") > FEW)
    side = lambda name: few.select("key", F.col("node").alias(name), F.col("size").alias(f"size_{name}"), F.col("comp").alias(f"comp_{name}"))
    bound = F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b")
    new = settle(side("a").join(side("b"), "key").where((F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & bound).select("a", "b").distinct(), "pairs")
    more = settle(_compare(new, shingles, similarity).union(_compare_blocks(many, shingles, similarity)).distinct(), "edges")
    if not more.isEmpty():
        edges = edges.union(more)
        comp = merged(comp, more)

    links = edges.union(edges.select("b", "a")).toDF("node", "o").groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    of = classes.select("node", "low", "n").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(links, "node", "left")
    whole = of.groupBy("comp").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"))
    of = of.join(whole, "comp").select("node", "comp", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = signed.where("size > 0").select("doc_id", "tag", "node").join(of, "node").select("doc_id", "tag", "comp", "class_id", "class_size", "n_links")
    alone = signed.where("size = 0").select("doc_id", "tag", F.lit(None).cast("bigint").alias("comp"), F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.lit(0).cast("bigint").alias("n_links"))
    return out.union(alone)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each document: doc_id, class_id (the least doc_id of its
    component), class_size (documents), n_links (compared links of its text),
    class_key (the component's own name)."""
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).cast("binary").alias("tag"))
    return _classes(docs, similarity, k, bands, rows).select("doc_id", "class_id", "class_size", "n_links", F.col("comp").alias("class_key"))


def first_of_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of df for each class: one of its least id (null ids last, ties by
    the text's digest). Rows are told apart by id and text, whatever ids repeat;
    rows without words all stay."""
    tag = F.unhex(F.md5(F.col(text_col).cast("binary")))
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), tag.alias("tag"))
    classed = _classes(docs)
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag")
    first = classed.where("comp IS NOT NULL").groupBy("comp").agg(F.min(row).alias("r")).select("r.doc_id", "r.tag", F.lit(False))
    alone = classed.where("comp IS NULL").select("doc_id", "tag", F.lit(True)).distinct()
    id_, own, single, of, nth = spare(df, "id_", "own", "alone", "tag", "nth")
    kept = first.union(alone).toDF(id_, own, single)
    left = df.withColumn(of, tag).join(kept, F.col(id_col).eqNullSafe(F.col(id_)) & F.col(of).eqNullSafe(F.col(own)))
    # equal rows are one, if they have words
    return left.withColumn(nth, F.when(F.col(single), F.monotonically_increasing_id())).dropDuplicates([id_col, of, nth]).select(*df.columns)


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their near-duplicate classes."""
    return near_duplicates(table(spark, sf_dir, "documents"))
