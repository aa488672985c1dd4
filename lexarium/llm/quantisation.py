"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one codeword from each of several codebooks,
all of full dimension. The codebooks are fitted in turn to residuals (k-means
on at most FIT vectors, the first in the order of a hash of their id). Encoding
is a beam search: the best BEAM sums so far are widened by every codeword of the
next book. Beside a code stands the norm of the sum, so that distances, too,
come from tables.

A search looks up a query's inner products with all codewords in one table and
adds them along each code. The best candidates over the whole index, RERANK of
them or one vector in RERANK_SHARE if that is more (ties to the smaller id), are
scored again with the original vectors in double precision. Every vector is
indexed. Codes and vectors lie in files of their own in the shared folder: a
task reads all codes, one block at a time, and those blocks of vectors that hold
candidates, once for each group of its queries. A group has up to GROUP queries,
fewer where their candidates would take more than HELD bytes: memory does not
grow with the index until one query's candidates alone are more. So the work is
that of queries times codes: the method scans all codes, it has no coarse
partition.

Vectors that are null, zero, of another dimension than the most frequent one
(least, if tied), or hold null or non-finite components take no part, nor do
rows with a null id. Repeated ids stay rows of their own; a query never finds
rows of its own id. An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import io
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm._shared import fresh, lean, open_shared, publish, settle, ship, table

BOOKS, WORDS, BEAM = 16, 128, 8
FIT = 16384
BLOCK = 16384  # vectors of an index block
QUERIES = 2048  # of a task
GROUP, HELD = 128, 64 << 20  # queries scored at once, bytes of their candidates
RERANK, RERANK_SHARE = 128, 40


def _sums(rows: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each of n groups."""
    out = np.zeros((n, rows.shape[1]))
    order = np.argsort(of, kind="stable")
    seen, first = np.unique(of[order], return_index=True)
    if len(seen):
        out[seen] = np.add.reduceat(rows[order], first, 0)
    return out


class AdditiveQuantiser:
    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)  # books x words x dimension

    @classmethod
    def fit(cls, x: np.ndarray, books: int = BOOKS, words: int = WORDS, steps: int = 8, seed: int = 7) -> AdditiveQuantiser:
        """Codebooks by k-means on residuals, one after the other."""
        rng, rest, out = np.random.default_rng(seed), x.astype(np.float64).copy(), []
        words = max(1, min(words, len(x)))
        for _ in range(books):
            c = rest[rng.choice(len(rest), words, replace=False)].copy()
            for _ in range(steps):
                near = np.argmin((c * c).sum(1) - 2 * rest @ c.T, 1)
                n = np.bincount(near, minlength=words)
                c[n > 0] = _sums(rest, near, words)[n > 0] / n[n > 0, None]
            out.append(c)
            rest -= c[np.argmin((c * c).sum(1) - 2 * rest @ c.T, 1)]
        return cls(np.stack(out))

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n x books) and squared norms of their sums."""
        books, words, d = self.books.shape
        n, x = len(x), x.astype(np.float32)
        codes, rest = np.zeros((n, 1, 0), np.uint16), x[:, None, :]
        at = np.arange(n)[:, None]
        for book in self.books:
            flat = (rest.reshape(-1, d) @ (-2 * book.T)).reshape(n, -1, words)
            flat += np.einsum("nkd,nkd->nk", rest, rest)[:, :, None] + np.einsum("wd,wd->w", book, book)
            flat = flat.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, 1)[:, :keep]
            row, word = best // words, best % words
            rest = rest[at, row] - book[word]
            codes = np.concatenate([codes[at, row], word[:, :, None].astype(np.uint16)], 2)
        first = np.argmin(np.einsum("nkd,nkd->nk", rest, rest), 1)
        codes = codes[at[:, 0], first]
        made = x - rest[at[:, 0], first]
        return codes.astype(np.uint8 if words <= 256 else np.uint16), (made.astype(np.float64) ** 2).sum(1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        return np.einsum("qd,bwd->qbw", q.astype(np.float32), self.books)


def scores(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Inner products, by look-up: queries x vectors. One look-up serves all queries."""
    by_word = np.ascontiguousarray(tables.transpose(1, 2, 0))
    out = np.zeros((len(codes), len(tables)), np.float32)
    for i in range(0, len(codes), 1024):
        some, sums = codes[i : i + 1024], out[i : i + 1024]
        for b in range(codes.shape[1]):
            sums += by_word[b].take(some[:, b], 0)
    return np.ascontiguousarray(out.T)


def _usable(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    v = F.col("vec")
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("vec") == (size.d if size else 0)), size.d if size else 0


def _matrix(col, d: int) -> np.ndarray:
    return np.asarray(col.flatten()).astype(np.float64).reshape(-1, d)


class Index(NamedTuple):
    """Files path/PART-BLOCK.codes and .rows in the shared folder: the number of
    blocks of each part, vectors in all, dimension, codebooks."""

    path: str
    blocks: np.ndarray
    n: int
    d: int
    books: np.ndarray | None


def build_index(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", books: int = BOOKS, words: int = WORDS, fit: int = FIT, block: int = BLOCK) -> Index:
    """Writes codes and vectors of all usable rows into the shared folder."""
    spark = df.sparkSession
    ship(spark)
    rows, d = _usable(df, id_col, vec_col)
    path = fresh(spark, "index")
    if not d:
        return Index(path, np.zeros(0, np.int32), 0, 0, None)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit).collect()  # a bounded fit
    made = AdditiveQuantiser.fit(np.array([r.vec for r in sample]), books, words).books
    sent = spark.sparkContext.broadcast(made)

    def run(batches):
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        quantiser = AdditiveQuantiser(sent.value)

        def flush():
            ids, x = (np.concatenate(c) for c in zip(*held))
            done = [quantiser.encode(x[i : i + 1024]) for i in range(0, len(x), 1024)]
            brief = x.astype(np.float32)
            x = brief if (brief == x).all() else x
            for kind, what in (("codes", {"ids": ids, "codes": np.concatenate([c for c, _ in done]), "norms": np.concatenate([n for _, n in done])}), ("rows", {"x": x})):
                out = io.BytesIO()
                np.savez(out, **what)
                publish(f"{path}/{part:06d}-{seq:06d}.{kind}", out.getvalue())

        n = 0
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                some = batch.slice(i, block)
                held.append((np.asarray(some.column(0)), _matrix(some.column(1), d)))
                size, n = size + some.num_rows, n + some.num_rows
                if size >= block:
                    flush()
                    seq, held, size = seq + 1, [], 0
        if held:
            flush()
            seq += 1
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "blocks": pa.array([seq], pa.int32()), "n": pa.array([n], pa.int64())})

    # one row of three numbers for each task that wrote
    found = settle(rows.mapInArrow(lean(run), "part int, blocks int, n bigint"), "blocks").where("blocks > 0").collect()
    blocks = np.zeros(max((r.part + 1 for r in found), default=0), np.int32)
    for r in found:
        blocks[r.part] = r.blocks
    return Index(path, blocks, sum(r.n for r in found), d, made)


def _best(score: np.ndarray, who: np.ndarray, most: int) -> np.ndarray:
    """Where the `most` best stand: by score, then the least id; in any order."""
    if len(score) <= most:
        return np.arange(len(score))
    edge = np.partition(score, len(score) - most)[len(score) - most]
    above, tied = np.flatnonzero(score > edge), np.flatnonzero(score == edge)
    need = most - len(above)
    if need < len(tied):
        tied = tied[np.argpartition(who[tied], need - 1)[:need]]
    return np.concatenate([above, tied])


class _Candidates:
    """The `most` best candidates of each query: by score, then the least id.
    They gather in a buffer, which is cut when it is full."""

    def __init__(self, qid: np.ndarray, most: int):
        n, size = len(qid), self.size(most)
        self.qid, self.most, self.low, self.n = qid, most, np.full(n, -np.inf, np.float32), np.zeros(n, np.int64)
        self.score, self.who, self.place = np.empty((n, size), np.float32), np.empty((n, size), np.int64), np.empty((n, size), np.int64)

    @staticmethod
    def size(most: int) -> int:
        return most + max(most, BLOCK)

    @classmethod
    def queries(cls, most: int) -> int:
        """As many as HELD bytes of candidates allow."""
        return max(1, min(GROUP, HELD // (20 * cls.size(most))))

    def cut(self, j: int) -> None:
        n = self.n[j]
        if n > self.most:
            keep = _best(self.score[j, :n], self.who[j, :n], self.most)
            for x in (self.score, self.who, self.place):
                x[j, : self.most] = x[j, keep]
            self.n[j], self.low[j] = self.most, self.score[j, : self.most].min()

    def add(self, approx: np.ndarray, ids: np.ndarray, first: int) -> None:
        """Scores of a block's vectors; `first` is the place of the first one."""
        for j in range(len(approx)):
            at = np.flatnonzero(approx[j] >= self.low[j])
            at = at[ids[at] != self.qid[j]]
            while len(at):
                if self.n[j] == self.score.shape[1]:
                    self.cut(j)
                n = self.n[j]
                some = at[: self.score.shape[1] - n]
                self.score[j, n : n + len(some)], self.who[j, n : n + len(some)], self.place[j, n : n + len(some)] = approx[j, some], ids[some], first + some
                self.n[j] += len(some)
                at = at[len(some) :]


def search(queries: DataFrame, index: Index, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", rerank: int | None = None, measure: str = "inner") -> DataFrame:
    """For each query its k nearest: query_id, rank, vec_id, score (exact, on the
    original vectors); ties go to the smaller vec_id. measure: `inner` product
    or `distance` (score: minus the squared distance, by the stored norms)."""
    spark = queries.sparkSession
    ship(spark)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not index.n:
        return spark.createDataFrame([], schema)
    if measure not in ("inner", "distance"):
        raise ValueError(measure)
    most = max(k, rerank or max(RERANK, -(-index.n // RERANK_SHARE)))
    rows, _ = _usable(queries, id_col, vec_col)
    rows = rows.where(F.size("vec") == index.d)
    count = rows.count()
    n = max(1, -(-count // QUERIES), min(spark.sparkContext.defaultParallelism, count // 64))
    rows = rows.repartition(n)
    sent, path, d = spark.sparkContext.broadcast((index.blocks, index.books)), index.path, index.d  # 4 bytes a part, codebooks

    def load(name: str):
        with open_shared(f"{path}/{name}", "rb") as f:
            return np.load(io.BytesIO(f.read()))

    def answer(qid: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        blocks, books = sent.value
        names = [f"{p:06d}-{i:06d}" for p, m in enumerate(blocks.tolist()) for i in range(m)]
        tables, held, starts = AdditiveQuantiser(books).tables(q), _Candidates(qid, most), [0]
        for name in names:
            file = load(f"{name}.codes")
            ids, approx = file["ids"], scores(tables, file["codes"])
            held.add(2 * approx - file["norms"].astype(np.float32) if measure == "distance" else approx, ids, starts[-1])
            starts.append(starts[-1] + len(ids))
        for j in range(len(q)):
            held.cut(j)
        # the original vectors of the candidates, block by block
        who, place = (np.concatenate([x[j, : held.n[j]] for j in range(len(q))]) for x in (held.who, held.place))
        ends, held = np.cumsum(held.n), None
        order = np.argsort(place, kind="stable")
        exact, edge = np.zeros(len(who)), np.searchsorted(place, starts, sorter=order)
        for b, name in enumerate(names):
            own = order[edge[b] : edge[b + 1]]
            x = load(f"{name}.rows")["x"] if len(own) else None
            for i in range(0, len(own), 1 << 12):
                some = own[i : i + (1 << 12)]
                a, c = x[place[some] - starts[b]].astype(np.float64), q[np.searchsorted(ends, some, "right")]
                exact[some] = (a * c).sum(1) if measure == "inner" else -((a - c) ** 2).sum(1)
        found, rated = [], np.where(np.isnan(exact), -np.inf, exact)
        for j, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
            own = a + _best(rated[a:b], who[a:b], k)
            own = own[np.lexsort((who[own], -exact[own]))]
            found.append((np.full(len(own), qid[j]), np.arange(1, len(own) + 1), who[own], exact[own]))
        cols = [pa.array(np.concatenate(c), t) for c, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.int64(), pa.float64()))]
        return pa.RecordBatch.from_arrays(cols, ["query_id", "rank", "vec_id", "score"])

    def run(batches):
        held = [(np.asarray(b.column(0)), _matrix(b.column(1), d)) for b in batches if b.num_rows]  # QUERIES a task, about
        if held:
            qid, q = (np.concatenate(c) for c in zip(*held))
            group = _Candidates.queries(most)
            for i in range(0, len(q), group):
                yield answer(qid[i : i + group], q[i : i + group])

    return rows.mapInArrow(lean(run), schema)


def op9_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors.where(F.col("vec_id") % 20 == 0), build_index(vectors))
