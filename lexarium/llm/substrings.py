"""Exact repeats across documents by fixed-block anchors.

A repeat of 50 words holds, wherever it starts, one whole block of 25 words
whose place in its document is a multiple of 25. So the index takes only such
non-overlapping blocks; each rolling window of 25 words is a probe. Hits are
extended: the windows of 50 words around them are compared by 128 bits (two
independent hashes of 64 over words that are hashed twice, too), and runs of
windows that repeat are the maximal exact repeats.

Documents are dealt into buckets by a hash of doc_id. A bucket hashes its words
as arrays, joins its own documents by itself, and sends each distinct window
once, four bytes long, to the part that its hash belongs to. A part answers
with one bit a window. So a passage that a third of all documents hold is sent
once a bucket, and no pair of documents is ever built. Only words' text goes
through one exchange, which Spark uses again in each of the three passes.

A word is removed if a window over it also starts in a document with a smaller
doc_id; windows are judged on the input. Rows of equal doc_id aren't copies of
each other, and each is judged alone; rows with a null doc_id keep all words
and are a source for none. Null texts have no words. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm._shared import estimated_bytes, lean_group, partitions, ship, table
from lexarium.llm._words import NOT_SPACE, buffers, find_words, hashed_words, window_at, windows

WINDOW = 50
BUCKET_BYTES = 4 << 20  # of a bucket on disk, about
BUCKETS_A_PART = 3
_REPLY = "bucket int, part int, kind int, body binary"


def _sorted(t: pa.Table) -> pa.Table:
    """The bucket's rows in an order that each pass finds again."""
    return t.take(pc.sort_indices(t, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def _parts(h: np.ndarray, n: int) -> np.ndarray:
    """Bounds of n ranges of hashes in sorted h."""
    edges = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])


def _short(h: np.ndarray, part: int, n: int) -> np.ndarray:
    """32 bits of hashes below the bits that the part stands for, in order."""
    return ((h - np.uint64((part << 64) // n)) >> np.uint64(max(0, 33 - n.bit_length()))).astype(np.uint32) if n > 1 else (h >> np.uint64(32)).astype(np.uint32)


class Bucket:
    """Hashes of a bucket's documents (null ids have no windows)."""

    def __init__(self, t: pa.Table, k: int):
        self.k, self.block = k, k // 2
        self.t = t
        ids = t.column("doc_id")
        self.null = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        self.data, self.offs = buffers(t.column("text"))
        self.h, self.doc = hashed_words(self.data, self.offs, NOT_SPACE)
        usable = ~self.null[self.doc]
        at, g = windows(self.h, self.doc, self.block)
        keep = usable[at]
        self.at, self.g = at[keep], g[keep]
        first = np.searchsorted(self.doc, np.arange(t.num_rows))
        self.aligned = (self.at - first[self.doc[self.at]]) % self.block == 0

    def anchors(self):
        """Distinct probes, whether a block is among their places, back links,
        and whether two documents of this bucket have them."""
        keys, back = np.unique(self.g, return_inverse=True)
        index = np.zeros(len(keys), bool)
        index[back[self.aligned]] = True
        doc = self.ids[self.doc[self.at]]
        low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, back, doc)
        np.maximum.at(high, back, doc)
        return keys, index, back, low < high

    def candidates(self, hit: np.ndarray) -> np.ndarray:
        """Starts of windows of k words with a hit block inside, a bit a word."""
        n, span = len(self.h), self.k - self.block
        run = np.zeros(n + 1, np.int32)
        np.cumsum(np.bincount(self.at[hit], minlength=n)[:n], out=run[1:])
        at = np.arange(max(0, n - self.k + 1))
        ok = self.doc[at] == self.doc[at + self.k - 1]
        ok &= run[np.minimum(at + span + 1, n)] > run[at]
        out = np.zeros(n, bool)
        out[: len(at)] = ok
        return out

    def repeats(self, cand: np.ndarray):
        """Places of candidate windows, their distinct 128-bit hashes in order,
        back links, and the least doc_id of each in this bucket."""
        at = np.flatnonzero(cand)
        both = np.empty(len(at), [("a", "<u8"), ("b", "<u8")])
        again, _ = hashed_words(self.data, self.offs, NOT_SPACE, seed=1) if len(at) else (self.h, None)
        both["a"], both["b"] = window_at(self.h, at, self.k, 0), window_at(again, at, self.k, 1)
        order = np.lexsort((both["b"], both["a"]))
        new = np.ones(len(at), bool)
        new[1:] = both[order][1:] != both[order][:-1]
        back = np.empty(len(at), np.int64)
        back[order] = np.cumsum(new) - 1
        keys = both[order][new]
        low = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(low, back, self.ids[self.doc[at]])
        return at, keys, back, low


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [(), (), (), ()]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], ["bucket", "part", "kind", "body"])


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _flags(body: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool)


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """A row for each document: doc_id, text (its kept words, joined by one
    space), n_words, n_removed, spans (of removed words, from 0)."""
    spark = df.sparkSession
    ship(spark)
    k = window
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    n = buckets or max(partitions(spark), -(-estimated_bytes(docs) // BUCKET_BYTES) if estimated_bytes(docs) < 1 << 56 else 1)
    m = -(-n // BUCKETS_A_PART)  # parts
    # rows without doc_id are spread by their text
    base = docs.select(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")))), F.lit(n)).cast("int").alias("bucket"), "doc_id", "text")

    def number(t: pa.Table) -> int:
        return t.column("bucket")[0].as_py()

    def probes(t: pa.Table) -> pa.Table:
        b, own = Bucket(_sorted(t), k), number(t)
        keys, index, _, _ = b.anchors()
        edge, rows = _parts(keys, m), []
        for p in range(m):
            x, y = edge[p], edge[p + 1]
            if x < y:
                rows.append((own, p, 0, _short(keys[x:y], p, m).tobytes() + _bits(index[x:y])))
        return _rows(rows)

    def split(t: pa.Table, width: int):
        """Buckets, sizes, and the joined bodies of a part's messages."""
        bucket, bodies = t.column("bucket").to_pylist(), t.column("body").to_pylist()
        return bucket, bodies, [len(x) * 8 // (width * 8 + 1) for x in bodies]

    def answer(t: pa.Table) -> pa.Table:
        """Which probes meet a block of another bucket."""
        bucket, bodies, sizes = split(t, 4)
        part = t.column("part")[0].as_py()
        key = np.concatenate([np.frombuffer(x, "<u4", s) for x, s in zip(bodies, sizes)])
        index = np.concatenate([_flags(x[4 * s :], s) for x, s in zip(bodies, sizes)])
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        group = np.empty(len(key), np.int64)
        group[order] = np.cumsum(new) - 1
        # two short keys of one bucket may be equal: then both count as met
        blocks, members = np.bincount(group, index), np.bincount(group)
        met = (blocks[group] > 0) & (members[group] > 1)
        edge = np.cumsum([0, *sizes])
        return _rows([(b, part, 0, _bits(met[x:y])) for b, x, y in zip(bucket, edge, edge[1:]) if met[x:y].any()])

    def extend(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _rows([])
        b, own = Bucket(_sorted(t), k), number(t)
        keys, index, back, hit = b.anchors()
        edge = _parts(keys, m)
        for p, body in zip(replies.column("part").to_pylist(), replies.column("body").to_pylist()):
            x, y = edge[p], edge[p + 1]
            hit[x:y] |= _flags(body, y - x)
        cand = b.candidates(hit[back])
        if not cand.any():
            return _rows([])
        _, keys, _, low = b.repeats(cand)
        edge, rows = _parts(keys["a"], m), [(own, own % m, 1, _bits(cand))]
        for p in range(m):
            x, y = edge[p], edge[p + 1]
            if x < y:
                rows.append((own, p, 0, keys[x:y].tobytes() + low[x:y].tobytes()))
        return _rows(rows)

    def judge(t: pa.Table) -> pa.Table:
        """Which windows also start in a document of another bucket with a
        smaller id than theirs; bits of candidates are handed on."""
        kind = np.asarray(t.column("kind"))
        own = t.filter(pa.array(kind == 1))
        t = t.filter(pa.array(kind == 0))
        rows = [(b, b, 1, x) for b, x in zip(own.column("bucket").to_pylist(), own.column("body").to_pylist())]
        if t.num_rows:
            part, bucket, bodies = t.column("part")[0].as_py(), t.column("bucket").to_pylist(), t.column("body").to_pylist()
            sizes = [len(x) // 24 for x in bodies]
            key = np.concatenate([np.frombuffer(x, [("a", "<u8"), ("b", "<u8")], s) for x, s in zip(bodies, sizes)])
            low = np.concatenate([np.frombuffer(x, "<i8", s, 16 * s) for x, s in zip(bodies, sizes)])
            order = np.lexsort((low, key["b"], key["a"]))
            new = np.ones(len(key), bool)
            new[1:] = key[order][1:] != key[order][:-1]
            least = np.empty(len(key), np.int64)
            least[order] = low[order][new][np.cumsum(new) - 1]
            edge = np.cumsum([0, *sizes])
            rows += [(b, part, 0, _bits((least < low)[x:y])) for b, x, y in zip(bucket, edge, edge[1:])]
        return _rows(rows)

    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])

    def remove(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return schema.empty_table()
        t = _sorted(t)
        kinds = replies.column("kind").to_pylist()
        texts = t.column("text").to_pylist()
        gone = None
        if kinds:
            b = Bucket(t, k)
            bodies, parts = replies.column("body").to_pylist(), replies.column("part").to_pylist()
            cand = _flags(bodies[kinds.index(1)], len(b.h))
            at, keys, back, low = b.repeats(cand)
            edge, bad = _parts(keys["a"], m), np.zeros(len(keys), bool)
            for p, kind, body in zip(parts, kinds, bodies):
                if kind == 0:
                    bad[edge[p] : edge[p + 1]] = _flags(body, edge[p + 1] - edge[p])
            starts = at[bad[back] | (b.ids[b.doc[at]] > low[back])]
            run = np.zeros(len(b.h) + 1, np.int64)
            np.add.at(run, starts, 1)
            np.add.at(run, starts + k, -1)
            gone = np.cumsum(run[:-1]) > 0
            first = np.searchsorted(b.doc, np.arange(t.num_rows + 1))
        out, n_words, n_removed, spans = [], [], [], []
        for i, text in enumerate(texts):
            words = (text or "").encode().split()
            n_words.append(len(words))
            own = gone[first[i] : first[i + 1]] if gone is not None else None
            if own is not None and own.any():
                turn = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                spans.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(turn[::2], turn[1::2])])
                n_removed.append(int(own.sum()))
                words = [w for w, g in zip(words, own.tolist()) if not g]
            else:
                spans.append([])
                n_removed.append(0)
            out.append(b" ".join(words).decode())
        return pa.table([t.column("doc_id").cast(pa.int64()), pa.array(out, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, schema.field("spans").type)], schema=schema)

    sent = base.groupBy("bucket").applyInArrow(lean_group(probes), _REPLY)
    met = sent.groupBy("part").applyInArrow(lean_group(answer), _REPLY)
    asked = base.groupBy("bucket").cogroup(met.groupBy("bucket")).applyInArrow(lean_group(extend), _REPLY)
    judged = asked.groupBy("part").applyInArrow(lean_group(judge), _REPLY)
    return base.groupBy("bucket").cogroup(judged.groupBy("bucket")).applyInArrow(lean_group(remove), "doc_id bigint, text string, n_words bigint, n_removed bigint, spans array<struct<first:bigint,last:bigint>>")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 50 words that earlier ones hold."""
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS s, ws FROM w WHERE len(ws) >= 50),
g AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS h FROM p),
m AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS low FROM g),
r AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM m WHERE low < doc_id),
c AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id),
j AS (SELECT w.doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
k AS (SELECT doc_id, ws, gone, list_filter(ws, lambda x, i: NOT list_contains(gone, i)) AS kept FROM j)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
