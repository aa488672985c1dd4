"""Token ids in wavelet matrix files: one compressed file for each shard.

A shard's ids become bit planes, the highest bit first; below each plane the
ids stand sorted, stably, by that bit. With running counts of ones beside the
planes, one file answers which id stands at a place, how often an id occurs
before a place, and where its k-th occurrence is, without other data.

Documents are dealt by ranges of doc_id and sorted, so files in the order of
their names hold them in ascending doc_id order (null ids first; equal ids by
text). Null texts count as empty; an empty text has its end id alone. A text
longer than SHARD_TOKENS ids makes its file that much longer; no text is cut.
An empty table writes no file. Other columns are not read.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm._shared import fresh, lean, open_shared, partitions, publish, settle, ship, table
from lexarium.llm._tokens import encoder, vocabulary, with_end
from lexarium.llm._words import buffers

MAGIC = b"WVMATRX1"
SHARD_TOKENS = 2 << 20  # ids of a file, about
_BLOCK = 512  # bits between counts


class WaveletMatrix:
    def __init__(self, n: int, bits: int, planes: list[np.ndarray], zeros: list[int], counts: list[np.ndarray], docs: np.ndarray, sizes: np.ndarray, null_id: np.ndarray):
        self.n, self.bits, self.planes, self.zeros, self.counts = n, bits, planes, zeros, counts
        self.docs, self.sizes, self.null_id = docs, sizes, null_id  # documents of the shard

    @classmethod
    def build(cls, ids: np.ndarray, docs: np.ndarray, sizes: np.ndarray, null_id: np.ndarray | None = None) -> WaveletMatrix:
        n, bits = len(ids), max(1, int(ids.max(initial=0)).bit_length())
        a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, counts = [], [], []
        for b in range(bits - 1, -1, -1):
            one = a & a.dtype.type(1 << b) != 0
            planes.append(np.packbits(one))
            counts.append(_sums(planes[-1]))
            # places, then rows: some times faster than a mask on random bits
            low, high = np.flatnonzero(~one), np.flatnonzero(one)
            zeros.append(len(low))
            a = np.concatenate([a[low], a[high]])
        return cls(n, bits, planes, zeros, counts, docs, sizes, np.zeros(len(docs), np.uint8) if null_id is None else null_id)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QIQ", self.n, self.bits, len(self.docs))
        parts = [head, self.docs.astype("<i8").tobytes(), self.sizes.astype("<i8").tobytes(), self.null_id.astype(np.uint8).tobytes(), np.array(self.zeros, "<i8").tobytes()]
        for p, c in zip(self.planes, self.counts):
            parts += [p.tobytes(), c.astype("<u4").tobytes()]
        return MAGIC + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    @classmethod
    def from_bytes(cls, payload: bytes) -> WaveletMatrix:
        if payload[:8] != MAGIC:
            raise ValueError("no wavelet matrix file")
        raw = zstandard.ZstdDecompressor().decompress(payload[8:])
        n, bits, d = struct.unpack_from("<QIQ", raw)
        at = struct.calcsize("<QIQ")

        def take(kind: str, size: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(raw, kind, size, at)
            at += x.nbytes
            return x

        docs, sizes, null_id, zeros = take("<i8", d), take("<i8", d), take("u1", d), take("<i8", bits)
        planes, counts = [], []
        for _ in range(bits):
            planes.append(take("u1", (n + 7) // 8))
            counts.append(take("<u4", (n + _BLOCK - 1) // _BLOCK + 1))
        return cls(n, bits, planes, zeros.tolist(), counts, docs, sizes, null_id)

    def _bit(self, plane: int, i: int) -> int:
        return int(self.planes[plane][i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // _BLOCK
        a = block * _BLOCK // 8
        n = int(self.counts[plane][block]) + int(np.bitwise_count(self.planes[plane][a : i >> 3]).sum())
        return n + (int(self.planes[plane][i >> 3] >> (8 - (i & 7))).bit_count() if i & 7 else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.bits):
            bit, ones = self._bit(p, i), self._ones(p, i)
            out, i = out << 1 | bit, self.zeros[p] + ones if bit else i - ones
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences before `end` stand below the last plane."""
        a, b = 0, end
        for p in range(self.bits):
            x, y = self._ones(p, a), self._ones(p, b)
            a, b = (self.zeros[p] + x, self.zeros[p] + y) if token >> (self.bits - 1 - p) & 1 else (a - x, b - y)
        return a, b

    def rank(self, token: int, end: int) -> int:
        """Occurrences of the token among the first `end` ids."""
        if token < 0 or token >> self.bits:
            return 0
        a, b = self._range(token, min(end, self.n))
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of the token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, self.n)[0] + k
        for p in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - p) & 1
            i = self._select(p, i - self.zeros[p] if one else i, one)
        return i

    def _select(self, plane: int, k: int, one: int) -> int:
        """The place of the k-th (from 0) bit of this kind in a plane."""
        c = self.counts[plane].astype(np.int64)
        c = c if one else np.minimum(np.arange(len(c)) * _BLOCK, self.n) - c
        block = int(np.searchsorted(c, k, "right")) - 1
        bits = np.unpackbits(self.planes[plane][block * _BLOCK // 8 : (block + 1) * _BLOCK // 8])[: self.n - block * _BLOCK]
        return block * _BLOCK + int(np.flatnonzero(bits == one)[k - int(c[block])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        a = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[p], count=self.n).view(bool)
            up = np.empty_like(a)
            up[np.flatnonzero(~one)] = a[: self.zeros[p]]
            up[np.flatnonzero(one)] = a[self.zeros[p] :] | a.dtype.type(1 << (self.bits - 1 - p))
            a = up
        return a.astype(np.uint32)


def _sums(packed: np.ndarray) -> np.ndarray:
    """Ones before each block, and of the whole plane."""
    size = _BLOCK // 8
    whole = np.zeros(-(-len(packed) // size) * size, np.uint8)
    whole[: len(packed)] = packed
    blocks = np.bitwise_count(whole.view(np.uint64)).reshape(-1, size // 8).sum(1)
    return np.concatenate([[0], np.cumsum(blocks)]).astype(np.uint32)


def write_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, path: str | None = None) -> DataFrame:
    """Write the files into the shared folder; the manifest has a row for each:
    part, seq, path, n_docs, n_tokens, before (ids before it in its part)."""
    spark = df.sparkSession
    ship(spark)
    vocab, path = vocab or vocabulary("byte_bpe_50k.json"), path or fresh(spark, "wavelet")
    n = max(partitions(spark), 1)
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held, sizes, names, total = [], [], [], 0

        def flush():
            nonlocal seq, before, held, sizes, names, total
            ids, to = np.concatenate(held), f"{path}/{part:06d}-{seq:06d}.wvm"
            null = np.array([x is None for x in names], np.uint8)
            docs = np.array([0 if x is None else x for x in names], np.int64)
            publish(to, WaveletMatrix.build(ids, docs, np.concatenate(sizes), null).to_bytes())
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": to, "n_docs": len(names), "n_tokens": len(ids), "before": before}])
            seq, before = seq + 1, before + len(ids)
            held, sizes, names, total = [], [], [], 0
            return row

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for a, ids, n in encoder(vocab).encode(*buffers(batch.column(1))):
                ids, _ = with_end(ids, n, end_id)
                held.append(ids)
                sizes.append(n + 1)
                names += docs[a : a + len(n)]
                total += len(ids)
                if total >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    return settle(docs.mapInArrow(lean(run), "part bigint, seq bigint, path string, n_docs bigint, n_tokens bigint, before bigint"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Documents from the files: doc_id, start (ids before it in all files),
    n_tokens, ids (little-endian unsigned 32-bit integers)."""
    spark = manifest.sparkSession
    ship(spark)
    base, rows = 0, []
    for part, n in manifest.groupBy("part").agg(F.sum("n_tokens")).orderBy("part").collect():  # one row a task that wrote
        rows.append((part, base))
        base += n
    bases = spark.createDataFrame(rows, "part bigint, base bigint")
    files = manifest.join(F.broadcast(bases), "part").select("path", (F.col("base") + F.col("before")).alias("start")).repartition(max(partitions(spark), 1))

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_shared(path, "rb") as f:
                    m = WaveletMatrix.from_bytes(f.read())
                ids = m.tokens().astype("<u4")
                offs = np.concatenate([[0], np.cumsum(m.sizes)])
                body = pa.Array.from_buffers(pa.large_binary(), len(m.docs), [None, pa.py_buffer((offs * 4).astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
                ids_of = pa.array(m.docs, pa.int64(), mask=m.null_id.astype(bool))
                yield pa.RecordBatch.from_arrays([ids_of, pa.array(start + offs[:-1], pa.int64()), pa.array(m.sizes, pa.int64()), body.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(lean(run), "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def op4_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written to wavelet matrix files and read back."""
    back = read_shards(write_shards(table(spark, sf_dir, "documents")))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
