"""Sum-of-squares online packing of documents into token windows.

Each task packs its own documents as they come. The state is one array: how
many open windows stand at each fill level. A document's rest (what its whole
windows leave over) goes to the level, or to a new window, for which the sum of
squared counts of partly filled windows becomes least. When the task ends, its
open windows pour into each other, and the last one is cut into sequences of a
power of two: these need no padding.

Null texts count as empty ones, and an empty text still has its end id. Equal
or repeated rows are packed one by one, each piece named by its doc_id (which
may be null). An empty table gives no rows; other columns are not read.
Nothing is shuffled, and memory is bounded by the open windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm._shared import lean, ship, table
from lexarium.llm._tokens import encoder, vocabulary, with_end
from lexarium.llm._words import buffers

WINDOW = 2048
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint"


class Packer:
    """Windows of `size` ids. Items are (doc, start, ids, doc_tokens); closed
    windows go to `out` as lists of items."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)  # the level array
        self.open: list[list] = [[] for _ in range(size + 1)]
        self.out: list[list] = []

    def level(self, s: int) -> int:
        """The fill level to put an item of s ids on; 0 is a new window."""
        n, room = self.count, self.size - s
        levels = np.flatnonzero(n[1 : room + 1]) + 1 if room > 0 else np.zeros(0, np.int64)
        if not len(levels):
            return 0
        after = levels + s
        change = 2 - 2 * n[levels] + np.where(after < self.size, 2 * n[after], -1)
        best = int(change.min())
        if 2 * int(n[s]) + 1 < best:
            return 0
        return int(levels[np.flatnonzero(change == best)[-1]])

    def add(self, doc, ids: np.ndarray) -> None:
        size, n = self.size, len(ids)
        whole = n - n % size
        for a in range(0, whole, size):
            self.out.append([(doc, a, ids[a : a + size], n)])
        s = n - whole
        if not s:
            return
        h = self.level(s)
        window = self.open[h].pop() if h else []
        self.count[h] -= 1 if h else 0
        window.append((doc, whole, ids[whole:].copy(), n))
        if h + s == size:
            self.out.append(window)
        else:
            self.open[h + s].append(window)
            self.count[h + s] += 1

    def finish(self) -> None:
        """Pour the emptiest open windows into the fullest, then cut the last."""
        left = [(h, w) for h in range(self.size, 0, -1) for w in self.open[h]]
        self.open, self.count = [[] for _ in range(self.size + 1)], np.zeros(self.size + 1, np.int64)
        items = [x for h, w in reversed(left) for x in w]  # of the emptiest first
        kept, spent, total = [], 0, sum(h for h, _ in left)
        # as many of the fullest windows stay as whole windows can be made
        for h, w in left[: total // self.size]:
            kept.append((h, w))
            spent += len(w)
        pour = items[: len(items) - spent]
        for h, w in kept:
            gap = self.size - h
            while gap:
                doc, a, ids, n = pour.pop()
                w.append((doc, a, ids[:gap], n))
                if len(ids) > gap:
                    pour.append((doc, a + gap, ids[gap:], n))
                gap -= min(gap, len(ids))
            self.out.append(w)
        rest = sum(len(x[2]) for x in pour)
        for bit in range(rest.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                w, gap = [], 1 << bit
                while gap:
                    doc, a, ids, n = pour.pop()
                    w.append((doc, a, ids[:gap], n))
                    if len(ids) > gap:
                        pour.append((doc, a + gap, ids[gap:], n))
                    gap -= min(gap, len(ids))
                self.out.append(w)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """One row for each piece: where it lies in its document and in its
    sequence, and its ids (little-endian unsigned 32-bit integers)."""
    vocab = vocab or vocabulary("word_bpe_49k.json")
    ship(df.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        packer, made = Packer(window), 0

        def rows():
            nonlocal made
            cols: list[list] = [[] for _ in range(8)]
            for w in packer.out:
                total, at = sum(len(x[2]) for x in w), 0
                for doc, start, ids, n in w:
                    for c, v in zip(cols, (doc, start, len(ids), ids.astype("<u4").tobytes(), n, first + made, at, total)):
                        c.append(v)
                    at += len(ids)
                made += 1
            packer.out = []
            types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"])

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for a, ids, n in encoder(vocab).encode(*buffers(batch.column(1))):
                ids, offs = with_end(ids, n, end_id)
                for i in range(len(n)):
                    packer.add(docs[a + i], ids[offs[i] : offs[i + 1]])
                yield rows()
        packer.finish()
        yield rows()

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 2048 ids."""
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")
