"""Benchmark decontamination: test n-grams in a hash set, scanned for in documents.

Words are runs of digits, letters and characters outside ASCII, with A-Z in
lower case. Each item gives its windows of 13 consecutive words; an item of
fewer words (but not none) is one window. The windows' hashes are sent to all
tasks; each window of a document is looked up, hits are compared word by word,
and every word inside an occurrence counts as hit.

The set is broadcast only while the items' text stays under SET_BYTES. Beyond,
the items are dealt into blocks of that size, written to the shared folder, and
each batch of documents is scanned with one block in memory after the other.

Null texts have no words; an item without words has no window. Items with a
null item_id hit words but are named nowhere; repeated items are named once.
Rows of documents are judged one by one, repeated or not; an empty table gives
no rows; other columns are not read (`keep_clean` hands them on). Long texts are
scanned whole.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm._shared import fresh, lean, open_shared, publish, ship, table
from lexarium.llm._words import ALNUM, LOWER, buffers, chunks, find_words, hash_ranges, window_at, windows

WINDOW = 13
SET_BYTES = 16 << 20


class Grams:
    """The windows of some items, by length: sorted hashes, and for each the
    windows' words and items."""

    def __init__(self, items: list[tuple[str | None, str | None]], k: int = WINDOW):
        self.k, self.names = k, [x for x, _ in items]
        found: dict[tuple[int, int], dict[bytes, set[int]]] = {}
        data, offs = buffers(pa.array([t for _, t in items], pa.string()))
        starts, ends, doc = find_words(data, offs, ALNUM)
        h = hash_ranges(data, starts, ends, LOWER)
        raw = LOWER[data].tobytes() if len(data) else b""
        n_words = np.bincount(doc, minlength=len(items))
        first = np.concatenate([[0], np.cumsum(n_words)])
        for i, n in enumerate(n_words.tolist()):
            size = min(n, k)
            at = np.arange(first[i], first[i] + max(0, n - k) + 1) if n else np.zeros(0, np.int64)
            for j, g in zip(at.tolist(), window_at(h, at, size).tolist()):
                words = b" ".join(raw[starts[x] : ends[x]] for x in range(j, j + size))
                found.setdefault((size, g), {}).setdefault(words, set()).add(i)
        self.sizes = sorted({s for s, _ in found})
        self.keys = {s: np.array(sorted(g for z, g in found if z == s), np.uint64) for s in self.sizes}
        self.found = found

    def scan(self, data: np.ndarray, starts, ends, doc, h, hit: np.ndarray, items: dict[int, set]) -> None:
        """Marks the hit words, and adds to each text's items."""
        for size in self.sizes:
            at, g = windows(h, doc, size)
            keys = self.keys[size]
            place = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            same = keys[place] == g
            for j, key in zip(at[same].tolist(), g[same].tolist()):
                words = b" ".join(LOWER[data[starts[x] : ends[x]]].tobytes() for x in range(j, j + size))
                if own := self.found[size, key].get(words):
                    hit[j : j + size] = True
                    items.setdefault(int(doc[j]), set()).update(self.names[i] for i in own)


def _blocks(bench: DataFrame, id_col: str, text_col: str, k: int):
    """A function that gives the Grams one after the other, in any worker."""
    spark = bench.sparkSession
    rows = bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    held = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    if held <= SET_BYTES:
        sent = spark.sparkContext.broadcast(Grams([tuple(r) for r in rows.collect()], k))
        return lambda: iter((sent.value,))
    n = -(-2 * held // SET_BYTES)
    paths = []
    for b in range(n):
        some = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).toLocalIterator()
        paths.append(f"{fresh(spark, 'grams')}/{b}")
        publish(paths[-1], pickle.dumps(Grams([tuple(r) for r in some], k)))

    def load():
        for p in paths:
            with open_shared(p, "rb") as f:
                yield pickle.loads(f.read())

    return load


def _judge(col, load, share: int):
    """Of each text: words, hit words, items, merged spans of words."""
    data, offs = buffers(col)
    for a, b, part, o in chunks(data, offs):
        starts, ends, doc = find_words(part, o, ALNUM)
        h = hash_ranges(part, starts, ends, LOWER)
        hit, items = np.zeros(len(h), bool), {}
        for grams in load():
            grams.scan(part, starts, ends, doc, h, hit, items)
        n_words = np.bincount(doc, minlength=b - a)
        n_hit = np.bincount(doc[hit], minlength=b - a)
        first = np.concatenate([[0], np.cumsum(n_words)])
        spans = [[] for _ in range(b - a)]
        for i in items:
            own = np.concatenate([[0], hit[first[i] : first[i + 1]].astype(np.int8), [0]])
            turn = np.flatnonzero(np.diff(own))
            spans[i] = [{"first": int(x), "last": int(y) - 1} for x, y in zip(turn[::2], turn[1::2])]
        yield n_words, n_hit, [sorted(x for x in items.get(i, ()) if x is not None) for i in range(b - a)], spans, (n_hit > 0) & (share * n_hit >= n_words)


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = WINDOW, share: int = 20) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, items (sorted as
    strings), spans (of words, from 0), contaminated (at least one word in
    `share` is hit)."""
    ship(docs.sparkSession)
    load = _blocks(bench, item_col, item_text_col, k)

    def run(batches):
        for batch in batches:
            at = 0
            for n_words, n_hit, items, spans, bad in _judge(batch.column(1), load, share):
                span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n_words)), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span), pa.array(bad)], ["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"])
                at += len(n_words)

    schema = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<first:bigint,last:bigint>>, contaminated boolean"
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)


def keep_clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = WINDOW, share: int = 20) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    ship(docs.sparkSession)
    load = _blocks(bench, item_col, item_text_col, k)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            bad = [x[-1] for x in _judge(batch.column(place), load, share)]
            if bad:
                yield batch.filter(pa.array(~np.concatenate(bad)))

    return docs.mapInArrow(lean(run), docs.schema)


def cut_spans(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Documents with their hit words taken out, the other words joined by a
    blank: doc_id, text, n_hit. Texts without hits stay as they are."""
    ship(docs.sparkSession)
    load = _blocks(bench, how.get("item_col", "item_id"), how.get("item_text_col", "text"), how.get("k", WINDOW))

    def run(batches):
        for batch in batches:
            texts, at = batch.column(1), 0
            for n_words, n_hit, _, spans, _ in _judge(texts, load, 20):
                out = []
                for i in range(len(n_words)):
                    text = texts[at + i].as_py()
                    if spans[i]:
                        data, offs = buffers(pa.array([text]))
                        s, e, _ = find_words(data, offs, ALNUM)
                        gone = np.zeros(len(s), bool)
                        for x in spans[i]:
                            gone[x["first"] : x["last"] + 1] = True
                        raw = data.tobytes()
                        text = b" ".join(raw[x:y] for x, y, g in zip(s, e, gone) if not g).decode()
                    out.append(text)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(out)), pa.array(out, pa.string()), pa.array(n_hit, pa.int64())], ["doc_id", "text", "n_hit"])
                at += len(out)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id bigint, text string, n_hit bigint")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
s AS (SELECT item_id, least(len(ws), 13) AS k, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i, ws FROM b WHERE len(ws) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS t FROM s),
w AS (SELECT r, k, unnest(range(1, len(ws) - k + 2)) AS i, ws FROM d CROSS JOIN (SELECT DISTINCT k FROM g) WHERE len(ws) >= k),
m AS (SELECT w.r, w.i, w.k, g.item_id FROM (SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS t FROM w) w JOIN g ON w.k = g.k AND w.t = g.t),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, i, k FROM m)) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN n ON d.r = n.r
"""
