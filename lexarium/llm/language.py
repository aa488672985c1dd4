"""Language identification by a bidirectional gated recurrent network on bytes.

Two gated recurrent units read a text's bytes, one from each end; the states at
a position give the probabilities of the languages there, and a document's are
the mean over all its positions. The network is trained here, in numpy, by
backpropagation through time, on at most FIT_WINDOWS windows of each language:
the first by a hash of text and place among all windows of all labelled whole
texts, equal texts once. Reading is by windows of SPAN bytes, side by side, so
that one step of the recurrence is one matrix product for thousands of windows;
each position of the whole text is in one window, and states start anew there.

Texts that are null or have no letter are `und` with score 0; so are all texts
if nothing is learnt. Ties go to the first language in order. Null ids, labels
and repeated rows are allowed (a null label teaches nothing); an empty table
gives no rows; columns other than id, text and label are not read, but for
result columns' names, which the result takes over. Long texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexarium.llm._shared import lean, ship, spare, table
from lexarium.llm._words import buffers, mix

FIT_WINDOWS = 2400  # of each language
FIT_LANGS = 64  # beyond, languages share FIT_LANGS * FIT_WINDOWS windows
SPAN, HIDDEN, STEPS, BATCH = 64, 8, 220, 192
UND = "und"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _gate(x: np.ndarray) -> np.ndarray:
    """The logistic function."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class ByteGru:
    """Weights of both directions: emb (256 x 3H: reset, update, candidate),
    u (H x 2H), v (H x H); out (2H x L), bias (L)."""

    def __init__(self, weights: dict[str, np.ndarray], langs: list[str]):
        self.w, self.langs = weights, langs

    @classmethod
    def start(cls, langs: list[str], hidden: int, seed: int) -> ByteGru:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"emb{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            w[f"u{d}"] = rng.normal(0, hidden**-0.5, (hidden, 2 * hidden))
            w[f"v{d}"] = rng.normal(0, hidden**-0.5, (hidden, hidden))
        w["out"] = rng.normal(0, 0.3, (2 * hidden, len(langs)))
        w["bias"] = np.zeros(len(langs))
        return cls({k: v.astype(np.float32) for k, v in w.items()}, langs)

    def _run(self, x: np.ndarray, d: str, keep: bool, live: np.ndarray | None = None):
        """States at each position (time x windows x H) of windows x (time x
        windows) of bytes, and what backpropagation needs. live: how many of the
        windows, the first ones, reach each position (None: all)."""
        emb, u, v = (self.w[k + d] for k in ("emb", "u", "v"))
        hidden = len(u)
        h, kept = np.zeros((x.shape[1], hidden), np.float32), []
        states = np.zeros((len(x), x.shape[1], hidden), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            n = x.shape[1] if live is None else int(live[t])
            whole, h = h, h[:n]
            e = emb[x[t, :n]]
            gates = h @ u
            gates += e[:, : 2 * hidden]
            gates = _gate(gates)
            r, z = gates[:, :hidden], gates[:, hidden:]
            c = (r * h) @ v
            c += e[:, 2 * hidden :]
            np.tanh(c, out=c)
            if keep:
                kept.append((t, h, r, z, c))
            h = c + z * (h - c)
            states[t, :n] = h
            if n < len(whole):
                whole[:n] = h
                h = whole
        return states, kept

    def probabilities(self, x: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
        """time x windows x languages."""
        logits = self._run(x, "f", False, live)[0] @ self.w["out"][: len(self.w["vf"])]
        logits += self._run(x, "b", False, live)[0] @ self.w["out"][len(self.w["vf"]) :]
        logits += self.w["bias"]
        logits -= logits.max(2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(2, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy at all positions; y: label of each window."""
        hidden = len(self.w["vf"])
        runs = {d: self._run(x, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        logits = both @ self.w["out"] + self.w["bias"]
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(len(y)), y] -= 1
        p /= x.size
        flat = both.reshape(-1, 2 * hidden)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["out"], g["bias"] = flat.T @ p.reshape(len(flat), -1), p.sum((0, 1))
        back = p @ self.w["out"].T
        for d, own in (("f", back[:, :, :hidden]), ("b", back[:, :, hidden:])):
            u, v = self.w["u" + d], self.w["v" + d]
            dh = np.zeros((x.shape[1], hidden), np.float32)
            emb = np.empty((len(x), x.shape[1], 3 * hidden), np.float32)
            for t, h, r, z, c in reversed(runs[d][1]):
                dh = dh + own[t]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                drh = dc @ v.T
                dr = drh * h * r * (1 - r)
                gates = np.concatenate([dr, dz], 1)
                g["u" + d] += h.T @ gates
                g["v" + d] += (r * h).T @ dc
                emb[t, :, : 2 * hidden], emb[t, :, 2 * hidden :] = gates, dc
                dh = dh * z + drh * r + gates @ u.T
            order = np.argsort(x.ravel(), kind="stable")
            seen, first = np.unique(x.ravel()[order], return_index=True)
            g["emb" + d][seen] = np.add.reduceat(emb.reshape(-1, 3 * hidden)[order], first, 0)
        return g

    @classmethod
    def fit(cls, windows: np.ndarray, labels: np.ndarray, langs: list[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, seed: int = 5) -> ByteGru:
        """Adam on random windows (rows of bytes), languages in equal shares."""
        net, rng = cls.start(langs, hidden, seed), np.random.default_rng(seed)
        of = [np.flatnonzero(labels == i) for i in range(len(langs))]
        m, s = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            rows = np.concatenate([rng.choice(o, -(-batch // len(of))) for o in of])
            g = net.gradients(np.ascontiguousarray(windows[rows].T), labels[rows])
            rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in g.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v * v
                net.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return net

    def pool(self, data: np.ndarray, offs: np.ndarray, span: int = SPAN, side: int = 2048) -> np.ndarray:
        """Mean probabilities over all positions of each text (0 if empty)."""
        size = np.diff(offs)
        n = -(-size // span)
        of = np.repeat(np.arange(len(size)), n)
        first = np.repeat(offs[:-1] - (np.cumsum(n) - n) * span, n) + np.arange(len(of)) * span
        length = np.minimum(span, offs[1:][of] - first)
        out = np.zeros((len(size), len(self.langs)))
        steps = np.arange(span)[:, None]
        # the longest first, so those that reach a position stand together
        order = np.argsort(-length, kind="stable")
        for i in range(0, len(order), side):
            own = order[i : i + side]
            longest = int(length[own[0]])
            at = steps[:longest]
            inside = at < length[own]
            x = data[first[own] + np.minimum(at, length[own] - 1)]
            p = self.probabilities(x, inside.sum(1))
            p *= inside[:, :, None]
            total = p.sum(0)
            for j in range(total.shape[1]):
                out[:, j] += np.bincount(of[own], total[:, j], len(size))
        return out / np.maximum(size, 1)[:, None]


def _sampled(rows: DataFrame, rates: dict[str, float]) -> DataFrame:
    """lang, u, piece: windows of whole texts whose hash u lies below the rate of
    their language. Equal texts give the same windows, which count once."""
    sent = rows.sparkSession.sparkContext.broadcast(rates)

    def run(batches):
        for batch in batches:
            data, offs = buffers(batch.column(1))
            h = np.asarray(batch.column(2)).astype(np.int64).view(np.uint64)
            for i, lang in enumerate(batch.column(0).to_pylist()):
                raw, rate = data[offs[i] : offs[i + 1]], sent.value.get(lang, 0.0)
                n = -(-len(raw) // SPAN)
                u = mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLD ^ h[i]) >> np.uint64(1)
                at = np.flatnonzero(u < rate * 2.0**63)
                if len(at):
                    pieces = [raw[x : x + SPAN].tobytes() for x in (at * SPAN).tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(u[at].astype(np.int64)), pa.array(pieces, pa.binary())], ["lang", "u", "piece"])

    some = rows.mapInArrow(lean(run), "lang string, u bigint, piece binary")
    return some.groupBy("lang", "u").agg(F.min("piece").alias("piece"))


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_windows: int = FIT_WINDOWS) -> ByteGru | None:
    """The network, from rows where `usable` holds; None if there are none. All
    labels are learnt, beyond FIT_LANGS of them from fewer windows each."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    # one pass counts, one samples, whatever the number of labels
    count = rows.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("text") / F.lit(SPAN))).alias("n")).where("n > 0").collect()
    if not count:
        return None
    share = min(fit_windows, max(1, FIT_LANGS * fit_windows // len(count)))
    rates = {r.lang: min(1.0, 4.0 * (share + 8) / r.n) for r in count}
    some = _sampled(rows.select("lang", "text", F.xxhash64("text").alias("h")), rates)
    some = some.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("u"))).where(F.col("nth") <= share)
    found = sorted((r.lang, r.u, bytes(r.piece)) for r in some.collect())  # fit_windows of each label
    langs = sorted({x for x, *_ in found})
    windows = [np.resize(np.frombuffer(p, np.uint8), SPAN) for *_, p in found]
    return ByteGru.fit(np.stack(windows), np.array([langs.index(x) for x, *_ in found]), langs) if found else None


def predict(docs: DataFrame, net: ByteGru | None, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two more columns: the language and the pooled probability of
    it. Columns of docs that have these names are replaced."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(*names)
    if net is None:
        return docs.withColumn(names[0], F.lit(UND)).withColumn(names[1], F.lit(0.0))
    sent = spark.sparkContext.broadcast((net.w, net.langs))  # a few kB
    rows = docs.withColumn(spare(docs, "letters")[0], F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    place = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches):
        own = ByteGru(*sent.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                ok = np.asarray(some.column(some.num_columns - 1).to_numpy(zero_copy_only=False)).astype(bool)
                p = own.pool(*buffers(some.column(place)))
                best = p.argmax(1)
                lang = pa.array([own.langs[j] if k else UND for j, k in zip(best.tolist(), ok.tolist())], pa.string())
                score = pa.array(np.where(ok, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0))
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], lang, score], names=[*some.schema.names[:-1], *names])

    return rows.mapInArrow(lean(run), schema)


def held_out(id_col: str, mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learnt from four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 5, 0)
    found = predict(docs.select("doc_id", "text"), train(docs, ~out & F.col("doc_id").isNotNull()))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
