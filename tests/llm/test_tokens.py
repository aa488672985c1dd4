import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lexarium.llm import _tokens as K
from lexarium.llm import packing, wavelet
from lexarium.llm._tokens import vocabulary
from lexarium.llm._words import buffers

TEXTS = ["", None, "plain words here", "it's  two\n\nblanks   wide x", " lead and trail \n", "é à è ñ", "<|endoftext|> a", "x" * 5000, "long text of words " * 3000, "tie", "tie", "Ünï 12 ab3\t\r\n?!"]


def frame(spark, texts=TEXTS):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.StringType()), T.StructField("ids", T.StringType())])
    return spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(texts)], schema).repartition(3)


def brute(name, end):
    tok = Tokenizer.from_file(vocabulary(name))
    tok.encode_special_tokens = True
    return {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], np.uint32) for i, t in enumerate(TEXTS)}


def test_pieces_cover_documents_once(spark):
    rows = packing.pack(frame(spark)).collect()
    want = brute("word_bpe_49k.json", 1)
    for doc, ids in want.items():
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        assert b"".join(bytes(r.ids) for r in own) == ids.astype("<u4").tobytes()
        assert {r.doc_tokens for r in own} == {len(ids)}


def test_sequences_are_gapless_and_need_no_padding(spark):
    by = {}
    for r in packing.pack(frame(spark)).collect():
        by.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_tokens))
    for pieces in by.values():
        at = 0
        for offset, length, total in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == total <= 2048 and at & (at - 1) == 0


def test_level_minimises_squared_counts():
    rng = np.random.default_rng(3)
    p = packing.Packer(20)
    for i in range(300):
        s = int(rng.integers(1, 20))
        h = p.level(s)

        def squares(level, s=s):
            c = p.count.copy()
            if level:
                c[level] -= 1
            if level + s < 20:
                c[level + s] += 1
            return int((c[1:20] ** 2).sum())

        options = [0, *[x for x in range(1, 20 - s + 1) if p.count[x]]]
        assert squares(h) == min(map(squares, options))
        p.add(i, np.arange(s, dtype=np.uint32))
    p.finish()
    assert all(sum(len(x[2]) for x in w) == 20 for w in p.out[:-5])


def test_empty_tables(spark):
    assert packing.pack(frame(spark, [])).count() == 0
    assert wavelet.read_shards(wavelet.write_shards(frame(spark, []))).count() == 0


def test_files_give_back_all_documents(spark):
    manifest = wavelet.write_shards(frame(spark), shard_tokens=2000)
    assert manifest.count() > 2
    rows = sorted(wavelet.read_shards(manifest).collect())
    want, start = brute("byte_bpe_50k.json", 0), 0
    assert [r.doc_id for r in rows] == sorted(want)
    for r in rows:
        assert (r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) == (start, len(want[r.doc_id]), zlib.crc32(want[r.doc_id].astype("<u4").tobytes()))
        start += r.n_tokens


@pytest.mark.parametrize("n,top", [(0, 1), (1, 5), (700, 3), (2500, 60000)])
def test_wavelet_matrix_queries(n, top):
    rng = np.random.default_rng(n)
    a = rng.integers(0, top, n).astype(np.uint32)
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(a, np.array([7]), np.array([n])).to_bytes())
    assert m.tokens().tolist() == a.tolist()
    for i in rng.integers(0, n, 20) if n else []:
        token = int(a[i])
        assert m.access(int(i)) == token
        assert m.rank(token, int(i)) == int((a[:i] == token).sum())
        assert m.occurrences(token)[:50] == np.flatnonzero(a == token)[:50].tolist()
    assert m.count(1 << 20) == 0 and m.count(top) == 0
    with pytest.raises(IndexError):
        m.select(top, 0)


def test_encoder_in_bounded_memory():
    r = np.random.default_rng(5)
    texts = [" ".join("".join(map(chr, r.integers(97, 123, 6))) for _ in range(400)) for _ in range(1500)]  # 4 MB of one batch
    coder, col = K.Encoder(K.vocabulary("word_bpe_49k.json")), pa.array(texts)
    tracemalloc.start()
    try:
        got, first = {}, []
        for a, ids, n in coder.encode(*buffers(col)):
            first.append(a)
            got[a] = ids[: n[0]]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(first) > 4 and peak < 100 << 20
    for a in first[:3]:
        assert got[a].tolist() == coder.tok.encode(texts[a], add_special_tokens=False).ids
