import random

import corpus_pipeline
from lexarium.llm import registry

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        docs = out.persist()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_stages_by_hand(spark):
    """Which documents stay, by plain comparisons of all texts."""
    from test_repeats import classes_by_hand, contaminated_by_hand

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    lang, near, clean, _, _ = (stage for _, stage in corpus_pipeline.STAGES)
    assert {r.doc_id for r in lang(spark, docs, SF).collect()} == {i for i, t in rows.items() if any(c.isalpha() for c in t or "")}
    ids = sorted(rows)
    classes = classes_by_hand([rows[i] for i in ids])
    worded = [i for i, t in rows.items() if any(c.isalnum() or ord(c) > 127 for c in t or "")]
    want = {i for i, c in zip(ids, classes) if ids[c] == i or i not in worded}
    assert {r.doc_id for r in near(spark, docs, SF).collect()} == want
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = contaminated_by_hand([rows[i] for i in ids], items)
    assert {r.doc_id for r in clean(spark, docs, SF).collect()} == {i for i, b in zip(ids, bad) if not b[3]}


def test_odd_tables(spark):
    """Null and repeated ids, no labels, empty tables, and columns named like those that operators use."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, lang_pred string, pii_found string, __hits string, tag string, alone string"
    rows = [(None, "plain words of one text", None), (7, "other words", None), (7, "third one of them", None), (8, None, None), (9, "", None), (9, "", None), (10, "long " * 30000, None)]
    docs = spark.createDataFrame([(i, t, x, "s", len(t or ""), "a", "b", "c", "d", "e", "f") for i, t, x in rows], schema).repartition(3)
    for frame in (docs, docs.where("false")):
        columns, n = frame.columns, frame.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == columns, name
            held = out.collect()
            # the two empty rows of one id are no near copies: they have no words
            assert len(held) == n and all((r.score, r.lang_pred, r.pii_found, r["__hits"], r.tag, r.alone) == tuple("abcdef") for r in held), name
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() >= n
    known = docs.withColumn("lang", __import__("pyspark").sql.functions.lit("en"))
    kept = corpus_pipeline.identify_language(spark, known, SF).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 7, 7, 10] and all(r.score == "a" for r in kept)


def test_registry():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{i}" for i in range(1, 11)]


def test_near_duplicates_with_null_and_repeated_ids(spark, documents):
    r = random.Random(8)
    a, b, c, d, e = ("".join(r.choice("abcdefgh ") for _ in range(600)) for _ in range(5))
    rows = [(None, a), (None, b), (None, a + " x"), (7, c), (7, d), (7, c), (8, d + " y"), (None, e), (9, e + " z"), (5, None), (5, ""), (None, None), (None, "!"), (None, "!")]
    docs = documents([t for _, t in rows], [i for i, _ in rows])
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    got = [(x.doc_id, x.text) for x in out.collect()]
    of_a = [x for x in got if x in (rows[0], rows[2])]
    assert len(of_a) == 1
    want = [*of_a, (None, b), (7, c), (7, d), (9, e + " z"), *rows[9:]]
    assert sorted(got, key=str) == sorted(want, key=str)
