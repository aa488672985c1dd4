import json

import pytest
from pyspark.sql import functions as F
from test_actors import each

from lexarium.functions import replies as J
from lexarium.operators import cost as M
from lexarium.operators import ranking as R
from lexarium.operators import seeds as S
from lexarium.operators import sweeps as G
from lexarium.sources import wos_records as W


def test_wos_records(spark, tmp_path):
    static = {
        "summary": {
            "titles": {"title": {"type": "item", "content": "T"}},
            "languages": {"language": ["German", {"type": "other", "content": "x"}]},
            "doctypes": {"doctype": ["Review", "Article"]},
            "pub_info": {"pubyear": 2020},
            "names": {"name": [{"role": "editor", "full_name": "Ed"}, {"full_name": "Roe, K", "data-item-ids": {"data-item-id": [{"id-type": "OtherORCID", "content": "0000-0001-0000-0001"}, {"id-type": "PreferredORCID", "content": "0000-0002-1825-0097"}]}}, {"display_name": "Doe, J"}]},
        },
        "fullrecord_metadata": {
            "references": {"reference": [{"uid": "WOS:9"}, {"uid": None}, "x"]},
            "addresses": {"address_name": [{"address_spec": {"full_address": "Dept X, Univ Y, Paris, France"}}, {"address_spec": {"country": "USA", "organizations": {"organization": [{"content": "Sub", "pref": "Y", "level": 2}, {"content": "Top", "pref": "Y", "level": 1, "ror_id": "https://ror.org/05abc1234"}]}}}, "odd"]},
        },
    }
    rows = [{"UID": "1", "static_data": static, "dynamic_data": {"citation_related": {"tc_list": {"silo_tc": {"local_count": "7"}}}}}, {"UID": "2", "static_data": {"summary": {"titles": {"title": None}}}, "dynamic_data": {"citation_related": {"tc_list": {"silo_tc": [{"coll_id": "WOS", "local_count": "x"}, {"coll_id": "WOK", "local_count": 3}]}}}}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    one, two = sorted(W.read_wos_json(spark, str(tmp_path / "r.json")).collect(), key=lambda r: r.id)
    assert (one.title, one.journal, one.language, one.document_type, one.year, one.cited_by, one.references) == ("T", None, "German", "Review", 2020.0, 7.0, "WOS:9")
    assert [a.name for a in one.actors.authors] == ["Roe, K", "Doe, J"] and one.actors.authors[0].key.endswith("0000-0002-1825-0097")
    assert [(i.name, i.country) for i in one.actors.institutions] == [("Univ Y", "FR"), ("Top", "US")] and "05abc1234" in one.actors.institutions[1].key
    assert (two.title, two.abstract, two.cited_by, two.actors) == (None, None, None, None)


def test_status(spark):
    rows = [('{"a": "}"}',), ('x [1, 2] y',), ('{"a": [{"b": 1}',), ('{"a": "cut \\" off',), ('{"a" 1}',), ("no",), ("",), (None,)]
    assert each(spark, J.status, *rows) == ["ok", "ok", "truncated", "truncated", "malformed", "none", "none", "none"]


def test_long_answers(spark):
    big = '{"evaluation": 4, "reasoning": "' + 'a \\" b ' * 50000 + '"}'
    (got,) = each(spark, J.evaluations, (big,))
    assert got[0].evaluation == 4 and len(got[0].reasoning) == 6 * 50000
    assert each(spark, J.status, (big[:-2],)) == ["truncated"]


def test_evaluations(spark):
    rows = [('[{"evaluation": 3}]',), ('{"evaluations": [{"evaluation": " 4 ", "reasoning": "r"}]}',), ('{"evaluation": 4.9}',), ('{"evaluation": "4.9"}',), ('{"reasoning": "r"}',), ("[]",), ("3",), (None,)]
    got = each(spark, J.evaluations, *rows)
    assert [g if g is None else [tuple(x) for x in g] for g in got] == [[(3, "")], [(4, "r")], [(4, "")], [(None, "")], [(None, "r")], [], None, None]
    assert each(spark, lambda c: J.complete(J.evaluations(c), 1), *rows) == [True, True, True, False, False, False, False, False]


def test_prompts(spark):
    df = spark.createDataFrame([("t", None, 3), (None, None, None)], "title string, abstract string, year int")
    assert [r[0] for r in df.select(J.prompt_text("title", "abstract", "year")).collect()] == ["title: t\nyear: 3", ""]
    assert [r[0] for r in df.select(J.reference_text(F.col("title"), F.col("abstract"), F.lit("v "))).collect()] == ["t. v", "v"]


def test_seeds(spark):
    assert each(spark, S.normalise_seed, (" w12 ",), ("https://openalex.org/W3",), ("https://doi.org/10.1000/AB",), ("x",), (None,)) == ["W12", "W3", "doi:10.1000/ab", None, None]
    works = spark.createDataFrame([("W1", "10.1000/a", "Deep sea mud", "", 2000, 1), ("W2", None, "mud of the deep sea", None, 2001, 5), ("W3", None, None, None, 2002, 9), ("W4", None, "x", "y", None, 2)], "id string, doi string, title string, abstract string, year int, cited int")
    edges = spark.createDataFrame([("W2", "W1"), ("W3", "W1"), ("W3", "W1"), ("W1", "W4"), ("W1", "W77")], "src string, dst string")
    seeds = spark.createDataFrame([("https://doi.org/10.1000/A",), ("W1",), ("W99",), ("odd",)], "seed string")
    pool, missing = S.expand(works, edges, seeds, ['"deep sea"', "sea, Deep", ""], most=1, most_query=1)
    assert {r.id: tuple(r)[1:] for r in pool.collect()} == {"W1": (True, False, False, False), "W3": (False, True, False, False), "W4": (False, False, True, False), "W2": (False, False, False, True)}
    assert sorted(r.seed for r in missing.collect()) == ["W99", "odd"]
    assert tuple(S.counts(pool).first()) == (1, 1, 1, 1, 4)
    assert S.forward(works, edges, works.where("id = 'W1'"), first=2001, last=2001).collect()[0].id == "W2"
    assert S.expand(works, edges, seeds.limit(0))[0].count() == 0


def test_budget():
    assert R.allocate_budget([100, 25, 4], 10) == [6, 3, 1]
    assert R.allocate_budget([100, 25, 4], 10, rule="linear", floor=1) == [7, 2, 1]
    assert R.allocate_budget([100, 1, 1], 50, ceiling=10) == [10, 1, 1]
    assert R.allocate_budget([9, 9, 9], 2, floor=1) == [1, 1, 1]
    assert R.allocate_budget([], 5) == [] and R.allocate_budget([0, 4], 9) == [0, 4]


def test_reviews(spark):
    df = spark.createDataFrame([(1, "a", 2020, 0), (2, "a", 2019, 9), (3, "a", 2010, 50), (4, "a", 2015, 40), (5, "a", None, None), (6, "b", 2000, None)], "id int, t string, year int, cited int")
    got = {(r.t, r.cohort, r.place): r.id for r in R.pick_reviews(df, "t", 2020, most_recent=1, most=2).collect()}
    assert got == {("a", "recent", 1): 1, ("a", "ranked", 1): 3, ("a", "ranked", 2): 4, ("b", "ranked", 1): 6}


def test_prices_and_calibration(spark):
    prices = spark.createDataFrame([("m-1", 1.0, 2.0)], "model string, input double, output double")
    ids = spark.createDataFrame([("lab/M-1",), ("m-1-20250101",), ("m-1-2025",), (None,)], "model_id string")
    assert [r.price_in for r in M.with_prices(ids, prices).collect()] == [1.0, 1.0, None, None]
    seen = spark.createDataFrame([("a" * 37, "b" * 37), ("a" * 37, None), ("", None), (None, None)], "x string, y string")
    c = M.calibrate(seen, {("1", "r"): "x", ("2", "s"): "y"})
    assert sorted(tuple(r) for r in c.collect()) == [("1", "r", 28, 0.5), ("2", "s", 28, 0.25)]
    assert M.escalation(c).first()[0] == 0.5 and M.escalation(c.limit(0)).first()[0] == 0.0


def test_estimate(spark):
    docs = spark.createDataFrame([(10,)] * 20, "n int")
    people = spark.createDataFrame([(0, "a", "m", 8, 100, 5, None), (1, "b", "m", 1, 10, 50, 20), (3, "c", "m", 1, 10, 50, 0)], "round int, reviewer string, model_id string, items_per_call int, fixed_tokens int, output_per_item int, max_tokens int")
    prices = spark.createDataFrame([("m", 1.0, 10.0)], "model string, input double, output double")
    g = M.estimate(docs, F.col("n"), people, prices)
    got = {r.reviewer: (r["items"], r.calls, r.tokens_in, r.tokens_out, r.capped, r.cost) for r in g.collect()}
    assert got == {"a": (20, 3, 500, 124, False, pytest.approx(1740e-6)), "b": (2, 2, 40, 40, True, pytest.approx(440e-6))}
    s = {r.items_per_call: (r.calls, r.tokens_in) for r in M.sweep(g, (1, 10)).collect()}
    assert s == {1: (22, 2240), 10: (3, 430)}
    assert M.estimate(docs.limit(0), F.col("n"), people, prices).count() == 0


def test_sweeps(spark):
    assert G.resolution_grid(0.1, 0.4) == [0.1, 0.2, 0.3, 0.4] and G.resolution_grid(2, 1) == [2.0] and G.resolution_grid(1, 2, 0) == [1.0]
    assert G.size_grid(1000, (10, 50)) == (20, 100, 11) and G.size_grid(5, (10, 50)) == (2, 2, 1)
    assert [G.tick_step(2000, y) for y in (2000, 2020, 2021, 2100, 2500)] == [1, 1, 2, 5, 10]
    runs = spark.createDataFrame([("10_1", 30), ("10_5", 20), ("20_9", 12), ("40_9", 0)], "hdbscan string, nb_topics int")
    assert G.aim_again(runs, (20, 30), 3) == [9, 11, 13] and G.aim_again(runs.where("nb_topics = 0"), (20, 30)) is None
    assert G.in_band(runs, (10, 15)).count() == 1 and G.in_band(runs, (99, 100)).count() == 4 and G.has_in_band(runs, None)
    assert [tuple(r) for r in G.unused_samples(runs.where("nb_topics = 30"), runs).collect()] == [(1, 9)]
    assert G.unused_samples(runs.where("nb_topics = 12"), runs).isEmpty()
