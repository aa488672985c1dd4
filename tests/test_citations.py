from pyspark.sql import functions as F
from test_actors import each

from lexarium.functions import citations as C
from lexarium.operators.corpus import clean_and_drop


def test_citation(spark):
    got = each(spark, C.citation, ("Müller J, 2018, NAT COMMUN, V15",), ("Roe, 1999",), ("Roe, in press",), (", 1999",), ("Roe",), ("Roe, 19999",), (None,))
    assert [g and tuple(g) for g in got] == [("muller", 2018, "NAT COMMUN"), ("roe", 1999, None), None, None, None, None, None]


def test_names_and_journals(spark):
    assert each(spark, C.first_author, ("O'Neil, J; Doe",), ("Čech J",), ("",), (",x",), (None,)) == ["oneil", "cech", None, None, None]
    assert each(spark, C.journal, ("Nat. Commun",), (None,)) == ["nat  commun", None]


def test_titles_and_labels(spark):
    assert each(spark, C.cleaned_title, ("It’s a B-2 Étude ",), (None,)) == ["it's a b tude", None]
    assert each(spark, lambda c: C.short_label(c, 6), ("abcdef",), ("abcd efg",), (None,)) == ["abcdef", "abcd…", None]
    assert each(spark, C.file_stem, ("10.1/a(b)-é",)) == ["10_1_a_b_-é"]
    assert each(spark, C.combine_hyphens, ("a-b  c",)) == ["ab c"] and each(spark, C.remove_punctuation, ("a.b_[c]~ é’",)) == ["abc é’"]


def test_reviews(spark):
    rows = [("Review; Early Access", None), ("Article", "A Review of x"), ("article", "Peer-review of x"), ("peer-review", "A review"), (None, None), ("Reviewed", "x")]
    assert each(spark, C.is_review, *rows) == [True, True, False, False, False, False]
    assert each(spark, lambda k, t: C.is_review(k, t, "type"), *rows) == [True] + [False] * 5


def test_keys(spark):
    rows = [("W12",), ("https://openalex.org/W1",), ("Roe J, 2020, DOI 10.1000/ab",), ("10.1000/ab",), ("Roe",)]
    assert each(spark, C.is_unkeyed, *rows) == [False, False, True, True, True]
    assert each(spark, C.is_bridgeable, *rows) == [False, False, True, True, False]


def test_clean_and_drop(spark):
    prose = "We show that the method is used in this study. It provides results. " * 3
    df = spark.createDataFrame([(1, prose, "10.1/a.,"), (2, "n/a", "x"), (3, None, None)], "id int, abstract string, doi string")
    assert [(r.id, r.doi, len(r.abstract)) for r in clean_and_drop(df, most=70).collect()] == [(1, "10.1/a", 67)]
    kept = clean_and_drop(df, drop=False).orderBy("id").collect()
    assert [r.abstract for r in kept] == [prose, None, None]
