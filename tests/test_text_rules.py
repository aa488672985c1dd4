import difflib
import random

import duckdb
import pytest
from differential import differences
from pyspark.sql import functions as F

from lexarium.functions import text as T
from lexarium.operators import corpus as C
from lexarium.plans import texts


def column(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", f(F.col("t")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def test_person_names(spark):
    names = ["Pires, Marcelo A.", "Pires M.A.", "Émile Chappin", "Jane Doe", "Plato", "Doe, Jane (Corresponding Author)", "", None, " , x", "de la Cruz J.-P."]
    assert column(spark, names, T.person_norm) == ["pires m", "pires m", "chappin e", "doe j", "plato", "doe j", None, None, None, "de la cruz j"]
    assert column(spark, names[:4], lambda c: T.person_norm(c, False)) == ["pires marcelo a", "pires m a", "chappin emile", "doe jane"]


def test_institutions_and_identities(spark):
    a = ["Korea Advanced Institute of Science & Technology (KAIST)", "The Korea Advanced Institute of Science and Technology", r"A \& B", None, " (x) "]
    assert column(spark, a, T.institution_norm) == ["korea advanced institute of science and technology"] * 2 + ["a and b", None, None]
    assert column(spark, ["https://orcid.org/0000-0002-8333-723x", "0000-0002-8333-7236", "1234", None, ""], T.orcid_key) == ["orcid:0000-0002-8333-723X", "orcid:0000-0002-8333-7236", None, None, None]
    assert column(spark, ["https://ror.org/02WNMK332", ""], T.ror_key) == ["ror:02wnmk332", None]
    assert column(spark, ["https://openalex.org/A5", "A5", None], T.openalex_key) == ["openalex:A5", "openalex:A5", None]


def test_titles_and_dois(spark):
    assert column(spark, ["søren čech: Ünï", "ﬂ", None], T.canonical_title) == ["sren cech uni", "", None]
    doi = "10.1002/(SICI)1096-9845(199908)28:8<879::AID-EQE845>3.0.CO;2-"
    assert column(spark, [doi + "1", doi + "#", "10.1/a+b, x", "10.1/a.;"], T.clean_doi) == [doi + "1", doi + "#", "10.1/a+b", "10.1/a"]


def test_truncation(spark):
    def by_rule(t, most):
        if t is None or len(t) <= most:
            return t
        head, floor = t[:most], int(most * 0.75)
        cut = max(head.rfind(c) for c in ".!?")
        if cut < floor:
            cut = head.rfind(" ") - 1
        if cut < floor:
            cut = most - 1
        return head[: cut + 1].rstrip()

    r = random.Random(1)
    texts = [None, "", "ab " + "x" * 400, *["".join(r.choice("abcd  .") if r.random() < 0.1 else "x" for _ in range(r.randint(20, 60))) for _ in range(400)]]
    assert column(spark, texts, lambda c: T.truncate(c, 40)) == [by_rule(t, 40) for t in texts]


def test_plausible_abstracts(spark):
    texts = [None, "", "  ", "No abstract available.", "(N/A)", "We show that this is a text of the kind and we use it.", "alpha beta gamma delta epsilon zeta eta", "The energy is the heart of it all. It is in the land", "Custom words."]
    assert column(spark, texts, lambda c: T.plausible_abstract(c, garbage=("custom words",))) == [False] * 5 + [True, False, True, False]


def test_indel_ratio():
    r = random.Random(2)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    for _ in range(200):
        a, b = ("".join(r.choice("abcé ") for _ in range(r.randint(0, 30))) for _ in range(2))
        want = 100.0 if not a and not b else 200 * longest(a, b) / (len(a) + len(b))
        assert C.indel_ratio(a, b) == pytest.approx(want)
    assert C.indel_ratio("same", "same") == 100 and difflib is not None


def test_merge_in_order_of_priority(spark):
    schema = "id string, doi string, title string"
    alex = spark.createDataFrame([("OA1", "10.1000/a", "shared paper on coupling networks"), ("OA2", "10.1000/b", "openalex only paper about topics")], schema)
    wos = spark.createDataFrame([("WOS1", "10.1000/a", "another title altogether"), ("WOS9", "10.1000/z", "wos only paper about references"), ("WOS2", None, "openalex only paper about topic"), ("WOS3", None, None)], schema)
    keys, title = [F.col("doi"), F.col("title")], F.col("title")
    kept, gone = C.merge_all([alex, wos], "id", keys, title, 90.0)
    assert {r.id for r in kept.collect()} == {"OA1", "OA2", "WOS9", "WOS3"}
    assert {(r.dropped, r.kept) for r in gone.collect()} == {("WOS1", "OA1"), ("WOS2", "OA2")}
    kept, gone = C.merge_all([wos, alex], "id", keys, title, 90.0)
    assert {r.id for r in kept.collect()} == {"WOS1", "WOS2", "WOS9", "WOS3"} and {(r.dropped, r.kept) for r in gone.collect()} == {("OA1", "WOS1"), ("OA2", "WOS2")}
    assert {r.id for r in C.merge_all([alex, wos], "id", keys)[0].collect()} == {"OA1", "OA2", "WOS2", "WOS9", "WOS3"}


@pytest.mark.parametrize("n", [1, 3, 8])
def test_strata_by_hand(spark, n):
    r = random.Random(n)
    for count in (0, 5, 37, 64):
        rows = [(r.choice([1, 2, 2, 2, 9, None]), i) for i in range(count)]
        got = {x.k: x.stratum for x in C.strata(spark.createDataFrame(rows, "s int, k int"), "s", "k", n).collect()}
        order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        want, at = {}, 0
        for t in range(n):
            size = count // n + (t < count % n)
            want |= {k: t + 1 for _, k in order[at : at + size]}
            at += size
        assert got == want


def test_identity_keys_beyond_four_digits(spark, tmp_path):
    keys = [0, 3, 9999, 10002, 10005, 99999, 899997, 10**6]
    spark.createDataFrame([(k, f"Customer#{k:09d}") for k in keys], "c_custkey bigint, c_name string").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.c_custkey: r for r in texts.identity_keys(spark, str(tmp_path)).collect()}
    assert {k for k, r in got.items() if r.orcid} == {0, 3, 9999}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert not differences(texts.identity_keys(spark, str(tmp_path)), con, texts.ORACLE["identity_keys"])
