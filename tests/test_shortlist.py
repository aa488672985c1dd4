import random

from pyspark.sql import functions as F

from lexarium.operators import corpus as C


def by_hand(left, right, n, most):
    def grams(t):
        w = t.split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {(x,) for x in w}

    held = [(b, grams(t)) for b, t in right]
    out = set()
    for a, t in left:
        own = grams(t)
        found = sorted((-len(own & g), b) for b, g in held if own & g)[:most]
        out |= {(a, b, -m, r) for r, (m, b) in enumerate(found, 1)}
    return out


def test_passage_in_more_than_a_thousand_rows(spark):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice("abcdef") for _ in range(n))
    passage = " ".join(f"w{i}" for i in range(20))
    left = [(0, passage), (1, text(30)), (2, passage[:40] + " " + text(10)), (3, "one two"), (4, "nowhere at all")]
    right = [(i, f"{text(8)} {passage if i % 3 else passage[:30]} {i}") for i in range(1800)] + [(1800 + i, text(60)) for i in range(40)] + [(1900, "two"), (1901, "")]
    make = lambda rows: spark.createDataFrame(rows, "id bigint, t string")
    got = C.shortlist(make(left), make(right), "id", F.col("t"), 3, 5).collect()
    assert {(x.a, x.b, x.overlap, x["rank"]) for x in got} == by_hand(left, right, 3, 5)
