import hashlib
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarium.llm import language, pii, quantisation, toxicity
from lexarium.llm._shared import table

SF = "/root/testdata/sf0.01"


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    net = language.ByteGru.start(["a", "b", "c"], 4, 2)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = rng.integers(60, 70, (7, 5)), rng.integers(0, 3, 5)

    def loss():
        p = net.probabilities(x)
        return -np.log(p[:, np.arange(5), y]).mean()

    g = net.gradients(x, y)
    for k, v in net.w.items():
        i = tuple(rng.integers(0, s) for s in v.shape) if not k.startswith("emb") else (int(x[3, 2]), 1)
        v[i] += 1e-3
        up = loss()
        v[i] -= 2e-3
        down = loss()
        v[i] += 1e-3
        assert g[k][i] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-4), k


def test_languages_held_out(spark):
    docs = table(spark, SF, "documents")
    rows = language.op7_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_texts(documents):
    docs = documents([None, "", "123 !?", "abc " * 5000, "le la", "x", "x"], langs=[None, "en", "en", "en", "fr", "fr", "fr"])
    rows = {r.doc_id: r for r in language.predict(docs, language.train(docs, F.lit(True))).collect()}
    assert [rows[i].lang_pred for i in range(3)] == ["und"] * 3 and rows[0].score == 0
    assert rows[3].lang_pred == "en" and rows[5].lang_pred == rows[6].lang_pred and rows[3].bucket == "clash"
    assert language.train(docs, F.lit(False)) is None and language.train(documents([]), F.lit(True)) is None
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}
    assert language.predict(documents([]), None).count() == 0


def test_all_labels_are_learnt(documents):
    langs = [f"l{i:03}" for i in range(70)]
    docs = documents([f"words of {x}" for x in langs], langs=langs)
    assert language.train(docs, docs.doc_id.isNotNull()).langs == langs


def test_result_names_and_schema(spark):
    docs = spark.createDataFrame([(1, "some words", "en", "x", 7), (2, "des mots", "fr", "y", 8)], "doc_id bigint, text string, lang string, lang_pred string, score int")
    before = docs.columns
    net = language.train(docs, F.lit(True))
    out = language.predict(docs, net)
    assert docs.columns == before and out.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and dict(out.dtypes)["score"] == "double"
    assert language.predict(docs, net, names=("a", "b")).columns == [*before, "a", "b"]
    assert {r.lang_pred for r in out.collect()} <= {"en", "fr"}


def test_pool_by_hand():
    """Position after position, one text at a time."""
    rng = np.random.default_rng(8)
    net = language.ByteGru.start(["a", "b", "c"], 4, 3)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 63, 64, 65, 300)]

    def gate(v):
        return 1 / (1 + np.exp(-v))

    def states(piece, d):
        h, out = np.zeros(4), {}
        for t in range(len(piece)) if d == "f" else reversed(range(len(piece))):
            e = net.w["emb" + d][piece[t]].astype(float)
            g = gate(h @ net.w["u" + d] + e[:8])
            r, z = g[:4], g[4:]
            h = z * h + (1 - z) * np.tanh((r * h) @ net.w["v" + d] + e[8:])
            out[t] = h
        return out

    want = []
    for t in texts:
        total = np.zeros(3)
        for i in range(0, len(t), language.SPAN):
            piece = t[i : i + language.SPAN]
            f, b = states(piece, "f"), states(piece, "b")
            for j in range(len(piece)):
                x = np.exp(np.concatenate([f[j], b[j]]) @ net.w["out"] + net.w["bias"])
                total += x / x.sum()
        want.append(total / max(1, len(t)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    assert np.allclose(net.pool(data, offs), want, atol=1e-5)


def test_segments_are_maximal():
    rng = np.random.default_rng(4)
    for _ in range(200):
        s = rng.integers(-4, 5, rng.integers(1, 25)).astype(float)
        found = toxicity.segments(s)
        best = max([0.0, *[s[i:j].sum() for i in range(len(s)) for j in range(i + 1, len(s) + 1)]])
        assert max([0.0, *[v for *_, v in found]]) == best
        assert all(v == s[a:b].sum() > 0 for a, b, v in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))
        for a, b, _ in found:  # no part of it is worth more
            assert all(s[a:i].sum() > 0 for i in range(a + 1, b + 1)) and all(s[i:b].sum() > 0 for i in range(a, b))


def test_toxicity_held_out(spark):
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    rows = toxicity.op2_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.85 and hit / sum(r.predicted for r in rows) > 0.75


def test_toxicity_by_hand(spark):
    """Words, scores, segments and the logistic function, text by text."""
    import re

    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.train(docs, labels, F.lit(True))
    model.odds[::4] *= -0.2  # few labels speak against toxicity by themselves
    known = dict(zip(model.keys.tolist(), model.odds.tolist()))

    def score(text):
        raw = (text or "").encode()
        words = [m.group() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
        s = []
        for w in words:
            data = np.frombuffer(w, np.uint8)
            keys = [int(k[0]) for k in toxicity.tokens(data, np.array([0]), np.array([len(w)]))]
            own = known.get(keys[0], -model.drift)
            stems = [known[k] for k in keys[1:] if known.get(k, 0) > 0]
            s.append(max([own, *stems]))
        s = np.array(s)
        best = total = 0.0
        while True:  # the heaviest segment first, then left and right of it
            found = []

            def cut(a, b):
                top = max(((s[i:j].sum(), -j, i, j) for i in range(a, b) if s[i] > 0 for j in range(i + 1, min(b, i + 60) + 1) if s[j - 1] > 0), default=None)
                if top and top[0] > 0:
                    found.append(top[0])
                    cut(a, top[2])
                    cut(top[3], b)

            cut(0, len(s))
            break
        for v in found:
            e = model.lam * v - np.log(max(model.k * len(s), 1e-12))
            best, total = max(best, e), total + max(e, 0)
        a, b, c = model.fit
        return 1 / (1 + np.exp(-np.clip(a + b * best + c * np.log1p(total), -30, 30)))

    rows = toxicity.score_documents(docs, model).join(docs, "doc_id").where("length(text) < 3000").orderBy(F.desc("score"), "doc_id").collect()
    some = rows[:40] + rows[40::25]
    assert np.allclose([r.score for r in some], [score(r.text) for r in some], atol=1e-6)


def test_toxicity_odd_texts(spark, documents):
    texts = [None, "", "!!", *["you idiot there"] * 2, *[f"kind words {i} here you there" for i in range(40)], *[f"w{i} idiot you moron x{i}" for i in range(40)]]
    docs = documents(texts)
    labels = spark.createDataFrame([(i, int("idiot" in (t or ""))) for i, t in enumerate(texts)] + [(3, None), (None, 1), (3, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    rows = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows.values())
    assert rows[0].score == rows[1].score == rows[2].score < rows[60].score and rows[3].score == rows[4].score
    assert toxicity.train(docs, labels.where("toxic = 0"), F.lit(True)) is None
    none = documents([])
    assert toxicity.train(none, labels, F.lit(True)) is None and toxicity.score_documents(none, model).count() == 0
    long = toxicity.score_documents(documents(["kind words " * 50000 + "you idiot moron you idiot moron"]), model).collect()[0]
    assert any(p["first"] > 500000 for p in long.passages)


def feistel(key, tag, s, radix):
    """The string network, written anew."""
    alphabet = "abcdefghijklmnopqrstuvwxyz" if radix == 26 else "0123456789abcdef"[:radix]
    number = lambda t: sum(alphabet.index(c) * radix**i for i, c in enumerate(reversed(t)))

    def written(x, n):
        out = ""
        for _ in range(n):
            x, r = divmod(x, radix)
            out = alphabet[r] + out
        return out

    out = ""
    for k in range(0, len(s), 24):
        p = s[k : k + 24]
        u, v = len(p) // 2, len(p) - len(p) // 2
        a, b = number(p[:u]), number(p[u:])
        for i in range(pii.ROUNDS):
            f = int(hashlib.sha256(f"{key}|{tag}{radix}|{i}|{b if i % 2 == 0 else a}".encode()).hexdigest()[:15], 16)
            if i % 2 == 0:
                a = (a + f) % radix**u
            else:
                b = (b + f) % radix**v
        out += written(a, u) + written(b, v)
    return out


@pytest.mark.parametrize("radix,n", [(10, 1), (10, 2), (10, 3), (26, 2), (16, 2)])
def test_network_is_a_permutation(spark, radix, n):
    alphabet = "abcdefghijklmnopqrstuvwxyz" if radix == 26 else "0123456789abcdef"[:radix]
    values = [""]
    for _ in range(n):
        values = [v + c for v in values for c in alphabet]
    rows = spark.createDataFrame([(v,) for v in values], "v string").selectExpr("v", pii._string("k", "t", "v", radix) + " AS w").collect()
    assert sorted(r.w for r in rows) == sorted(values)
    assert all(r.w == feistel("k", "t", r.v, radix) for r in rows)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(documents):
    card, bad = "4539 1488 0343 6467", "4539 1488 0343 6468"
    texts = [None, "", f"pay {card} or 4539148803436467!", f"not {bad}", "on 2024-02-29, 02/29/2024 and 31.12.1999", "not 2023-02-29 or 1.2.3", "at 10.0.0.255 not 10.0.0.256", "ssn 123-45-6789, not 666-45-6789 or 123-00-6789", "+1 (337)%%% 555-7349 call", "Mail Jo.Doe99@mail3.example.com.", "x" * 20000 + " 10.0.0.255", f"key={'0123456789abcdef' * 2}", "DE89 3704 0044 0532 0130 00 account", "plain words"]
    docs = documents(texts)
    out = pii.pseudonymise(docs, "k")
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    new = [rows[i].text for i in range(len(texts))]
    assert new[:2] == [None, ""] and new[3] == texts[3] and new[5] == texts[5] and new[13] == texts[13]
    a, b = new[2][4:23], new[2][27:43]
    assert a.replace(" ", "") == b and luhn(b) and b != "4539148803436467" and [c for c in a if c == " "] == [" "] * 3
    import datetime

    iso, us, de = new[4].split()[1].strip(","), new[4].split()[2], new[4].split()[4]
    assert datetime.date.fromisoformat(iso) == datetime.datetime.strptime(us, "%m/%d/%Y").date() and datetime.datetime.strptime(de, "%d.%m.%Y")
    assert new[6].endswith("not 10.0.0.256") and new[6].split()[1] == new[10].split()[1] != "10.0.0.255"
    assert new[7].endswith("not 666-45-6789 or 123-00-6789") and "123-45-6789" not in new[7]
    assert new[8].startswith("+1 (") and "555-7349" not in new[8] and ")%%% " in new[8]
    assert new[9].endswith(".com.") and "mail3.example" not in new[9] and len(new[9]) == len(texts[9]) and new[9][7] == "." and new[9][5].isupper() and "Jo.Doe99" not in new[9]
    assert len(new[11]) == len(texts[11]) and new[11] != texts[11]
    iban = new[12][:27].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "DE89370400440532013000"
    assert [rows[i].pii_changed for i in (0, 1, 2, 3, 4, 13)] == [0, 0, 2, 0, 3, 0]
    assert pii.pseudonymise(documents([]), "k").count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, "")


def test_clashing_columns_and_keys(spark):
    df = spark.createDataFrame([(1, "at 10.0.0.255 or a@b.example.org", "x", 5, "y"), (2, "c@b.example.org and " + "abcdefab" * 4, "x", 5, "y")], "doc_id bigint, text string, hits string, pii_found int, __hits string")
    out = pii.pseudonymise(df, "k")
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "hits", "__hits", "pii_found", "pii_changed"] and rows[1].hits == "x" and rows[1]["__hits"] == "y" and rows[1].pii_found == 2
    assert rows[1].text.split("@")[1] == rows[2].text.split("@")[1].split()[0] and "abcdefab" not in rows[2].text
    other = {r.doc_id: r.text for r in pii.pseudonymise(df, "l").collect()}
    assert other[1] != rows[1].text
    assert pii.configured_key(spark) == pii.configured_key(spark)
    spark.conf.set("spark.lexarium.pii.key", "named")
    assert pii.configured_key(spark) == "named"
    spark.conf.unset("spark.lexarium.pii.key")


def residues(key, tag, a, b, ma, mb):
    """The network over two residues, written anew."""
    for i in range(pii.ROUNDS):
        f = int(hashlib.sha256(f"{key}|{tag}|{i}|{b if i % 2 == 0 else a}".encode()).hexdigest()[:15], 16)
        a, b = ((a + f) % ma, b) if i % 2 == 0 else (a, (b + f) % mb)
    return a, b


def pseudonym_by_hand(key, m):
    import datetime
    import re

    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", m):
        o = [int(x) for x in m.split(".")]
        a, b = residues(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", m):
        area, group, serial = map(int, m.split("-"))
        a, b = residues(key, "ssn", area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 989901)
        return f"{a + 1 + (a >= 665):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", m):
        d = datetime.date.fromisoformat(m)
        start = datetime.date(d.year - d.year % 400, 1, 1)
        a, b = residues(key, "date", (d - start).days // 773, (d - start).days % 773, 189, 773)
        return (start + datetime.timedelta(a * 773 + b)).isoformat()
    if m.startswith("+"):
        return m[:2] + feistel(key, "phone", m[2:], 10)
    if re.fullmatch(r"[0-9a-f]{32,64}", m):
        return feistel(key, "hex", m, 16)
    if re.fullmatch(r"[A-Z]{2}[0-9]+", m):
        body = feistel(key, "iban", m[4:], 10)
        return f"{m[:2]}{98 - int(''.join(str(int(c, 36)) for c in body + m[:2] + '00')) % 97:02}{body}"
    body = feistel(key, "card", m[:-1], 10)
    return next(body + c for c in "0123456789" if luhn(body + c))


def test_pseudonyms_by_hand(documents):
    rng = np.random.default_rng(6)
    values = ["10.0.0.255", "192.168.1.20", "123-45-6789", "899-01-0001", "2024-02-29", "1999-12-31", "+14155550123", "+493012345678", "0123456789abcdef" * 2, "DE89370400440532013000", "4539148803436467", "378282246310005"]
    values += [".".join(map(str, rng.integers(0, 256, 4))) for _ in range(20)]
    rows = {r.doc_id: r.text for r in pii.pseudonymise(documents([f"a {v} b" for v in values]), "s3cret").collect()}
    assert [rows[i][2:-2] for i in range(len(values))] == [pseudonym_by_hand("s3cret", v) for v in values]


def test_cards_beside_other_numbers(documents):
    card, other = "4111 1111 1111 1111", "5500 0000 0000 0004"
    around = ["{}", "{} 12/25", "order 12 {}", "12 34 {}", "{} 12 25 34 5", "no 7 {} 12th", "{} 12/25/2024", "{}-12"]
    texts = [a.format(card) for a in around] + [f"{card} {other}", f"{card} 12 {other} 3", f"{card} 555-123-4567", f"{card} 9 2024-01-05 123-45-6789 x", "12345678-1234-1234-1234-123456789abc", "mail 4111 1111 1111 1111 12.ab@example.com", other, "555-123-4567", "2024-01-05", "123-45-6789", "12.ab@example.com"]
    rows = {r.doc_id: r for r in pii.pseudonymise(documents(texts), "lexarium").collect()}
    new = [rows[i].text for i in range(len(texts))]
    mine, its, phone, day, ssn, mail = new[0], *new[14:]
    assert mine != card and luhn(mine.replace(" ", "")) and its != other
    want = [a.format(mine) for a in around]
    want[6] = f"{mine} {new[6][20:]}"
    assert new[:8] == want and new[6][20:] != "12/25/2024"
    assert new[8:14] == [f"{mine} {its}", f"{mine} 12 {its} 3", f"{mine} {phone}", f"{mine} 9 {day} {ssn} x", texts[12], f"mail {mine} {mail}"]
    assert [rows[i].pii_changed for i in (0, 1, 6, 8, 9, 10, 11, 12, 13)] == [1, 1, 2, 2, 2, 2, 3, 0, 2]


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_nearest_recall(spark, sf):
    rows = quantisation.op9_quantisation(spark, f"/root/testdata/sf{sf}").collect()
    data = table(spark, f"/root/testdata/sf{sf}", "embeddings").collect()
    ids, x = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], float)
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        want = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        got = sorted((r["rank"], r.vec_id) for r in rows if r.query_id == q)
        assert [r for r, _ in got] == list(range(1, 21))
        hit, total = hit + len({v for _, v in got} & set(want)), total + 20
    assert hit / total >= 0.9


def test_nearest_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (2, [0.0, 0.0], "c"), (3, None, "d"), (4, [nan, 1.0], "e"), (5, [1.0, None], "f"), (6, [2.0, 1.0], "g"), (7, [1.0], "h"), (None, [1.0, 1.0], "i"), (1, [1.0, 0.0], "j")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, path string")
    out = quantisation.search(df, quantisation.build_index(df)).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == 0] == [(1, 6, 2.0), (2, 1, 1.0), (3, 1, 1.0)]
    assert {r.query_id for r in out} == {0, 1, 6}
    none = df.where("false")
    assert quantisation.search(none, quantisation.build_index(none)).count() == 0


def test_many_copies_of_a_vector(spark):
    """More equal vectors than are scored again: the least ids win."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8))
    x[100:] = x[100]
    df = spark.createDataFrame([(int(i) * 3, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(5)
    index = quantisation.build_index(df, block=64, fit=256)
    for measure in ("inner", "distance"):
        got = quantisation.search(df.where("vec_id in (300, 1500)"), index, rerank=40, measure=measure).collect()
        s = x @ x[100] if measure == "inner" else -((x - x[100]) ** 2).sum(1)
        for q in (300, 1500):
            want = [3 * i for i in np.lexsort((np.arange(900), -s)).tolist() if 3 * i != q][:20]
            mine = [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
            assert mine == want if measure == "distance" else len(set(mine) & set(want)) >= 18


def test_full_blocks_recall():
    """Vectors without any structure, many times as many as are scored again."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20000, 32))
    own = quantisation.AdditiveQuantiser.fit(x[:6000], 8)
    codes, norms = own.encode(x)
    made = sum(own.books[b][codes[:, b]] for b in range(8)).astype(float)
    assert np.allclose((made**2).sum(1), norms, rtol=1e-3, atol=1e-3)
    q = x[:50]
    approx = quantisation.scores(own.tables(q), codes)
    assert np.allclose(approx, q @ made.T, atol=1e-2)
    top, exact = np.argsort(-approx, 1)[:, : len(x) // quantisation.RERANK_SHARE], np.argsort(-(q @ x.T), 1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(top.tolist(), exact.tolist())]) >= 0.9


@pytest.mark.parametrize("most", [100, 15385])  # the latter: candidates of a query among 615384 vectors
def test_candidates_in_bounded_memory(most):
    """The best of all blocks, ties to the least id, whatever is cut on the way."""
    rng = np.random.default_rng(most)
    n, size = min(3, quantisation._Candidates.queries(most)), 20000
    qid, ids = np.array([7, 500, 10**6])[:n], rng.permutation(3 * size)
    approx = rng.integers(0, 40, (n, 3 * size)).astype(np.float32)  # many ties
    tracemalloc.start()
    try:
        held = quantisation._Candidates(qid, most)
        for a in range(0, 3 * size, size):
            held.add(approx[:, a : a + size], ids[a : a + size], a)
        for j in range(n):
            held.cut(j)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak / n * quantisation._Candidates.queries(most) < 3 * quantisation.HELD
    for j in range(n):
        order = np.lexsort((ids, -approx[j]))
        want = order[ids[order] != qid[j]][:most]
        m = held.n[j]
        assert m == most and set(held.place[j, :m].tolist()) == set(want.tolist())
        assert (ids[held.place[j, :m]] == held.who[j, :m]).all()
