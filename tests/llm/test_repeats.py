import collections
import random
import re

import pytest

from lexarium.llm import decontamination, neardup, sharding, substrings
from lexarium.llm._shared import table

SF = "/root/testdata/sf0.001"
FOLD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(t):
    return FOLD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéüß") for _ in range(r.randint(1, 6))) for _ in range(n))


P = prose(70, 1)
TEXTS = [None, "", "   ", P, prose(90, 2) + " " + P, P + "\n" + prose(30, 3), P, prose(400, 4) * 20, prose(49, 5), prose(49, 5), "a " * 300, "a " * 120]


def kept_by_hand(texts, ids, k=50):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    first = {}
    for w, i in zip(words, ids):
        for s in range(len(w) - k + 1) if i is not None else ():
            key = tuple(w[s : s + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for w, i in zip(words, ids):
        gone = [False] * len(w)
        for s in range(len(w) - k + 1) if i is not None else ():
            if first[tuple(w[s : s + k])] < i:
                gone[s : s + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("ids", [list(range(12)), [5, 4, 4, 9, 1, 1, None, 3, None, 2, 2, 0]])
@pytest.mark.parametrize("buckets", [1, 5])
def test_substrings_by_hand(documents, ids, buckets):
    rows = substrings.dedup_substrings(documents(TEXTS, ids), buckets=buckets).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in rows), key=str) == kept_by_hand(TEXTS, ids)
    assert all(sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_removed for r in rows)


def test_empty_tables(documents):
    none = documents([])
    assert substrings.dedup_substrings(none).count() == 0
    assert neardup.near_duplicates(none).count() == 0
    assert sharding.shard(none).count() == 0
    assert decontamination.contamination(none, none, item_col="doc_id").count() == 0


def classes_by_hand(texts):
    sets = []
    for t in texts:
        w = folded(t)
        sets.append(collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) > 4 else collections.Counter([tuple(w)] if w else []))
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = sum((a & sets[j]).values())
            if both and both >= 0.8 * (sum(a.values()) + sum(sets[j].values()) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"edit{seed}x{i}"
    return " ".join(w)


def test_near_duplicates_by_hand(documents):
    base = prose(400, 9)
    texts = [*TEXTS, base, base.upper().replace("É", "é").replace("Ü", "ü").replace("SS", "ß"), *[edited(base, 3, s) for s in range(12)], *[edited(prose(300, 11), n, n) for n in (0, 6, 40)], "one two", "One, two!", "three"]
    rows = {r.doc_id: r for r in neardup.near_duplicates(documents(texts)).collect()}
    assert [rows[i].class_id for i in range(len(texts))] == classes_by_hand(texts)
    size = collections.Counter(r.class_id for r in rows.values())
    assert all(r.class_size == size[r.class_id] for r in rows.values())


def test_near_duplicates_of_the_table(spark):
    docs = table(spark, SF, "documents")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    rows = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert [rows[i] for i in range(len(texts))] == classes_by_hand(texts)


def contaminated_by_hand(texts, items):
    grams = collections.defaultdict(set)
    for i, t in items:
        w = folded(t)
        k = min(13, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            grams[tuple(w[j : j + k])].add(i)
    out = []
    for t in texts:
        w, hit, found = folded(t), set(), set()
        for k in {len(g) for g in grams}:
            for j in range(len(w) - k + 1):
                if own := grams.get(tuple(w[j : j + k])):
                    found |= own
                    hit.update(range(j, j + k))
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("limit", [decontamination.SET_BYTES, 64])
def test_contamination_by_hand(spark, documents, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "SET_BYTES", limit)
    items = [(1, prose(40, 20)), (2, prose(40, 20)), (10, "Short, item"), (11, None), (12, " ?!"), (None, prose(13, 21))]
    texts = [*TEXTS, "x " + re.sub("[a-e]", lambda m: m[0].upper(), prose(40, 20)) + " y", "a short ITEM; short item", prose(300, 22) + " " + prose(40, 20)[:60], prose(13, 21)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents(texts)
    rows = {r.doc_id: r for r in decontamination.contamination(docs, bench).collect()}
    want = contaminated_by_hand(texts, items)
    assert [(rows[i].n_words, rows[i].n_hit, rows[i]["items"], rows[i].contaminated) for i in range(len(texts))] == want
    kept = decontamination.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, w in enumerate(want) if not w[3]]
    cut = {r.doc_id: r.text for r in decontamination.cut_spans(docs, bench).collect()}
    assert cut[len(TEXTS)] == "x y" and cut[3] == TEXTS[3]


def test_shards(documents, spark):
    texts = [*TEXTS, *["copy"] * 300, *[prose(20, s) for s in range(400)]]
    rows = sharding.shard(documents(texts)).collect()
    assert len(rows) == len(texts) and {r["size"] for r in rows if r.doc_id == 0} == {1}
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    big = sharding.shard(table(spark, "/root/testdata/sf0.01", "documents")).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in big]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 0.05 * sum(sizes) / 16


def test_equal_texts_lie_in_one_shard(documents):
    """Also a group of a fourth of a shard; one above a shard is dealt on."""
    r = random.Random(3)
    texts = ["much " * 8] * 900 + ["some more words"] * 120 + [f"{prose(8, s)} {s % 7}" for s in range(2500)] + [None] * 30 + [prose(9, 7)] * 60
    ids = [None if r.random() < 0.05 else r.randrange(10**6) for _ in texts]
    rows = sharding.shard(documents(texts, ids)).collect()
    assert len(rows) == len(texts)
    where = collections.defaultdict(set)
    for x in rows:
        where[x.text_crc32].add(x.shard)
    crc = lambda t: neardup.np.uint32(__import__("zlib").crc32((t or "").encode()))
    assert len(where[int(crc(texts[0]))]) > 1 and all(len(s) == 1 for c, s in where.items() if c != int(crc(texts[0])))
    by = collections.defaultdict(list)
    sizes = collections.Counter()
    for x in rows:
        by[x.shard].append(x.slot)
        sizes[x.shard] += x["size"]
    assert len(by) == 16 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(sizes.values()) - min(sizes.values()) < 0.05 * sum(sizes.values()) / 16


def test_place_by_hand():
    r = random.Random(4)
    for n in (1, 3, 5):
        vectors = [[r.randint(0, 50) / 1000 for _ in range(3)] for _ in range(60)]
        room, want = [[1 / n] * 3 for _ in range(n)], [None] * 60
        weigh = lambda v: sum(w * x for w, x in zip(sharding.WEIGHTS, v))
        for i in sorted(range(60), key=lambda i: (-weigh(vectors[i]), i)):
            dots = [sum(w * x * y for w, x, y in zip(sharding.WEIGHTS, vectors[i], rm)) for rm in room]
            want[i] = max(range(n), key=lambda s: (round(dots[s], 12), -s))
            room[want[i]] = [a - b for a, b in zip(room[want[i]], vectors[i])]
        assert sharding.place(neardup.np.array(vectors), n).tolist() == want


def test_components_merged_in_two_steps(spark):
    r = random.Random(7)
    pairs = sorted({tuple(sorted(r.sample(range(60), 2))) for _ in range(45)})
    one, two = pairs[::2], pairs[1::2]
    make = lambda x: spark.createDataFrame(x, "a bigint, b bigint")
    got = {x.node: x.comp for x in neardup.merged(neardup.components(make(one)), make(two)).collect()}
    want = {n: n for p in pairs for n in p}
    for _ in want:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_near_duplicates_in_large_buckets(documents):
    """Thousands of texts of one template, all below the similarity, and close pairs among them."""
    n, base = 2500, prose(60, 30)
    own = lambda name, s, k: " ".join(f"{name}{s}x{i}" for i in range(k))
    texts = [f"{own('a', s, 5)} {base} {own('b', s, 5)}" for s in range(n)]
    pairs = {n + i: 601 * i + 7 for i in range(4)}
    texts += [f"{texts[i]} {own('c', j, 15)}" for j, i in pairs.items()]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(documents(texts)).collect()}
    assert got == {i: i for i in range(n)} | pairs


def test_shared_regions():
    r = random.Random(3)
    sides = [[sorted(r.sample(range(90), r.randint(0, 60))) for _ in range(n)] for n in (7, 5)]
    got = neardup.shared_regions(*[[neardup.np.array(x, "<u4") for x in s] for s in sides], step=16)
    assert got.tolist() == [[len(set(a) & set(b)) for b in sides[1]] for a in sides[0]]
