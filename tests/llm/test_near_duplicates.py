import random
import re
from itertools import combinations

import numpy as np

from verityloom.llm import near_duplicates as nd

WORD = re.compile(r"[^\W_]+")


def shingled(t, n):
    w = WORD.findall(t.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def corpus(seed=1, families=25):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    out = []
    for f in range(families):
        base = [r.choice(vocab) for _ in range(60)]
        out.append(base)
        for _ in range(r.randint(0, 3)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            out.append(copy)
    return [" ".join(x) for x in out]


def brute(texts, n, threshold, min_words):
    sets = {i: shingled(t, n) for i, t in texts.items() if t and len(WORD.findall(t)) >= min_words}
    return {
        (min(a, b), max(a, b)) for a,
        b in combinations(sets, 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) > 0
    }


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "id string, t string, sid int")
    return nd.links(df, "id", "t", **kw)


def test_pairs_match_brute_force(spark):
    texts = {f"c{i:03}": t for i, t in enumerate(corpus())}
    texts |= {"n1": None, "n2": "", "s1": "too short", "s2": "too short", "x1": "A, b! " * 40}
    rows = list(texts.items()) + [("c000", texts["c000"]), (None, texts["c001"])]
    members, found = run(spark, rows, shingle=3, threshold=0.6, min_words=20)
    assert {tuple(r) for r in nd.similar_pairs(members, found).collect()} == brute(texts, 3, 0.6, 20)
    groups = {r.id: r for r in nd.groups(members, found).collect()}
    assert set(groups) == {i for i, t in texts.items() if t and len(WORD.findall(t)) >= 20}
    pairs = brute(texts, 3, 0.6, 20)
    for a, b in pairs:
        assert groups[a].group_id == groups[b].group_id
    parent = {i: i for i in groups}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: g.group_id for i, g in groups.items()} == {i: root(i) for i in groups}


def test_large_buckets_take_the_blocks_and_lose_nothing(spark, monkeypatch):
    texts = {f"c{i:03}": t for i, t in enumerate(corpus(3, 4))}
    base = " ".join(f"v{i}" for i in range(60))
    texts |= {f"h{i:03}": f"{base} tail{i}" for i in range(40)}
    monkeypatch.setattr(nd, "BUCKET_ROWS", 8)
    nd_meet = nd._meet
    members, found = run(spark, list(texts.items()), shingle=3, threshold=0.6, min_words=20)
    assert {tuple(r) for r in nd.similar_pairs(members, found).collect()} == brute(texts, 3, 0.6, 20)
    assert nd_meet is nd._meet


def test_many_copies_are_a_star(spark):
    t = " ".join(f"w{i}" for i in range(30))
    members, found = run(spark, [(f"k{i}", t) for i in range(7)] + [("z", t + " more")])
    got = {tuple(r) for r in nd.similar_pairs(members, found, expand=4).collect()}
    assert got == {("k0", f"k{i}") for i in range(1, 7)} | {("k0", "z")}
    g = {r.id: r for r in nd.groups(members, found).collect()}
    assert {r.group_id for r in g.values()} == {"k0"} and g["k3"].copies == 7 and g["z"].links == 1


def test_streamed_buckets():
    import pyarrow as pa

    r = np.random.default_rng(0)
    key = np.sort(r.integers(0, 400, 5000))
    key[1000:3000] = key[1000]
    key.sort()
    sid = np.arange(5000)
    b = [
        pa.RecordBatch.from_arrays(
            [pa.array(key[i : i + 700]), pa.array(sid[i : i + 700])], names=["key", "sid"]
        ) for i in range(0, 5000, 700)
    ]
    pairs, large = set(), set()
    for x in nd._meet(iter(b)):
        for k, a, c in zip(*(x.column(i).to_pylist() for i in range(3))):
            pairs.add((a, c)) if c is not None else large.add((k, a))
    size = {k: int((key == k).sum()) for k in np.unique(key)}
    assert large == {(int(k), int(s)) for k, s in zip(key, sid) if size[k] > nd.BUCKET_ROWS}
    assert pairs == {
        (int(a), int(c)) for k in size if 1 < size[k] <= nd.BUCKET_ROWS for a, c in combinations(sid[key == k], 2)
    }


def test_empty_table(spark):
    members, found = run(spark, [])
    assert nd.similar_pairs(members, found).collect() == [] and nd.groups(members, found).collect() == []


def test_filter_lets_every_id_through_and_few_others(spark, monkeypatch):
    monkeypatch.setattr(nd, "SEGMENT", 1 << 12)
    ids = [(x * 0x9E3779B97F4A7C15) % (1 << 63) for x in range(20_000)]
    bits, n = nd._filter_of(spark.createDataFrame([(x,) for x in ids], "sid long"))
    assert n == len(bits) * 8

    def inside(v):
        ok = np.ones(len(v), dtype=bool)
        for spot in nd._spots(np.array(v, dtype=np.int64), n):
            ok &= (bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1).astype(bool)
        return ok

    assert inside(ids).all() and inside([x + 1 for x in ids]).mean() < 0.05
