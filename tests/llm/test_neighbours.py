import os

import numpy as np
import pytest

from verityloom.llm import neighbours as nb
from verityloom.llm import queries

SCHEMA = "id string, v array<float>, rank int, near string"


def run(spark, rows, **kw):
    df = spark.createDataFrame(
        [(i, None if v is None else [None if x is None else float(x) for x in v], 0, "") for i, v in rows], SCHEMA
    )
    return nb.nearest(df, "id", "v", **kw)


def brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    return {
        ids[i]: [
            ids[j] for j in sorted(range(len(ids)), key=lambda j: (-round(float(s[i, j]), 4), ids[j])) if j != i
        ][:k] for i in range(len(ids))
    }


def test_recall_against_brute_force(spark):
    r = np.random.default_rng(1)
    centres = r.standard_normal((40, 64))
    x = centres[r.integers(0, 40, 3000)] + 0.9 * r.standard_normal((3000, 64))
    ids = [f"v{i:04}" for i in range(3000)]
    want = brute(ids, x.astype(np.float32), 5)
    got = {}
    for row in run(spark, list(zip(ids, x)), list_rows=150).collect():
        got.setdefault(row.id, set()).add(row.neighbour)
    assert set(got) == set(ids) and all(len(v) == 5 for v in got.values())
    recall = np.mean([len(got[i] & set(want[i])) / 5 for i in ids])
    assert recall >= 0.9, recall


def test_dirty_vectors_copies_and_ties(spark):
    e = np.eye(64)
    rows = [(f"a{i}", e[0]) for i in range(9)] + [
        ("b", e[0] + e[1]), ("c", e[1]), ("c", e[1]), ("n", None), ("z", e[0] * 0), ("short", [1.0]),
        ("hole", [None] + [1.0] * 63), ("nan", [float("nan")] * 64), (None, e[2]), ("big", e[1] * 1e30)
    ]
    got = {}
    for r in run(spark, rows).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.neighbour, round(r.similarity, 3)))
    assert set(got) == {*(f"a{i}" for i in range(9)), "b", "c", "big"}
    assert got["a7"] == [(f"a{i}", 1.0) for i in range(5)] and got["a0"][0] == ("a1", 1.0)
    assert got["b"] == [("a0", 0.707), ("a1", 0.707), ("a2", 0.707), ("a3", 0.707), ("a4", 0.707)]
    assert got["c"][:2] == [("big", 1.0), ("b", 0.707)]
    pairs = {tuple(r) for r in nb.mutual_pairs(run(spark, rows, min_similarity=0.9), 0.9).collect()}
    assert ("big", "c") in pairs and ("a0", "a8") in pairs and not any("b" in p for p in pairs)


def test_large_lists_are_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 32)
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 64))
    ids = [f"v{i:03}" for i in range(300)]
    want = brute(ids, x.astype(np.float32), 5)
    got = {}
    for row in run(spark, list(zip(ids, x)), list_rows=300, replicas=1).collect():
        got.setdefault(row.id, set()).add(row.neighbour)
    assert np.mean([len(got[i] & set(want[i])) / 5 for i in ids]) > 0.99


def test_best_rows_are_exact():
    r = np.random.default_rng(3)
    q, x = r.standard_normal((20, 8)).astype(np.float32), r.standard_normal((1001, 8)).astype(np.float32)
    at, s = nb.best_rows(q, x, 6)
    assert [set(a) for a in at.tolist()] == [set(np.argsort(-row)[:6].tolist()) for row in q @ x.T]


@pytest.mark.parametrize("lists", [400, 1500])
def test_graph_walk_finds_the_best_centroids_from_few_entry_points(lists):
    r = np.random.default_rng(4)
    x = r.standard_normal((20_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, graph, entries = nb.fit_lists(x, lists)
    assert len(entries) == 64 and 0.9 * lists < len(c) < 1.1 * lists
    ids, sims = nb.walk(x[:1000], c, graph, entries, 5)
    every = x[:1000] @ c[:, :64].T + c[:, 64]
    best = np.argsort(-every, axis=1)[:, :5]
    assert np.allclose(sims, np.take_along_axis(every, ids, 1), atol=1e-5)
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids.tolist(), best.tolist())]) > 0.95
    n = np.bincount((x @ c[:, :64].T + c[:, 64]).argmax(1), minlength=len(c))
    assert n.max() < 3 * n.mean()


def test_walk_crosses_between_far_clusters():
    r = np.random.default_rng(7)
    centres = r.standard_normal((12, 64)) * 3
    x = (centres[r.integers(0, 12, 20_000)] + 0.3 * r.standard_normal((20_000, 64))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, graph, entries = nb.fit_lists(x, 600)
    ids, _ = nb.walk(x[:1000], c, graph, entries[:4], 5)
    best = np.argsort(-(x[:1000] @ c[:, :64].T + c[:, 64]), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids.tolist(), best.tolist())]) > 0.9


def test_recall_of_the_chunks_divisible_by_20(spark):
    """p5_nearest of every 20th chunk against all rows, by brute force, with the query's own parameters."""
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    rows = {
        r.chunk_id: r.embedding for r in spark.read.parquet(
            f"{d}/document_chunks.parquet"
        ).select("chunk_id", "embedding").collect() if r.embedding and len(r.embedding) == 64 and any(r.embedding)
    }
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in queries.p5_nearest(spark, d).collect():
        got.setdefault(r.id, []).append((ids.index(r.neighbour), r.similarity))
    assert got.keys() == rows.keys()
    hits = []
    for i in range(0, len(ids), 20):
        s = x @ x[i]
        s[i] = -9
        least = np.sort(s)[-5]
        assert len(got[ids[i]]) == 5 and all(abs(s[j] - v) < 2e-3 for j, v in got[ids[i]])
        hits.append(np.mean([s[j] >= least - 1e-3 for j, _ in got[ids[i]]]))
    assert np.mean(hits) >= 0.9


def test_empty_and_single(spark):
    assert run(spark, []).collect() == []
    assert run(spark, [("a", np.ones(64))]).collect() == []
