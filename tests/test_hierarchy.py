import random

import pytest

from verityloom.operators.hierarchy import descendants, tree


def brute(nodes, edges):
    nodes = {n for n in nodes if n}
    parent = {}
    for c, p in edges:
        if c in nodes and p in nodes:
            parent[c] = min(p, parent.get(c, p))
    out = {}
    for v in nodes:
        line = [v]
        while line[-1] in parent and parent[line[-1]] not in line:
            line.append(parent[line[-1]])
        if line[-1] in parent:
            ring = line[line.index(parent[line[-1]]):]
            out[v] = (parent.get(v), min(ring), -1, None)
        else:
            out[v] = (parent.get(v), line[-1], len(line) - 1, "/".join(reversed(line)))
    return out


def run(spark, nodes, edges, **kw):
    n = spark.createDataFrame([(x, "a") for x in nodes], "id string, root string")
    e = spark.createDataFrame([(c, p, 1) for c, p in edges], "c string, p string, depth int")
    return tree(n, "id", e, "c", "p", **kw)


def check(spark, nodes, edges):
    for chunk in (1 << 18, 20, 5):  # all in one chunk; links between chunks; groups that do not fit in one chunk
        got = once(spark, nodes, edges, chunk=chunk, near="root")
    return got


def once(spark, nodes, edges, **kw):
    want = brute(nodes, edges)
    got = run(spark, nodes, edges, **kw).collect()
    assert {r.node: (r.parent, r.root, r.depth, r.path) for r in got} == want
    assert len(got) == len(want)
    under = {
        v: {u for u, (_, _, _, path) in want.items() if path and path.startswith(x[3] + "/") and u != v} for v,
        x in want.items() if x[3]
    }
    at = {(r.root, r.lo): r.node for r in got if r.depth >= 0}
    for r in got:
        if r.depth < 0:
            assert r.lo is None and r.subtree_size is None
        else:
            assert {at[r.root, i] for i in range(r.lo + 1, r.hi)} == under[r.node]
    return got


def test_trees_rings_tails_and_dirt(spark):
    nodes = list("abcdefghij") + [None, "a", "z"]
    edges = [
        ("b", "a"), ("c", "b"), ("d", "b"), ("b", "a"), ("e", "f"), ("f", "g"), ("g", "e"), ("h", "e"), ("i", "i"),
        ("j", "missing"), ("missing", "a"), (None, "a"), ("z", None)
    ]
    check(spark, nodes, edges)


def test_several_parents_take_the_least(spark):
    got = {r.node: r.parent for r in run(spark, ["a", "b", "c"], [("c", "b"), ("c", "a")]).collect()}
    assert got["c"] == "a"


def test_long_line_star_and_random_forest(spark):
    r = random.Random(5)
    nodes = [f"n{i:03}" for i in range(150)]
    edges = [(nodes[i], nodes[i - 1]) for i in range(1, 60)]
    edges += [(nodes[i], nodes[60]) for i in range(61, 110)]
    edges += [(nodes[i], nodes[r.randrange(110, i)]) for i in range(111, 150)]
    got = check(spark, nodes, edges)
    assert max(x.depth for x in got) == 59


def test_long_ring_with_long_tail(spark):
    nodes = [f"n{i:02}" for i in range(50)]
    edges = [(nodes[i], nodes[i + 1]) for i in range(49)] + [(nodes[49], nodes[31])]
    check(spark, nodes, edges)


@pytest.mark.parametrize("nodes", [[], ["a"]])
def test_empty_and_single(spark, nodes):
    check(spark, nodes, [])


def test_descendants_of_some(spark):
    t = run(spark, list("abcd"), [("b", "a"), ("c", "b"), ("d", "a")])
    assert {
        tuple(x) for x in descendants(t).select("node", "descendant", "steps").collect()
    } == {("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)}
    q = spark.createDataFrame([("b",), ("nowhere",)], "node string")
    assert [tuple(x) for x in descendants(t, q).select("node", "descendant").collect()] == [("b", "c")]


def test_long_ranges_are_unrolled_piece_by_piece(spark):
    nodes = ["r"] + [f"n{i:02}" for i in range(40)]
    t = run(spark, nodes, [(n, "r") for n in nodes[1:]])
    for piece in (1, 7, 40, 4096):
        got = [tuple(x) for x in descendants(t, piece=piece).select("node", "descendant", "steps").collect()]
        assert sorted(got) == [("r", n, 1) for n in nodes[1:]]
