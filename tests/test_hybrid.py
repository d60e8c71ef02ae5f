import pytest
from pyspark.sql import functions as F

from verityloom.operators import graph, hybrid, metrics

KINDS = {"runs": ("team", "service"), "in": ("service", "other")}
REL = "subject string, predicate string, object string, chunk string, revision string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def make(spark, extra=()):
    rel = [
        ("The Blue Team", "runs", "Pay service", "c1", "r1"), ("Blue Team", "runs", "Pay service", "c2", "r2"),
        ("Pay service", "in", "Oslo", "c3", "r1"), ("Red Team", "runs", "Log service", "c4", "r1"),
        ("Log service", "in", "Oslo", "c5", None), ("", "runs", "x", "c6", "r1"), (None, "runs", "x", "c6", "r1"),
        *extra
    ]
    return hybrid.typed_graph(spark.createDataFrame(rel, REL), KINDS)


def names(nodes):
    return {r.node_id: r.name for r in nodes.collect()}


def test_typed_graph_merges_names_and_rejects_what_has_no_key(spark):
    nodes, edges, evidence = make(spark)
    got = {r.name: (r.kind, r.aliases, r.mentions) for r in nodes.collect()}
    assert got["Blue Team"] == (
        "team", ["The Blue Team"], 2
    ) and got["Pay service"][0] == "service" and got["Oslo"][0] == "other"
    assert edges.count() == 4 and evidence.count() == 5 and "x" not in got
    e, ev = hybrid.eligible_graph(edges, evidence, spark.createDataFrame([("r2",)], "revision string"))
    assert e.count() == 1 and [r.chunk for r in ev.collect()] == ["c2"]
    none, _ = hybrid.eligible_graph(edges, evidence, spark.createDataFrame([], "revision string"))
    assert none.count() == 0
    empty = hybrid.typed_graph(spark.createDataFrame([], REL), KINDS)
    assert [x.count() for x in empty] == [0, 0, 0]
    h = lambda g: hybrid.graph_hash(g[0], g[1]).first()
    assert h(make(spark)) == h((nodes.orderBy("name"), edges)) != h(make(spark, [("a", "runs", "b", "c9", "r1")]))
    assert {
        r.kind: r.content for r in hybrid.artifacts(nodes.where("name = 'Oslo'"), edges, evidence).collect()
    } == {"entity": "Entity: Oslo (other)"}


def test_seeds_by_identifier_and_by_name(spark):
    nodes = spark.createDataFrame(
        [
            ("C-88", [], "control"), ("C-88a", [], "control"), ("Pay service", ["the Paymaster"], "service"),
            ("Oslo", [], "other"), ("abc", [], "team")
        ],
        "name string, aliases array<string>, kind string"
    )
    q = spark.createDataFrame(
        [("q1", "Does c-88 cover the PAYMASTER in Oslo?"), ("q2", "C-88a and abc"), ("q3", None), ("q4", "")],
        "query string, question string"
    )
    got = rows(graph.match_seeds(q, "query", F.col("question"), nodes, "name", "aliases", "kind"))
    assert got == [("q1", "C-88", "C-88"), ("q1", "Pay service", "the Paymaster"), ("q2", "C-88a", "C-88a")]
    assert graph.match_seeds(q.limit(0), "query", F.col("question"), nodes, "name").collect() == []


def test_hops_evidence_and_outcomes(spark, monkeypatch):
    nodes, edges, evidence = make(spark)
    of = {v: k for k, v in names(nodes).items()}
    seeds = spark.createDataFrame([("q", of["Blue Team"]), ("p", of["Oslo"])], "query string, node string")
    dist = hybrid.hops(edges, seeds, 2)
    at = {(r.query, names(nodes)[r.node]): r.distance for r in dist.collect()}
    assert at == {
        ("q", "Blue Team"): 0, ("q", "Pay service"): 1, ("q", "Oslo"): 2, ("p", "Oslo"): 0, ("p", "Pay service"): 1,
        ("p", "Log service"): 1, ("p", "Blue Team"): 2, ("p", "Red Team"): 2
    }
    sim = spark.createDataFrame([("q", "c2", 0.9)], "query string, chunk string, similarity double")
    ranked = hybrid.hop_evidence(edges, evidence, dist, sim)
    assert [(r.chunk, r.hop) for r in ranked.where("query = 'q'").orderBy("rank").collect()] == [("c2", 0), ("c1", 0), ("c3", 1), ("c5", 2)]  # one end reached is enough
    q = spark.createDataFrame([("q",), ("z",), ("f",)], "query string")
    got = hybrid.outcomes(q, seeds, ranked, q.where("query = 'f'"))
    assert rows(got) == [("f", "failed_closed", 0, 0), ("q", "ok", 1, 4), ("z", "no_seed_entity", 0, 0)]


def test_hubs_give_the_same_neighbours(spark):
    e = spark.createDataFrame([(f"n{i}", "hub") for i in range(50)] + [("n1", "n2")], "src string, dst string")
    front = spark.createDataFrame([("q", "hub"), ("q", "n1")], "query string, node string")
    plain, split = graph.Neighbours(e), graph.Neighbours(e, share=3, least=10)
    assert split.hubs == ["hub"] and not plain.hubs
    assert rows(
        plain.of(front).select("query", "node", "next")
    ) == rows(split.of(front).select("query", "node", "next"))


def test_supplemental_seeds_paths_and_fusion(spark):
    edges = spark.createDataFrame(
        [("e1", "a", "b"), ("e2", "b", "c"), ("e3", "a", "c"), ("e4", "a", "a"), ("e5", "a", "b")],
        "edge_id string, src string, dst string"
    )
    ends = edges.select("edge_id", F.explode(F.array("src", "dst")).alias("node"))
    explicit = spark.createDataFrame([("q", "a")], "query string, node string")
    r = spark.createDataFrame([("q", "e2", 1), ("q", "e3", 2)], "query string, edge_id string, rank int")
    got = hybrid.supplemental_seeds(explicit, [r, r], ends, cap=1)
    assert {
        (x.node, x.source) for x in got.collect()
    } == {("a", "explicit"), ("b", "supplemental")} or {
        (x.node, x.source) for x in got.collect()
    } == {("a", "explicit"), ("c", "supplemental")}
    paths = hybrid.seed_paths(edges, explicit, 2, 100)
    assert sorted(">".join(x.nodes) + ":" + ">".join(x.edge_ids) for x in paths.collect()) == [
        "a>b:e1", "a>b:e5", "a>b>c:e1>e2", "a>b>c:e5>e2", "a>c:e3", "a>c>b:e3>e2"
    ]
    with pytest.raises(ValueError, match="more than 3"):
        hybrid.seed_paths(edges, explicit, 2, 3)
    ranked = spark.createDataFrame(
        [("q", 1, ["e2", "e1"]), ("q", 2, ["e3"])], "query string, rank int, edge_ids array<string>"
    )
    ev = spark.createDataFrame([("e1", "x"), ("e2", "y"), ("e3", "x"), ("e3", "z")], "edge_id string, chunk string")
    assert [
        (x.chunk, x.rank) for x in hybrid.path_evidence(ranked, ev).orderBy("rank").collect()
    ] == [("y", 1), ("x", 2), ("z", 3)]


def test_chunk_scores(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "query string")
    hits = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "query string, item string, rank int")
    gold = spark.createDataFrame([("a", "y"), ("a", "w"), ("a", "y"), ("c", "v")], "query string, item string")
    got = {r.query: r for r in metrics.chunk_scores(q, hits, gold, 2).collect()}
    assert (got["a"].coverage, got["a"].outcome, got["a"].reciprocal_rank) == (0.5, "partial", 0.5)
    assert (got["b"].coverage, got["b"].ndcg, got["b"].outcome) == (1.0, 0.0, "solved") and got["c"].outcome == "failed"
