"""Questions answered over the evidence graph of the chunks, by vectors, and by both, with the SQL of each step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verityloom.functions import text, vectors
from verityloom.operators import assembly, graph, hybrid, keyed, metrics, search, temporal
from verityloom.plans.graphs import _KEY, PATTERNS
from verityloom.session import cut_lineage, table

AS_OF = "2021-06-30"
# Kinds of the two ends of each relation; places are 'other', from which no question begins.
KINDS = {
    "controls": ("control", "service"), "annex_to": ("annex", "obligation"),
    "finding_against": ("finding", "application"), "section_of": ("section", "procedure"),
    "located_in": ("application", "other")
}
HOPS, PATH_EDGES, CEILING, K, POOL = 3, 2, 5_000_000, 10, 8


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "document_chunks").select(
        "chunk_id", "document_revision_id", "chunk_text", "embedding", "created_at"
    )
    c = keyed.first_per_key(c, ["chunk_id"], F.desc("created_at"), "document_revision_id")
    return c.select(
        F.col("chunk_id").alias("chunk"), F.col("document_revision_id").alias("revision"),
        F.col("chunk_text").alias("text"), "embedding"
    )


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    relations = graph.extract_relations(_chunks(spark, d), ["chunk", "revision"], "text", PATTERNS)
    return hybrid.typed_graph(cut_lineage(relations), KINDS)  # nodes, edges and evidence each read them


def _eligible(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, evidence) of the revisions in force on AS_OF, checkpointed: traversals read them again and again."""
    nodes, edges, evidence = _graph(spark, d)
    p = temporal.real(table(spark, d, "edib_revision_authority_period"), "effective_from", "effective_to")
    ok = p.where(
        temporal.covers(F.lit(AS_OF).cast("date"), F.col("effective_from"), F.col("effective_to"))
    ).select(F.col("document_revision_id").alias("revision"))
    edges, evidence = hybrid.eligible_graph(edges, evidence, ok)
    return nodes, cut_lineage(edges), cut_lineage(evidence)


def _questions(spark: SparkSession, d: str, dim: int = 32) -> DataFrame:
    i = table(spark, d, "evaluation_items")
    return i.select(
        F.col("item_id").alias("query"), "question", vectors.hashed_embedding(F.col("question"), dim).alias("embedding")
    )


def _seeds(spark: SparkSession, d: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(query, node): nodes of the eligible graph that a question names."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    here = nodes.join(ends, "node_id", "left_semi")
    named = graph.match_seeds(_questions(spark, d), "query", F.col("question"), here, "name", "aliases", "kind")
    return named.join(here.select("name", "node_id"), "name").select("query", F.col("node_id").alias("node"))


def typed_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[0].withColumn("aliases", F.array_join("aliases", "|"))


def eligible_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges in force on a day with the number of their chunks."""
    _, edges, evidence = _eligible(spark, d)
    return edges.join(evidence.groupBy("edge_id").agg(F.count("*").alias("chunks")), "edge_id")


def graph_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.artifacts(*_graph(spark, d))


def _edge_texts(
    spark: SparkSession, d: str, nodes: DataFrame, edges: DataFrame, evidence: DataFrame
) -> DataFrame:
    """What the edges say, with their vectors; searched for seeds and again for the text of paths, hence kept."""
    return cut_lineage(hybrid.edge_texts(nodes, edges, evidence, _chunks(spark, d).select("chunk", "text")))


def edge_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The vector of every edge, written to five places, and the hash of the text that it stands for."""
    nodes, edges, evidence = _graph(spark, d)
    x = hybrid.edge_texts(nodes, edges, evidence, _chunks(spark, d).select("chunk", "text"))
    return x.select(
        "edge_id", F.sha2("text", 256).alias("text_hash"),
        F.array_join(F.transform("embedding", lambda v: F.format_string("%.5f", v)), ",").alias("vector")
    )


def graph_payload_hash(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, _ = _graph(spark, d)
    return hybrid.graph_hash(nodes, edges)


def _hop_ranking(spark: SparkSession, d: str, edges: DataFrame, evidence: DataFrame, seeds: DataFrame) -> DataFrame:
    dist = hybrid.hops(edges, seeds, HOPS)
    met = hybrid.hop_evidence(edges, evidence, dist).select("query", "chunk")
    v = met.join(
        _chunks(spark, d).where("size(embedding) = 64").select("chunk", "embedding"), "chunk"
    ).join(_questions(spark, d, 64).select("query", F.col("embedding").alias("q")), "query")
    near = v.select("query", "chunk", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 9).alias("similarity"))
    return hybrid.hop_evidence(edges, evidence, dist, near)


def graph_search(spark: SparkSession, d: str) -> DataFrame:
    """The best K chunks of each question by hop and similarity over the eligible graph."""
    nodes, edges, evidence = _eligible(spark, d)
    ranked = _hop_ranking(
        spark, d, edges, evidence, cut_lineage(_seeds(spark, d, nodes, edges))
    ).where(F.col("rank") <= K)
    return ranked.withColumn("similarity", F.round("similarity", 6))


def graph_outcomes(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, evidence = _eligible(spark, d)
    seeds = cut_lineage(_seeds(spark, d, nodes, edges))
    return hybrid.outcomes(
        _questions(spark, d), seeds, hybrid.hop_evidence(edges, evidence, hybrid.hops(edges, seeds, HOPS))
    )


def _vector_ranking(spark: SparkSession, d: str, k: int) -> DataFrame:
    c = _chunks(spark, d).select("chunk", "embedding")
    got = search.exact_search(
        _questions(spark, d, 64).select(F.col("query").alias("chunk"), "embedding"), "chunk", c, "chunk", "embedding",
        k, skip_self=False
    )
    return got.select("query", F.col("row").alias("chunk"), "rank")


def _all_seeds(
    spark: SparkSession, d: str, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, texts: DataFrame
) -> DataFrame:
    near_edges = search.exact_search(
        _questions(spark, d).select(F.col("query").alias("edge_id"), "embedding"), "edge_id",
        texts.select("edge_id", "embedding"), "edge_id", "embedding", POOL, dim=32, skip_self=False
    )
    in_chunks = _vector_ranking(spark, d, POOL).join(
        evidence.select("chunk", "edge_id"), "chunk"
    ).groupBy("query", "edge_id").agg(F.min("rank").alias("rank"))
    ends = edges.select("edge_id", F.explode(F.array("src", "dst")).alias("node"))
    return hybrid.supplemental_seeds(
        _seeds(spark, d, nodes, edges), [in_chunks, near_edges.select("query", F.col("row").alias("edge_id"), "rank")],
        ends
    )


def hybrid_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Named seeds and up to four more of each question, from the nearest chunks and the nearest edges."""
    nodes, edges, evidence = _eligible(spark, d)
    seeds = _all_seeds(spark, d, nodes, edges, evidence, _edge_texts(spark, d, nodes, edges, evidence))
    return seeds.withColumn("score", F.round("score", 8))


def _paths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges, evidence = _eligible(spark, d)
    texts = _edge_texts(spark, d, nodes, edges, evidence)
    seeds = cut_lineage(_all_seeds(spark, d, nodes, edges, evidence, texts).select("query", "node"))
    paths = hybrid.seed_paths(edges, seeds, PATH_EDGES, CEILING)
    return hybrid.ranked_paths(paths, texts, _questions(spark, d)), evidence


def hybrid_paths(spark: SparkSession, d: str) -> DataFrame:
    """The best 32 paths of each question by the similarity of what they say."""
    return _paths(spark, d)[0].select(
        "query", "path_id", "hops", F.array_join("edge_ids", ",").alias("edges"), F.round("score", 6).alias("score"),
        "rank"
    )


def _fused(vector: DataFrame, graph_: DataFrame) -> DataFrame:
    f = search.reciprocal_rank_fusion([vector, graph_], "query", "chunk", "rank", K)
    return f.select(
        "query", "chunk", F.round("score", 8).alias("score"), "rank",
        hybrid.contributed_by(F.col("sources")).alias("contributed_by")
    )


def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The vector ranking of each question fused with the chunks of its ranked paths."""
    ranked, evidence = _paths(spark, d)
    return _fused(_vector_ranking(spark, d, K), hybrid.path_evidence(ranked, evidence))


def hybrid_contributions(spark: SparkSession, d: str) -> DataFrame:
    """How many of the fused chunks, and of the questions, each side gave."""
    return hybrid_fusion(spark, d).groupBy("contributed_by").agg(
        F.count("*").alias("chunks"), F.count_distinct("query").alias("questions"),
        F.count_if(F.col("rank") == 1).alias("first")
    )


def mode_scores(spark: SparkSession, d: str) -> DataFrame:
    """Vector, graph by hop, and both fusions under one scorer; gold are chunks with two identifiers of the expected passage."""
    i = table(spark, d, "evaluation_items").select(
        F.col("item_id").alias("query"),
        F.explode(text.identifiers(F.col("expected_supporting_passage"))).alias("identifier")
    )
    c = _chunks(spark, d).select(
        F.col("chunk").alias("item"), F.explode(text.identifiers(F.col("text"))).alias("identifier")
    )
    gold = i.join(c, "identifier").groupBy("query", "item").agg(F.count("*").alias("n")).where("n >= 2")
    nodes, edges, evidence = _eligible(spark, d)
    texts = _edge_texts(spark, d, nodes, edges, evidence)
    seeds = cut_lineage(_all_seeds(spark, d, nodes, edges, evidence, texts))
    named = seeds.where("source = 'explicit'").select("query", "node")
    by_hop = cut_lineage(_hop_ranking(spark, d, edges, evidence, named).select("query", "chunk", "rank"))
    paths = hybrid.seed_paths(edges, seeds.select("query", "node"), PATH_EDGES, CEILING)
    by_path = hybrid.path_evidence(
        hybrid.ranked_paths(paths, texts, _questions(spark, d)), evidence
    )
    vector = cut_lineage(_vector_ranking(spark, d, K))
    modes = {"V": vector, "G": by_hop, "H1": _fused(vector, by_hop), "H2": _fused(vector, by_path)}
    q = _questions(spark, d).select("query")
    per = reduce(
        DataFrame.unionByName,
        [
            metrics.chunk_scores(
                q, r.select("query", F.col("chunk").alias("item"), "rank"), gold, K
            ).withColumn("mode", F.lit(m)) for m,
            r in modes.items()
        ]
    )
    return per.groupBy("mode").agg(
        F.round(F.avg("coverage"), 6).alias("coverage"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
        F.round(F.avg("ndcg"), 6).alias("ndcg"), F.count_if(F.col("outcome") == "solved").alias("solved"),
        F.count_if(F.col("outcome") == "partial").alias("partial"),
        F.count_if(F.col("outcome") == "failed").alias("failed")
    )


def _artifact_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    a = hybrid.artifacts(*_graph(spark, d)).select(
        "artifact_id", vectors.hashed_embedding(F.col("content"), 32).alias("embedding")
    )
    q = _questions(spark, d).select(F.col("query").alias("artifact_id"), "embedding")
    return search.exact_search(q, "artifact_id", a, "artifact_id", "embedding", k, dim=32, skip_self=False)


def artifact_search(spark: SparkSession, d: str) -> DataFrame:
    """The five entity and edge artifacts nearest to each question."""
    return _artifact_hits(spark, d, 5).withColumn("similarity", F.round("similarity", 6))


def artifact_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Questions answered by artifacts: entities found, and both ends of edges found, are seeds; one step on, and its evidence."""
    nodes, edges, evidence = _graph(spark, d)
    hits = cut_lineage(_artifact_hits(spark, d, 5).select("query", F.col("row").alias("id")))
    entity = hits.join(nodes.select(F.col("node_id").alias("id")), "id").select("query", F.col("id").alias("node"))
    ends = hits.join(
        edges.select(F.col("edge_id").alias("id"), F.explode(F.array("src", "dst")).alias("node")), "id"
    ).select("query", "node")
    dist = hybrid.hops(edges, entity.union(ends), 1)
    per = dist.groupBy("query").agg(F.count_if(F.col("distance") == 0).alias("seeds"), F.count("*").alias("nodes"))
    return per.join(
        hybrid.hop_evidence(edges, evidence, dist).groupBy("query").agg(F.count("*").alias("chunks")), "query", "left"
    )


def target_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """For each question whether its vector ranking, or its graph ranking, holds a chunk of its target, and the verdict."""
    i = table(spark, d, "evaluation_items").select(
        F.col("item_id").alias("query"),
        F.explode(text.identifiers(F.col("expected_supporting_passage"))).alias("identifier")
    )
    c = _chunks(spark, d).select("chunk", F.explode(text.identifiers(F.col("text"))).alias("identifier"))
    gold = i.join(c, "identifier").groupBy("query", "chunk").agg(F.count("*").alias("n")).where("n >= 2").drop("n")
    nodes, edges, evidence = _eligible(spark, d)
    graph_ = hybrid.hop_evidence(edges, evidence, hybrid.hops(edges, cut_lineage(_seeds(spark, d, nodes, edges)), HOPS))
    found = lambda r, n: r.join(
        gold, ["query", "chunk"], "left_semi"
    ).select("query").distinct().withColumn(n, F.lit(True))
    x = _questions(spark, d).select("query").join(
        found(_vector_ranking(spark, d, K), "v"), "query", "left"
    ).join(found(graph_, "g"), "query", "left").fillna(False, ["v", "g"])
    return x.select(
        "query", F.col("v").alias("vector_hit"), F.col("g").alias("graph_hit"),
        assembly.verdict(F.col("v"), F.col("g")).alias("verdict")
    )


QUERIES = {
    f.__name__: f for f in (
        typed_nodes, eligible_edges, graph_artifacts, edge_embeddings, graph_payload_hash, graph_search, graph_outcomes,
        hybrid_seeds, hybrid_paths, hybrid_fusion, hybrid_contributions, mode_scores, artifact_search,
        artifact_retrieval, target_verdicts
    )
}

_REL = " union all ".join(
    f"select chunk, revision, t, unnest(regexp_extract_all(t, '{p}', 1)) subject, '{n}' predicate, unnest(regexp_extract_all(t, '{p}', 2)) object from c" for n,
    p in PATTERNS.items()
)
_KIND = lambda i, c: "case predicate " + " ".join(f"when '{p}' then '{k[i]}'" for p, k in KINDS.items()) + f" end {c}"
_IDS = "list_distinct(list_transform(regexp_extract_all({}, '([A-Za-z]{{1,6}}-\\d+[A-Za-z]?)', 1), lambda x: upper(x)))"
_DOT = "coalesce(list_dot_product({0}, {1}) / nullif(sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})), 0), 0)"


def _vector(t: str, dim: int) -> str:
    h = " || ".join(f"sha256({t} || '|{i}')" for i in range(dim // 8))
    return f"list_transform(range(0, {dim}), lambda i: cast(('0x' || substr({h}, cast(i * 8 + 1 as bigint), 8)) as bigint) / 2147483648.0 - 1)"


_BASE = f"""
c as (select chunk_id chunk, document_revision_id revision, chunk_text t, cast(embedding as double[]) v from (select *, row_number() over (partition by chunk_id order by created_at desc, document_revision_id) n from document_chunks) where n = 1),
rel as (select *, {_KEY.format('subject')} sk, {_KEY.format('object')} ok from ({_REL})),
good as (select *, 'node_' || substr(sha256(sk), 1, 24) src, 'node_' || substr(sha256(ok), 1, 24) dst, 'edge_' || substr(sha256(sk || '|' || predicate || '|' || ok), 1, 24) edge_id from rel where sk <> '' and ok <> ''),
ends as (select src node_id, subject as name, predicate, {_KIND(0, 'kind')} from good union all select dst, object, predicate, {_KIND(1, 'kind')} from good),
nodes as (select node_id, min(name) as name, arg_min(kind, (predicate, kind)) kind, list_sort(list(distinct name)) names, count(*) mentions from ends group by 1),
edges_ as (select distinct edge_id, src, predicate, dst from good),
ev_ as (select distinct edge_id, chunk, revision, t from good),
valid as (select distinct document_revision_id r from edib_revision_authority_period where effective_from <= date '{AS_OF}' and (effective_to is null or date '{AS_OF}' < effective_to)),
ev as materialized (select * from ev_ where revision in (select r from valid)),
edges as materialized (select * from edges_ where edge_id in (select edge_id from ev)),
"""
_TEXT = "select edge_id, s.name || ' ' || predicate || ' ' || o.name || '. ' || coalesce(t, '') said from {edges} e join nodes s on s.node_id = e.src join nodes o on o.node_id = e.dst left join (select edge_id, min(t) t from {ev} group by 1) using (edge_id)"
_SEEDS = f"""
qs as materialized (select item_id query, question, {_KEY.format('question')} qk, {_IDS.format('question')} qi, {_vector('question', 32)} e32, {_vector('question', 64)} e64 from evaluation_items),
al as (select node_id, unnest(names) alias from nodes where node_id in (select src from edges union select dst from edges) and kind not in ('status', 'other')),
ak as (select node_id, {_KEY.format('alias')} ak, {_IDS.format('alias')} ai from al),
named as materialized (select distinct query, node_id node from qs join ak on case when len(ai) > 0 then list_has_any(ai, qi) else length(ak) >= 4 and contains(qk, ak) end),
adj as materialized (select src node, dst nxt, edge_id from edges where src <> dst union all select dst, src, edge_id from edges where src <> dst),
"""
_HOPS = f"""
walk(query, node, distance) as (select query, node, 0 from named union select query, nxt, distance + 1 from walk join adj using (node) where distance < {HOPS}),
dist as (select query, node, min(distance) distance from walk group by 1, 2),
hop as (select query, chunk, min(distance) hop from dist join edges on node in (src, dst) join ev using (edge_id) group by 1, 2),
byhop as (select h.query, h.chunk, hop, coalesce(round({_DOT.format('v', 'e64')}, 9), 0) similarity from hop h join qs using (query) left join (select chunk, v from c where len(v) = 64) using (chunk)),
gr as (select *, row_number() over (partition by query order by hop, similarity desc, chunk) rank from byhop),
"""
_MORE = f"""
vr as materialized (select query, chunk, row_number() over (partition by query order by round({_DOT.format('v', 'e64')}, 9) desc, chunk) rank from qs, (select chunk, v from c where v is not null and len(v) = 64)),
said as materialized ({_TEXT.format(edges='edges', ev='ev')}),
er as (select query, edge_id, row_number() over (partition by query order by round({_DOT.format('w', 'e32')}, 9) desc, edge_id) rank from qs, (select edge_id, {_vector('said', 32)} w from said)),
lists as (select 0 l, query, edge_id, min(rank) rank from vr join ev using (chunk) where rank <= {POOL} group by 1, 2, 3 union all select 1, query, edge_id, rank from er where rank <= {POOL}),
touched as (select l, query, node, min(rank) rank from (select l, query, rank, unnest([src, dst]) node from lists join edges using (edge_id)) group by 1, 2, 3),
fusedn as (select query, node, round(sum(1.0 / (60 + rank)), 12) score from touched anti join named using (query, node) group by 1, 2),
seeds as materialized (select query, node, 'explicit' source, cast(null as double) score from named union all select query, node, 'supplemental', score from (select *, row_number() over (partition by query order by score desc, node) n from fusedn) where n <= 4),
steps(query, node, nodes, edge_ids) as (select query, node, [node], cast([] as varchar[]) from seeds union all
  select query, nxt, list_append(nodes, nxt), list_append(edge_ids, edge_id) from steps join adj using (node) where len(edge_ids) < {PATH_EDGES} and not list_contains(nodes, nxt)),
paths as (select query, 'path_' || substr(sha256(array_to_string(nodes, '>') || '|' || array_to_string(edge_ids, '>')), 1, 24) path_id, len(edge_ids) hops, edge_ids from steps where len(edge_ids) > 0),
ptext as (select query, path_id, string_agg(said, chr(10) order by pos) t from (select query, path_id, unnest(edge_ids) edge_id, unnest(range(1, len(edge_ids) + 1)) pos from paths) join said using (edge_id) group by 1, 2),
rp as materialized (select query, path_id, hops, edge_ids, score, row_number() over (partition by query order by score desc, hops, path_id) rank from (
  select p.query, path_id, hops, edge_ids, round({_DOT.format(_vector('t', 32), 'e32')}, 9) score from paths p join ptext using (query, path_id) join qs using (query)) qualify rank <= 32),
pe as (select query, chunk, min((rank, pos)) first_at from (select query, rank, unnest(edge_ids) edge_id, unnest(range(0, len(edge_ids))) pos from rp) join ev using (edge_id) group by 1, 2),
pr as (select query, chunk, row_number() over (partition by query order by first_at, chunk) rank from pe),
"""


def _rrf(name: str, other: str) -> str:
    return f"""{name} as (select query, chunk, round(score, 8) score, rank, contributed_by from (select *, row_number() over (partition by query order by score desc, chunk) rank from (
  select query, chunk, round(sum(1.0 / (60 + rank)), 12) score, case when count(distinct l) > 1 then 'both' when min(l) = 0 then 'vector_only' else 'graph_only' end contributed_by
  from (select query, chunk, rank, 0 l from vr where rank <= {K} union all select query, chunk, rank, 1 from {other}) group by 1, 2)) where rank <= {K})"""


_SCORES = f"""
gold as (select query, item from (select distinct item_id query, upper(unnest(regexp_extract_all(expected_supporting_passage, '\\b([A-Za-z]{{1,6}}-\\d+[A-Za-z]?)\\b', 1))) i from evaluation_items)
  join (select distinct chunk item, upper(unnest(regexp_extract_all(t, '\\b([A-Za-z]{{1,6}}-\\d+[A-Za-z]?)\\b', 1))) i from c) using (i) group by 1, 2 having count(*) >= 2),
hits as (select 'V' as mode, query, chunk, rank from vr union all select 'G', query, chunk, rank from gr union all select 'H1', query, chunk, rank from h1 union all select 'H2', query, chunk, rank from h2),
need as (select mode, query, count(item) required from (select unnest(['V', 'G', 'H1', 'H2']) as mode), qs left join gold using (query) group by 1, 2),
got as (select mode, h.query, count(*) found, min(rank) first_, sum(1 / log2(rank + 1)) gain from hits h join gold g on g.query = h.query and g.item = h.chunk where rank <= {K} group by 1, 2),
per as (select mode, required, coalesce(found, 0) found, round(coalesce(1.0 / first_, 0), 6) rr, case when required > 0 then round(coalesce(found, 0) / required, 6) else 1 end coverage,
  case when required > 0 then round(coalesce(gain, 0) / (select sum(1 / log2(i + 1)) from range(1, cast(least({K}, required) as bigint) + 1) t(i)), 6) else 0 end ndcg from need left join got using (mode, query))
"""
_GOLD = _SCORES[: _SCORES.index("hits as")].strip().rstrip(",")
_ART = f"""
art as (select node_id id, 'Entity: ' || name || ' (' || kind || ')' said from nodes union all
  select edge_id, s.name || ' --[' || predicate || ']--> ' || o.name || chr(10) || 'Evidence: ' || (select min(chunk) from ev_ where ev_.edge_id = e.edge_id) from edges_ e join nodes s on s.node_id = e.src join nodes o on o.node_id = e.dst),
ah as materialized (select * from (select query, id, sim, row_number() over (partition by query order by sim desc, id) rank from (select item_id query, id, round({_DOT.format('w', 'e')}, 9) sim from (select item_id, {_vector('question', 32)} e from evaluation_items), (select id, {_vector('said', 32)} w from art))) where rank <= 5)
"""
ORACLES = {
    "artifact_search": f'with {_BASE}{_ART} select query, id "row", rank, round(sim, 6) similarity from ah',
    "artifact_retrieval": f"""with {_BASE}{_ART}, s as (select distinct query, node from (select query, id node from ah join nodes on node_id = id union all select query, unnest([src, dst]) from ah join edges_ on edge_id = id)),
n as (select query, node, 0 d from s union all select query, case when src = node then dst else src end, 1 from s join edges_ on node in (src, dst) where src <> dst), dist as (select query, node, min(d) d from n group by 1, 2),
ch as (select query, count(distinct chunk) chunks from dist join edges_ on node in (src, dst) join ev_ using (edge_id) group by 1)
select query, count(*) filter (d = 0) seeds, count(*) nodes, any_value(chunks) chunks from dist left join ch using (query) group by 1""",
    "target_verdicts": f"""with recursive {_BASE}{_SEEDS}{_HOPS}{_MORE}{_GOLD},
x as (select query, exists (select 1 from vr join gold on gold.query = vr.query and item = chunk where vr.query = qs.query and rank <= {K}) v, exists (select 1 from gr join gold on gold.query = gr.query and item = chunk where gr.query = qs.query) g from qs)
select query, v vector_hit, g graph_hit, case when g and not v then 'PASS' when not g then 'FAIL: graph did not find it' else 'FAIL: vector found it too' end verdict from x""",
    "typed_nodes": f"with {_BASE.rstrip().rstrip(',')} select node_id, name, kind, array_to_string(list_filter(names, lambda x: x <> name), '|') aliases, mentions from nodes",
    "eligible_edges": f"with {_BASE.rstrip().rstrip(',')} select edge_id, src, predicate, dst, (select count(*) from ev where ev.edge_id = e.edge_id) chunks from edges e",
    "graph_artifacts": f"""with {_BASE.rstrip().rstrip(',')} select node_id artifact_id, 'entity' kind, 'Entity: ' || name || ' (' || kind || ')' as content from nodes
union all select edge_id, 'single_edge', s.name || ' --[' || predicate || ']--> ' || o.name || chr(10) || 'Evidence: ' || (select min(chunk) from ev_ where ev_.edge_id = e.edge_id) from edges_ e join nodes s on s.node_id = e.src join nodes o on o.node_id = e.dst""",
    "edge_embeddings": f"""with {_BASE} said as ({_TEXT.format(edges='edges_', ev='ev_')}), w as (select edge_id, said, {_vector('said', 32)} r from said)
select edge_id, sha256(said) text_hash, array_to_string(list_transform(r, lambda x: format('{{:.5f}}', x / sqrt(list_dot_product(r, r)))), ',') vector from w""",
    "graph_payload_hash": f"""with {_BASE.rstrip().rstrip(',')}, h as (select cast(('0x' || substr(sha256(node_id || chr(31) || name || chr(31) || kind || chr(31) || array_to_string(list_filter(names, lambda x: x <> name), chr(30))), 1, 15)) as bigint) x from nodes),
g as (select cast(('0x' || substr(sha256(edge_id || chr(31) || src || chr(31) || predicate || chr(31) || dst), 1, 15)) as bigint) x from edges_)
select (select sha256(count(*) || '|' || sum(x)) from h) nodes_hash, (select count(*) from h) nodes, (select sha256(count(*) || '|' || sum(x)) from g) edges_hash, (select count(*) from g) edges""",
    "graph_search": f"with recursive {_BASE}{_SEEDS}{_HOPS.rstrip().rstrip(',')} select query, chunk, hop, round(similarity, 6) similarity, rank from gr where rank <= {K}",
    "graph_outcomes": f"""with recursive {_BASE}{_SEEDS}{_HOPS.rstrip().rstrip(',')} select query, case when s is null then 'no_seed_entity' else 'ok' end outcome, coalesce(s, 0) seeds, coalesce(n, 0) chunks
from qs left join (select query, count(*) s from named group by 1) using (query) left join (select query, count(*) n from gr group by 1) using (query)""",
    "hybrid_seeds": f"with recursive {_BASE}{_SEEDS}{_MORE.rstrip().rstrip(',')} select query, node, source, round(score, 8) score from seeds",
    "hybrid_paths": f"with recursive {_BASE}{_SEEDS}{_MORE.rstrip().rstrip(',')} select query, path_id, cast(hops as int) hops, array_to_string(edge_ids, ',') edges, round(score, 6) score, rank from rp",
    "hybrid_fusion": f"with recursive {_BASE}{_SEEDS}{_MORE}{_rrf('h2', 'pr')} select * from h2",
    "hybrid_contributions": f"with recursive {_BASE}{_SEEDS}{_MORE}{_rrf('h2', 'pr')} select contributed_by, count(*) chunks, count(distinct query) questions, count(*) filter (rank = 1) as first from h2 group by 1",
    "mode_scores": f"with recursive {_BASE}{_SEEDS}{_HOPS}{_MORE}{_rrf('h1', 'gr')}, {_rrf('h2', 'pr')}, {_SCORES} select mode, round(avg(coverage), 6) coverage, round(avg(rr), 6) mrr, round(avg(ndcg), 6) ndcg, count(*) filter (found = required) solved, count(*) filter (found between 1 and required - 1) partial, count(*) filter (found = 0 and required > 0) failed from per group by 1",
}
