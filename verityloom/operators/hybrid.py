"""Retrieval over an evidence graph and its fusion with vector retrieval: typed graphs, seeds, hops, ranked paths.

relations(subject, predicate, object, chunk, revision) are assertions with the chunk that holds them. Everything here runs
for all queries at once: seeds, frontiers and paths carry the query they belong to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verityloom.functions import hashing, vectors
from verityloom.functions.text import entity_key
from verityloom.operators.graph import Neighbours
from verityloom.operators.keyed import first_per_key
from verityloom.session import cut_lineage


def typed_graph(relations: DataFrame, kinds: dict[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, evidence) of assertions; names of one entity key are one node.

    nodes(node_id, name, kind, aliases, mentions): the name is the least of a node, the others are its aliases, the kind that
    of the least predicate it occurs under. edges(edge_id, src, predicate, dst): one per distinct assertion. evidence(edge_id,
    chunk, revision): the chunks that hold it. kinds: predicate -> kinds of subject and object. Assertions without a
    subject, object or key are rejected.
    """
    ok = relations.select(
        "*", entity_key(F.col("subject")).alias("sk"), entity_key(F.col("object")).alias("ok")
    ).where("sk <> '' and ok <> ''")
    kind = lambda i: F.coalesce(
        *(F.when(F.col("predicate") == p, F.lit(k[i])) for p, k in kinds.items()), F.lit("other")
    )
    ends = ok.select(
        F.explode(
            F.array(
                F.struct(F.col("sk").alias("key"), F.col("subject").alias("name"), "predicate", kind(0).alias("kind")),
                F.struct(F.col("ok").alias("key"), F.col("object").alias("name"), "predicate", kind(1).alias("kind"))
            )
        ).alias("e")
    ).select("e.*")
    n = ends.groupBy("key").agg(
        F.min("name").alias("name"), F.min_by("kind", F.struct("predicate", "kind")).alias("kind"),
        F.array_sort(F.collect_set("name")).alias("names"), F.count("*").alias("mentions")
    )
    nodes = n.select(
        hashing.short_id("node_", F.col("key")).alias("node_id"), "name", "kind",
        F.array_remove("names", F.col("name")).alias("aliases"), "mentions"
    )
    e = ok.select(
        hashing.short_id("edge_", F.col("sk"), F.col("predicate"), F.col("ok")).alias("edge_id"),
        hashing.short_id("node_", F.col("sk")).alias("src"), "predicate",
        hashing.short_id("node_", F.col("ok")).alias("dst"), "chunk", "revision"
    )
    return nodes, e.select(
        "edge_id", "src", "predicate", "dst"
    ).distinct(), e.select("edge_id", "chunk", "revision").distinct()


def eligible_graph(edges: DataFrame, evidence: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges with evidence in eligible revisions, and that evidence: no eligible revisions, no edges."""
    ev = evidence.join(revisions.select("revision").distinct(), "revision", "left_semi")
    return edges.join(ev.select("edge_id"), "edge_id", "left_semi"), ev


def artifacts(nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """(artifact_id, kind, content): a text per entity and per edge, the latter with its first evidence or the word None."""
    n = nodes.select("node_id", "name")
    first = evidence.groupBy("edge_id").agg(F.min("chunk").alias("chunk"))
    e = edges.join(
        n.select(F.col("node_id").alias("src"), F.col("name").alias("s")), "src"
    ).join(n.select(F.col("node_id").alias("dst"), F.col("name").alias("o")), "dst").join(first, "edge_id", "left")
    one = nodes.select(
        F.col("node_id").alias("artifact_id"), F.lit("entity").alias("kind"),
        F.concat(F.lit("Entity: "), F.col("name"), F.lit(" ("), F.col("kind"), F.lit(")")).alias("content")
    )
    return one.unionByName(
        e.select(
            F.col("edge_id").alias("artifact_id"), F.lit("single_edge").alias("kind"),
            F.concat(
                F.col("s"), F.lit(" --["), F.col("predicate"), F.lit("]--> "), F.col("o"), F.lit("\nEvidence: "),
                F.coalesce("chunk", F.lit("None"))
            ).alias("content")
        )
    )


def edge_texts(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """(edge_id, text, embedding): what an edge is searched by: subject, predicate, object, and the least text that asserts it; chunks(chunk, text)."""
    n = nodes.select("node_id", "name")
    text = evidence.join(chunks, "chunk").groupBy("edge_id").agg(F.min("text").alias("t"))
    x = edges.join(
        n.select(F.col("node_id").alias("src"), F.col("name").alias("s")), "src"
    ).join(n.select(F.col("node_id").alias("dst"), F.col("name").alias("o")), "dst").join(text, "edge_id", "left")
    said = F.concat(F.concat_ws(" ", "s", "predicate", "o"), F.lit(". "), F.coalesce("t", F.lit("")))
    return x.select("edge_id", said.alias("text")).withColumn("embedding", vectors.hashed_embedding(F.col("text"), 32))


def graph_hash(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: order-free hashes of the nodes and of the edges, equal for graphs of equal content."""
    aliases = F.array_join("aliases", "\u001e")
    n = nodes.agg(
        hashing.set_hash(F.col("node_id"), F.col("name"), F.col("kind"), aliases).alias("nodes_hash"),
        F.count("*").alias("nodes")
    )
    e = edges.agg(
        hashing.set_hash(F.col("edge_id"), F.col("src"), F.col("predicate"), F.col("dst")).alias("edges_hash"),
        F.count("*").alias("edges")
    )
    return n.crossJoin(e)  # two single rows


def hops(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(query, node, distance) from seeds(query, node), along edges in either direction, every query by itself."""
    near = Neighbours(edges)
    seen = cut_lineage(seeds.select("query", "node").distinct().withColumn("distance", F.lit(0)))
    front = seen
    for step in range(1, max_depth + 1):
        reached = near.of(front.select("query", "node")).select("query", F.col("next").alias("node")).distinct()
        front = cut_lineage(reached.join(seen, ["query", "node"], "left_anti").withColumn("distance", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    near.close()
    return seen


def hop_evidence(
    edges: DataFrame, evidence: DataFrame, dist: DataFrame, similarity: DataFrame | None = None
) -> DataFrame:
    """(query, chunk, hop, similarity, rank): the chunks of all edges that touch a reached node, by hop, similarity and id.

    An edge's hop is the lesser distance of its ends, one end being enough. similarity(query, chunk, similarity) may lack
    pairs, which have 0.
    """
    one = lambda c: edges.select(
        "edge_id", F.col(c).alias("node")
    ).join(dist, "node").select("query", "edge_id", "distance")
    hop = one("src").unionByName(one("dst")).groupBy("query", "edge_id").agg(F.min("distance").alias("hop"))
    c = hop.join(
        evidence.select("edge_id", "chunk"), "edge_id"
    ).groupBy("query", "chunk").agg(F.min("hop").alias("hop"))
    c = c.withColumn("similarity", F.lit(0.0)) if similarity is None else c.join(
        similarity, ["query", "chunk"], "left"
    ).fillna(0.0, ["similarity"])
    rank = F.row_number().over(Window.partitionBy("query").orderBy("hop", F.desc("similarity"), "chunk"))
    return c.withColumn("rank", rank)


def outcomes(queries: DataFrame, seeds: DataFrame, ranked: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(query, outcome, seeds, chunks): failed_closed for queries of failed(query), no_seed_entity without a seed, else ok."""
    x = queries.select("query").distinct().join(
        seeds.groupBy("query").agg(F.count_distinct("node").alias("seeds")), "query", "left"
    ).join(ranked.groupBy("query").agg(F.count("*").alias("chunks")), "query", "left")
    x = x.withColumn("f", F.lit(False)) if failed is None else x.join(
        failed.select("query", F.lit(True).alias("f")).distinct(), "query", "left"
    )
    code = F.when(
        F.coalesce("f", F.lit(False)), "failed_closed"
    ).when(F.col("seeds").isNull(), "no_seed_entity").otherwise("ok")
    return x.select(
        "query", code.alias("outcome"), F.coalesce("seeds", F.lit(0)).alias("seeds"),
        F.when(code == "ok", F.coalesce("chunks", F.lit(0))).otherwise(0).alias("chunks")
    )


def supplemental_seeds(
    explicit: DataFrame, rankings: list[DataFrame], ends: DataFrame, cap: int = 4, constant: int = 60
) -> DataFrame:
    """(query, node, source, score): explicit seeds as they are and the best `cap` supplemental ones of each query.

    rankings: (query, edge_id, rank) each, as of the edges in the nearest chunks and of the nearest edges; both ends of an
    edge take its rank, in ends(edge_id, node). Nodes are fused by reciprocal rank; a seed that is explicit is not
    supplemented and does not count towards the cap, which is the operator's feature.
    """
    rows = None
    for i, r in enumerate(rankings):
        x = r.join(ends, "edge_id").groupBy("query", "node").agg(
            F.min("rank").alias("rank")
        ).withColumn("list", F.lit(i))
        rows = x if rows is None else rows.unionByName(x)
    fused = rows.groupBy("query", "node").agg(F.round(F.sum(1 / (F.lit(constant) + F.col("rank"))), 12).alias("score"))
    fused = fused.join(explicit.select("query", "node"), ["query", "node"], "left_anti")
    at = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    more = fused.withColumn("at", at).where(F.col("at") <= cap).select(
        "query", "node", F.lit("supplemental").alias("source"), "score"
    )
    return explicit.select(
        "query", "node", F.lit("explicit").alias("source"), F.lit(None).cast("double").alias("score")
    ).distinct().unionByName(more)


def seed_paths(edges: DataFrame, seeds: DataFrame, max_edges: int, ceiling: int) -> DataFrame:
    """(query, path_id, hops, edge_ids, nodes): simple paths of up to max_edges edges from every seed of every query.

    Every beginning of a path is one too. Parallel edges make paths of their own. Raises once there are more than `ceiling`.
    """
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), "edge_id").unionByName(
        edges.select(F.col("dst").alias("node"), F.col("src").alias("next"), "edge_id")
    ).where("node <> next")
    front = seeds.select(
        "query", "node", F.array("node").alias("nodes"), F.array().cast("array<string>").alias("edge_ids")
    ).distinct()
    out, total = None, 0
    for step in range(1, max_edges + 1):
        grown = front.join(both, "node").where(~F.array_contains("nodes", F.col("next"))).select(
            "query", F.col("next").alias("node"), F.concat("nodes", F.array("next")).alias("nodes"),
            F.concat("edge_ids", F.array("edge_id")).alias("edge_ids")
        )
        total += grown.limit(ceiling - total + 1).count()
        if total > ceiling:
            raise ValueError(f"more than {ceiling} paths of up to {step} edges")
        front = cut_lineage(grown)
        level = front.withColumn("hops", F.lit(step))
        out = level if out is None else out.unionByName(level)
    return out.select(
        "query", hashing.short_id("path_", F.concat_ws(">", "nodes"), F.concat_ws(">", "edge_ids")).alias("path_id"),
        "hops", "edge_ids", "nodes"
    )


def ranked_paths(paths: DataFrame, texts: DataFrame, queries: DataFrame, keep: int = 32) -> DataFrame:
    """(query, path_id, hops, edge_ids, score, rank): each query's paths by similarity of their text, hops and id; the best `keep`.

    A path's text is its edges' texts line by line; it is embedded and held against queries(query, embedding). The cut
    comes after all are scored and is the operator's feature.
    """
    e = paths.select(
        "query", "path_id", F.posexplode("edge_ids").alias("pos", "edge_id")
    ).join(texts.select("edge_id", "text"), "edge_id")
    said = e.groupBy("query", "path_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n"
        ).alias("text")
    )
    x = said.withColumn("v", vectors.hashed_embedding(F.col("text"), 32)).join(
        queries.select("query", F.col("embedding").alias("q")), "query"
    )
    x = x.select(
        "query", "path_id", F.round(vectors.cosine(F.col("v"), F.col("q")), 9).alias("score")
    ).join(paths.select("query", "path_id", "hops", "edge_ids"), ["query", "path_id"])
    at = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "hops", "path_id"))
    return x.withColumn("rank", at).where(F.col("rank") <= keep)


def path_evidence(ranked: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query, chunk, rank): chunks of the ranked paths' edges, each at its first occurrence by path, place on it and id."""
    e = ranked.select(
        "query", F.col("rank").alias("path_rank"), F.posexplode("edge_ids").alias("pos", "edge_id")
    ).join(evidence.select("edge_id", "chunk"), "edge_id")
    once = first_per_key(e, ["query", "chunk"], "path_rank", "pos")
    return once.select(
        "query", "chunk",
        F.row_number().over(Window.partitionBy("query").orderBy("path_rank", "pos", "chunk")).alias("rank")
    )


def contributed_by(sources: Column) -> Column:
    """Of a fusion of a vector ranking (0) and a graph ranking (1): which of the two, or both, gave an item."""
    return F.when(F.size(sources) > 1, "both").when(F.array_contains(sources, 0), "vector_only").otherwise("graph_only")
