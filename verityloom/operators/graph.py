"""Property graphs as node and edge tables: extraction, seeds, traversal and paths, all level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verityloom.functions.hashing import short_id
from verityloom.functions.text import entity_key
from verityloom.operators.elements import contained
from verityloom.operators.keyed import first_per_key
from verityloom.session import cut_lineage


NOT_SEEDS = ("status", "other")  # fixed values: kinds of nodes that no query begins from


def adjacency(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, next, direction) of every edge in both directions."""
    return edges.select(F.col(src).alias("node"), F.col(dst).alias("next"), F.lit("out").alias("direction")).unionByName(
        edges.select(F.col(dst).alias("node"), F.col(src).alias("next"), F.lit("in").alias("direction"))
    )


class Neighbours:
    """Distinct (node, next) of both directions, kept by node: a step joins them where they lie and shuffles only its frontier.

    Nodes with more than 1/200 of all links, fewer than 200, are kept apart and spread evenly; the frontier's rows for them,
    at most one per such node and seed, are joined by the optimiser's choice. Blocks lost with an executor are worked out
    again from the edges.
    """

    def __init__(self, edges: DataFrame, share: int = 200, least: int = 50_000) -> None:
        pairs = adjacency(edges).select("node", "next").distinct()
        degree = pairs.groupBy("node").agg(F.count("*").alias("n"))
        total, most = degree.agg(F.sum("n"), F.max("n")).first()
        line = max(least, (total or 0) // share)
        self.hubs = [r[0] for r in degree.where(F.col("n") > line).select("node").collect()] if (most or 0) > line else []
        is_hub = F.col("node").isin(self.hubs)  # they are set apart before anything is laid out by node
        self.few = (pairs.where(~is_hub) if self.hubs else pairs).repartition("node").persist()
        self.many = pairs.where(is_hub).repartition("next").persist() if self.hubs else None

    def of(self, front: DataFrame) -> DataFrame:
        """The rows of front(node, ...), one per neighbour of the node, with that as next."""
        got = self.few.join(front, "node")
        return got if self.many is None else got.unionByName(
            self.many.join(front.where(F.col("node").isin(self.hubs)), "node")
        )

    def close(self) -> None:
        self.few.unpersist()
        if self.many is not None:
            self.many.unpersist()


def extract_relations(df: DataFrame, keep: list[str], text: str, patterns: dict[str, str]) -> DataFrame:
    """(keep..., subject, predicate, object): every match of every two-group pattern in the text."""
    found = [
        df.select(
            *keep, F.lit(p).alias("predicate"),
            F.explode(
                F.arrays_zip(
                    F.regexp_extract_all(text, F.lit(rx), 1).alias("s"),
                    F.regexp_extract_all(text, F.lit(rx), 2).alias("o")
                )
            ).alias("m")
        ) for p,
        rx in patterns.items()
    ]
    return reduce(DataFrame.unionByName, found).select(
        *keep, F.col("m.s").alias("subject"), "predicate", F.col("m.o").alias("object")
    )


def build_graph(relations: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of extracted relations: one node per distinct name, one edge per distinct assertion.

    nodes: node_id, name, mentions. edges: edge_id, src, predicate, dst, first_source (the least source that asserts it),
    sources (how many do). Rows without subject or object are rejected. Ids are hashes of the content.
    """
    ok = relations.where(
        (F.coalesce(F.trim("subject"), F.lit("")) != "") & (F.coalesce(F.trim("object"), F.lit("")) != "")
    )
    names = ok.select(
        F.explode(F.array("subject", "object")).alias("name")
    ).groupBy("name").agg(F.count("*").alias("mentions"))
    nodes = names.select(short_id("node_", F.col("name")).alias("node_id"), "name", "mentions")
    edges = ok.groupBy("subject", "predicate", "object").agg(
        F.min(source).alias("first_source"), F.count_distinct(source).alias("sources")
    )
    return nodes, edges.select(
        short_id("edge_", F.col("subject"), F.col("predicate"), F.col("object")).alias("edge_id"),
        short_id("node_", F.col("subject")).alias("src"), "predicate", short_id("node_", F.col("object")).alias("dst"),
        "first_source", "sources"
    )


def distances(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(node, distance): steps from the nearest seed along edges in either direction, up to max_depth."""
    near = Neighbours(edges)
    seen = cut_lineage(seeds.select("node").distinct().withColumn("distance", F.lit(0)))
    front = seen
    for step in range(1, max_depth + 1):
        reached = near.of(front.select("node")).select(F.col("next").alias("node")).distinct()
        front = cut_lineage(reached.join(seen, "node", "left_anti").withColumn("distance", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    near.close()
    return seen


def edge_hops(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """Edges with the lesser distance of their ends; an edge with one end reached counts."""
    d = lambda c: dist.select(F.col("node").alias(c), F.col("distance").alias(f"_{c}"))
    return edges.join(d("src"), "src", "left").join(d("dst"), "dst", "left").withColumn(
        "hop", F.least("_src", "_dst")
    ).where("hop is not null").drop("_src", "_dst")


def maximal_paths(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(seed, leaf, depth, path): paths of the breadth-first trees that nothing continues; of several parents the least id."""
    near = Neighbours(edges)
    seen = cut_lineage(
        seeds.select(F.col("node").alias("seed"), "node").distinct().select(
            "seed", "node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"),
            F.array("node").alias("path")
        )
    )
    front = seen
    for step in range(1, max_depth + 1):
        reached = near.of(front.select("seed", "node", "path")).select(
            "seed", F.col("next").alias("node"), F.col("node").alias("parent"), "path"
        )
        fresh = reached.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        front = cut_lineage(
            first_per_key(fresh, ["seed", "node"], "parent").select(
                "seed", "node", "parent", F.lit(step).alias("depth"), F.concat("path", F.array("node")).alias("path")
            )
        )
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    near.close()
    inner = seen.where("parent is not null").select("seed", F.col("parent").alias("node")).distinct()
    return seen.join(inner, ["seed", "node"], "left_anti").select(
        "seed", F.col("node").alias("leaf"), "depth", F.array_join("path", " > ").alias("path")
    )


def simple_paths(edges: DataFrame, seeds: DataFrame, max_edges: int, ceiling: int) -> DataFrame:
    """(seed, node, hops, path): all paths without a repeated node, every beginning of a path being one itself.

    Raises once a level brings the total above the ceiling, before the next level is built.
    """
    near = Neighbours(edges)
    front = seeds.select(F.col("node").alias("seed"), "node", F.array("node").alias("path")).distinct()
    out, total = None, 0
    for step in range(1, max_edges + 1):
        grown = near.of(front).where(~F.array_contains("path", F.col("next"))).select(
            "seed", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path")
        )
        total += grown.limit(ceiling - total + 1).count()
        if total > ceiling:
            raise ValueError(f"more than {ceiling} paths of up to {step} edges")
        front = cut_lineage(grown)
        level = front.withColumn("hops", F.lit(step))
        out = level if out is None else out.unionByName(level)
    near.close()
    return out.select("seed", "node", "hops", F.array_join("path", " > ").alias("path"))


def match_seeds(
    queries: DataFrame, query_id: str, text: Column, nodes: DataFrame, name: str, aliases: str | None = None,
    kind: str | None = None, least: int = 4, not_seeds: tuple[str, ...] = NOT_SEEDS
) -> DataFrame:
    """(query_id, name, alias): the nodes that a query names, each by the first of its name and aliases that matches.

    An alias with identifiers matches only by a whole identifier that the query has too. Any other matches if its key, of
    at least `least` characters, stands anywhere in the key of the query: one automaton of all such keys, in blocks of
    bounded size, passes over the queries. Nodes of the kinds in not_seeds match nothing; a null text neither.
    """
    n = nodes.where(~F.coalesce(F.col(kind), F.lit("")).isin(*not_seeds)) if kind else nodes
    all_ = F.concat(
        F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>"))
    ) if aliases else F.array(F.col(name))
    n = n.select(F.col(name).alias("name"), F.posexplode(all_).alias("pos", "alias")).where("alias is not null")
    ids = lambda c: F.array_distinct(
        F.transform(F.regexp_extract_all(c, F.lit(r"([A-Za-z]{1,6}-\d+[A-Za-z]?)"), 1), F.upper)
    )
    n = n.withColumn("ids", ids(F.col("alias")))
    q = queries.select(F.col(query_id).alias("q"), text.alias("t"))
    by_id = q.select("q", F.explode(ids(F.col("t"))).alias("k")).join(
        n.select("name", "pos", "alias", F.explode("ids").alias("k")), "k"
    ).select("q", "name", "pos", "alias")
    plain = n.where("size(ids) = 0").withColumn("k", entity_key(F.col("alias"))).where(F.length("k") >= least)
    hits = contained(
        plain.select("k").distinct().withColumn("i", F.col("k")), "i", "k",
        q.select("q", entity_key(F.col("t")).alias("t")), "q", "t"
    )
    by_text = hits.select("q", F.col("i").alias("k")).join(plain, "k").select("q", "name", "pos", "alias")
    first = by_id.unionByName(by_text).groupBy("q", "name").agg(F.min_by("alias", "pos").alias("alias"))
    return first.select(F.col("q").alias(query_id), F.col("name").alias(name), "alias")


def path_histogram(paths: DataFrame) -> DataFrame:
    return paths.groupBy("hops").agg(F.count("*").alias("paths"), F.count_distinct("node").alias("nodes"))


def graph_agreement(found: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: gold, found and common edges, recall (null without gold), precision (1 without found)."""
    cols = ["subject", "predicate", "object"]
    f, g = (x.select(*cols).distinct() for x in (found, gold))
    both = f.join(g, cols, "left_semi").agg(F.count("*").alias("common"))
    one = f.agg(F.count("*").alias("found")).crossJoin(g.agg(F.count("*").alias("gold"))).crossJoin(both)  # three single rows
    return one.select(
        "gold", "found", "common", F.round(F.try_divide("common", "gold"), 6).alias("recall"),
        F.round(F.coalesce(F.try_divide("common", "found"), F.lit(1.0)), 6).alias("precision")
    )


def ranked_by(df: DataFrame, group: str, *order: Column | str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
