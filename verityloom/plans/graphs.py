"""Graph queries with their SQL: trade geography, and relations extracted from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verityloom.functions import text
from verityloom.operators import graph
from verityloom.session import table

# Two-group patterns that both Java and RE2 read alike.
PATTERNS = {
    "controls": r"[Cc]ontrol (C-[0-9]+[a-z]?) of the ([A-Z][a-z]+ [A-Z][a-z]+) service",
    "annex_to": r"Annex ([0-9]+) to (O-[0-9]+)",
    "finding_against": r"Finding ([0-9]+) against (APP-[0-9]+)",
    "section_of": r"Section ([0-9]+) of procedure (P-[0-9]+)",
    "located_in": r"Application (APP-[0-9]+) in ([A-Z][a-z]+)",
}
CEILING = 5_000_000


def _geo(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = t("nation").select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst")).unionByName(
        t("supplier").select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"))
    )
    return e.unionByName(
        t("customer").select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))
    )


def _trade(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")
    ).distinct()
    return _geo(spark, d).unionByName(parts)


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))


def graph_bfs_distance(spark: SparkSession, d: str) -> DataFrame:
    return graph.distances(_trade(spark, d), _regions(spark, d).where("node = 'r0'"), 5)


def hop_ranked_edges(spark: SparkSession, d: str) -> DataFrame:
    e = _trade(spark, d)
    return graph.edge_hops(
        e, graph.distances(e, _regions(spark, d).where("node = 'r0'"), 3)
    ).groupBy("hop").agg(F.count("*").alias("edges"))


def graph_maximal_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.maximal_paths(_geo(spark, d), _regions(spark, d), 4)


def graph_simple_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.simple_paths(_geo(spark, d), _regions(spark, d), 5, CEILING)


def path_histogram(spark: SparkSession, d: str) -> DataFrame:
    return graph.path_histogram(graph_simple_paths(spark, d))


def _relations(spark: SparkSession, d: str) -> DataFrame:
    return graph.extract_relations(table(spark, d, "documents"), ["doc_id"], "text", PATTERNS)


def relation_extract(spark: SparkSession, d: str) -> DataFrame:
    return _relations(spark, d).groupBy("doc_id", "subject", "predicate", "object").agg(F.count("*").alias("n"))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.build_graph(_relations(spark, d), "doc_id")[0]


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.build_graph(_relations(spark, d), "doc_id")[1]


def graph_build_eval(spark: SparkSession, d: str) -> DataFrame:
    """Relations found in the chunks against those found in the whole documents."""
    chunks = graph.extract_relations(table(spark, d, "document_chunks"), ["chunk_id"], "chunk_text", PATTERNS)
    return graph.graph_agreement(chunks, _relations(spark, d))


def graph_seed_match(spark: SparkSession, d: str) -> DataFrame:
    """Extracted nodes that test questions name, by identifier or by name."""
    nodes = graph.build_graph(_relations(spark, d), "doc_id")[0]
    return graph.match_seeds(table(spark, d, "evaluation_items"), "item_id", F.col("question"), nodes, "name")


def identifier_index(spark: SparkSession, d: str) -> DataFrame:
    """How many documents name each identifier."""
    ids = table(spark, d, "documents").select("doc_id", F.explode(text.identifiers(F.col("text"))).alias("identifier"))
    return ids.groupBy("identifier").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


QUERIES = {
    f.__name__: f for f in (
        graph_bfs_distance, hop_ranked_edges, graph_maximal_paths, graph_simple_paths, path_histogram, relation_extract,
        graph_nodes, graph_edges, graph_build_eval, graph_seed_match, identifier_index
    )
}

_GEO = """
e_small as (select 'n' || n_nationkey s, 'r' || n_regionkey t from nation union all select 's' || s_suppkey, 'n' || s_nationkey from supplier),
e_geo as (select * from e_small union all select 'c' || c_custkey, 'n' || c_nationkey from customer),
e_trade as (select * from e_geo union all select distinct 's' || l_suppkey, 'p' || l_partkey from lineitem),
"""
_ADJ = "adj as (select distinct * from (select s, t from {0} union all select t, s from {0}) x),"
_BFS = "walk(node, distance) as (select 'r0', 0 union select t, distance + 1 from walk join adj on s = node where distance < {0}), dist as (select node, min(distance) distance from walk group by 1)"
_REL = " union all ".join(
    f"select doc_id, unnest(regexp_extract_all(text, '{p}', 1)) subject, '{n}' predicate, unnest(regexp_extract_all(text, '{p}', 2)) object from documents" for n,
    p in PATTERNS.items()
)
_REL_CHUNK = _REL.replace("doc_id", "chunk_id").replace("(text,", "(chunk_text,").replace(
    "from documents", "from document_chunks"
)
_PATHS = f"""with recursive {_GEO} {_ADJ.format("e_geo")}
p(seed, node, hops, path) as (
  select 'r' || r_regionkey, 'r' || r_regionkey, 0, ['r' || r_regionkey] from region
  union all select seed, t, hops + 1, list_append(path, t) from p join adj on s = node where hops < 5 and not list_contains(path, t))"""
_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace({}, '\\s+', ' ', 'g'))), '^the ', ''), '^a ', ''), '^an ', ''), '^(application|control|procedure|obligation) (.)', '\\2'), ' business service$', ''))"
ORACLES = {
    "graph_bfs_distance": f"with recursive {_GEO} {_ADJ.format('e_trade')} {_BFS.format(5)} select node, distance from dist",
    "hop_ranked_edges": f"with recursive {_GEO} {_ADJ.format('e_trade')} {_BFS.format(3)} select hop, count(*) edges from (select least(a.distance, b.distance) hop from e_trade left join dist a on a.node = s left join dist b on b.node = t) where hop is not null group by 1",
    "graph_maximal_paths": f"""with recursive {_GEO} {_ADJ.format('e_geo')}
p(seed, node, depth, path) as (
  select 'r' || r_regionkey, 'r' || r_regionkey, 0, ['r' || r_regionkey] from region
  union all select seed, t, depth + 1, list_append(path, t) from p join adj on s = node where depth < 4 and not list_contains(path, t))
select seed, node leaf, depth, array_to_string(path, ' > ') path from p a where not exists (select 1 from p b where b.seed = a.seed and b.depth = a.depth + 1 and b.path[1:a.depth + 1] = a.path)""",
    "graph_simple_paths": _PATHS + " select seed, node, hops, array_to_string(path, ' > ') path from p where hops > 0",
    "path_histogram": _PATHS + " select hops, count(*) paths, count(distinct node) nodes from p where hops > 0 group by 1",
    "relation_extract": f"select doc_id, subject, predicate, object, count(*) n from ({_REL}) group by all",
    "graph_nodes": f"select 'node_' || substr(sha256(name), 1, 24) node_id, name, count(*) mentions from (select unnest([subject, object]) name from ({_REL})) group by name",
    "graph_edges": f"select 'edge_' || substr(sha256(subject || '|' || predicate || '|' || object), 1, 24) edge_id, 'node_' || substr(sha256(subject), 1, 24) src, predicate, 'node_' || substr(sha256(object), 1, 24) dst, min(doc_id) first_source, count(distinct doc_id) sources from ({_REL}) group by subject, predicate, object",
    "graph_build_eval": f"with g as (select distinct subject, predicate, object from ({_REL})), f as (select distinct subject, predicate, object from ({_REL_CHUNK})), c as (select count(*) n from f join g using (subject, predicate, object)) select (select count(*) from g) gold, (select count(*) from f) found, n common, round(n / nullif((select count(*) from g), 0), 6) recall, round(coalesce(n / nullif((select count(*) from f), 0), 1), 6) \"precision\" from c",
    "graph_seed_match": f"""with n as (select distinct unnest([subject, object]) name from ({_REL})),
k as (select name, {_KEY.format('name')} key, list_transform(regexp_extract_all(name, '([A-Za-z]{{1,6}}-\\d+[A-Za-z]?)', 1), lambda x: upper(x)) ids from n),
q as (select item_id, {_KEY.format('question')} key, list_transform(regexp_extract_all(question, '([A-Za-z]{{1,6}}-\\d+[A-Za-z]?)', 1), lambda x: upper(x)) ids from evaluation_items)
select item_id, name, name alias from q join k on case when len(k.ids) > 0 then list_has_any(q.ids, k.ids) else length(k.key) >= 4 and contains(q.key, k.key) end""",
    "identifier_index": "select identifier, count(*) documents, min(doc_id) first_doc from (select distinct doc_id, upper(unnest(regexp_extract_all(text, '\\b([A-Za-z]{1,6}-\\d+[A-Za-z]?)\\b', 1))) identifier from documents) group by 1",
}
