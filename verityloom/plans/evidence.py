"""Queries that put the parts together: authority-aware search, snapshots, evidence, provenance, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verityloom.functions import hashing, text
from verityloom.operators import assembly, elements, graph, keyed, metrics, search, temporal
from verityloom.plans import graphs
from verityloom.session import table

AS_OF = "2021-06-30"
K = 5


def _eligible(spark: SparkSession, d: str) -> DataFrame:
    """Revisions in force on AS_OF."""
    p = temporal.real(table(spark, d, "edib_revision_authority_period"), "effective_from", "effective_to")
    return p.where(
        temporal.covers(F.lit(AS_OF).cast("date"), F.col("effective_from"), F.col("effective_to"))
    ).select("document_revision_id").distinct()


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "document_chunks").select(
        "chunk_id", "document_id", "document_revision_id", "embedding", "created_at"
    )
    return keyed.first_per_key(c, ["chunk_id"], F.desc("created_at"), "document_id")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(
        F.col("vec_id").cast("string").alias("chunk_id"), "embedding"
    )


def authority_aware_search(spark: SparkSession, d: str) -> DataFrame:
    """The nearest chunks of each query vector among the revisions in force on a day: resolved first, then ranked."""
    got = search.eligible_search(
        _questions(spark, d), "chunk_id", _chunks(spark, d), "chunk_id", "embedding", _eligible(spark, d),
        "document_revision_id", K, skip_self=False
    )
    return got.select("query", "row", "rank", F.round("similarity", 6).alias("similarity"))


def cross_document_diversity(spark: SparkSession, d: str) -> DataFrame:
    """Distinct documents among the hits of each query."""
    of = _chunks(spark, d).select(F.col("chunk_id").alias("row"), "document_id")
    return authority_aware_search(spark, d).join(of, "row").groupBy("query").agg(
        F.count_distinct("document_id").alias("documents"), F.count("*").alias("hits")
    )


def registry_snapshot_hash(spark: SparkSession, d: str) -> DataFrame:
    """An order-free hash of every document's periods."""
    p = table(spark, d, "edib_revision_authority_period").select(
        "logical_document_id", "authority_period_id", "document_revision_id", "effective_from", "effective_to"
    ).distinct()
    return p.groupBy("logical_document_id").agg(
        hashing.set_hash(
            F.col("authority_period_id"), F.col("document_revision_id"), F.col("effective_from"), F.col("effective_to")
        ).alias("snapshot")
    )


def authority_switch_invariants(spark: SparkSession, d: str) -> DataFrame:
    """A new period changes the registry's hash and what is in force, and leaves the index's hash as it is."""
    p = table(spark, d, "edib_revision_authority_period").select(
        "document_revision_id", "effective_from", "effective_to"
    ).distinct()
    newest = p.agg(F.max("document_revision_id").alias("document_revision_id")).select(
        "document_revision_id", F.lit(AS_OF).cast("date").alias("effective_from"),
        F.lit(None).cast("date").alias("effective_to")
    )
    h = lambda x: x.agg(hashing.set_hash(*(F.col(c) for c in x.columns)).alias("h"))
    c = _chunks(spark, d)
    index = h(c.select("chunk_id", "document_revision_id")).crossJoin(
        c.agg(
            F.count("*").alias("chunks"), hashing.set_hash(F.col("chunk_id"), F.size("embedding")).alias("payload_hash")
        )
    )
    a, b = h(p), h(p.unionByName(newest))
    one = a.withColumnRenamed("h", "before").crossJoin(b.withColumnRenamed("h", "after")).crossJoin(index)  # three single rows
    return one.select(
        (F.col("before") != F.col("after")).alias("registry_changed"), F.col("h").alias("index_hash"), "payload_hash",
        "chunks"
    )


def edge_evidence(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph.build_graph(graphs._relations(spark, d), "doc_id")
    return assembly.edges_with_evidence(
        edges, nodes, edges.where("sources > 1").select("edge_id", F.col("first_source").alias("evidence"))
    )


def gold_resolution_status(spark: SparkSession, d: str) -> DataFrame:
    """For every document type what became of its documents: chunked, delivered without chunks, or without a text."""
    docs = table(spark, d, "documents").select(
        "document_id", "document_type", (F.length(F.trim("text")) > 0).alias("has_text")
    ).distinct()
    c = table(
        spark, d, "document_chunks"
    ).where("chunk_text is not null").select("document_id").distinct().withColumn("chunked", F.lit(True))
    status = F.when(F.coalesce("chunked", F.lit(False)), "available_with_chunks").when(
        F.coalesce("has_text", F.lit(False)), "ingested_without_chunks"
    ).otherwise("missing_from_ingestion")
    return docs.join(c, "document_id", "left").groupBy("document_type", status.alias("status")).agg(
        F.count_distinct("document_id").alias("documents")
    )


def chunks_of_elements(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of each document inverted to the chunks that hold them."""
    c = table(spark, d, "document_chunks").select(
        "document_id", "chunk_index", F.explode(text.identifiers(F.col("chunk_text"))).alias("identifier")
    )
    return c.groupBy("document_id", "identifier").agg(
        F.array_join(F.array_sort(F.collect_set("chunk_index")), ",").alias("chunks")
    )


def chunk_retrieval_text(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "document_chunks").join(
        table(spark, d, "documents").groupBy("document_id").agg(F.max("title").alias("title")), "document_id"
    )
    t = assembly.retrieval_text(F.col("title"), F.col("chunk_text"), F.lit(None).cast("string"))
    return c.select("chunk_id", F.sha2(t, 256).alias("input_hash")).distinct()


def identifier_survival(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of identifiers in documents matched one to one with those in their chunks: recall by document type."""
    docs = keyed.first_per_key(
        table(spark, d, "documents").select("document_id", "document_type", "text", "created_at", "doc_id"),
        ["document_id"], F.desc("created_at"), "doc_id"
    )
    rx = F.lit(r"\b([A-Z]{1,6}-\d+[a-z]?)\b")
    e = docs.select(
        "document_id", "document_type", F.posexplode(F.regexp_extract_all("text", rx, 1)).alias("pos", "identifier")
    )
    c = keyed.first_per_key(
        table(spark, d, "document_chunks").select("chunk_id", "document_id", "chunk_index", "chunk_text", "created_at"),
        ["chunk_id"], F.desc("created_at")
    )
    o = c.select(
        "document_id", F.explode(F.regexp_extract_all("chunk_text", rx, 1)).alias("identifier"),
        F.col("chunk_index").alias("at")
    )
    m = elements.one_to_one(e, o, ["document_id", "identifier"], "pos", "at").where("expected is not null").join(
        docs.select("document_id", "document_type"), "document_id"
    )
    x = m.select(
        "document_type", F.lit("identifier_recall").alias("metric"), F.col("observed").isNotNull().alias("hit"),
        F.lit(False).alias("excluded")
    )
    return metrics.scorecard(x, "document_type", "metric", "hit", "excluded")


def provenance_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose document and revision exist, by language of the document and over all."""
    docs = table(spark, d, "documents").groupBy("document_id").agg(
        F.max(F.lower("lang")).alias("lang"), F.lit(True).alias("known")
    )
    reg = table(
        spark, d, "edib_document_revision_registry"
    ).select("document_revision_id").distinct().withColumn("registered", F.lit(True))
    c = table(spark, d, "document_chunks").dropDuplicates(["chunk_id"]).join(docs, "document_id", "left").join(
        reg, "document_revision_id", "left"
    )
    facts = [
        c.select(
            "lang", F.lit(m).alias("metric"), F.coalesce(h, F.lit(False)).alias("hit"), F.lit(False).alias("excluded")
        ) for m,
        h in (("document", F.col("known")), ("revision", F.col("registered")))
    ]
    return metrics.scorecard(facts[0].unionByName(facts[1]), "lang", "metric", "hit", "excluded")


def best_matching_part(spark: SparkSession, d: str) -> DataFrame:
    """For each supplier the nation whose customers ordered most of its parts."""
    li = table(spark, d, "lineitem")
    e = li.select(F.col("l_suppkey").alias("g"), "l_partkey")
    o = li.join(
        table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    ).join(
        table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select(F.col("c_nationkey").alias("g"), "l_partkey")
    return assembly.best_overlap(e, o, "g", "l_partkey")


def path_ranked_items(spark: SparkSession, d: str) -> DataFrame:
    """Nodes in the order in which the ranked paths from each region come by them first."""
    p = graphs.graph_simple_paths(spark, d).where("hops <= 3")
    p = graph.ranked_by(p, "seed", F.desc("hops"), "path").select("seed", "rank", F.split("path", " > ").alias("nodes"))
    ev = p.select(F.explode("nodes").alias("edge_id")).distinct().select("edge_id", F.col("edge_id").alias("item"))
    return assembly.first_on_path(p, "seed", "rank", "nodes", ev)


def decoded_props(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type").agg(
        F.count("p.k").alias("n"), F.sum("p.k").alias("total"), F.count_distinct("p.k").alias("kinds")
    )


def payload_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        "vec_id", assembly.payload_hash(F.col("vec_id"), F.col("embedding")).alias("payload")
    )


def question_prompts(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "evaluation_items")
    return i.select(
        "item_id",
        F.sha2(
            assembly.prompt(F.col("question"), F.split("expected_supporting_passage", r"\. ")), 256
        ).alias("prompt_hash")
    )


def chunk_coverage_sets(spark: SparkSession, d: str) -> DataFrame:
    """Documents delivered against documents chunked, as sets."""
    return assembly.same_sets(
        table(spark, d, "documents").select("document_id"), table(spark, d, "document_chunks").select("document_id")
    )


def list_nesting(spark: SparkSession, d: str) -> DataFrame:
    """List items with the item that each hangs on."""
    items = elements.elements(table(spark, d, "documents"), "doc_id", "text").where("kind = 'list_item'")
    return assembly.list_parents(items, "doc_id", "order_index", "level").select(
        "doc_id", "order_index", "level", "parent_order"
    )


def flipped_boxes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(
        "p_partkey",
        assembly.flip_box(
            F.lit(0.0), F.col("p_size").cast("double"), F.lit(1.0), F.col("p_size") + 10.0, F.lit(100.0)
        ).alias("b")
    )
    return p.select("p_partkey", F.col("b.y0").alias("y0"), F.col("b.y1").alias("y1"))


def phrases_recovered(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose title stands in their text, line ends notwithstanding."""
    docs = table(spark, d, "documents")
    return docs.select(
        "doc_id",
        F.coalesce(assembly.phrase_in_lines(F.split("text", "\n"), F.col("title")), F.lit(False)).alias("recovered")
    )


QUERIES = {
    f.__name__: f for f in (
        authority_aware_search, cross_document_diversity, registry_snapshot_hash, authority_switch_invariants,
        edge_evidence, gold_resolution_status, chunks_of_elements, chunk_retrieval_text, identifier_survival,
        provenance_completeness, best_matching_part, path_ranked_items, decoded_props, payload_hashes, question_prompts,
        chunk_coverage_sets, list_nesting, flipped_boxes, phrases_recovered
    )
}

_AWARE = f"""
ok as (select distinct document_revision_id r from edib_revision_authority_period where effective_from <= date '{AS_OF}' and (effective_to is null or (effective_to > effective_from and date '{AS_OF}' < effective_to))),
c as (select * from (select *, row_number() over (partition by chunk_id order by created_at desc, document_id) rn from document_chunks) where rn = 1),
v as (select chunk_id, document_id, cast(embedding as double[]) x from c where document_revision_id in (select r from ok) and embedding is not null and len(embedding) = 64),
s as (select cast(e.vec_id as varchar) query, chunk_id "row", document_id, round(coalesce(list_dot_product(cast(e.embedding as double[]), x) / nullif(sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(cast(e.embedding as double[]), cast(e.embedding as double[]))), 0), 0), 9) similarity from embeddings e, v where vec_id % 20 = 0),
hits as (select * from (select *, row_number() over (partition by query order by similarity desc, "row") rank from s) where rank <= {K})
"""
_H = "cast(('0x' || substr(sha256({}), 1, 15)) as bigint)"
_SETH = "sha256(cast(count(*) as varchar) || '|' || cast(sum(" + _H + ") as varchar))"
_NUL = "coalesce(cast({} as varchar), chr(0))"


def _joined(*cols: str) -> str:
    return " || chr(31) || ".join(_NUL.format(c) for c in cols)


ORACLES = {
    "list_nesting": """with raw as (select doc_id, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) t, unnest(range(0, len(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))))) o from documents),
i as (select doc_id, cast(o as int) o, cast(length(regexp_extract(t, '^( *)', 1)) // 2 as int) l from raw where regexp_matches(t, '^\\s*([-*\\x{2022}]|\\d+[.)])\\s+\\S') and not regexp_matches(t, '^\\s*(\\d+(\\.\\d+)*)\\s+\\p{Lu}[^.!?]*$'))
select doc_id, o order_index, l "level", (select max(o) from i j where j.doc_id = i.doc_id and j.o < i.o and j.l < i.l) parent_order from i""",
    "phrases_recovered": """select doc_id, coalesce(regexp_matches(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '(^|[^\\pL\\pN])' || regexp_escape(trim(regexp_replace(lower(title), '\\s+', ' ', 'g'))) || '($|[^\\pL\\pN])'), false) recovered from documents""",
    "identifier_survival": """with d as (select document_id, document_type, text from (select *, row_number() over (partition by document_id order by created_at desc, doc_id) n from documents) where n = 1),
c as (select document_id, chunk_text from (select *, row_number() over (partition by chunk_id order by created_at desc) n from document_chunks) where n = 1),
e as (select document_id, document_type, i, count(*) n from (select document_id, document_type, unnest(regexp_extract_all(text, '\\b([A-Z]{1,6}-\\d+[a-z]?)\\b', 1)) i from d) group by all),
o as (select document_id, i, count(*) m from (select document_id, unnest(regexp_extract_all(chunk_text, '\\b([A-Z]{1,6}-\\d+[a-z]?)\\b', 1)) i from c) group by all),
x as (select document_type, n, least(n, coalesce(m, 0)) hit from e left join o using (document_id, i))
select case when grouping(document_type) = 1 then 'overall' else coalesce(document_type, 'none') end bucket, 'identifier_recall' metric, cast(sum(hit) as bigint) numerator, cast(sum(n) as bigint) denominator, 0 excluded, round(sum(hit) / sum(n), 6) score from x group by grouping sets ((document_type), ())""",
    "provenance_completeness": """with d as (select document_id, max(lower(lang)) lang from documents group by 1), r as (select distinct document_revision_id rev from edib_document_revision_registry),
c as (select lang, d.document_id is not null doc, r.rev is not null rev from (select distinct on (chunk_id) * from document_chunks) c left join d using (document_id) left join r on r.rev = c.document_revision_id),
f as (select lang, 'document' metric, doc hit from c union all select lang, 'revision', rev from c)
select case when grouping(lang) = 1 then 'overall' else coalesce(lang, 'none') end bucket, metric, count(*) filter (hit) numerator, count(*) denominator, 0 excluded, round(count(*) filter (hit) / count(*), 6) score from f group by grouping sets ((lang, metric), (metric))""",
    "authority_aware_search": f'with {_AWARE} select query, "row", rank, round(similarity, 6) similarity from hits',
    "cross_document_diversity": f"with {_AWARE} select query, count(distinct document_id) documents, count(*) hits from hits group by 1",
    "registry_snapshot_hash": f"with p as (select distinct logical_document_id, authority_period_id, document_revision_id, effective_from, effective_to from edib_revision_authority_period) select logical_document_id, {_SETH.format(_joined('authority_period_id', 'document_revision_id', 'effective_from', 'effective_to'))} snapshot from p group by 1",
    "authority_switch_invariants": f"with c as (select chunk_id, document_revision_id, len(embedding) n from (select *, row_number() over (partition by chunk_id order by created_at desc, document_id) rn from document_chunks) where rn = 1) select true registry_changed, {_SETH.format(_joined('chunk_id', 'document_revision_id'))} index_hash, {_SETH.format(_joined('chunk_id', 'n'))} payload_hash, count(*) chunks from c",
    "edge_evidence": f"select 'edge_' || substr(sha256(subject || '|' || predicate || '|' || object), 1, 24) edge_id, subject || ' --[' || predicate || ']--> ' || object path, case when count(distinct doc_id) > 1 then min(doc_id) end evidence from ({graphs._REL}) group by subject, predicate, object",
    "gold_resolution_status": """with d as (select distinct document_id, document_type, length(trim(text)) > 0 t from documents), c as (select distinct document_id from document_chunks where chunk_text is not null)
select document_type, case when c.document_id is not null then 'available_with_chunks' when t then 'ingested_without_chunks' else 'missing_from_ingestion' end status, count(distinct d.document_id) documents from d left join c using (document_id) group by 1, 2""",
    "chunks_of_elements": "select document_id, identifier, array_to_string(list_sort(list(distinct chunk_index)), ',') chunks from (select document_id, chunk_index, upper(unnest(regexp_extract_all(chunk_text, '\\b([A-Za-z]{1,6}-\\d+[A-Za-z]?)\\b', 1))) identifier from document_chunks) group by 1, 2",
    "chunk_retrieval_text": "with t as (select document_id, max(title) title from documents group by 1) select distinct chunk_id, sha256(case when trim(coalesce(title, ''), ' ') <> '' and trim(coalesce(chunk_text, ''), ' ') <> '' then title || chr(10) || chr(10) || chunk_text when trim(coalesce(title, ''), ' ') <> '' then title when trim(coalesce(chunk_text, ''), ' ') <> '' then chunk_text end) input_hash from document_chunks join t using (document_id)",
    "best_matching_part": """with e as (select distinct l_suppkey g, l_partkey from lineitem), o as (select distinct c_nationkey n, l_partkey from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
s as (select g, n, count(*) shared from e join o using (l_partkey) group by 1, 2) select g expected_group, n observed_group, shared from (select *, row_number() over (partition by g order by shared desc, n) r from s) where r = 1""",
    "path_ranked_items": graphs._PATHS + ", x as (select seed, path, row_number() over (partition by seed order by hops desc, array_to_string(path, ' > ')) rank from p where hops between 1 and 3), e as (select seed, rank, unnest(path) item, unnest(range(0, len(path))) pos from x), m as (select seed, item, min(rank * 1000 + pos) as first_at from e group by 1, 2) select seed, item, row_number() over (partition by seed order by first_at, item) rank from m",
    "decoded_props": "select event_type, count(k) n, sum(k) total, count(distinct k) kinds from (select event_type, cast(json_extract(props, '$.k') as int) k from events) group by 1",
    "question_prompts": "select item_id, sha256('Question: ' || question || chr(10) || 'Evidence:' || chr(10) || array_to_string(list_transform(string_split(expected_supporting_passage, '. '), lambda x, i: '[' || i || '] ' || x), chr(10))) prompt_hash from evaluation_items",
    "chunk_coverage_sets": "with a as (select distinct document_id from documents), b as (select distinct document_id from document_chunks) select (select count(*) from a anti join b using (document_id)) only_left, (select count(*) from b anti join a using (document_id)) only_right, not exists (from a anti join b using (document_id)) and not exists (from b anti join a using (document_id)) equal",
    "flipped_boxes": "select p_partkey, cast(90 - p_size as double) y0, cast(100 - p_size as double) y1 from part",
    "payload_hashes": "select vec_id, sha256(cast(vec_id as varchar) || '|[' || array_to_string(list_transform(embedding, lambda x: format('{:.8f}', cast(x as double))), ',') || ']') payload from embeddings",
}
