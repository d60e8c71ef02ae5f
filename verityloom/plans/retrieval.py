"""Search, fusion and keyed-table queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verityloom.functions import hashing, text, vectors
from verityloom.operators import keyed, metrics, search
from verityloom.session import cut_lineage, table

K = 10


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 20 = 0")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The rows nearest to the least vector id, by built-in expressions and TakeOrdered."""
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"), F.col("vec_id").alias("q_id"))
    s = e.join(F.broadcast(q), F.col("vec_id") != F.col("q_id")).select(
        "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity")
    )
    return s.orderBy(F.desc("similarity"), "vec_id").limit(K)


def _batch(spark: SparkSession, d: str) -> DataFrame:
    return search.exact_search(_queries(spark, d), "vec_id", table(spark, d, "embeddings"), "vec_id", "embedding", K)


def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    return _batch(spark, d).select("query", "row", "rank", F.round("similarity", 6).alias("similarity"))


def vector_topk_eligible(spark: SparkSession, d: str) -> DataFrame:
    """As vector_topk_batch among the rows of even labels only, which are picked before ranking."""
    e = table(spark, d, "embeddings")
    ok = e.select("label").distinct().where("label % 2 = 0")
    return search.eligible_search(
        _queries(spark, d), "vec_id", e, "vec_id", "embedding", ok, "label", K
    ).select("query", "row", "rank", F.round("similarity", 6).alias("similarity"))


def vector_ineligible_hits(spark: SparkSession, d: str) -> DataFrame:
    """Per query: how many of the unfiltered best are ineligible, and how many both searches share."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), "label")
    a, b = _batch(spark, d), vector_topk_eligible(spark, d).select("query", "row", F.lit(1).alias("both"))
    return a.join(e, "row").join(b, ["query", "row"], "left").groupBy("query").agg(
        F.count_if(F.col("label") % 2 != 0).alias("ineligible_hits"), F.count("both").alias("shared")
    )


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The vector ranking of each query fused with a ranking of its label's rows by id distance."""
    e = table(spark, d, "embeddings")
    q = _queries(spark, d).select(F.col("vec_id").alias("query"), "label")
    # the nearest K ids of a label are among the K before and the K after in its order: positions are looked up, not pairs ranked
    at = cut_lineage(keyed.numbered(e.select(F.col("vec_id").alias("row"), "label"), "place", "label", "row"))
    mine = q.join(at.select(F.col("row").alias("query"), "place"), "query")
    near = mine.select(
        "query", "label", F.explode(F.sequence(F.col("place") - K, F.col("place") + K)).alias("place")
    ).join(at, ["label", "place"]).where("query <> row")
    r = F.row_number().over(Window.partitionBy("query").orderBy(F.abs(F.col("row") - F.col("query")), "row"))
    near = near.withColumn("rank", r).where(F.col("rank") <= K).select("query", "row", "rank")
    return search.reciprocal_rank_fusion([_batch(spark, d), near], "query", "row", "rank", K).select(
        "query", F.col("row").alias("item"), F.round("score", 8).alias("score"), "rank",
        F.array_join("sources", ",").alias("sources")
    )


def _metrics(spark: SparkSession, d: str, hits: DataFrame, ks: list[int]) -> DataFrame:
    """Metrics of hits(query, item, rank): rows of a query's own label are required, of the next label forbidden.

    Counts per label say how many are judged; only hits are looked up.
    """
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), "label")
    n = e.groupBy("label").agg(F.count("*").alias("n"))
    q = _queries(spark, d).select(
        F.col("vec_id").alias("query"), F.col("label").alias("own"), ((F.col("label") + 1) % 10).alias("next")
    )
    own, nxt = n.select(
        F.col("label").alias("own"), (F.col("n") - 1).alias("required")
    ), n.select(F.col("label").alias("next"), F.col("n").alias("forbidden"))
    need = q.join(own, "own").join(nxt, "next", "left").fillna(0, ["forbidden"])
    kind = F.when(F.col("label") == F.col("own"), "required").when(F.col("label") == F.col("next"), "forbidden")
    scored = hits.join(e, "item").join(q, "query").withColumn("kind", kind).where("kind is not null").select(
        "query", "item", "rank", "kind"
    )
    return metrics.scored_metrics(need.select("query", "required", "forbidden"), scored, ks)


def question_metrics_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d, _batch(spark, d).select("query", F.col("row").alias("item"), "rank"), [1, 3, 5])


def aggregate_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.aggregate_metrics(question_metrics_at_k(spark, d))


def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Coverage at 5 of the vector ranking against the fused one, by query."""
    a = _metrics(spark, d, _batch(spark, d).select("query", F.col("row").alias("item"), "rank"), [5])
    b = _metrics(spark, d, rrf_fusion(spark, d).select("query", "item", "rank"), [5])
    return metrics.compare_runs(a, b, "query", "coverage")


def citation_validation(spark: SparkSession, d: str) -> DataFrame:
    """A claim per hit among the best 3 that cites the hit and the id after it, held against the best 5."""
    hits = _batch(spark, d)
    claims = hits.where("rank <= 3").select(
        "query", F.col("rank").alias("claim"), F.array("row", F.col("row") + 1).alias("cited")
    )
    need = hits.where("rank <= 2").select("query", F.col("row").alias("item"))
    return metrics.citation_checks(claims, hits.where("rank <= 5").select("query", F.col("row").alias("item")), need)


def latest_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "document_chunks").select("chunk_id", "document_id", "chunk_index", "created_at")
    return keyed.first_per_key(c, ["chunk_id"], F.desc("created_at"), "document_id", "chunk_index")


def incremental_upsert_counts(spark: SparkSession, d: str) -> DataFrame:
    """The later half of the deliveries indexed over the earlier one."""
    docs = table(spark, d, "documents").select(
        "document_id", "doc_id", "created_at", "text", F.sha2("text", 256).alias("content")
    )
    old = keyed.first_per_key(
        docs.where("created_at < timestamp '2024-01-01'"), ["document_id"], F.desc("created_at"), "doc_id"
    )
    new = keyed.first_per_key(
        docs.where("created_at >= timestamp '2024-01-01'"), ["document_id"], F.desc("created_at"), "doc_id"
    )
    return keyed.change_counts(old, new, "document_id", "content", "text")


def upserted_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("document_id", "doc_id", "created_at")
    old, new = docs.where("created_at < timestamp '2024-01-01'"), docs.where("created_at >= timestamp '2024-01-01'")
    return keyed.upsert(
        keyed.first_per_key(old, ["document_id"], F.desc("created_at"), "doc_id"), new, ["document_id"],
        F.desc("created_at"), "doc_id"
    )


def inserted_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("document_id", "doc_id", "created_at")
    old, new = docs.where("created_at < timestamp '2024-01-01'"), docs.where("created_at >= timestamp '2024-01-01'")
    return keyed.insert_if_absent(
        keyed.first_per_key(old, ["document_id"], "created_at", "doc_id"), new, ["document_id"], "created_at", "doc_id"
    )


def numbered_events(spark: SparkSession, d: str) -> DataFrame:
    return keyed.numbered(table(spark, d, "events").select("event_id", "ts"), "serial", "ts", "event_id")


def first_evidence_per_edge(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    return keyed.first_per_key(li, ["l_suppkey", "l_partkey"], "l_orderkey", "l_linenumber")


def null_safe_identity(spark: SparkSession, d: str) -> DataFrame:
    """Revisions of a document with the same label and number as another, nulls being equal: each with the least of its like."""
    r = table(spark, d, "edib_document_revision_registry").select(
        "logical_document_id", "document_revision_id", F.lower(F.trim("version_label")).alias("label"),
        "revision_number"
    ).distinct()
    k = F.row_number().over(
        Window.partitionBy("logical_document_id", "label", "revision_number").orderBy("document_revision_id")
    )
    r = r.withColumn(
        "first",
        F.first("document_revision_id").over(
            Window.partitionBy("logical_document_id", "label", "revision_number").orderBy("document_revision_id")
        )
    ).withColumn("k", k)
    return r.where("k > 1").select(
        "logical_document_id", F.col("first").alias("document_revision_id"),
        F.col("document_revision_id").alias("other")
    )


def revision_ids(spark: SparkSession, d: str) -> DataFrame:
    """The content-derived identity of every revision, over canonical JSON."""
    r = table(spark, d, "edib_document_revision_registry")
    label = F.lower(F.trim("version_label"))
    ident = hashing.content_id(
        logical_document_id=F.col("logical_document_id"), revision_number=F.col("revision_number"),
        source_document_sha256=F.col("source_document_sha256"), version_label=label
    )
    return r.select("document_revision_id", ident.alias("content_id")).distinct()


def index_hash(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.groupBy("label").agg(hashing.set_hash(F.col("vec_id"), F.size("embedding")).alias("index_hash"))


def hashed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The test vector of every part's name, all numbers to five places, and its length."""
    v = table(spark, d, "part").select("p_partkey", vectors.hashed_embedding(F.col("p_name"), 32).alias("v"))
    return v.select(
        "p_partkey", F.array_join(F.transform("v", lambda x: F.format_string("%.5f", x)), ",").alias("vector"),
        F.round(vectors.norm(F.col("v")), 6).alias("length")
    )


def entity_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.entity_key(F.col("title")).alias("entity_key"))


QUERIES = {
    f.__name__: f for f in (
        vector_topk, vector_topk_batch, vector_topk_eligible, vector_ineligible_hits, rrf_fusion, question_metrics_at_k,
        aggregate_metrics, run_comparison, citation_validation, latest_chunks, incremental_upsert_counts,
        upserted_documents, inserted_documents, numbered_events, first_evidence_per_edge, null_safe_identity,
        revision_ids, index_hash, hashed_embeddings, entity_keys
    )
}

_SIM = "coalesce(list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) / nullif(sqrt(list_dot_product(cast(a.embedding as double[]), cast(a.embedding as double[]))) * sqrt(list_dot_product(cast(b.embedding as double[]), cast(b.embedding as double[]))), 0), 0)"
_HITS = f"""
all_hits as (select a.vec_id query, b.vec_id "row", b.label, round({_SIM}, 9) similarity from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
hits as (select query, "row", rank, similarity from (select *, row_number() over (partition by query order by similarity desc, "row") rank from all_hits) where rank <= {K}),
eligible as (select query, "row", rank, similarity from (select *, row_number() over (partition by query order by similarity desc, "row") rank from all_hits where label % 2 = 0) where rank <= {K}),
near as (select query, "row", rank from (select a.vec_id query, b.vec_id "row", row_number() over (partition by a.vec_id order by abs(b.vec_id - a.vec_id), b.vec_id) rank from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 20 = 0) where rank <= {K}),
fused as (select query, item, round(score, 8) score, rank, sources from (
  select *, row_number() over (partition by query order by score desc, item) rank from (
    select query, "row" item, round(sum(1.0 / (60 + rank)), 12) score, string_agg(cast(s as varchar), ',' order by s) sources
    from (select query, "row", rank, 0 s from hits union all select query, "row", rank, 1 from near) group by 1, 2)) where rank <= {K}),
judged as (select a.vec_id query, b.vec_id item, case when b.label = a.label then 'required' else 'forbidden' end kind from embeddings a join embeddings b on a.vec_id <> b.vec_id and (b.label = a.label or b.label = (a.label + 1) % 10) where a.vec_id % 20 = 0)
"""


def _metrics_sql(ranking: str, ks: str) -> str:
    return f"""
need_ as (select query, count(*) filter (kind = 'required') required, count(*) filter (kind = 'forbidden') forbidden from judged group by 1),
ks as (select unnest({ks}) k),
scored as (select h.*, j.kind from {ranking} h join judged j on j.query = h.query and j.item = h.item),
rr as (select query, 1.0 / min(rank) rr from scored where kind = 'required' group by 1),
at_k as (select n.query, k, count(*) filter (kind = 'required') r, count(*) filter (kind = 'forbidden') f, sum(case when kind = 'required' then 1 / log2(rank + 1) end) dcg, string_agg(cast(item as varchar), ',' order by item) filter (kind = 'required') m, string_agg(cast(item as varchar), ',' order by item) filter (kind = 'forbidden') l
  from need_ n cross join ks left join scored s on s.query = n.query and s.rank <= k group by 1, 2),
per as (select n.query, cast(k as int) k, required, round(r / nullif(required, 0), 6) coverage, case when required > 0 then r = required end all_found,
  round(coalesce(f / nullif(forbidden, 0), 0), 6) forbidden_share, round(coalesce(rr, 0), 6) reciprocal_rank,
  case when required > 0 then round(coalesce(dcg, 0) / (select sum(1 / log2(i + 1)) from range(1, cast(least(k, required) as bigint) + 1) t(i)), 6) end ndcg, coalesce(m, '') matched, coalesce(l, '') leaked
  from need_ n join at_k using (query) left join rr using (query))"""


_ITEMS = ', items as (select query, "row" item, rank from hits), '
_DOCS = "select document_id, doc_id, created_at, text, row_number() over (partition by document_id, created_at >= timestamp '2024-01-01' order by created_at {dir}, doc_id) rn, created_at >= timestamp '2024-01-01' late from documents"
ORACLES = {
    "hashed_embeddings": """with h as (select p_partkey, sha256(p_name || '|0') || sha256(p_name || '|1') || sha256(p_name || '|2') || sha256(p_name || '|3') h from part),
r as (select p_partkey, list_transform(range(0, 32), lambda i: cast(('0x' || substr(h, cast(i * 8 + 1 as bigint), 8)) as bigint) / 2147483648.0 - 1) r from h)
select p_partkey, array_to_string(list_transform(r, lambda x: format('{:.5f}', x / sqrt(list_dot_product(r, r)))), ',') vector, cast(1 as double) as length from r""",
    "vector_topk": f"select b.vec_id, round({_SIM}, 6) similarity from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id = (select min(vec_id) from embeddings) order by similarity desc, b.vec_id limit {K}",
    "vector_topk_batch": f'with {_HITS} select query, "row", rank, round(similarity, 6) similarity from hits',
    "vector_topk_eligible": f'with {_HITS} select query, "row", rank, round(similarity, 6) similarity from eligible',
    "vector_ineligible_hits": f'with {_HITS} select h.query, count(*) filter (e.label % 2 <> 0) ineligible_hits, count(g."row") shared from hits h join embeddings e on e.vec_id = h."row" left join eligible g on g.query = h.query and g."row" = h."row" group by 1',
    "rrf_fusion": f"with {_HITS} select * from fused",
    "question_metrics_at_k": f"with {_HITS}{_ITEMS}{_metrics_sql('items', '[1, 3, 5]')} select * from per",
    "aggregate_metrics": f"with {_HITS}{_ITEMS}{_metrics_sql('items', '[1, 3, 5]')} select k, count(*) queries, round(avg(coverage), 6) mean_coverage, round(avg(cast(all_found as double)), 6) all_rate, round(avg(ndcg), 6) mean_ndcg, round(coalesce(avg(forbidden_share), 0), 6) mean_forbidden, round(coalesce(avg(reciprocal_rank), 0), 6) mrr from per group by k",
    "run_comparison": f"""with {_HITS}, need_ as (select query, count(*) filter (kind = 'required') n from judged group by 1),
a as (select n.query, round(count(j.item) / nullif(n.n, 0), 6) s from need_ n left join (select h.query, h."row" item from hits h join judged j on j.query = h.query and j.item = h."row" and j.kind = 'required' where rank <= 5) j using (query) group by 1, n.n),
b as (select n.query, round(count(j.item) / nullif(n.n, 0), 6) s from need_ n left join (select h.query, h.item from fused h join judged j on j.query = h.query and j.item = h.item and j.kind = 'required' where rank <= 5) j using (query) group by 1, n.n)
select query, a.s a, b.s b, case when a.s is null or b.s is null then null when b.s > a.s + 1e-9 then 'improved' when b.s < a.s - 1e-9 then 'regressed' else 'unchanged' end outcome from a join b using (query)""",
    "citation_validation": f"""with {_HITS}, cited as (select distinct query, unnest(["row", "row" + 1]) item from hits where rank <= 3)
select query, (select count(*) from hits h where h.query = c.query and rank <= 3) claims, 0 uncited, count(*) cited,
  count(*) filter (not exists (select 1 from hits h where h.query = c.query and h."row" = c.item and rank <= 5)) invalid,
  (select count(*) from hits h where h.query = c.query and rank <= 2) required,
  count(*) filter (exists (select 1 from hits h where h.query = c.query and h."row" = c.item and rank <= 2)) required_cited,
  round(count(*) filter (exists (select 1 from hits h where h.query = c.query and h."row" = c.item and rank <= 2)) / (select count(*) from hits h where h.query = c.query and rank <= 2), 6) coverage
from cited c group by query""",
    "latest_chunks": "select chunk_id, document_id, chunk_index, created_at from (select *, row_number() over (partition by chunk_id order by created_at desc, document_id, chunk_index) rn from document_chunks) where rn = 1",
    "incremental_upsert_counts": f"""with x as ({_DOCS.format(dir='desc')}), o as (select * from x where rn = 1 and not late), n as (select * from x where rn = 1 and late),
j as (select n.*, o.document_id k, n.text is not distinct from o.text same, coalesce(regexp_replace(n.text, '\\s+', '', 'g'), '') = '' blank from n left join o using (document_id))
select count(*) candidates, count(*) filter (blank) blank, count(*) filter (not blank and k is not null and same) unchanged, count(*) filter (not blank and k is not null and not same) changed, count(*) filter (not blank and k is null) added from j""",
    "upserted_documents": f"with x as ({_DOCS.format(dir='desc')}) select document_id, doc_id, created_at from (select *, row_number() over (partition by document_id order by late desc) r from x where rn = 1) where r = 1",
    "inserted_documents": f"with x as ({_DOCS.format(dir='asc')}) select document_id, doc_id, created_at from (select *, row_number() over (partition by document_id order by late) r from x where rn = 1) where r = 1",
    "numbered_events": "select event_id, ts, row_number() over (order by ts, event_id) serial from events",
    "first_evidence_per_edge": "select distinct on (l_suppkey, l_partkey) l_suppkey, l_partkey, l_orderkey, l_linenumber from lineitem order by l_suppkey, l_partkey, l_orderkey, l_linenumber",
    "null_safe_identity": """with r as (select distinct logical_document_id, document_revision_id, lower(trim(version_label)) l, revision_number n from edib_document_revision_registry)
select b.logical_document_id, min(a.document_revision_id) document_revision_id, b.document_revision_id other from r a join r b on a.logical_document_id = b.logical_document_id and a.l is not distinct from b.l and a.n is not distinct from b.n and a.document_revision_id < b.document_revision_id group by b.logical_document_id, b.document_revision_id""",
    "revision_ids": """select distinct document_revision_id, sha256('{"logical_document_id":' || coalesce(cast(to_json(logical_document_id) as varchar), 'null') || ',"revision_number":' || coalesce(cast(revision_number as varchar), 'null') || ',"source_document_sha256":' || coalesce(cast(to_json(source_document_sha256) as varchar), 'null') || ',"version_label":' || coalesce(cast(to_json(lower(trim(version_label))) as varchar), 'null') || '}') content_id from edib_document_revision_registry""",
    "index_hash": "select label, sha256(cast(count(*) as varchar) || '|' || cast(sum(cast(('0x' || substr(sha256(cast(vec_id as varchar) || chr(31) || cast(len(embedding) as varchar)), 1, 15)) as bigint)) as varchar)) index_hash from embeddings group by 1",
    "entity_keys": """select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))), '^the ', ''), '^a ', ''), '^an ', ''), '^(application|control|procedure|obligation) (.)', '\\2'), ' business service$', '')) entity_key from documents""",
}
