"""Lookups and small aggregates over the index, the log and the registry, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verityloom.functions import hashing, text
from verityloom.operators import authority, elements, keyed, search
from verityloom.plans import authority as plan
from verityloom.plans import evaluation, evidence, graphs, retrieval
from verityloom.plans import hybrid as hybrid_plan
from verityloom.session import table


def appended_log(spark: SparkSession, d: str) -> DataFrame:
    """The log of events up to 2021 with the later ones appended under the next serial numbers."""
    e = table(spark, d, "edib_authority_decision_event").select("event_id", "recorded_at").distinct()
    early, late = e.where("recorded_at < timestamp '2021-01-01'"), e.where("recorded_at >= timestamp '2021-01-01'")
    return keyed.append_numbered(
        keyed.numbered(early, "serial", "recorded_at", "event_id"), late, "serial", "recorded_at", "event_id"
    )


def index_overview(spark: SparkSession, d: str) -> DataFrame:
    """Records, ids and distinct contents of the chunk index."""
    c = table(spark, d, "document_chunks")
    return c.agg(
        F.count("*").alias("records"), F.count_distinct("chunk_id").alias("ids"),
        F.count_distinct(F.xxhash64("chunk_text")).alias("contents"),
        F.count_if(F.col("embedding").isNull()).alias("without_vector")
    )


def scoped_search(spark: SparkSession, d: str) -> DataFrame:
    """The nearest rows of each query within its scope of two columns: even labels of odd ids."""
    e = table(spark, d, "embeddings").withColumn("odd", F.col("vec_id") % 2)
    ok = e.where("label % 2 = 0 and odd = 1").select("label", "odd").distinct()
    got = search.eligible_search(
        e.where("vec_id % 20 = 0"), "vec_id", e, "vec_id", "embedding", ok, ["label", "odd"], 5
    )
    return got.select("query", "row", "rank", F.round("similarity", 6).alias("similarity"))


def search_provenance(spark: SparkSession, d: str) -> DataFrame:
    """The hits of authority_aware_search with where each comes from."""
    c = table(spark, d, "document_chunks").select(
        F.col("chunk_id").alias("row"), "document_id", "document_revision_id", "chunk_index", "created_at"
    )
    c = keyed.first_per_key(c, ["row"], F.desc("created_at"), "document_id").drop("created_at")
    titles = table(spark, d, "documents").groupBy("document_id").agg(F.max("title").alias("title"))
    return evidence.authority_aware_search(spark, d).join(c, "row").join(titles, "document_id", "left")


def fact_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of the test passages in each type of document: pairs that no document has are left out."""
    i = table(spark, d, "evaluation_items").select(
        "item_id", F.explode(text.identifiers(F.col("expected_supporting_passage"))).alias("identifier")
    )
    c = table(spark, d, "documents").select(
        "document_type", "document_id", F.explode(text.identifiers(F.col("text"))).alias("identifier")
    )
    known = c.groupBy("document_type", "identifier").agg(F.count_distinct("document_id").alias("documents"))
    return i.join(known, "identifier").select("item_id", "document_type", "identifier", "documents")


def chain_contained(spark: SparkSession, d: str) -> DataFrame:
    """Whether the chunks found for each question together hold all identifiers of its passage, and which are left."""
    i = table(spark, d, "evaluation_items").select(
        F.col("item_id").alias("query"), text.identifiers(F.col("expected_supporting_passage")).alias("chain")
    )
    hits = hybrid_plan._vector_ranking(spark, d, 10).join(
        hybrid_plan._chunks(spark, d).select("chunk", "text"), "chunk"
    )
    held = hits.groupBy("query").agg(
        F.array_distinct(F.flatten(F.collect_list(text.identifiers(F.col("text"))))).alias("held")
    )
    left = F.array_except("chain", F.coalesce("held", F.array().cast("array<string>")))
    return i.join(held, "query", "left").select(
        "query", (F.size(left) == 0).alias("contained"), F.array_join(F.array_sort(left), ",").alias("left_over")
    )


def answer_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sums and means over all answers: claims, citations, invalid ones, coverage over those that have one."""
    c = retrieval.citation_validation(spark, d)
    return c.agg(
        F.count("*").alias("answers"), F.sum("claims").alias("claims"), F.sum("cited").alias("cited"),
        F.sum("invalid").alias("invalid"),
        F.round(F.try_divide(F.sum("invalid"), F.sum("cited")), 6).alias("invalid_share"),
        F.round(F.avg("coverage"), 6).alias("mean_coverage")
    )


def corpus_snapshot_hash(spark: SparkSession, d: str) -> DataFrame:
    """One hash of all documents' snapshots."""
    return evidence.registry_snapshot_hash(spark, d).agg(
        hashing.set_hash(F.col("logical_document_id"), F.col("snapshot")).alias("corpus"),
        F.count("*").alias("documents")
    )


def revision_query_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per query: hits among the five nearest of all chunks that are not in force, the precision that leaves, and those shared with the search in force."""
    c, ok = evidence._chunks(spark, d), evidence._eligible(spark, d).withColumn("ok", F.lit(True))
    all_ = search.exact_search(
        evidence._questions(spark, d), "chunk_id", c, "chunk_id", "embedding", evidence.K, skip_self=False
    )
    x = all_.join(
        c.select(F.col("chunk_id").alias("row"), "document_revision_id"), "row"
    ).join(ok, "document_revision_id", "left")
    mine = evidence.authority_aware_search(spark, d).select("query", "row", F.lit(True).alias("both"))
    return x.join(mine, ["query", "row"], "left").groupBy("query").agg(
        F.count_if(F.col("ok").isNull()).alias("ineligible"),
        F.round(F.count("ok") / F.count("*"), 6).alias("precision"), F.count("both").alias("shared")
    )


def reading_positions(spark: SparkSession, d: str) -> DataFrame:
    """Elements in reading order, where list items are given no place and so come last in their document."""
    e = elements.elements(table(spark, d, "documents"), "doc_id", "text").withColumn("unit", F.lit(1)).withColumn(
        "place", F.when(F.col("kind") != "list_item", F.col("order_index"))
    )
    return elements.reading_order(
        e, "doc_id", "unit", "place", "kind", "order_index"
    ).select("doc_id", "order_index", "position")


def explicit_requests(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery's revision asked for by id in the order of delivery: how many of each outcome."""
    r = table(spark, d, "documents").where("document_revision_id is not null").select(
        F.col("logical_document_id").alias("doc"), F.col("document_revision_id").alias("revision"),
        F.col("doc_id").alias("position")
    )
    got = authority.resolve_explicit(
        r, plan.authority_state(spark, d), plan.integrity_rules(spark, d), ("effective", "superseded")
    )
    return got.groupBy("code").agg(F.count("*").alias("requests"))


def relation_counts(spark: SparkSession, d: str) -> DataFrame:
    """Assertions of the documents: all, rejected for want of an end, repeated, and left as edges."""
    r = graphs._relations(spark, d)
    blank = (F.coalesce(F.trim("subject"), F.lit("")) == "") | (F.coalesce(F.trim("object"), F.lit("")) == "")
    edges = F.count_distinct(F.when(~blank, F.struct("subject", "predicate", "object")))
    return r.agg(
        F.count("*").alias("assertions"), F.count_if(blank).alias("rejected"),
        (F.count_if(~blank) - edges).alias("repeated"), edges.alias("edges")
    )


def seed_sources(spark: SparkSession, d: str) -> DataFrame:
    """How many seeds, and of how many questions, each source gave."""
    return hybrid_plan.hybrid_seeds(spark, d).groupBy("source").agg(
        F.count("*").alias("seeds"), F.count_distinct("query").alias("questions")
    )


QUERIES = {
    f.__name__: f for f in (
        appended_log, index_overview, scoped_search, search_provenance, fact_lookup, chain_contained, answer_summary,
        corpus_snapshot_hash, revision_query_metrics, reading_positions, explicit_requests, relation_counts,
        seed_sources
    )
}

_IDS = "list_distinct(list_transform(regexp_extract_all({}, '\\b([A-Za-z]{{1,6}}-\\d+[A-Za-z]?)\\b', 1), lambda x: upper(x)))"
_HITS5 = f"""
ok as (select distinct document_revision_id r from edib_revision_authority_period where effective_from <= date '{evidence.AS_OF}' and (effective_to is null or (effective_to > effective_from and date '{evidence.AS_OF}' < effective_to))),
c as (select * from (select *, row_number() over (partition by chunk_id order by created_at desc, document_id) rn from document_chunks) where rn = 1),
s as (select cast(e.vec_id as varchar) query, chunk_id "row", document_revision_id in (select r from ok) and document_revision_id is not null fine, round(coalesce(list_dot_product(cast(e.embedding as double[]), cast(c.embedding as double[])) / nullif(sqrt(list_dot_product(cast(c.embedding as double[]), cast(c.embedding as double[]))) * sqrt(list_dot_product(cast(e.embedding as double[]), cast(e.embedding as double[]))), 0), 0), 9) sim
  from embeddings e, c where vec_id % 20 = 0 and c.embedding is not null and len(c.embedding) = 64),
whole as (select * from (select *, row_number() over (partition by query order by sim desc, "row") k from s) where k <= {evidence.K}),
aware as (select * from (select *, row_number() over (partition by query order by sim desc, "row") k from s where fine) where k <= {evidence.K})
"""
ORACLES = {
    "appended_log": "select event_id, recorded_at, row_number() over (order by recorded_at, event_id) serial from (select distinct event_id, recorded_at from edib_authority_decision_event)",
    "index_overview": "select count(*) records, count(distinct chunk_id) ids, count(distinct coalesce(chunk_text, chr(0))) contents, count(*) filter (embedding is null) without_vector from document_chunks",
    "scoped_search": f"""with s as (select a.vec_id query, b.vec_id "row", round({retrieval._SIM}, 9) sim from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0 and b.label % 2 = 0 and b.vec_id % 2 = 1)
select query, "row", rank, round(sim, 6) similarity from (select *, row_number() over (partition by query order by sim desc, "row") rank from s) where rank <= 5""",
    "search_provenance": f"""with {evidence._AWARE}, t as (select document_id, max(title) title from documents group by 1)
select h.query, h."row", h.rank, round(h.similarity, 6) similarity, c.document_id, c.document_revision_id, c.chunk_index, title from hits h join c on c.chunk_id = h."row" left join t on t.document_id = c.document_id""",
    "fact_lookup": f"""with i as (select item_id, unnest({_IDS.format('expected_supporting_passage')}) identifier from evaluation_items), k as (select document_type, identifier, count(distinct document_id) documents from (select document_type, document_id, unnest({_IDS.format('text')}) identifier from documents) group by 1, 2)
select item_id, document_type, identifier, documents from i join k using (identifier)""",
    "chain_contained": f"""with {hybrid_plan._BASE} qs as (select item_id query, {hybrid_plan._vector('question', 64)} e64, {_IDS.format('expected_supporting_passage')} chain from evaluation_items),
vr as (select * from (select query, t, row_number() over (partition by query order by round({hybrid_plan._DOT.format('v', 'e64')}, 9) desc, chunk) rank from qs, (select chunk, v, t from c where v is not null and len(v) = 64)) where rank <= 10),
h as (select query, list(distinct i) held from (select query, unnest({_IDS.format('t')}) i from vr) group by 1),
x as (select query, list_sort(list_filter(chain, lambda y: not list_contains(coalesce(held, []), y))) l from qs left join h using (query))
select query, len(l) = 0 contained, array_to_string(l, ',') left_over from x""",
    "answer_summary": f"with a as ({retrieval.ORACLES['citation_validation']}) select count(*) answers, cast(sum(claims) as bigint) claims, cast(sum(cited) as bigint) cited, cast(sum(invalid) as bigint) invalid, round(sum(invalid) / sum(cited), 6) invalid_share, round(avg(coverage), 6) mean_coverage from a",
    "corpus_snapshot_hash": f"with s as ({evidence.ORACLES['registry_snapshot_hash']}) select {evidence._SETH.format(evidence._joined('logical_document_id', 'snapshot'))} corpus, count(*) documents from s",
    "revision_query_metrics": f'with {_HITS5} select w.query, count(*) filter (not w.fine) ineligible, round(count(*) filter (w.fine) / count(*), 6) "precision", count(a."row") shared from whole w left join aware a on a.query = w.query and a."row" = w."row" group by 1',
    "reading_positions": f"with e as ({evaluation._split('doc_id', 'documents', 'text')}) select doc_id, cast(o as int) order_index, cast(row_number() over (partition by doc_id order by case when kind = 'list_item' then 1 else 0 end, o) as int) position from e",
    "explicit_requests": f"""with {plan._STATES.rstrip()}, req as (select logical_document_id doc, document_revision_id rev, doc_id, row_number() over (partition by logical_document_id, document_revision_id order by doc_id) n from documents where document_revision_id is not null),
w as (select doc, arg_min(code, list_position(['orphaned_period', 'period_document_mismatch', 'missing_predecessor', 'cross_revision_period_overlap', 'missing_successor', 'ambiguous_successor'], code)) code from scoped where scope = 'document' group by 1),
o as (select distinct doc, rev from scoped where scope = 'revision')
select coalesce(w.code, case when n > 1 then 'duplicate_request' when s.rev is null then 'revision_not_found' when s.state is null or o.rev is not null then 'malformed_authority_record' when s.state not in ('effective', 'superseded') then 'not_eligible' else 'ok' end) code, count(*) requests
from req left join w using (doc) left join o on o.doc = req.doc and o.rev = req.rev left join states s on s.doc = req.doc and s.rev = req.rev group by 1""",
    "relation_counts": f"with r as ({graphs._REL}), e as (select distinct subject, predicate, object from r where trim(subject) <> '' and trim(object) <> '') select count(*) assertions, count(*) filter (trim(subject) = '' or trim(object) = '') rejected, count(*) filter (trim(subject) <> '' and trim(object) <> '') - (select count(*) from e) repeated, (select count(*) from e) edges from r",
    "seed_sources": f"with recursive {hybrid_plan._BASE}{hybrid_plan._SEEDS}{hybrid_plan._MORE.rstrip().rstrip(',')} select source, count(*) seeds, count(distinct query) questions from seeds group by 1",
}
