"""How much of the documents their chunks have kept, with the SQL of each score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verityloom.functions import hashing, rendering, text
from verityloom.operators import assembly, elements, keyed
from verityloom.operators import evaluation as ev
from verityloom.plans import evidence
from verityloom.plans.documents import _SQUASH
from verityloom.session import table
from verityloom.sources import files


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of every document."""
    return keyed.first_per_key(table(spark, d, "documents"), ["document_id"], F.desc("created_at"), "doc_id")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "document_chunks").drop("logical_document_id")
    return keyed.first_per_key(c, ["chunk_id"], F.desc("created_at"), "document_id", "chunk_index")


def _lines(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, order_index, kind, level, said, norm) of the elements of a text column; said is the normalised text."""
    e = elements.elements(df.select(F.struct(*keys).alias("_k"), F.col(text_col).alias("_t")), "_k", "_t")
    said = text.squashed(F.col("text"))
    return e.select("_k.*", "order_index", "kind", "level", said.alias("said")).withColumn("norm", F.sha2("said", 256))


def _expected(spark: SparkSession, d: str) -> DataFrame:
    return _lines(_documents(spark, d), ["document_id", "document_type"], "text")


def _observed(spark: SparkSession, d: str) -> DataFrame:
    return _lines(_chunks(spark, d), ["document_id", "chunk_index"], "chunk_text").select(
        "document_id", F.struct("chunk_index", "order_index").alias("at"), "kind", "level", "norm"
    )


def fact_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Every fact of every document: lines, headings and list items with their identity."""
    return ev.fact_catalog(_expected(spark, d), "document_id", ["document_id"]).drop("norm")


def _matched(spark: SparkSession, d: str) -> DataFrame:
    facts = ev.fact_catalog(_expected(spark, d), "document_id", ["document_id", "document_type", "said"])
    return ev.text_matches(facts, _observed(spark, d), "document_id")


def ingestion_scores(spark: SparkSession, d: str) -> DataFrame:
    """Recall, single occurrence, headings by text, kind and level, and list items, by document type and overall.

    A fact found more than once is a partial match of its single occurrence; kind and level are scored where the text is there.
    """
    m = _matched(spark, d)
    there, once = F.col("copies") > 0, F.col("copies") == 1
    heads, items = m.where("kind = 'heading'"), m.where("kind = 'list_item'")
    part = lambda df, name, hit, **kw: ev.as_facts(df, "document_type", name, "fact_id", hit, **kw)
    parts = [
        part(m, "text", there), part(m, "text_once", once, partial=there), part(heads, "heading_text", there),
        part(heads, "heading_kind", F.col("same_kind"), excluded=~there), part(heads, "heading_level", F.col("same_level"), excluded=~there),
        part(items, "item_text", there), part(items, "item_level", F.col("same_level"), excluded=~there),
    ]
    return ev.evaluation(reduce(DataFrame.unionByName, parts))


def chunk_availability(spark: SparkSession, d: str) -> DataFrame:
    """Facts of each kind, those that some chunk holds, and the places where the first of them were found."""
    m = _matched(spark, d)
    return m.groupBy("kind").agg(
        F.count("*").alias("facts"), F.count_if(F.col("copies") > 0).alias("available"),
        F.count_if(F.col("first_at.chunk_index") == 0).alias("in_first_chunk"), F.sum("copies").alias("copies")
    )


def absence_reasons(spark: SparkSession, d: str) -> DataFrame:
    """What became of the facts that no chunk holds as they are."""
    missing = _matched(spark, d).where("copies = 0").select("document_id", "kind", "said", "norm", "fact_id")
    put = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda s: s["chunk_text"]), " "
    )
    joined = _chunks(spark, d).groupBy("document_id").agg(text.squashed(put).alias("whole"))
    return ev.absence(
        missing, "document_id", joined, _observed(spark, d)
    ).groupBy("kind", "reason").agg(F.count("*").alias("facts"))


def unexpected_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of chunks that their document does not have, in a canonical order."""
    o, e = _observed(spark, d), _expected(spark, d).select("document_id", "norm").distinct()
    return o.join(e, ["document_id", "norm"], "left_anti").select(
        "document_id", "at.chunk_index", "at.order_index", "kind", "norm"
    ).orderBy("document_id", "chunk_index", "order_index", "kind", "norm")


def provenance_categories(spark: SparkSession, d: str) -> DataFrame:
    """Seven things that a chunk's origin needs, by language of the document and overall."""
    docs = _documents(spark, d).select(
        "document_id", F.lower("lang").alias("lang"), F.col("created_at").alias("delivered"), F.lit(True).alias("known")
    )
    reg = table(
        spark, d, "edib_document_revision_registry"
    ).select("document_revision_id").distinct().withColumn("registered", F.lit(True))
    c = _chunks(spark, d).join(docs, "document_id", "left").join(reg, "document_revision_id", "left")
    whole = F.size("embedding") == 64
    tests = {
        "document": F.col("known"), "revision": F.col("registered"),
        "revision_given": F.col("document_revision_id").isNotNull(), "index": F.col("chunk_index") >= 0,
        "text": F.length(F.trim("chunk_text")) > 0, "embedding": whole & F.exists("embedding", lambda x: x != 0),
        "time": F.col("created_at") >= F.col("delivered")
    }
    return ev.evaluation(
        reduce(DataFrame.unionByName, [ev.as_facts(c, "lang", m, "chunk_id", hit) for m, hit in tests.items()])
    )


def chunk_structure(spark: SparkSession, d: str) -> DataFrame:
    """Per document: chunks, numbers left out of their row, numbers given twice, chunks without text, over 1,200 characters, and of headings alone."""
    c = _chunks(spark, d).select("document_id", "chunk_index", "chunk_text")
    n = F.count_distinct("chunk_index")
    alone = F.col("chunk_text").rlike(r"^\s*\d+(\.\d+)*\s+\p{Lu}[^.!?\n]*\s*$")
    return c.groupBy("document_id").agg(
        F.count("*").alias("chunks"), (F.max("chunk_index") + 1 - n).alias("left_out"),
        (F.count("chunk_index") - n).alias("repeated"),
        F.count_if(F.coalesce(F.length(F.trim("chunk_text")), F.lit(0)) == 0).alias("blank"),
        F.count_if(F.length("chunk_text") > 1200).alias("oversized"), F.count_if(alone).alias("headings")
    )


def identifier_scores(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of identifiers per document type: matched, missing, in surplus, and read as a longer one."""
    rx = F.lit(r"\b([A-Z]{1,6}-\d+[a-z]?)\b")
    e = _documents(spark, d).select("document_id", F.explode(F.regexp_extract_all("text", rx, 1)).alias("identifier"))
    o = _chunks(spark, d).select(
        "document_id", F.explode(F.regexp_extract_all("chunk_text", rx, 1)).alias("identifier")
    )
    x = ev.span_scores(e, o, ["document_id"], "identifier").join(
        _documents(spark, d).select("document_id", "document_type"), "document_id", "left"
    )
    return x.groupBy("document_type").agg(
        *(F.sum(c).alias(c) for c in ("expected", "observed", "matched", "missing", "extra", "merged"))
    )


def text_under_headings(spark: SparkSession, d: str) -> DataFrame:
    """For each heading the first paragraph before the next heading, as a caption is linked to its picture."""
    e = elements.elements(table(spark, d, "documents"), "doc_id", "text")
    return ev.following(
        e.where("kind = 'heading'"), e.where("kind = 'paragraph'"), "doc_id", "order_index", "text"
    ).select("doc_id", "order_index", F.sha2("text", 256).alias("text_hash"))


def token_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Per document type the words of titles that stand in the text as words of their own."""
    docs = table(spark, d, "documents").select(
        "doc_id", "document_type", F.split("text", "\n").alias("lines"),
        F.explode(F.array_distinct(F.split("title", r"\s+"))).alias("token")
    ).where("token <> ''")
    hit = F.coalesce(assembly.phrase_in_lines(F.col("lines"), F.col("token")), F.lit(False))
    return docs.groupBy("document_type").agg(F.count("*").alias("tokens"), F.count_if(hit).alias("recovered"))


def list_parent_scores(spark: SparkSession, d: str) -> DataFrame:
    """List items whose parent in the chunks has the text of their parent in the document; of items of one text the last counts."""

    def tree(df: DataFrame, keys: list[str], doc: str, t: str) -> DataFrame:
        items = _lines(df, keys, t).where("kind = 'list_item'").withColumn("_o", F.col("order_index"))
        x = assembly.list_parents(items, keys[-1], "order_index", "level")
        up = x.select(
            F.col(keys[-1]).alias("_k"), F.col("order_index").alias("parent_order"), F.col("norm").alias("parent")
        )
        x = x.join(up, (F.col(keys[-1]) == F.col("_k")) & (x["parent_order"] == up["parent_order"]), "left")
        return keyed.first_per_key(
            x.select(doc, "norm", "parent", F.struct(keys[-1], "order_index").alias("place")), [doc, "norm"],
            F.desc("place")
        )

    a = tree(_documents(spark, d), ["document_id"], "document_id", "text")
    b = tree(_chunks(spark, d), ["document_id", "chunk_id"], "document_id", "chunk_text").select(
        "document_id", "norm", F.col("parent").alias("found"), F.lit(True).alias("there")
    )
    x = a.join(b, ["document_id", "norm"], "left")
    return x.agg(
        F.count("*").alias("items"), F.count("there").alias("found"),
        F.count_if(F.col("there") & F.col("parent").eqNullSafe(F.col("found"))).alias("same_parent"),
        F.count("parent").alias("nested")
    )


def checked_claims(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as claims, written as text, held against the first line of the order."""
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag")
    )
    claims = li.select(
        "l_orderkey", "l_linenumber", F.format_string("%.3f", "quantity").alias("quantity"),
        F.lower("flag").alias("flag")
    )
    got = ev.supported_claims(claims, li.where("l_linenumber = 1"), ["l_orderkey"], ["quantity", "flag"])
    return got.groupBy("l_linenumber").agg(
        F.count_if("supported").alias("supported"), F.count_if(~F.col("supported")).alias("unsupported")
    )


def resolved_items(spark: SparkSession, d: str) -> DataFrame:
    """The expected passage of every item by difficulty, from a catalogue that must know each just once."""
    i = table(spark, d, "evaluation_items")
    got = ev.resolved_facts(
        i.select("difficulty", "item_id"),
        i.select("item_id", F.sha2("expected_supporting_passage", 256).alias("passage")), "difficulty", "item_id"
    )
    return got.select("difficulty", "item_id", "passage")


def element_ids(spark: SparkSession, d: str) -> DataFrame:
    """The identity of every element from six parts."""
    e = elements.elements(table(spark, d, "documents"), "doc_id", "text")
    ident = rendering.element_id(
        F.col("doc_id"), F.col("kind"), F.lit(1), F.col("order_index"), F.sha2("text", 256), F.col("level")
    )
    return e.select("doc_id", "order_index", ident.alias("element_id"))


def rendered_documents(spark: SparkSession, d: str) -> DataFrame:
    """A hash of each document's elements as they are rendered, and one of the elements themselves, in their order."""
    e = elements.elements(table(spark, d, "documents"), "doc_id", "text")
    shown = F.when(
        F.col("kind") == "list_item",
        rendering.list_item(F.col("text"), F.col("level"), F.lit(False), F.lit(None).cast("int"))
    ).when(
        F.col("kind") == "dated_entry", rendering.annotation(F.lit("visual_fact"), F.col("text"), F.lit(True))
    ).otherwise(F.col("text"))
    return e.groupBy("doc_id").agg(
        hashing.ordered_hash(F.col("order_index"), shown).alias("rendered"),
        hashing.ordered_hash(F.col("order_index"), F.col("kind"), F.col("level"), F.col("text")).alias("document_hash")
    )


def path_checks(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries with a portable path, by source."""
    return table(spark, d, "documents").groupBy("source").agg(
        F.count_if(rendering.portable_path(F.col("source_path"))).alias("portable"),
        F.count_if(F.col("source_path").isNull()).alias("none")
    )


def html_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Headings and paragraphs of the documents written as pages and read again by the HTML source."""
    e = elements.elements(table(spark, d, "documents"), "doc_id", "text").where("kind in ('heading', 'paragraph')")
    tag = F.when(
        F.col("kind") == "heading", F.concat(F.lit("h"), F.least("level", F.lit(6)).cast("string"))
    ).otherwise(F.lit("p"))
    said = F.trim(F.regexp_replace("text", r"[\s\x{00A0}\x{2009}\x{202F}]+", " "))
    line = F.concat(F.lit("<"), tag, F.lit(">"), text.html_text(said), F.lit("</"), tag, F.lit(">"))
    pages = e.groupBy("doc_id").agg(
        F.concat(
            F.lit("<html><body>"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("order_index", line.alias("h")))), lambda s: s["h"]),
                "\n"
            ),
            F.lit("</body></html>")
        ).alias("html")
    )
    return files.html_elements(pages, "doc_id", "html").select(
        "doc_id", "order_index", "kind", "level", F.sha2("text", 256).alias("text_hash")
    )


def question_view(spark: SparkSession, d: str) -> DataFrame:
    """Per query: the document of its best chunk, one claim per chunk found, and a warning if claims come from other documents too."""
    of = _chunks(spark, d).select(F.col("chunk_id").alias("row"), "document_id")
    h = evidence.authority_aware_search(spark, d).join(of, "row")
    x = h.groupBy("query").agg(
        F.min_by("document_id", "rank").alias("principal"), F.count("*").alias("claims"),
        F.array_sort(F.collect_set("document_id")).alias("cited")
    )
    return x.select(
        "query", "principal", "claims", F.array_join("cited", ",").alias("cited"),
        (F.size("cited") > 1).alias("cross_document")
    )


def frozen_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The content of every chunk now against what was frozen of the chunks delivered before 2023: changed, missing, unlisted."""
    c = table(spark, d, "document_chunks").select(
        "chunk_id", "created_at", F.sha2(F.coalesce("chunk_text", F.lit("")), 256).alias("content")
    )
    first, last = keyed.first_per_key(c, ["chunk_id"], "created_at", "content"), keyed.first_per_key(
        c, ["chunk_id"], F.desc("created_at"), "content"
    )
    early = first.where("created_at < timestamp '2023-01-01'")
    return assembly.changed_rows(
        last, early, "chunk_id", "content"
    ).groupBy("problem").agg(F.count("*").alias("chunks"))


def grouped_annotations(spark: SparkSession, d: str) -> DataFrame:
    """What is shown beside each document: its title as source text, dated entries as derived text, identifiers not at all."""
    docs = table(spark, d, "documents")
    e = elements.elements(docs, "doc_id", "text")
    title = docs.select(
        "doc_id", F.lit(-1).alias("at"), F.lit("caption").alias("kind"), F.col("title").alias("text"),
        F.lit(False).alias("derived")
    )
    dated = e.where("kind = 'dated_entry'").select(
        "doc_id", F.col("order_index").alias("at"), F.lit("visual_fact").alias("kind"), "text",
        F.lit(True).alias("derived")
    )
    ids = docs.select(
        "doc_id", F.lit(0).alias("at"), F.lit("identifier").alias("kind"), F.col("document_id").alias("text"),
        F.lit(False).alias("derived")
    )
    got = assembly.grouped_annotations(title.unionByName(dated).unionByName(ids), ["doc_id"], "at")
    return got.select(
        "doc_id", F.sha2("source_text", 256).alias("source_hash"), F.sha2("derived_text", 256).alias("derived_hash")
    )


def chunking_config(spark: SparkSession, d: str) -> DataFrame:
    """The hash of the chunking configuration that chunk_documents is run with, beside the number of chunks it gives."""
    config = elements.ChunkingConfig(split_oversized=False)
    c = elements.chunk(elements.elements(table(spark, d, "documents"), "doc_id", "text"), "doc_id", config)
    return c.agg(
        F.lit(config.config_hash()).alias("config_hash"), F.count("*").alias("chunks"),
        F.count_if(F.length("chunk_text") > config.max_chars).alias("oversized")
    )


QUERIES = {
    f.__name__: f for f in (
        fact_catalog, ingestion_scores, chunk_availability, absence_reasons, unexpected_lines, provenance_categories,
        chunk_structure, identifier_scores, text_under_headings, token_recovery, list_parent_scores, checked_claims,
        resolved_items, element_ids, rendered_documents, path_checks, html_round_trip, question_view, frozen_chunks,
        grouped_annotations, chunking_config
    )
}

_KINDS = r"case when regexp_matches(t, '^\s*(\d+(\.\d+)*)\s+\p{Lu}[^.!?]*$') then 'heading' when regexp_matches(t, '^\s*([-*\x{2022}]|\d+[.)])\s+\S') then 'list_item' when regexp_matches(t, '^\s*\[?\d{4}-\d{2}-\d{2}\]?\s') then 'dated_entry' else 'paragraph' end"
_LEVEL = r"cast(case kind when 'heading' then len(string_split(regexp_extract(t, '^\s*(\d+(\.\d+)*)', 1), '.')) when 'list_item' then length(regexp_extract(t, '^( *)', 1)) // 2 end as int)"


def _split(keys: str, source: str, column: str) -> str:
    lines = f"string_split(regexp_replace({column}, '\\r\\n?', chr(10), 'g'), chr(10))"
    return f"select *, {_LEVEL} lv, {_SQUASH.format('trim(t)')} said from (select *, {_KINDS} kind from (select {keys}, unnest({lines}) t, unnest(range(0, len({lines}))) o from {source})) where trim(t) <> ''"


_BASE = f"""
d as (select * from (select *, row_number() over (partition by document_id order by created_at desc, doc_id) n from documents) where n = 1),
c as (select * from (select *, row_number() over (partition by chunk_id order by created_at desc, document_id, chunk_index) n from document_chunks) where n = 1),
f as ({_split('document_id, document_type', 'd', 'text')}),
o as ({_split('document_id, chunk_index, chunk_id', 'c', 'chunk_text')}),
"""
_FACT = """sha256('{"document":' || to_json(document_id) || ',"kind":' || to_json(kind) || ',"order_index":' || o || ',"text":' || to_json(sha256(said)) || '}')"""
_MATCH = f"""
g as (select f.document_id, f.document_type, f.kind, f.lv, f.o, said, {_FACT} fact_id from f),
h as (select document_id, said, kind, lv, count(*) n, min((chunk_index, o)) at_ from o group by 1, 2, 3, 4),
m as (select g.document_id, document_type, g.kind, g.lv, g.o, g.said, fact_id, coalesce(sum(n), 0) copies, min(at_) first_at, coalesce(bool_or(h.kind = g.kind), false) same_kind, coalesce(bool_or(h.kind = g.kind and h.lv is not distinct from g.lv), false) same_level
  from g left join h on h.document_id = g.document_id and h.said = g.said group by 1, 2, 3, 4, 5, 6, 7),
"""
_HASH = "sha256(concat_ws('|', count(*) filter ({0}), cast(sum(cast(('0x' || substr(sha256(id), 1, 15)) as bigint)) filter ({0}) as varchar)))"
_EVAL = f"""select case when grouping(bucket) = 1 then 'overall' else coalesce(bucket, 'none') end bucket, metric, count(*) filter (hit and not ex) hits, count(*) filter (part and not hit and not ex) partials, count(*) filter (not hit and not part and not ex) misses, count(*) filter (ex) excluded,
  round(count(*) filter (hit and not ex) / nullif(count(*) filter (not ex), 0), 6) score, {_HASH.format('hit and not ex')} matched, {_HASH.format('not hit and not part and not ex')} missed from x group by grouping sets ((bucket, metric), (metric))"""
_T = _BASE.rstrip().rstrip(",")
ORACLES = {
    "fact_catalog": f"with {_T} select document_id, {_FACT} fact_id, kind, lv as level, cast(o as int) order_index from f",
    "ingestion_scores": f"""with {_BASE}{_MATCH} x as (
  select document_type bucket, 'text' metric, fact_id id, copies > 0 hit, false part, false ex from m union all select document_type, 'text_once', fact_id, copies = 1, copies > 0, false from m
  union all select document_type, 'heading_text', fact_id, copies > 0, false, false from m where kind = 'heading' union all select document_type, 'heading_kind', fact_id, same_kind, false, copies = 0 from m where kind = 'heading'
  union all select document_type, 'heading_level', fact_id, same_level, false, copies = 0 from m where kind = 'heading' union all select document_type, 'item_text', fact_id, copies > 0, false, false from m where kind = 'list_item'
  union all select document_type, 'item_level', fact_id, same_level, false, copies = 0 from m where kind = 'list_item') {_EVAL}""",
    "chunk_availability": f"with {_BASE}{_MATCH.rstrip().rstrip(',')} select kind, count(*) facts, count(*) filter (copies > 0) available, count(*) filter (first_at[1] = 0) in_first_chunk, cast(sum(copies) as bigint) copies from m group by 1",
    "absence_reasons": f"""with {_BASE}{_MATCH} w as (select document_id, {_SQUASH.format("string_agg(chunk_text, ' ' order by chunk_index, chunk_text)")} whole from c group by 1),
r as (select kind, case when coalesce(contains(whole, said), false) then 'split' when exists (select 1 from o where o.said = m.said and o.document_id <> m.document_id) then 'elsewhere' else 'lost' end reason from m left join w using (document_id) where copies = 0)
select kind, reason, count(*) facts from r group by 1, 2""",
    "unexpected_lines": f"with {_T} select document_id, chunk_index, cast(o as int) order_index, kind, sha256(said) norm from o where not exists (select 1 from f where f.document_id = o.document_id and f.said = o.said)",
    "provenance_categories": f"""with {_T}, r as (select distinct document_revision_id rev from edib_document_revision_registry),
y as (select c.*, lower(d.lang) bucket, d.document_id is not null known, r.rev is not null registered, d.created_at delivered from c left join d using (document_id) left join r on r.rev = c.document_revision_id),
z as (select bucket, chunk_id, unnest(['document', 'revision', 'revision_given', 'index', 'text', 'embedding', 'time']) metric, unnest([known, registered, document_revision_id is not null, chunk_index >= 0, length(trim(chunk_text, ' ')) > 0, len(embedding) = 64 and list_max(list_transform(embedding, lambda e: abs(e))) > 0, created_at >= delivered]) hit from y),
x as (select bucket, metric, chunk_id id, coalesce(hit, false) hit, false part, false ex from z) {_EVAL}""",
    "chunk_structure": f"""with {_T} select document_id, count(*) chunks, max(chunk_index) + 1 - count(distinct chunk_index) left_out, count(chunk_index) - count(distinct chunk_index) repeated, count(*) filter (coalesce(length(trim(chunk_text, ' ')), 0) = 0) blank,
  count(*) filter (length(chunk_text) > 1200) oversized, count(*) filter (regexp_matches(chunk_text, '^\\s*\\d+(\\.\\d+)*\\s+\\p{{Lu}}[^.!?\\n]*\\s*$')) headings from c group by 1""",
    "identifier_scores": f"""with {_T}, e as (select document_id, i, count(*) n from (select document_id, unnest(regexp_extract_all(text, '\\b([A-Z]{{1,6}}-\\d+[a-z]?)\\b', 1)) i from d) group by 1, 2),
s as (select document_id, i, count(*) m from (select document_id, unnest(regexp_extract_all(chunk_text, '\\b([A-Z]{{1,6}}-\\d+[a-z]?)\\b', 1)) i from c) group by 1, 2),
x as (select document_id, i, coalesce(n, 0) n, coalesce(m, 0) m from e full join s using (document_id, i)),
l as (select document_id, regexp_replace(i, '[a-z]$', '') i, sum(m - least(n, m)) k from x where m > n and regexp_matches(i, '[a-z]$') group by 1, 2),
y as (select document_type, x.n, m, least(x.n, m) hit, least(x.n - least(x.n, m), coalesce(k, 0)) merged from x left join l using (document_id, i) left join d using (document_id))
select document_type, cast(sum(n) as bigint) expected, cast(sum(m) as bigint) observed, cast(sum(hit) as bigint) matched, cast(sum(n - hit) as bigint) missing, cast(sum(m - hit) as bigint) extra, cast(sum(merged) as bigint) merged from y group by 1""",
    "text_under_headings": f"""with e as ({_split('doc_id', 'documents', 'text')}), h as (select doc_id, o, lead(o) over (partition by doc_id order by o) next_ from e where kind = 'heading')
select doc_id, cast(h.o as int) order_index, (select sha256(arg_min(trim(e.t), e.o)) from e where e.doc_id = h.doc_id and e.kind = 'paragraph' and e.o > h.o and (next_ is null or e.o < next_)) text_hash from h""",
    "token_recovery": r"""with t as (select document_type, text, unnest(list_distinct(string_split_regex(title, '\s+'))) token from documents)
select document_type, count(*) tokens, count(*) filter (regexp_matches(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '(^|[^\pL\pN])' || regexp_escape(lower(token)) || '($|[^\pL\pN])')) recovered from t where token <> '' group by 1""",
    "list_parent_scores": f"""with {_T}, fi as (select document_id, said, lv, o from f where kind = 'list_item'), oi as (select document_id, chunk_id, said, lv, o from o where kind = 'list_item'),
fp as (select a.document_id, a.said, a.o, arg_max(b.said, b.o) parent from fi a left join fi b on b.document_id = a.document_id and b.o < a.o and b.lv < a.lv group by 1, 2, 3),
op as (select a.document_id, a.chunk_id, a.said, a.o, arg_max(b.said, b.o) parent from oi a left join oi b on b.chunk_id = a.chunk_id and b.o < a.o and b.lv < a.lv group by 1, 2, 3, 4),
x as (select * from (select *, row_number() over (partition by document_id, said order by o desc) n from fp) where n = 1), y as (select document_id, said, parent found, true there from (select *, row_number() over (partition by document_id, said order by chunk_id desc, o desc) n from op) where n = 1)
select count(*) items, count(there) found, count(*) filter (there and parent is not distinct from found) same_parent, count(parent) nested from x left join y using (document_id, said)""",
    "checked_claims": """with f as (select l_orderkey, l_quantity q, l_returnflag r from lineitem where l_linenumber = 1)
select l_linenumber, count(*) filter (ok) supported, count(*) filter (not ok) unsupported from (select l_linenumber, exists (select 1 from f where f.l_orderkey = l.l_orderkey and f.q = l.l_quantity and f.r = l.l_returnflag) ok from lineitem l) group by 1""",
    "resolved_items": "select difficulty, item_id, sha256(expected_supporting_passage) passage from evaluation_items",
    "element_ids": f"""with e as ({_split('doc_id', 'documents', 'text')}) select doc_id, cast(o as int) order_index, sha256('{{"discriminator":"' || sha256(trim(t)) || '","document_id":' || doc_id || ',"element_type":"' || kind || '","extra":' || coalesce(cast(lv as varchar), 'null') || ',"order_index":' || o || ',"unit":1}}') element_id from e""",
    "rendered_documents": f"""with e as ({_split('doc_id', 'documents', 'text')}) select doc_id,
  sha256(string_agg(sha256(case kind when 'list_item' then repeat('  ', lv) || '- ' || trim(t) when 'dated_entry' then '[derived] Fact: ' || trim(t) else trim(t) end), '|' order by o)) rendered,
  sha256(string_agg(sha256(kind || chr(31) || coalesce(cast(lv as varchar), chr(0)) || chr(31) || trim(t)), '|' order by o)) document_hash from e group by 1""",
    "path_checks": r"select source, count(*) filter (source_path <> '' and not regexp_matches(source_path, '^/|^[A-Za-z]:|\\') and not regexp_matches(source_path, '(^|/)\.\.(/|$)')) portable, count(*) filter (source_path is null) as none from documents group by 1",
    "html_round_trip": f"""with e as ({_split('doc_id', 'documents', 'text')}) select doc_id, cast(row_number() over (partition by doc_id order by o) - 1 as int) order_index, kind, case when kind = 'heading' then least(lv, 6) end as level, sha256(trim(regexp_replace(trim(t), '[\\s\\x{{0B}}\\x{{00A0}}\\x{{2009}}\\x{{202F}}]+', ' ', 'g'))) text_hash from e where kind in ('heading', 'paragraph')""",
    "frozen_chunks": """with c as (select chunk_id, created_at, sha256(coalesce(chunk_text, '')) h from document_chunks),
n as (select chunk_id, h from (select *, row_number() over (partition by chunk_id order by created_at desc, h) r from c) where r = 1), f as (select chunk_id, h f from (select *, row_number() over (partition by chunk_id order by created_at, h) r from c) where r = 1 and created_at < timestamp '2023-01-01')
select problem, count(*) chunks from (select case when h is null then 'missing' when f is null then 'unlisted' when h <> f then 'changed' end problem from n full join f using (chunk_id)) where problem is not null group by 1""",
    "grouped_annotations": f"""with e as ({_split('doc_id', 'documents', 'text')})
select doc_id, sha256('Caption: ' || title) source_hash, (select sha256(string_agg('Fact: ' || trim(t), chr(10) order by o)) from e where e.doc_id = d.doc_id and kind = 'dated_entry') derived_hash from documents d where title is not null or exists (select 1 from e where e.doc_id = d.doc_id and kind = 'dated_entry')""",
    "chunking_config": f"""with recursive e as ({_split('doc_id', 'documents', 'text')}), c as (select doc_id d, kind = 'heading' b, length(trim(t)) n, row_number() over (partition by doc_id order by o) k from e),
w(d, k, size, pack) as (select d, k, n, 0 from c where k = 1 union all select c.d, c.k, case when b or size + 1 + n > 1200 then n else size + 1 + n end, case when b or size + 1 + n > 1200 then pack + 1 else pack end from w join c on c.d = w.d and c.k = w.k + 1),
p as (select d, pack, max(size) size from w group by 1, 2)
select sha256('{{"cross_unit":false,"flush_on_heading":true,"joint":"\\n","max_chars":1200,"split_oversized":false}}') config_hash, count(*) chunks, count(*) filter (size > 1200) oversized from p""",
    "question_view": f"with {evidence._AWARE} select query, arg_min(document_id, rank) principal, count(*) claims, array_to_string(list_sort(list(distinct document_id)), ',') cited, count(distinct document_id) > 1 cross_document from hits group by 1",
}
