"""Queries over texts: elements, headings, packing, spans, matching, normalisation, scorecards, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verityloom.functions import text
from verityloom.operators import elements, metrics
from verityloom.plans import authority
from verityloom.session import table
from verityloom.streaming import events

LABELS = ["draft", "formal", "quarterly", "legacy", "interim", "manual"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def element_extract(spark: SparkSession, d: str) -> DataFrame:
    return elements.elements(_docs(spark, d), "doc_id", "text")


def element_kinds(spark: SparkSession, d: str) -> DataFrame:
    return element_extract(spark, d).groupBy("doc_id", "kind").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")
    )


def heading_path(spark: SparkSession, d: str) -> DataFrame:
    return elements.heading_paths(element_extract(spark, d), "doc_id").select(
        "doc_id", "order_index", "kind", "heading_path"
    )


def _distinct_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_chunks").select(
        "chunk_id", "document_id", "chunk_index", "chunk_text"
    ).dropDuplicates(["chunk_id"])


def chunk_packing(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of each document packed up to 2,400 characters."""
    return elements.pack(
        _distinct_chunks(spark, d), "document_id", "chunk_index", "chunk_text", 2400
    ).select("document_id", "chunk_index", "pack_index")


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents' elements in chunks of up to 1,200 characters; a heading begins a chunk, which has its heading path."""
    config = elements.ChunkingConfig(split_oversized=False)
    c = elements.chunk(element_extract(spark, d), "doc_id", config)
    return c.select(
        "doc_id", F.col("chunk_index").alias("pack_index"), "elements", "first",
        F.length("chunk_text").cast("long").alias("chars"), "heading_path"
    )


def oversized_parts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks over 1,200 characters in parts, and that the parts are the text again."""
    x = elements.split_long(_distinct_chunks(spark, d).where(F.length("chunk_text") > 1200), "chunk_text", 1200)
    again = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "part_text"))), lambda s: s["part_text"]), ""
    ) == F.any_value("chunk_text")
    return x.groupBy("document_id", "chunk_index").agg(
        F.count("*").alias("parts"), F.max(F.length("part_text")).alias("longest"), again.alias("whole")
    )


def fragment_split(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every document, their characters, and whether they make up the text again."""
    f = _docs(spark, d).select("doc_id", "text", elements.fragments(F.col("text")).alias("f"))
    return f.select(
        "doc_id", F.size("f").cast("long").alias("sentences"),
        F.length(F.array_join("f", "")).cast("long").alias("chars"),
        (F.array_join("f", "") == F.col("text")).alias("whole")
    )


def identifier_spans(spark: SparkSession, d: str) -> DataFrame:
    """Which sentence of its document each identifier stands in."""
    f = _docs(spark, d).select("doc_id", F.posexplode(elements.fragments(F.col("text"))).alias("sentence", "piece"))
    return f.select("doc_id", "sentence", F.explode(text.identifiers(F.col("piece"))).alias("identifier"))


def normalised_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.sha2(text.squashed(F.col("text")), 256).alias("normal_hash"))


def folded_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.sha2(text.folded(text.squashed(F.col("text"))), 256).alias("folded_hash"))


def status_labels(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(
        "doc_id", F.array_join(text.contained_labels(F.col("text"), LABELS), ",").alias("labels")
    )


def identifier_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of each of a document's identifiers that are not part of a longer one."""
    ids = _docs(spark, d).select(
        "doc_id", "text",
        F.explode(
            F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Z]{1,6}-[0-9]+[a-z]?)"), 1))
        ).alias("identifier")
    )
    return ids.select(
        "doc_id", "identifier", text.occurrences(F.col("text"), F.col("identifier")).cast("long").alias("n")
    )


def passage_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a whole test passage, and how often each is found."""
    n = table(spark, d, "evaluation_items").select("item_id", F.col("expected_supporting_passage").alias("needle"))
    return elements.contained(n, "item_id", "needle", _docs(spark, d), "doc_id", "text").groupBy("item_id").agg(
        F.count("*").alias("documents"), F.min("doc_id").alias("first_doc")
    )


def text_fact_recall(spark: SparkSession, d: str) -> DataFrame:
    """Per document type: lines of the documents that their chunks hold as they are after normalisation."""
    lines = lambda df, keys, t: elements.elements(
        df.select(F.struct(*keys).alias("k"), F.col(t).alias("t")), "k", "t"
    ).select("k.*", "kind", F.sha2(text.squashed(F.col("text")), 256).alias("h"))
    facts = lines(
        _docs(spark, d), ["document_id", "document_type"], "text"
    ).where("kind = 'paragraph'").drop("kind").distinct()
    seen = lines(
        table(spark, d, "document_chunks"), ["document_id"], "chunk_text"
    ).select("document_id", "h").distinct().withColumn("hit", F.lit(True))
    x = facts.join(seen, ["document_id", "h"], "left").select(
        "document_type", F.lit("line_recall").alias("metric"), F.coalesce("hit", F.lit(False)).alias("hit"),
        F.lit(False).alias("excluded")
    )
    return metrics.scorecard(x, "document_type", "metric", "hit", "excluded")


def metric_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Completeness of the documents' fields by type and over all; rows without a revision are excluded from 'revision'."""
    docs = _docs(spark, d)
    facts = [
        docs.select(
            "document_type", F.lit(m).alias("metric"), F.coalesce(hit, F.lit(False)).alias("hit"), ex.alias("excluded")
        ) for m,
        hit,
        ex in (
            ("language", F.col("lang").isNotNull(), F.lit(False)),
            ("source", F.col("source").isNotNull(), F.lit(False)),
            ("revision", F.col("document_revision_id").startswith("REV"), F.col("document_revision_id").isNull())
        )
    ]
    return metrics.scorecard(
        facts[0].unionByName(facts[1]).unionByName(facts[2]), "document_type", "metric", "hit", "excluded"
    )


def miss_ledger(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return docs.select(
        "doc_id",
        F.explode(
            F.array_compact(
                F.array(
                    *(
                        F.when(F.col(c).isNull(), F.lit(c)) for c in (
                            "document_revision_id", "lang", "source", "source_path"
                        )
                    )
                )
            )
        ).alias("missing")
    )


def cell_match(spark: SparkSession, d: str) -> DataFrame:
    """The quantities of each order on odd lines matched one to one with equal ones on even lines, the pair of lines (1, 2), (3, 4) ... first."""
    li = table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_quantity").cast("long").alias("q"),
        F.expr("cast((l_linenumber + 1) div 2 as int)").alias("row"), "l_linenumber"
    )
    a, b = li.where("l_linenumber % 2 = 1").drop("l_linenumber"), li.where("l_linenumber % 2 = 0").drop("l_linenumber")
    m = elements.matched_by_value(a, b, ["l_orderkey"], "q", ["row"])
    return m.groupBy("l_orderkey").agg(
        F.count_if(F.col("expected").isNotNull() & F.col("observed").isNotNull()).alias("equal"),
        F.count_if(F.col("observed").isNull()).alias("missing"), F.count_if(F.col("expected").isNull()).alias("extra")
    )


def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events per type and day, counted by a stream over the file with a watermark."""
    schema = table(spark, d, "events").schema
    s = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = events.run_to_end(
        events.windowed_counts(s, "ts", ["event_type"], "1 day", "30 days"), "windows", ["window_start", "event_type"]
    )
    return got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of every user, kept up to date batch by batch."""
    schema = table(spark, d, "events").schema
    s = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").select("user_id", "ts", "event_id")
    return events.keep_latest(s, "latest", ["user_id"], "ts").select("user_id", "ts")


def stream_periods(spark: SparkSession, d: str) -> DataFrame:
    """The decision log kept up to date as a stream, each event once, and folded into periods."""
    schema = table(spark, d, "edib_authority_decision_event").schema
    s = spark.readStream.schema(schema).parquet(f"{d}/edib_authority_decision_event*.parquet")
    return authority.log_periods(events.keep_latest(s, "log", ["event_id"], "recorded_at"))


QUERIES = {
    f.__name__: f for f in (
        element_extract, element_kinds, heading_path, chunk_packing, chunk_documents, oversized_parts, fragment_split,
        identifier_spans, normalised_text, folded_text, status_labels, identifier_occurrences, passage_alignment,
        text_fact_recall, metric_grouping_sets, miss_ledger, cell_match, stream_window_counts, stream_upsert, stream_periods
    )
}

_LINES = """
raw as (select doc_id, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) t, unnest(range(0, len(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))))) order_index from documents),
el as (select doc_id, order_index, case when regexp_matches(t, '^\\s*(\\d+(\\.\\d+)*)\\s+\\p{Lu}[^.!?]*$') then 'heading' when regexp_matches(t, '^\\s*([-*\\x{2022}]|\\d+[.)])\\s+\\S') then 'list_item' when regexp_matches(t, '^\\s*\\[?\\d{4}-\\d{2}-\\d{2}\\]?\\s') then 'dated_entry' else 'paragraph' end kind, trim(t) as text, t raw from raw where trim(t) <> '')
"""
_SQUASH = "lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\x0B]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '^\\s+|\\s+$', '', 'g'))"
ORACLES = {
    "element_extract": f"with {_LINES} select doc_id, cast(order_index as int) order_index, kind, cast(case kind when 'heading' then len(string_split(regexp_extract(raw, '^\\s*(\\d+(\\.\\d+)*)', 1), '.')) when 'list_item' then length(regexp_extract(raw, '^( *)', 1)) // 2 end as int) as level, text from el",
    "element_kinds": f"with {_LINES} select doc_id, kind, count(*) n, cast(sum(length(text)) as bigint) chars from el group by 1, 2",
    "heading_path": f"""with {_LINES}, h as (select doc_id, order_index o, text t, len(string_split(regexp_extract(raw, '^\\s*(\\d+(\\.\\d+)*)', 1), '.')) l from el where kind = 'heading'),
j as (select e.doc_id, e.order_index, h.o, h.t from el e join h on h.doc_id = e.doc_id and h.o <= e.order_index where not exists (select 1 from h g where g.doc_id = h.doc_id and g.o > h.o and g.o <= e.order_index and g.l <= h.l)),
p as (select doc_id, order_index, string_agg(t, ' > ' order by o) path from j group by 1, 2)
select doc_id, cast(order_index as int) order_index, kind, coalesce(path, '') heading_path from el left join p using (doc_id, order_index)""",
    "chunk_packing": """with recursive c as (select document_id d, chunk_index i, coalesce(length(chunk_text), 0) n, row_number() over (partition by document_id order by chunk_index) k from (select distinct on (chunk_id) * from document_chunks)),
w(d, i, k, size, pack) as (select d, i, k, n, 0 from c where k = 1 union all select c.d, c.i, c.k, case when size + 1 + n > 2400 then n else size + 1 + n end, case when size + 1 + n > 2400 then pack + 1 else pack end from w join c on c.d = w.d and c.k = w.k + 1)
select d document_id, i chunk_index, cast(pack as int) pack_index from w""",
    "chunk_documents": f"""with recursive {_LINES}, h as (select doc_id, order_index o, text t, len(string_split(regexp_extract(raw, '^\\s*(\\d+(\\.\\d+)*)', 1), '.')) l from el where kind = 'heading'),
j as (select e.doc_id, e.order_index, h.o, h.t from el e join h on h.doc_id = e.doc_id and h.o <= e.order_index where not exists (select 1 from h g where g.doc_id = h.doc_id and g.o > h.o and g.o <= e.order_index and g.l <= h.l)),
p as (select doc_id, order_index, string_agg(t, ' > ' order by o) path from j group by 1, 2),
c as (select doc_id d, order_index o, kind = 'heading' b, length(text) n, coalesce(path, '') path, row_number() over (partition by doc_id order by order_index) k from el left join p using (doc_id, order_index)),
w(d, o, k, n, path, size, pack) as (select d, o, k, n, path, n, 0 from c where k = 1 union all select c.d, c.o, c.k, c.n, c.path, case when b or size + 1 + c.n > 1200 then c.n else size + 1 + c.n end, case when b or size + 1 + c.n > 1200 then pack + 1 else pack end from w join c on c.d = w.d and c.k = w.k + 1)
select d doc_id, cast(pack as int) pack_index, count(*) elements, cast(min(o) as int) "first", cast(sum(n) + count(*) - 1 as bigint) chars, arg_min(path, o) heading_path from w group by 1, 2""",
    "oversized_parts": r"""with c as (select distinct on (chunk_id) document_id, chunk_index, chunk_text t from document_chunks where length(chunk_text) > 1200),
s as (select *, string_split(regexp_replace(t, '([.!?][ \t\n\r\f\x0B]+)([^ \t\n\r\f\x0B])', '\1' || chr(1) || '\2', 'g'), chr(1)) f from c),
m as (select *, list_reduce(f, lambda a, x: case when length(regexp_extract(a, '[^\x01]*$')) + length(x) <= 1200 then a || x else a || chr(1) || x end) g from s),
w as (select *, list_transform(string_split(g, chr(1)), lambda y: case when length(y) <= 1200 then y else list_reduce(string_split(regexp_replace(y, '([ \t\n\r\f\x0B]+)([^ \t\n\r\f\x0B])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda a, x: case when length(regexp_extract(a, '[^\x01]*$')) + length(x) <= 1200 then a || x else a || chr(1) || x end) end) z from m)
select document_id, chunk_index, cast(len(string_split(array_to_string(z, chr(1)), chr(1))) as bigint) parts, cast(list_max(list_transform(string_split(array_to_string(z, chr(1)), chr(1)), lambda x: length(x))) as int) longest, replace(array_to_string(z, ''), chr(1), '') = t whole from w""",
    "fragment_split": r"""with s as (select doc_id, text, string_split(regexp_replace(text, '([.!?][ \t\n\r\f\x0B]+)([^ \t\n\r\f\x0B])', '\1' || chr(1) || '\2', 'g'), chr(1)) f from documents)
select doc_id, cast(len(f) as bigint) sentences, cast(length(array_to_string(f, '')) as bigint) chars, array_to_string(f, '') = text whole from s""",
    "identifier_spans": r"""with s as (select doc_id, string_split(regexp_replace(text, '([.!?][ \t\n\r\f\x0B]+)([^ \t\n\r\f\x0B])', '\1' || chr(1) || '\2', 'g'), chr(1)) f from documents),
p as (select doc_id, unnest(f) piece, unnest(range(0, len(f))) sentence from s)
select distinct doc_id, cast(sentence as int) sentence, upper(unnest(regexp_extract_all(piece, '\b([A-Za-z]{1,6}-\d+[A-Za-z]?)\b', 1))) identifier from p""",
    "identifier_occurrences": r"""with i as (select distinct doc_id, text, unnest(regexp_extract_all(text, '([A-Z]{1,6}-[0-9]+[a-z]?)', 1)) identifier from documents)
select doc_id, identifier, cast((select count(*) from (select unnest(range(1, length(text) + 1)) k) where substr(text, k, length(identifier)) = identifier and not regexp_matches(substr(text, k - 1, case when k = 1 then 0 else 1 end), '[A-Za-z0-9]') and not regexp_matches(substr(text, k + length(identifier), 1), '[A-Za-z0-9]')) as bigint) n from i""",
    "text_fact_recall": r"""with el as (select document_id, document_type, text, trim(t) v, regexp_matches(t, '^\s*(\d+(\.\d+)*)\s+\p{Lu}[^.!?]*$') or regexp_matches(t, '^\s*([-*\x{2022}]|\d+[.)])\s+\S') or regexp_matches(t, '^\s*\[?\d{4}-\d{2}-\d{2}\]?\s') other from (select document_id, document_type, text, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) t from documents) where trim(t) <> ''),
f as (select distinct document_id, document_type, SQUASH(v) h from el where not other),
s as (select distinct document_id, SQUASH(v) h from (select document_id, trim(unnest(string_split(regexp_replace(chunk_text, '\r\n?', chr(10), 'g'), chr(10)))) v from document_chunks) where v <> '')
select case when grouping(document_type) = 1 then 'overall' else coalesce(document_type, 'none') end bucket, 'line_recall' metric, count(*) filter (s.h is not null) numerator, count(*) denominator, 0 excluded, round(count(*) filter (s.h is not null) / count(*), 6) score from f left join s using (document_id, h) group by grouping sets ((document_type), ())""".replace("SQUASH(v)", _SQUASH.format("v")),
    "normalised_text": f"select doc_id, sha256({_SQUASH.format('text')}) normal_hash from documents",
    "folded_text": f"select doc_id, sha256(replace(lower(nfc_normalize({_SQUASH.format('text')})), 'ß', 'ss')) folded_hash from documents",
    "status_labels": "select doc_id, array_to_string(list_filter(" + str(LABELS) + ", lambda x: contains(lower(text), x)), ',') labels from documents",
    "passage_alignment": "select item_id, count(*) documents, min(doc_id) first_doc from evaluation_items join documents on contains(text, expected_supporting_passage) where expected_supporting_passage <> '' group by 1",
    "metric_grouping_sets": """with f as (select document_type, 'language' metric, lang is not null hit, false excluded from documents union all select document_type, 'source', source is not null, false from documents union all select document_type, 'revision', coalesce(starts_with(document_revision_id, 'REV'), false), document_revision_id is null from documents)
select case when grouping(document_type) = 1 then 'overall' else coalesce(document_type, 'none') end bucket, metric, count(*) filter (hit and not excluded) numerator, count(*) filter (not excluded) denominator, count(*) filter (excluded) excluded, round(count(*) filter (hit and not excluded) / nullif(count(*) filter (not excluded), 0), 6) score
from f group by grouping sets ((document_type, metric), (metric))""",
    "miss_ledger": "select doc_id, unnest(list_filter([case when document_revision_id is null then 'document_revision_id' end, case when lang is null then 'lang' end, case when source is null then 'source' end, case when source_path is null then 'source_path' end], lambda x: x is not null)) missing from documents",
    "cell_match": """with n as (select l_orderkey, l_quantity, count(*) filter (l_linenumber % 2 = 1) a, count(*) filter (l_linenumber % 2 = 0) b from lineitem group by 1, 2)
select l_orderkey, cast(sum(least(a, b)) as bigint) equal, cast(sum(a - least(a, b)) as bigint) missing, cast(sum(b - least(a, b)) as bigint) extra from n group by 1""",
    "stream_window_counts": "select date_trunc('day', ts)::timestamp window_start, event_type, count(*) n from events group by 1, 2",
    "stream_periods": authority.ORACLES["periods_from_log"],
    "stream_upsert": "select user_id, max(ts) ts from events group by 1",
}
