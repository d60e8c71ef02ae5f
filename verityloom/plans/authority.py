"""Queries over revisions and their periods, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verityloom.functions import hashing
from verityloom.operators import authority, keyed, search, temporal
from verityloom.session import table

AS_OF, K = "2021-06-30", 5
DOC, REV, FROM, TO = "logical_document_id", "document_revision_id", "effective_from", "effective_to"


def _periods(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edib_revision_authority_period")


def authority_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Each delivery with the period of its document that was in force on the day of delivery."""
    docs = table(spark, d, "documents").select("doc_id", DOC, F.to_date("created_at").alias("day"))
    return temporal.as_of(docs, DOC, "day", _periods(spark, d).select(DOC, FROM, TO), DOC, FROM, TO)


def overlapping_periods(spark: SparkSession, d: str) -> DataFrame:
    p = temporal.real(_periods(spark, d), FROM, TO).select(
        DOC, "authority_period_id", FROM, TO
    ).dropDuplicates(["authority_period_id"])
    return temporal.overlapping_pairs(p, DOC, "authority_period_id", FROM, TO)


def chain_integrity(spark: SparkSession, d: str) -> DataFrame:
    return temporal.chain_problems(
        _periods(spark, d), table(spark, d, "edib_document_revision_registry"), DOC, REV, FROM, TO,
        "predecessor_revision_id", "closure_reason"
    )


def integrity_summary(spark: SparkSession, d: str) -> DataFrame:
    return chain_integrity(spark, d).groupBy("problem").agg(
        F.count("*").alias("revisions"), F.count_distinct(DOC).alias("documents")
    )


def _registry(spark: SparkSession, d: str) -> DataFrame:
    """One row per revision: the last one written."""
    r = table(spark, d, "edib_document_revision_registry").select(
        F.col(DOC).alias("doc"), F.col(REV).alias("revision"), F.col("publication_status").alias("status"),
        "version_label", "revision_number", "updated_at"
    )
    return keyed.first_per_key(
        r, ["doc", "revision"], F.desc("updated_at"), "status", "version_label", "revision_number"
    )


def _history(spark: SparkSession, d: str) -> DataFrame:
    """One row per period that has a start."""
    p = _periods(spark, d).where(f"{FROM} is not null").select(
        F.col(DOC).alias("doc"), F.col(REV).alias("revision"), F.col("authority_period_id").alias("period"),
        F.col(FROM).alias("start"), F.col(TO).alias("end"), F.col("predecessor_revision_id").alias("predecessor"),
        F.col("closure_reason").alias("reason")
    )
    return p.distinct()


def integrity_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every broken one of the nine rules, by document and revision."""
    return authority.integrity_problems(_registry(spark, d), _history(spark, d))


def authority_state(spark: SparkSession, d: str) -> DataFrame:
    """The state of every revision on AS_OF."""
    return authority.authority_states(_registry(spark, d), _history(spark, d), F.lit(AS_OF))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col(DOC).alias("doc"))
    return authority.resolve(authority_state(spark, d), integrity_rules(spark, d), docs)


def authority_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The one revision in force of every delivered document on AS_OF, or why there is none."""
    return _resolved(spark, d)


def authority_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Why each revision is left out, counted."""
    return authority.exclusions(
        authority_state(spark, d), _resolved(spark, d)
    ).groupBy("reason", "detail").agg(F.count("*").alias("revisions"))


def fail_closed_search(spark: SparkSession, d: str) -> DataFrame:
    """The nearest chunks of each query vector among the revisions that resolve; a document that fails closed has none."""
    ok = _resolved(spark, d).where("code = 'ok'").select(F.col("revision").alias(REV))
    c = keyed.first_per_key(
        table(spark, d, "document_chunks").select("chunk_id", "document_id", REV, "embedding", "created_at"),
        ["chunk_id"], F.desc("created_at"), "document_id"
    )
    q = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(
        F.col("vec_id").cast("string").alias("chunk_id"), "embedding"
    )
    return search.eligible_search(
        q, "chunk_id", c, "chunk_id", "embedding", ok, REV, K, skip_self=False
    ).select("query", "row", "rank", F.round("similarity", 6).alias("similarity"))


def registry_dump(spark: SparkSession, d: str) -> DataFrame:
    """Per document its revisions with status and number of periods, and a hash of all of it: what a resolution rests on."""
    n = _history(spark, d).groupBy("doc", "revision").agg(F.count("*").alias("periods"))
    x = _registry(spark, d).join(n, ["doc", "revision"], "left").fillna(0, ["periods"])
    line = F.concat_ws(":", "revision", F.coalesce("status", F.lit("none")), "periods")
    return x.groupBy("doc").agg(
        F.array_join(F.array_sort(F.collect_list(line)), ",").alias("revisions"),
        hashing.set_hash(
            F.col("revision"), F.col("status"), F.col("version_label"), F.col("revision_number"), F.col("periods")
        ).alias("snapshot")
    )


def log_periods(log: DataFrame) -> DataFrame:
    """Periods of a log with the columns of edib_authority_decision_event, each event once."""
    kind = F.when(F.col("event_type") == "revision_activated", "open").when(
        F.col("event_type") == "revision_withdrawn", "close"
    )
    return authority.periods_from_log(
        log.select(
            F.col("event_id").alias("event"), kind.alias("kind"), F.col(DOC).alias("doc"),
            F.col("revision_id").alias("revision"), F.col("related_revision_id").alias("related"),
            F.col("decision_effective_date").alias("day"), F.col("closure_reason").alias("reason")
        )
    )


def periods_from_log(spark: SparkSession, d: str) -> DataFrame:
    """The periods that the decision log gives when folded in the order of its events."""
    e = table(spark, d, "edib_authority_decision_event")
    return log_periods(keyed.first_per_key(e, ["event_id"], F.desc("recorded_at")))


def days_in_force(spark: SparkSession, d: str) -> DataFrame:
    """Days that each revision was in force up to the newest start of any period."""
    p = temporal.real(_periods(spark, d), FROM, TO).select("authority_period_id", REV, FROM, TO).distinct()
    end = F.broadcast(p.agg(F.max(FROM).alias("newest")))
    return p.join(end).groupBy(REV).agg(
        F.sum(
            F.greatest(F.lit(0), F.datediff(F.least(F.coalesce(TO, "newest"), "newest"), FROM))
        ).cast("long").alias("days"),
        F.count("*").alias("periods")
    )


def orphaned_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Registered revisions without any period."""
    return table(
        spark, d, "edib_document_revision_registry"
    ).select(DOC, REV).distinct().join(_periods(spark, d), REV, "left_anti").select(DOC, REV)


def event_log_latest(spark: SparkSession, d: str) -> DataFrame:
    """Per revision the last event of the log and how many different events there were."""
    e = table(spark, d, "edib_authority_decision_event").select(
        "event_id", "event_type", "revision_id", "recorded_at"
    ).distinct()
    return e.groupBy("revision_id").agg(
        F.max_by("event_type", F.struct("recorded_at", "event_id", "event_type")).alias("last_event"),
        F.count_distinct("event_id").alias("events")
    )


QUERIES = {
    f.__name__: f for f in (
        authority_as_of, overlapping_periods, chain_integrity, integrity_summary, integrity_rules, authority_state,
        authority_resolution, authority_exclusions, fail_closed_search, registry_dump, periods_from_log, days_in_force,
        orphaned_revisions, event_log_latest
    )
}

_P = "edib_revision_authority_period"
_REAL = "effective_from is not null and (effective_to is null or effective_to > effective_from)"
_CHAIN = f"""
p as (select distinct logical_document_id d, document_revision_id r, effective_from s, effective_to e, predecessor_revision_id pre, closure_reason why from {_P}),
reg as (select distinct document_revision_id r, logical_document_id rd from edib_document_revision_registry),
f as (select d, pre r, s e, count(distinct r) n from p where pre is not null group by all),
problems as (
  select 'orphaned_period' problem, d, r from p where r not in (select r from reg where r is not null)
  union select 'period_document_mismatch', d, p.r from p join reg using (r) where d <> rd
  union select 'missing_predecessor', d, r from p where pre is not null and not exists (select 1 from p q where q.d = p.d and q.r = p.pre)
  union select case when coalesce(n, 0) = 0 then 'missing_successor' else 'ambiguous_successor' end, d, r from p left join f using (d, r, e) where e is not null and why in ('superseded', 'rollback') and coalesce(n, 0) <> 1)
"""
_BASE = """
r as (select logical_document_id doc, document_revision_id rev, publication_status status, version_label, revision_number from (
  select *, row_number() over (partition by logical_document_id, document_revision_id order by updated_at desc, publication_status nulls first, version_label nulls first, revision_number nulls first) n from edib_document_revision_registry) where n = 1),
p as (select distinct logical_document_id doc, document_revision_id rev, authority_period_id id, effective_from s, effective_to e, predecessor_revision_id pre, closure_reason why from edib_revision_authority_period where effective_from is not null),
met as (select a.doc, least(a.rev, b.rev) x, greatest(a.rev, b.rev) y from p a join p b on a.doc = b.doc and a.id < b.id and (a.e is null or b.s < a.e) and (b.e is null or a.s < b.e)),
problems as (
  select p.doc, p.rev, case when p.rev in (select rev from r) then 'period_document_mismatch' else 'orphaned_period' end code from p where not exists (select 1 from r where r.doc = p.doc and r.rev = p.rev)
  union select doc, rev, 'missing_predecessor' from p where pre is not null and not exists (select 1 from r where r.doc = p.doc and r.rev = p.pre)
  union select doc, x, case when x = y then 'own_periods_overlap' else 'cross_revision_period_overlap' end from met
  union select doc, rev, case when n = 0 then 'missing_successor' else 'ambiguous_successor' end from (
    select doc, rev, (select count(*) from p q where q.doc = p.doc and q.pre = p.rev and q.s = p.e and q.id <> p.id) n from p where why in ('superseded', 'rollback')) where n <> 1
  union select doc, rev, 'withdrawn_with_open_period' from p join r using (doc, rev) where status = 'withdrawn' and e is null
  union select doc, rev, 'unapproved_with_real_period' from p join r using (doc, rev) where status in ('draft', 'under_review') and (e is null or e > s)),
scoped as (select *, case when code in ('own_periods_overlap', 'withdrawn_with_open_period', 'unapproved_with_real_period') then 'revision' else 'document' end scope from problems),
"""
_STATES = _BASE + f"""
per as (select doc, rev, count(*) n, count(*) filter (e is null or e > s) n_real, bool_or(s <= date '{AS_OF}' and (e is null or date '{AS_OF}' < e)) covered, bool_or(s > date '{AS_OF}') future from p group by 1, 2),
own as (select distinct doc, x rev from met where x = y),
checked as (select r.*, n, covered, future, case when status is null then 'unknown_status' when status in ('draft', 'under_review') then case when coalesce(n_real, 0) > 0 then 'unapproved_with_real_period' end
    when own.rev is not null then 'own_periods_overlap' when n is null then 'no_period_recorded' end error from r left join per using (doc, rev) left join own using (doc, rev)),
states as (select doc, rev, status, error, case when error is null then case when status in ('draft', 'under_review') then status when covered then 'effective' when future then 'approved_future' when status = 'withdrawn' then 'withdrawn' else 'superseded' end end state from checked),
lead_ as (select doc, arg_min(code, (scope, list_position(['orphaned_period', 'period_document_mismatch', 'missing_predecessor', 'cross_revision_period_overlap', 'own_periods_overlap', 'missing_successor', 'ambiguous_successor', 'withdrawn_with_open_period', 'unapproved_with_real_period'], code))) lead_code from scoped group by 1),
resolved as (select doc, effective, revisions, only_, case when revisions = 0 then 'no_revisions_registered' when lead_code is not null then lead_code when effective > 1 then 'overlapping_effective_revisions' when effective = 0 then 'no_effective_revision' else 'ok' end code from (
  select d.doc, count(s.rev) revisions, count(*) filter (state = 'effective') effective, min(rev) filter (state = 'effective') only_ from (select distinct logical_document_id doc from documents) d left join states s using (doc) group by 1) left join lead_ using (doc))
"""
ORACLES = {
    "authority_as_of": f"""select doc_id, logical_document_id, day, effective_from, effective_to from (
  select doc_id, d.logical_document_id, d.day, p.effective_from, p.effective_to, row_number() over (partition by doc_id order by p.effective_from desc nulls last, p.effective_to desc nulls first) rn
  from (select doc_id, logical_document_id, cast(created_at as date) as day from documents) d
  left join (select * from {_P} where {_REAL}) p on p.logical_document_id = d.logical_document_id and p.effective_from <= d.day and (p.effective_to is null or d.day < p.effective_to)) where rn = 1""",
    "overlapping_periods": f"""with p as (select distinct logical_document_id k, authority_period_id i, effective_from f, coalesce(effective_to, date '9999-12-31') t from {_P} where {_REAL})
select a.k logical_document_id, a.i first_id, b.i second_id from p a join p b on a.k = b.k and a.f < b.t and b.f < a.t and (a.f, a.t, a.i) < (b.f, b.t, b.i)""",
    "chain_integrity": f"with {_CHAIN} select problem, d logical_document_id, r document_revision_id from problems",
    "integrity_summary": f"with {_CHAIN} select problem, count(*) revisions, count(distinct d) documents from problems group by 1",
    "integrity_rules": f"with {_BASE.rstrip().rstrip(',')} select doc, rev revision, code, scope from scoped",
    "authority_state": f"with {_STATES} select doc, rev revision, status, state, error from states",
    "authority_resolution": f"with {_STATES} select doc, case when code = 'ok' then only_ end revision, code, effective, revisions from resolved",
    "authority_exclusions": f"""with {_STATES} select case when code <> 'ok' then code else 'not_effective_' || coalesce(state, 'unresolved') end reason, concat_ws('; ', 'status=' || status, 'state=' || state, 'error=' || error) detail, count(*) revisions
from states s join resolved using (doc) where not (code = 'ok' and rev is not distinct from only_) group by 1, 2""",
    "fail_closed_search": f"""with {_STATES}, c as (select * from (select *, row_number() over (partition by chunk_id order by created_at desc, document_id) rn from document_chunks) where rn = 1),
v as (select chunk_id, cast(embedding as double[]) x from c where document_revision_id in (select only_ from resolved where code = 'ok') and embedding is not null and len(embedding) = 64),
s as (select cast(e.vec_id as varchar) query, chunk_id "row", round(coalesce(list_dot_product(cast(e.embedding as double[]), x) / nullif(sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(cast(e.embedding as double[]), cast(e.embedding as double[]))), 0), 0), 9) sim from embeddings e, v where vec_id % 20 = 0)
select query, "row", rank, round(sim, 6) similarity from (select *, row_number() over (partition by query order by sim desc, "row") rank from s) where rank <= {K}""",
    "registry_dump": f"""with {_BASE.rstrip().rstrip(',')}, n as (select doc, rev, count(*) periods from p group by 1, 2), x as (select r.*, coalesce(periods, 0) periods from r left join n using (doc, rev))
select doc, string_agg(rev || ':' || coalesce(status, 'none') || ':' || periods, ',' order by rev || ':' || coalesce(status, 'none') || ':' || periods) revisions,
  sha256(count(*) || '|' || sum(cast(('0x' || substr(sha256(rev || chr(31) || coalesce(status, chr(0)) || chr(31) || coalesce(version_label, chr(0)) || chr(31) || coalesce(cast(revision_number as varchar), chr(0)) || chr(31) || periods), 1, 15)) as bigint))) snapshot from x group by 1""",
    "periods_from_log": """with e as (select * from (select *, row_number() over (partition by event_id order by recorded_at desc) n from edib_authority_decision_event) where n = 1),
o as (select * from e where event_type = 'revision_activated'),
c as (select logical_document_id d, related_revision_id r, event_id i, decision_effective_date "day", coalesce(closure_reason, 'superseded') why from o where related_revision_id is not null
  union all select logical_document_id, revision_id, event_id, decision_effective_date, closure_reason from e where event_type = 'revision_withdrawn')
select o.logical_document_id doc, o.revision_id revision, o.decision_effective_date "start", arg_min(c."day", c.i) "end", o.related_revision_id predecessor, arg_min(c.why, c.i) reason, o.event_id opened_by, min(c.i) closed_by
from o left join c on c.d = o.logical_document_id and c.r = o.revision_id and c.i > o.event_id group by all""",
    "days_in_force": f"""with p as (select distinct authority_period_id, document_revision_id, effective_from f, effective_to t from {_P} where {_REAL}), n as (select max(f) m from p)
select document_revision_id, cast(sum(greatest(0, date_diff('day', f, least(coalesce(t, m), m)))) as bigint) "days", count(*) periods from p, n group by 1""",
    "orphaned_revisions": f"select distinct logical_document_id, document_revision_id from edib_document_revision_registry r where not exists (select 1 from {_P} p where p.document_revision_id = r.document_revision_id)",
    "event_log_latest": "select revision_id, arg_max(event_type, (recorded_at, event_id, event_type)) last_event, count(distinct event_id) events from edib_authority_decision_event group by 1",
}
