"""Queries and SQL of the two general training-data problems: periods and gaps (p1), hierarchies (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verityloom.operators import hierarchy, intervals
from verityloom.session import table


def _periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.continuous_periods(
        table(spark, d, "edib_revision_authority_period"), "logical_document_id", "authority_period_id",
        "effective_from", "effective_to"
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("span_kind") == "gap", F.lit("gap")).otherwise(F.lit("merged")).alias("span_kind")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return _periods(spark, d).where("span_kind = 'gap' or shared").select(
        "logical_document_id", kind, day("span_from"), day("span_to")
    )


def p1_spans(spark: SparkSession, d: str) -> DataFrame:
    return _periods(spark, d)


def _revisions(spark: SparkSession, d: str, with_path: bool) -> DataFrame:
    return hierarchy.tree(
        table(spark, d, "edib_document_revision_registry"), "document_revision_id",
        table(spark, d, "edib_revision_authority_period"), "document_revision_id", "predecessor_revision_id",
        with_path=with_path, near="logical_document_id"
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _revisions(spark, d, False).where("parent is not null").select(
        F.col("node").alias("document_revision_id"), F.col("root").alias("root_revision_id"),
        F.col("depth").cast("int").alias("depth")
    )


def p4_tree(spark: SparkSession, d: str) -> DataFrame:
    return _revisions(spark, d, True).select(
        "node", "parent", "root", "depth", "subtree_size", "path", (F.col("hi") - F.col("lo")).alias("range_width")
    )


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_revisions(spark, d, False))


QUERIES = {f.__name__: f for f in (p1_found, p1_spans, p4_found, p4_tree, p4_descendants)}

_P1 = """
with rows_ as (
  select distinct logical_document_id k, authority_period_id id, effective_from f, coalesce(effective_to, date '9999-12-31') t
  from edib_revision_authority_period
  where logical_document_id is not null and coalesce(effective_to, date '9999-12-31') > effective_from),
reach as (
  select *, max(t) over (partition by k order by f, t, id rows between unbounded preceding and 1 preceding) before from rows_),
marked as (
  select *, sum(case when before is null or f > before then 1 else 0 end) over (partition by k order by f, t, id rows unbounded preceding) span from reach),
spans as (
  select k, span, min(f) f, max(t) t, bool_or(coalesce(f < before, false)) shared from marked group by k, span),
gaps as (
  select k, t f, lead(f) over (partition by k order by f) t from spans)
"""
_P4 = """
with recursive v as (select distinct document_revision_id v from edib_document_revision_registry where document_revision_id is not null),
e as (
  select p.document_revision_id c, min(p.predecessor_revision_id) p from edib_revision_authority_period p
  join v a on a.v = p.document_revision_id join v b on b.v = p.predecessor_revision_id group by 1),
walk(v, here, steps, seen) as (
  select v, v, 0, cast([] as varchar[]) from v
  union all
  select w.v, e.p, w.steps + 1, list_append(w.seen, w.here) from walk w join e on e.c = w.here where not list_contains(w.seen, w.here)),
ends as (select v, max(steps) steps, arg_max(here, steps) here, arg_max(seen, steps) seen from walk group by v),
placed as (
  select n.v node, e.p parent, not list_contains(n.seen, n.here) ended, list_append(n.seen, n.here) seen,
         case when list_contains(n.seen, n.here) then list_min(list_slice(n.seen, list_position(n.seen, n.here), -1)) else n.here end root,
         case when list_contains(n.seen, n.here) then -1 else n.steps end depth,
         case when not list_contains(n.seen, n.here) then array_to_string(list_reverse(list_append(n.seen, n.here)), '/') end path
  from ends n left join e on e.c = n.v)
"""
ORACLES = {
    "p1_found": _P1 + """
select k logical_document_id, 'merged' span_kind, strftime(f, '%Y-%m-%d') span_from, strftime(t, '%Y-%m-%d') span_to from spans where shared
union all select k, 'gap', strftime(f, '%Y-%m-%d'), strftime(t, '%Y-%m-%d') from gaps where t is not null""",
    "p1_spans": _P1 + """
select k logical_document_id, 'period' span_kind, f span_from, t span_to, shared from spans
union all select k, 'gap', f, t, false from gaps where t is not null""",
    "p4_found": _P4 + "select node document_revision_id, root root_revision_id, cast(depth as int) depth from placed where parent is not null",
    "p4_tree": _P4 + """
, sizes as (select x.a, count(*) n from (select unnest(seen) a from placed where ended) x group by 1)
select node, parent, root, cast(depth as bigint) depth, cast(case when ended then n end as bigint) subtree_size, path, cast(case when ended then n end as bigint) range_width
from placed left join sizes on a = node""",
    "p4_descendants": _P4 + """
select root, a node, node descendant, cast(pos as bigint) steps from (
  select root, node, unnest(list_slice(seen, 2, -1)) a, unnest(range(1, len(seen))) pos from placed where ended) x""",
}
