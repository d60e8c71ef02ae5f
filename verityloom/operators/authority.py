"""Authority over revisions as sets: integrity rules, states on a day, resolution that fails closed, periods from an event log.

Tables have fixed columns here. registry(doc, revision, status), one row per revision; periods(doc, revision, period,
start, end, predecessor, reason), one row per period, with a null end while open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verityloom.operators import temporal

# The rules in the order of their detection, and whether they concern a document or one revision.
RULES = {
    "orphaned_period": "document",
    "period_document_mismatch": "document",
    "missing_predecessor": "document",
    "cross_revision_period_overlap": "document",
    "own_periods_overlap": "revision",
    "missing_successor": "document",
    "ambiguous_successor": "document",
    "withdrawn_with_open_period": "revision",
    "unapproved_with_real_period": "revision",
}
UNAPPROVED = ("draft", "under_review")


def _real() -> Column:
    return F.col("end").isNull() | (F.col("end") > F.col("start"))


def overlaps(periods: DataFrame) -> DataFrame:
    """(doc, a, b): revisions of every two periods of a document that overlap; a = b for periods of one revision."""
    revision = periods.select(F.struct("period", "revision").alias("id"), "doc", "start", "end")
    pairs = temporal.overlapping_pairs(revision, "doc", "id", "start", "end")
    return pairs.select(
        "doc", F.least("first_id.revision", "second_id.revision").alias("a"),
        F.greatest("first_id.revision", "second_id.revision").alias("b")
    )


def integrity_problems(registry: DataFrame, periods: DataFrame) -> DataFrame:
    """(doc, revision, code, scope): every broken rule, once per revision; an intact table gives no rows.

    Overlaps are sought between all pairs of periods, own ones included, and reported for the lesser revision of a pair.
    A predecessor must be registered in the document. A period closed as superseded or by rollback needs just one other
    period that begins at its end and names its revision as predecessor.
    """
    known = registry.select("doc", "revision").distinct()
    where = known.select(F.col("doc").alias("home"), "revision")
    stray = periods.join(known, ["doc", "revision"], "left_anti").join(where, "revision", "left")
    stray = stray.select(
        "doc", "revision",
        F.when(F.col("home").isNull(), "orphaned_period").otherwise("period_document_mismatch").alias("code")
    )
    name = lambda df, code: df.select("doc", "revision", F.lit(code).alias("code"))
    named = periods.where("predecessor is not null").join(
        known.withColumnRenamed("revision", "predecessor"), ["doc", "predecessor"], "left_anti"
    )
    met = overlaps(periods).select(
        "doc", F.col("a").alias("revision"),
        F.when(F.col("a") == F.col("b"), "own_periods_overlap").otherwise("cross_revision_period_overlap").alias("code")
    )
    follow = periods.where("predecessor is not null").groupBy(
        "doc", F.col("predecessor").alias("revision"), F.col("start").alias("end")
    ).agg(
        F.count("*").alias("n"),
        F.collect_set(F.when(F.col("predecessor") == F.col("revision"), F.col("period"))).alias("own")
    )
    closed = periods.where("reason in ('superseded', 'rollback')").join(follow, ["doc", "revision", "end"], "left")
    n = F.coalesce("n", F.lit(0)) - F.when(F.array_contains("own", F.col("period")), 1).otherwise(0)  # a period is not its own successor
    bad = closed.withColumn("found", n).where("found <> 1").select(
        "doc", "revision",
        F.when(F.col("found") == 0, "missing_successor").otherwise("ambiguous_successor").alias("code")
    )
    held = registry.join(periods.select("doc", "revision", "start", "end"), ["doc", "revision"])
    parts = [
        stray, name(named, "missing_predecessor"), met, bad,
        name(held.where("status = 'withdrawn' and end is null"), "withdrawn_with_open_period"),
        name(held.where(F.col("status").isin(*UNAPPROVED) & _real()), "unapproved_with_real_period")
    ]
    scope = F.when(
        F.col("code").isin(*(c for c, s in RULES.items() if s == "document")), "document"
    ).otherwise("revision")
    return reduce(DataFrame.unionByName, parts).distinct().withColumn("scope", scope)


def authority_states(registry: DataFrame, periods: DataFrame, day: Column) -> DataFrame:
    """(doc, revision, status, state, error) of every registered revision on a day; the state is null where there is an error.

    Unapproved revisions keep their status, unless a period of at least a day makes them inconsistent. Others are
    effective while a period covers the day; a future period goes before one that has ended; a withdrawn revision is
    withdrawn and any other superseded when all its periods are over. Periods that overlap, or none at all, are errors.
    """
    day = day.cast("date")
    own = overlaps(periods).where("a = b").select(
        "doc", F.col("a").alias("revision")
    ).distinct().withColumn("own", F.lit(True))
    per = periods.groupBy("doc", "revision").agg(
        F.count("*").alias("n"), F.count_if(_real()).alias("real"),
        F.bool_or(temporal.covers(day, F.col("start"), F.col("end"))).alias("covered"),
        F.bool_or(day < F.col("start")).alias("future")
    )
    x = registry.join(per, ["doc", "revision"], "left").join(own, ["doc", "revision"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    draft = F.col("status").isin(*UNAPPROVED)
    error = (
        F.when(F.col("status").isNull(), "unknown_status")
        .when(draft & (F.coalesce("real", F.lit(0)) > 0), "unapproved_with_real_period")
        .when(~draft & yes("own"), "own_periods_overlap")
        .when(~draft & F.col("n").isNull(), "no_period_recorded")
    )
    state = F.when(draft, F.col("status")).when(yes("covered"), "effective").when(yes("future"), "approved_future").when(
        F.col("status") == "withdrawn", "withdrawn"
    ).otherwise("superseded")
    return x.withColumn("error", error).select(
        "doc", "revision", "status", F.when(F.col("error").isNull(), state).alias("state"), "error"
    )


def resolve(states: DataFrame, problems: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(doc, revision, code, effective, revisions): the one revision in force of each document, or null and why not.

    A document with any broken rule fails closed under its leading code: document-scoped rules first, then in the order
    of RULES. Else exactly one revision must be effective. documents(doc) adds documents that may have no revision.
    """
    order = F.create_map(
        *(F.lit(x) for i, (c, s) in enumerate(RULES.items()) for x in (c, i + (0 if s == "document" else len(RULES))))
    )
    lead = problems.groupBy("doc").agg(F.min_by("code", order[F.col("code")]).alias("lead"))
    per = states.groupBy("doc").agg(
        F.count("*").alias("revisions"), F.count_if(F.col("state") == "effective").alias("effective"),
        F.min(F.when(F.col("state") == "effective", F.col("revision"))).alias("only")
    )
    x = per if documents is None else documents.select("doc").distinct().join(per, "doc", "left").fillna(
        0, ["revisions", "effective"]
    )
    code = (
        F.when(F.col("revisions") == 0, "no_revisions_registered")
        .when(F.col("lead").isNotNull(), F.col("lead"))
        .when(F.col("effective") > 1, "overlapping_effective_revisions")
        .when(F.col("effective") == 0, "no_effective_revision")
        .otherwise("ok")
    )
    x = x.join(lead, "doc", "left").withColumn("code", code)
    return x.select(
        "doc", F.when(F.col("code") == "ok", F.col("only")).alias("revision"), "code", "effective", "revisions"
    )


def exclusions(states: DataFrame, resolved: DataFrame) -> DataFrame:
    """(doc, revision, reason, detail) of every revision that a document's resolution leaves out."""
    x = states.join(
        resolved.select("doc", F.col("revision").alias("chosen"), "code"), "doc"
    ).where(~F.col("revision").eqNullSafe(F.col("chosen")))
    reason = F.when(F.col("code") != "ok", F.col("code")).otherwise(
        F.concat(F.lit("not_effective_"), F.coalesce("state", F.lit("unresolved")))
    )
    return x.select(
        "doc", "revision", reason.alias("reason"),
        F.concat_ws(
            "; ", F.concat(F.lit("status="), F.col("status")), F.concat(F.lit("state="), F.col("state")),
            F.concat(F.lit("error="), F.col("error"))
        ).alias("detail")
    )


def periods_from_log(events: DataFrame) -> DataFrame:
    """(doc, revision, start, end, predecessor, reason, opened_by, closed_by): the periods that a log of decisions gives.

    events(event, kind, doc, revision, related, day, reason) with kind 'open' or 'close', unique by event, folded in the
    order of their number: an opening closes the open period of the revision it names as related, as superseded unless it
    gives a reason, and a closing that of its own revision. A closing without an open period before it changes nothing. An
    opening while a period is open starts a further one, closed by the next closing as well.
    """
    at = ["doc", "revision", "event", "day"]
    opens = events.where("kind = 'open'").select(
        *at, F.col("related").alias("predecessor"), F.lit(None).cast("string").alias("reason"),
        F.lit(True).alias("opens")
    )
    taken = events.where("kind = 'open' and related is not null").select(
        "doc", F.col("related").alias("revision"), "event", "day", F.lit(None).cast("string").alias("predecessor"),
        F.coalesce("reason", F.lit("superseded")).alias("reason"), F.lit(False).alias("opens")
    )
    closes = events.where("kind = 'close'").select(
        *at, F.lit(None).cast("string").alias("predecessor"), "reason", F.lit(False).alias("opens")
    )
    ahead = Window.partitionBy("doc", "revision").orderBy("event", "opens").rowsBetween(1, Window.unboundedFollowing)
    end = F.first(F.when(~F.col("opens"), F.struct("day", "event", "reason")), ignorenulls=True).over(ahead)
    return opens.unionByName(taken).unionByName(closes).withColumn("c", end).where("opens").select(
        "doc", "revision", F.col("day").alias("start"), F.col("c.day").alias("end"), "predecessor",
        F.col("c.reason").alias("reason"), F.col("event").alias("opened_by"), F.col("c.event").alias("closed_by")
    )


def resolve_explicit(
    requested: DataFrame, states: DataFrame, problems: DataFrame, allowed: tuple[str, ...]
) -> DataFrame:
    """(doc, revision, position, code): what became of revisions that were asked for by id, in the order of position.

    A problem of the whole document fails every request of it under its code. Else a request is a duplicate_request if the id
    came before, revision_not_found if the document has no such one, malformed_authority_record if it has no state or a
    problem of its own, not_eligible if its state is not allowed, and ok.
    """
    whole = problems.where("scope = 'document'").groupBy("doc").agg(
        F.min_by("code", F.array_position(F.array(*(F.lit(c) for c in RULES)), F.col("code"))).alias("lead")
    )
    own = problems.where("scope = 'revision'").select("doc", "revision", F.lit(True).alias("bad")).distinct()
    x = requested.withColumn(
        "again", F.row_number().over(Window.partitionBy("doc", "revision").orderBy("position")) > 1
    )
    x = x.join(whole, "doc", "left").join(own, ["doc", "revision"], "left").join(
        states.select("doc", "revision", "state", F.lit(True).alias("there")), ["doc", "revision"], "left"
    )
    code = (
        F.when(F.col("lead").isNotNull(), F.col("lead")).when(F.col("again"), "duplicate_request").when(F.col("there").isNull(), "revision_not_found")
        .when(F.col("state").isNull() | F.col("bad").isNotNull(), "malformed_authority_record").when(~F.col("state").isin(*allowed), "not_eligible").otherwise("ok")
    )
    return x.select("doc", "revision", "position", code.alias("code"))
