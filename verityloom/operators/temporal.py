"""Periods and points in time: as-of lookup, overlaps, chains and integrity checks as queries that should be empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def real(df: DataFrame, start: str, end: str) -> DataFrame:
    """Periods that cover at least a day; an end of null is open."""
    return df.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))


def covers(day: Column, start: Column, end: Column) -> Column:
    return (start <= day) & (end.isNull() | (day < end))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Half-open intervals with a null end as open share a moment; an empty interval inside another counts as sharing it."""
    return (a1.isNull() | (b0 < a1)) & (b1.isNull() | (a0 < b1))


#: Days lie on an axis of 2^22 days that begins before the first date; cells of level n are 8^n days wide, and there are LEVELS.
_ZERO, _END, LEVELS = 1 << 20, 1 << 22, 8


def _day(c: Column) -> Column:
    return F.unix_date(c.cast("date")) + _ZERO


def _cells_of(start: Column, end: Column) -> Column:
    """The fewest cells that together are the days start <= day < end, at most 14 of each level; a null end is open."""
    none = F.array().cast("array<int>")
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    number = lambda n: lambda c: c + n * _END
    s, e = _day(start), F.least(F.coalesce(_day(end), F.lit(_END)), F.lit(_END))
    lo = [F.shiftright(s + ((1 << 3 * n) - 1), 3 * n) for n in range(LEVELS)]
    hi = [F.shiftright(e, 3 * n) for n in range(LEVELS)]
    out = []
    for n in range(LEVELS):
        cells = span(lo[n], hi[n])
        if n + 1 < LEVELS:
            a, b = lo[n + 1] * 8, hi[n + 1] * 8
            cells = F.when(a < b, F.concat(span(lo[n], a), span(b, hi[n]))).otherwise(cells)
        out.append(F.transform(cells, number(n)))
    return F.flatten(F.array(*out))


def _cells_with(day: Column) -> Column:
    """The cells that a day lies in, one of each level: a period covers the day where just one of them is a cell of the period."""
    return F.array(*(F.shiftright(_day(day), 3 * n) + n * _END for n in range(LEVELS)))


def as_of(points: DataFrame, point_key: str, day: str, periods: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Each point with the period of its key that covers its day; of several the one that began last, then the one that ends last.

    Days are dates. Periods are cut into cells of the time axis and each cell keeps the best period that covers all of it,
    so a point looks up LEVELS cells by equality however many periods of a key overlap. Points without a period have nulls.
    Both joins are sort-merge joins at any size: the planner takes the cells for no larger than the periods, though a period has
    up to 14 of each level, and would broadcast them.
    The columns of periods, which must have an order, come back as they are.
    """
    real_ = real(periods, start, end)
    cols = [c for c in periods.columns if c != key]
    best = F.max(
        F.struct(
            F.col(start).alias("s"), F.col(end).isNull().alias("open"), F.col(end).alias("e"),
            F.struct(*cols).alias("q")
        )
    ).alias("_b")
    cells = real_.select(
        F.col(key).alias("_k"), F.explode(_cells_of(F.col(start), F.col(end))).alias("_c"), *cols
    ).groupBy("_k", "_c").agg(best)
    asked = points.select(
        F.col(point_key).alias("_k"), F.col(day).alias("_d")
    ).where("_k is not null and _d is not null").distinct()
    got = asked.withColumn(
        "_c", F.explode(_cells_with(F.col("_d")))
    ).join(cells.hint("merge"), ["_k", "_c"]).groupBy("_k", "_d").agg(F.max("_b").alias("_b"))
    left = points.select(F.struct(*points.columns).alias("_p"), F.col(point_key).alias("_k"), F.col(day).alias("_d"))
    return left.join(got.hint("merge"), ["_k", "_d"], "left").select(
        "_p.*", *(F.col(f"_b.q.{c}").alias(c if c not in points.columns else f"{c}_period") for c in cols)
    )


def overlapping_pairs(df: DataFrame, key: str, row_id: str, start: str, end: str) -> DataFrame:
    """(key, first_id, second_id): every two periods of a key that overlap, in the order of their start, end and id.

    Of two that overlap the first covers the day on which the second begins, so days meet periods in the one cell that they
    share: an equality join on key and cell, which also splits a key of many periods. Days are dates; a null start meets nothing.
    """
    at = lambda x: F.struct(F.col(f"{x}s"), F.col(f"{x}e").isNull(), F.col(f"{x}e"), F.col(f"{x}i"))
    side = lambda x, cells: df.select(
        F.col(key).alias("_k"), F.col(start).alias(f"{x}s"), F.col(end).alias(f"{x}e"), F.col(row_id).alias(f"{x}i"),
        F.explode(cells).alias("_c")
    ).where(F.col(f"{x}s").isNotNull())
    pairs = side("a", _cells_of(F.col(start), F.col(end))).join(side("b", _cells_with(F.col(start))), ["_k", "_c"])
    return pairs.where((at("a") < at("b")) & overlap(F.col("as"), F.col("ae"), F.col("bs"), F.col("be"))).select(
        F.col("_k").alias(key), F.col("ai").alias("first_id"), F.col("bi").alias("second_id")
    )


def chain_problems(
    periods: DataFrame, registry: DataFrame, doc: str, revision: str, start: str, end: str, predecessor: str,
    reason: str
) -> DataFrame:
    """(problem, doc, revision): violations of a chain of periods, each rule a query; an intact table gives no rows.

    orphaned_period: a revision that is not registered. period_document_mismatch: registered for another document.
    missing_predecessor: a predecessor that has no period in the document. missing_successor / ambiguous_successor: a
    period closed as superseded or by rollback to which no period, or more than one, is attached at its end.
    """
    p = periods.select(
        F.col(doc).alias("d"), F.col(revision).alias("r"), F.col(start).alias("s"), F.col(end).alias("e"),
        F.col(predecessor).alias("pre"), F.col(reason).alias("why")
    ).distinct()
    reg = registry.select(F.col(revision).alias("r"), F.col(doc).alias("rd")).distinct()
    orphan = p.join(reg, "r", "left_anti").select(F.lit("orphaned_period").alias("problem"), "d", "r")
    mismatch = p.join(reg, "r").where("d <> rd").select(F.lit("period_document_mismatch"), "d", "r")
    has = p.select("d", F.col("r").alias("pre")).distinct()
    missing = p.where("pre is not null").join(has, ["d", "pre"], "left_anti").select(
        F.lit("missing_predecessor"), "d", "r"
    )
    follow = p.where("pre is not null").groupBy(
        "d", F.col("pre").alias("r"), F.col("s").alias("e")
    ).agg(F.count_distinct("r").alias("n"))
    closed = p.where("e is not null and why in ('superseded', 'rollback')").join(follow, ["d", "r", "e"], "left")
    bad = closed.where("coalesce(n, 0) <> 1").select(
        F.when(F.coalesce("n", F.lit(0)) == 0, "missing_successor").otherwise("ambiguous_successor"), "d", "r"
    )
    return orphan.union(mismatch).union(missing).union(bad).select(
        "problem", F.col("d").alias(doc), F.col("r").alias(revision)
    ).distinct()
