"""Periods that overlap more than their neighbours, against plain loops."""

import datetime as dt
import random

from pyspark.sql import functions as F

from verityloom.operators import temporal


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def some_periods():
    r = random.Random(5)
    out = [
        ("a", 0, day(0), None), ("a", 1, day(1), day(900)), ("a", 2, day(2), day(3)), ("a", 3, day(2), day(3)),
        ("b", 4, day(-9000), day(9000))
    ]
    return out + [
        (r.choice("abc"), i, day(f), r.choice([None, *[day(f + n) for n in (1, 7, 8, 64, 700)]])) for i,
        f in enumerate((r.randint(-50, 1500) for _ in range(120)), 5)
    ]


def test_all_overlapping_pairs(spark):
    rows = some_periods()
    far = lambda t: t or dt.date.max
    at = lambda x: (x[2], far(x[3]), x[1])
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and at(a) < at(b) and b[2] < far(a[3]))
    got = temporal.overlapping_pairs(
        spark.createDataFrame(rows, "k string, id int, f date, t date"), "k", "id", "f", "t"
    )
    assert sorted(map(tuple, got.collect())) == want


def test_rollback_needs_a_successor(spark):
    p = spark.createDataFrame(
        [("d", "r1", day(1), day(5), None, "rollback"), ("d", "r2", day(1), day(5), None, "withdrawn")],
        "doc string, rev string, f date, t date, pre string, why string"
    )
    reg = spark.createDataFrame([("r1", "d"), ("r2", "d")], "rev string, doc string")
    got = {(r.problem, r.rev) for r in temporal.chain_problems(p, reg, "doc", "rev", "f", "t", "pre", "why").collect()}
    assert got == {("missing_successor", "r1")}


def test_as_of_takes_an_earlier_period_that_still_covers_the_day(spark):
    rows = some_periods()
    far = lambda t: t or dt.date.max
    points = [(i, k, day(n)) for i, (k, n) in enumerate((k, n) for k in "abcd" for n in range(-60, 1700, 3))]
    want = {}
    for i, k, d in points:
        best = max(((f, far(t)) for p, _, f, t in rows if p == k and f <= d < far(t)), default=None)
        want[i] = best and best[0], best and (None if best[1] == dt.date.max else best[1])
    x = spark.createDataFrame(points, "n int, k string, d date")
    got = temporal.as_of(
        x, "k", "d", spark.createDataFrame(rows, "k string, id int, f date, t date").drop("id"), "k", "f", "t"
    )
    assert {r.n: (r.f, r.t) for r in got.collect()} == want


def test_as_of_never_broadcasts_the_cells_of_periods(spark, tmp_path):
    rows = [(k, day(k), day(k + 701)) for k in range(2000)]
    points = [(k, day(k + n)) for k in range(2000) for n in (-1, 0, 700, 701)]
    spark.createDataFrame(rows, "k int, f date, t date").write.parquet(f"{tmp_path}/periods")
    spark.createDataFrame(points, "k int, d date").write.parquet(f"{tmp_path}/points")
    got = temporal.as_of(
        spark.read.parquet(f"{tmp_path}/points"), "k", "d", spark.read.parquet(f"{tmp_path}/periods"), "k", "f", "t"
    )
    want = {(k, d): (day(k), day(k + 701)) if day(k) <= d < day(k + 701) else (None, None) for k, d in points}
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    plan = lambda: got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan()
    assert {(r.k, r.d): (r.f, r.t) for r in got.collect()} == want
    assert "Broadcast" not in plan()


def test_resolution_fails_closed_and_states_follow_their_order(spark):
    from verityloom.operators import authority

    day = lambda n: dt.date(2020, 1, n)
    reg = spark.createDataFrame(
        [
            ("a", "r1", "approved"), ("a", "r2", "withdrawn"), ("b", "r3", "draft"), ("c", "r4", "approved"),
            ("c", "r5", "approved"), ("d", "r6", None)
        ],
        "doc string, revision string, status string"
    )
    per = spark.createDataFrame(
        [
            ("a", "r1", 1, day(1), day(5), None, "superseded"), ("a", "r2", 2, day(5), day(9), "r1", "withdrawn"),
            ("c", "r4", 3, day(1), None, None, None), ("c", "r5", 4, day(3), None, None, None),
            ("b", "rx", 5, day(1), day(2), None, None), ("a", "r1", 6, day(20), None, None, None)
        ],
        "doc string, revision string, period int, start date, end date, predecessor string, reason string"
    )
    problems = {(r.doc, r.revision, r.code) for r in authority.integrity_problems(reg, per).collect()}
    assert problems == {("b", "rx", "orphaned_period"), ("c", "r4", "cross_revision_period_overlap")}
    states = authority.authority_states(reg, per, F.lit("2020-01-10"))
    assert {r.revision: (r.state, r.error) for r in states.collect()} == {
        "r1": ("approved_future", None), "r2": ("withdrawn", None), "r3": ("draft", None), "r4": ("effective", None),
        "r5": ("effective", None), "r6": (None, "unknown_status")
    }
    docs = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "doc string")
    got = authority.resolve(states, authority.integrity_problems(reg, per), docs)
    assert {r.doc: (r.code, r.revision) for r in got.collect()} == {
        "a": ("no_effective_revision", None), "b": ("orphaned_period", None),
        "c": ("cross_revision_period_overlap", None), "z": ("no_revisions_registered", None)
    }
    early = authority.resolve(
        authority.authority_states(reg, per, F.lit("2020-01-06")), authority.integrity_problems(reg, per),
        docs.where("doc = 'a'")
    )
    assert [(r.code, r.revision) for r in early.collect()] == [("ok", "r2")]
    none = authority.resolve(states.limit(0), authority.integrity_problems(reg.limit(0), per.limit(0)), docs.limit(0))
    assert none.collect() == []


def test_log_folds_into_periods(spark):
    from verityloom.operators import authority

    day = lambda n: dt.date(2020, 1, n)
    log = spark.createDataFrame(
        [
            (1, "open", "d", "r1", None, day(1), None), (2, "open", "d", "r2", "r1", day(5), None),
            (3, "close", "d", "r2", None, day(9), "withdrawn"), (4, "close", "d", "r2", None, day(10), "withdrawn"),
            (5, "open", "d", "r1", "r2", day(12), "rollback")
        ],
        "event int, kind string, doc string, revision string, related string, day date, reason string"
    )
    got = sorted(
        tuple(r) for r in authority.periods_from_log(log).select("revision", "start", "end", "reason").collect()
    )
    assert got[0][:3] == ("r1", day(1), day(5)) and got[1] == ("r1", day(12), None, None) and got[2] == (
        "r2", day(5), day(9), "withdrawn"
    )
