import random
from datetime import date, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from verityloom.operators.intervals import _State, continuous_periods, linear_merge

D0 = date(2020, 1, 1)
SCHEMA = "k string, id long, f date, t date, span_kind string, shared string"


def brute(rows):
    """Spans of one key from whole days: [(from, to, shared)]."""
    count = {}
    for _, f, t in set(rows):
        for x in range(f, t):
            count[x] = count.get(x, 0) + 1
    out = []
    for x in sorted(count):
        if out and out[-1][1] == x:
            out[-1] = (out[-1][0], x + 1, out[-1][2] or count[x] > 1)
        else:
            out.append((x, x + 1, count[x] > 1))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 8)), max_size=25), st.integers(1, 5))
def test_state_merges_alike_in_any_order(rows, parts):
    rows = [(i, f, f + n) for i, (f, n) in enumerate(rows)]
    states = []
    for p in range(parts):
        mine = rows[p::parts]
        states.append(
            linear_merge(
                np.zeros(len(mine), dtype=np.int64), *(np.array([r[k] for r in mine], dtype=np.int64) for k in (1, 2)),
                np.zeros(len(mine), dtype=bool)
            )
        )
    random.Random(len(rows)).shuffle(states)
    while len(states) > 1:
        a, b = states.pop(), states.pop()
        states.insert(0, linear_merge(*(np.concatenate(x) for x in zip(a, b))))
    got = list(zip(*(x.tolist() for x in states[0][1:])))
    assert got == brute(rows)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(k, i, f, t, "x", "y") for k, i, f, t in rows], SCHEMA)
    return {tuple(r) for r in continuous_periods(df, "k", "id", "f", "t", **kw).collect()}


def day(n):
    return D0 + timedelta(days=n)


def test_touching_nesting_gaps_nulls_and_repeats(spark):
    rows = [("a", 1, day(0), day(5)), ("a", 2, day(5), day(7)), ("a", 1, day(0), day(5)), ("a", 3, day(10), day(20)), ("a", 4, day(12), day(13)), ("a", 5, day(30), day(30)), ("a", 6, day(9), day(8)),
            ("b", 7, day(0), None), ("b", 8, day(3), date(9999, 12, 31)), (None, 9, day(0), day(1)), ("c", None, day(0), day(2)), ("c", None, day(0), day(2)), ("d", 10, None, day(3))]
    assert run(spark, rows) == {
        ("a", "period", day(0), day(7), False), ("a", "gap", day(7), day(10), False), ("a", "period", day(10), day(20), True),
        ("b", "period", day(0), date(9999, 12, 31), True), ("c", "period", day(0), day(2), False),
    }


def test_empty_table(spark):
    assert run(spark, []) == set()


def test_hot_key_over_a_deep_reduction_tree(spark):
    r = random.Random(3)
    rows = [("hot", i, day(f), day(f + r.randint(1, 4))) for i, f in enumerate(r.randint(0, 3000) for _ in range(900))]
    want = brute([(i, (f - D0).days, (t - D0).days) for _, i, f, t in rows])
    got = {x for x in run(spark, rows, fan_in=2) if x[1] == "period"}
    assert got == {("hot", "period", day(a), day(b), s) for a, b, s in want}


def test_state_compacts_while_it_grows():
    import pyarrow as pa

    s = _State()
    for i in range(5):
        n = 100_000
        s.add(pa.array(["k"] * n), np.arange(n) % 50, np.arange(n) % 50 + 1, np.zeros(n, dtype=bool))
    assert sum(len(p[0]) for p in s.parts) <= 250_000
    assert [len(x[1]) for x in s.lists()] == [1]
