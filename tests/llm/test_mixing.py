import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from verityloom.llm import mixing

DOCS = "doc long, source string, tokens long"
TARGETS = "source string, target_weight double, max_repeats int"


def tables(spark):
    docs = [(i, "big", 10) for i in range(600)] + [
        (1000 + i, "small", 7) for i in range(20)
    ] + [(2000 + i, "mid", 5) for i in range(100)] + [
        (3000, "unlisted", 50), (3001, None, 50), (3002, "mid", 0)
    ]
    targets = [
        ("big", 0.5, 1), ("small", 0.3, 2), ("mid", 0.15, 4), ("absent", 0.05, 3), ("zero", 0.0, 3), (None, 0.1, 1)
    ]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)


def reached(spark, counts, targets):
    demand = mixing.demands(counts, targets)
    return {r.source: r for r in mixing.shares(mixing.curriculum(counts, targets), demand).collect()}


def test_shares(spark):
    got = reached(spark, *tables(spark))
    assert set(got) == {"big", "small", "mid", "absent", "zero"}
    assert {r.budget for r in got.values()} == {6640}
    assert {s for s, r in got.items() if r.falls_short} == {"small", "absent"}
    assert got["small"].used == 280 and got["small"].repeats == 2 and got["zero"].used == 0 and got["absent"].actual_share == 0
    assert sum(r.actual_share for r in got.values()) == pytest.approx(1)


def test_shares_are_those_of_the_drawn_documents(spark):
    counts = spark.createDataFrame([(1, "a", 10_000)] + [(i, "b", 10) for i in range(2, 1002)], DOCS)
    targets = spark.createDataFrame([("a", 0.05, 1), ("b", 0.95, 3)], TARGETS)
    got = reached(spark, counts, targets)
    assert got["a"].used == 10_000 and got["b"].used == 19_000  # the one document of a is drawn whole
    assert got["a"].actual_share == pytest.approx(10 / 29) and not got["a"].falls_short


def test_curriculum_draws_what_is_due(spark):
    counts, targets = tables(spark)
    due = {r.source: r for r in mixing.demands(counts, targets).collect()}
    plan = mixing.curriculum(counts, targets).collect()
    assert [
        r.position for r in plan
    ] == sorted(r.position for r in plan) and 0 <= plan[0].position and plan[-1].position < 1
    for s in ("big", "small", "mid"):
        mine = [r for r in plan if r.source == s]
        most = max(r.tokens for r in mine)
        assert due[s].due <= sum(r.tokens for r in mine) < due[s].due + most
        assert len({(r.doc, r.copy) for r in mine}) == len(mine) and max(r.copy for r in mine) < due[s].max_repeats
    assert {r.source for r in plan} == {"big", "small", "mid"} and 3002 not in {r.doc for r in plan}


def test_curriculum_against_brute_force(spark):
    """Every copy and position by walking the documents one by one and integrating the ramp in small steps."""
    counts, targets = tables(spark)
    order = {r.doc: r.h for r in counts.select("doc", F.xxhash64("doc").alias("h")).collect()}
    listed = sorted((w, s, m) for s, w, m in [tuple(r) for r in targets.collect()] if s)
    budget = sum(r.tokens for r in counts.collect() if r.source in {s for _, s, _ in listed})
    want = {}
    for place, (weight, source, repeats) in enumerate(listed):
        lean = (2 * place / (len(listed) - 1) - 1) * 0.5
        docs = sorted(
            (
                order[r.doc] % 1024, order[r.doc], r.doc, r.tokens
            ) for r in counts.collect() if r.source == source and r.tokens
        )
        due = min(weight * budget, repeats * sum(n for *_, n in docs))
        area = np.cumsum(np.full(200_000, 1 / 200_000) * (1 + lean - 2 * lean * (np.arange(200_000) + 0.5) / 200_000))
        at = 0
        for copy in range(repeats):
            for *_, doc, n in docs:
                if at < due:
                    want[doc, copy] = np.searchsorted(area, at / due * area[-1]) / 200_000
                at += n
    got = {(r.doc, r.copy): r.position for r in mixing.curriculum(counts, targets).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-4


def test_positions_follow_the_integral_of_the_schedule(spark):
    counts = spark.createDataFrame([(i, "a", 1) for i in range(4000)], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    schedule = spark.createDataFrame(
        [("a", 0.0, 2.0), ("a", 0.5, 1.0), ("a", 1.0, 0.0)], "source string, time double, factor double"
    )
    at = sorted(r.position for r in mixing.curriculum(counts, targets, schedule).collect())
    for t in (0.1, 0.25, 0.5, 0.8):
        demand = 2 * t - t * t  # the integral of 2 - 2t
        assert sum(x < t for x in at) / 4000 == pytest.approx(demand, abs=0.002)


def test_tokens_and_empty_tables(spark):
    df = spark.createDataFrame(
        [(1, "a", "hello world", 5), (2, "a", None, 5), (3, None, "", 5), (4, "b", "x " * 50_000, 5)],
        "doc_id long, source string, text string, tokens int"
    )
    got = {r.doc: r.tokens for r in mixing.token_counts(df, "doc_id", "source", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 40_000
    none = mixing.token_counts(df.limit(0), "doc_id", "source", "text")
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mixing.curriculum(none, targets).collect() == []
    assert [r.falls_short for r in reached(spark, none, targets).values()] == [False]
    assert reached(spark, none, targets.limit(0)) == {}


def test_the_vocabulary_is_a_parameter_of_bounded_size(spark, tmp_path, monkeypatch):
    (tmp_path / "v").write_bytes(b"\n".join(base64.b64encode(bytes([i])) + f" {i}".encode() for i in range(256)))
    df = spark.createDataFrame([(1, "a", "hello")], "doc_id long, source string, text string")
    assert mixing.token_counts(df, "doc_id", "source", "text", str(tmp_path / "v")).first().tokens == 5
    monkeypatch.setattr(mixing, "RANK_BYTES", 100)
    with pytest.raises(ValueError, match="more than 100 bytes"):
        mixing.token_counts(df, "doc_id", "source", "text", str(tmp_path / "v"))
