"""Continuous periods and gaps per key, by a mergeable aggregate of sorted disjoint intervals.

The state of a key is a list of disjoint, non-touching half-open day spans in ascending order, each with a flag that says
whether two source rows share a day in it. Two states merge by one linear pass, and the result is the same in whatever
order they merge, so the aggregate is built per partition, combined in a reduction tree of bounded fan-in, and only then
emitted with its complement. A key that holds a third of all rows is thus spread over all partitions in the first step;
later steps see only its spans. As days are whole, one state never holds more spans than half the days between its
first and its last day, however many rows went in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"
_STATE = "k string, part int, froms array<int>, tos array<int>, shared array<boolean>"
_SPANS = "k string, span_kind string, d_from int, d_to int, shared boolean"
_WIDE = np.int64(1) << 33  # wider than any range of days, so that running maxima never pass from one key to the next


def linear_merge(key: np.ndarray, start: np.ndarray, end: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merge intervals into disjoint spans per integer key; returns key, start, end, shared, sorted by key and start.

    Intervals that overlap join and mark the span as shared; intervals that only touch join without marking it. The lists
    of merged states lie end to end, each in ascending order; the stable sort takes such runs as they are and merges them
    linearly. Only rows that are not yet in a state are really sorted.
    """
    if not len(key):
        return key, start, end, shared
    order = np.argsort(key * _WIDE + start, kind="stable")
    key, start, end, shared = key[order], start[order], end[order], shared[order]
    reach = np.maximum.accumulate(key * _WIDE + (end + _WIDE // 4))
    same = np.r_[False, key[1:] == key[:-1]]
    before = np.r_[np.int64(0), reach[:-1]]
    at = key * _WIDE + (start + _WIDE // 4)
    opens = np.flatnonzero(~same | (at > before))
    flag = np.logical_or.reduceat(shared | (same & (at < before)), opens)
    last = np.r_[opens[1:] - 1, len(key) - 1]
    return key[opens], start[opens], reach[last] - key[opens] * _WIDE - _WIDE // 4, flag


class _State:
    """The spans of all keys of one task, compacted whenever the unmerged part outgrows the merged part."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.pending, self.merged = 0, 0

    def add(self, keys: pa.Array, start: np.ndarray, end: np.ndarray, shared: np.ndarray) -> None:
        if not len(keys):
            return
        d = keys.dictionary_encode()
        code = np.array([self.codes.setdefault(x, len(self.codes)) for x in d.dictionary.to_pylist()], dtype=np.int64)
        self.parts.append(
            (code[d.indices.to_numpy(zero_copy_only=False)], start.astype(np.int64), end.astype(np.int64), shared)
        )
        self.pending += len(start)
        if self.pending > max(200_000, self.merged):
            self.compact()

    def compact(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            z = np.zeros(0, dtype=np.int64)
            return z, z, z, z.astype(bool)
        out = linear_merge(*(np.concatenate([p[i] for p in self.parts]) for i in range(4)))
        self.parts, self.pending, self.merged = [out], 0, len(out[0])
        return out

    def lists(self) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        key, start, end, shared = self.compact()
        names = list(self.codes)
        if len(key):
            cuts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield names[key[a]], start[a:b], end[a:b], shared[a:b]


def _emit(state: _State, part: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    width = 0

    def batch() -> pa.RecordBatch:
        off = pa.array(np.r_[0, np.cumsum([len(r[1]) for r in rows])].astype(np.int32))
        lists = [
            pa.ListArray.from_arrays(off, pa.array(np.concatenate([r[i] for r in rows]).astype(t))) for i,
            t in ((1, np.int32), (2, np.int32), (3, bool))
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array(np.full(len(rows), part, dtype=np.int32)), *lists],
            names=["k", "part", "froms", "tos", "shared"]
        )

    for row in state.lists():
        rows.append(row)
        width += len(row[1])
        if width > 100_000:
            yield batch()
            rows, width = [], 0
    if rows:
        yield batch()


def _first(fan: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _State()
        for b in batches:
            start, end = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            state.add(b.column(0), start, end, np.zeros(len(start), dtype=bool))
        yield from _emit(state, TaskContext.get().partitionId() // fan)

    return run


def _read_lists(state: _State, b: pa.RecordBatch) -> None:
    froms = b.column("froms")
    n = np.diff(froms.offsets.to_numpy())
    flat = [b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("froms", "tos", "shared")]
    state.add(b.column("k").take(pa.array(np.repeat(np.arange(len(n)), n))), *flat)


def _combine(fan: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, _State] = {}
        for b in batches:
            part = b.column("part").to_numpy(zero_copy_only=False)
            for p in np.unique(part):
                _read_lists(states.setdefault(int(p), _State()), b.filter(pa.array(part == p)))
        for p, state in states.items():
            yield from _emit(state, p // fan)

    return run


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = _State()
    for b in batches:
        _read_lists(state, b)
    key, start, end, shared = state.compact()
    if not len(key):
        return
    names = pa.array(list(state.codes), pa.string())
    for a in range(0, len(key), 100_000):
        b = min(a + 100_000, len(key))
        nxt = slice(a + 1, b + 1)
        gap = np.flatnonzero(key[a : min(b, len(key) - 1)] == key[nxt])
        k = np.r_[key[a:b], key[a:b][gap]]
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(k)), pa.array(["period"] * (b - a) + ["gap"] * len(gap), pa.string()), pa.array(np.r_[start[a:b], end[a:b][gap]].astype(np.int32)), pa.array(np.r_[end[a:b], start[nxt][gap]].astype(np.int32)), pa.array(np.r_[shared[a:b], np.zeros(len(gap), dtype=bool)])],
            names=["k", "span_kind", "d_from", "d_to", "shared"],
        )


def continuous_periods(
    df: DataFrame, key: str, row_id: str, start: str, end: str, open_end: str = OPEN_END, fan_in: int = 64
) -> DataFrame:
    """The continuous periods of every key and the gaps between them.

    Returns (key string, span_kind 'period' or 'gap', span_from date, span_to date, shared boolean). `shared` says that
    two source rows have a day of the period in common; it is false for gaps.

    Periods are half-open whole days. Rows with end <= start cover nothing; a null end counts as `open_end`. Rows with a
    null key or a null start are left out. A row repeated with the same key, id and period counts once, rows with a null
    id included; rows of one id with different periods count as different rows. An empty table gives no rows. Other
    columns of df are ignored whatever their names.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    rows = (
        df.select(F.col(key).cast("string").alias("k"), day(start).alias("d_from"), F.coalesce(day(end), F.unix_date(F.lit(open_end).cast("date"))).alias("d_to"), F.col(row_id).alias("id"))
        .where(F.col("k").isNotNull() & (F.col("d_to") > F.col("d_from")))
        .dropDuplicates(["k", "id", "d_from", "d_to"])
        .select("k", "d_from", "d_to")
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = rows.mapInArrow(_first(fan_in), _STATE)
    parts = -(-parts // fan_in)
    while parts > 1:
        state = state.repartition("k", "part").mapInArrow(_combine(fan_in), _STATE)
        parts = -(-parts // fan_in)
    spans = state.repartition("k").mapInArrow(_last, _SPANS)
    return spans.select(
        F.col("k").alias(key), "span_kind", F.date_from_unix_date("d_from").alias("span_from"),
        F.date_from_unix_date("d_to").alias("span_to"), "shared"
    )
