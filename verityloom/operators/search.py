"""Exact similarity search of a stated query set: eligibility first, then ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verityloom.operators.keyed import first_per_key

BLOCK = 32_768  # queries that are broadcast at a time, 16 MB at 64 numbers
STEP = 1_024  # queries that are multiplied at a time


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    off = column.offsets.to_numpy()
    at = np.flatnonzero(np.asarray(column.is_valid()) & (np.diff(off) == dim))
    if not len(at):
        return at, np.zeros((0, dim))
    x = column.values.to_numpy(zero_copy_only=False).astype(np.float64)[
        off[at].astype(np.int64)[:, None] + np.arange(dim)
    ]
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return at, np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _first_best(s: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the `keep` greatest values of each row, of equal ones the first."""
    edge = np.partition(s, -keep, axis=1)[:, -keep][:, None]
    order = np.where(s > edge, 0, np.where(s == edge, 1, 2)).astype(np.int8)
    return np.argsort(order, axis=1, kind="stable")[:, :keep]


def exact_search(
    queries: DataFrame, query_id: str, index: DataFrame, row_id: str, vector: str, k: int, dim: int = 64,
    skip_self: bool = True
) -> DataFrame:
    """(query, row, rank, similarity): the k rows of greatest cosine of every query, ties by row id.

    The index is scanned once per block of BLOCK queries, which is broadcast; every task keeps its own k best per query,
    of ties those of least id, and only those are shuffled. Zero vectors have similarity 0; null vectors and those of
    another length take no part. Similarities are compared when rounded to nine places.
    """
    kind = index.schema[row_id].dataType.simpleString()
    q = queries.select(
        F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v")
    ).where(F.size("v") == dim).orderBy("q")
    out, block = None, []

    def scan(rows: list) -> DataFrame:
        names = [r[0] for r in rows]
        m = np.array([r[1] for r in rows])
        n = np.linalg.norm(m, axis=1, keepdims=True)
        shared = index.sparkSession.sparkContext.broadcast((names, np.divide(m, n, out=np.zeros_like(m), where=n > 0)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, m = shared.value
            keep = k + skip_self
            held_s, held_i = np.full((len(names), keep), -9.0), np.full((len(names), keep), None, dtype=object)
            for b in batches:
                at, x = _vectors(b.column(1), dim)
                if not len(at):
                    continue
                ids = np.array(b.column(0).take(pa.array(at)).to_pylist(), dtype=object)
                order = np.argsort(ids, kind="stable")  # so that of equal similarities the least id comes first
                ids, x = ids[order], x[order]
                for a in range(0, len(m), STEP):
                    for c in range(0, len(ids), 4096):
                        s = np.round(m[a : a + STEP] @ x[c : c + 4096].T, 9)
                        better = np.flatnonzero((s >= held_s[a : a + STEP, -1:]).any(axis=1))  # only these queries change
                        if not len(better):
                            continue
                        rows, s = a + better, s[better]
                        top = np.argsort(
                            -s, axis=1, kind="stable"
                        )[:, :keep] if s.shape[1] <= 4 * keep else _first_best(s, keep)
                        all_s, all_i = np.hstack(
                            [held_s[rows], np.take_along_axis(s, top, 1)]
                        ), np.hstack([held_i[rows], ids[c : c + 4096][top]])
                        for r, (score, name) in enumerate(zip(all_s, all_i)):
                            best = sorted(((-v, n) for v, n in zip(score.tolist(), name) if n is not None))[:keep]
                            held_s[rows[r], : len(best)] = [-v for v, _ in best]
                            held_i[rows[r], : len(best)] = [n for _, n in best]
            full = held_s > -9
            if full.any():
                qs = np.repeat(np.array(names, dtype=object), full.sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qs.tolist()), pa.array(held_i[full].tolist()), pa.array(held_s[full])],
                    names=["query", "row", "similarity"]
                )

        return index.select(F.col(row_id), F.col(vector)).mapInArrow(
            run, f"query {kind}, row {kind}, similarity double"
        )

    for r in q.toLocalIterator():
        block.append((r["q"], r["v"]))
        if len(block) == BLOCK:
            out, block = (scan(block) if out is None else out.unionByName(scan(block))), []
    if block or out is None:
        got = scan(block) if block else index.select(
            F.col(row_id).alias("query"), F.col(row_id).alias("row"), F.lit(0.0).alias("similarity")
        ).limit(0)
        out = got if out is None else out.unionByName(got)
    out = out.where("query <> row") if skip_self else out
    out = out.withColumn("similarity", F.round("similarity", 9))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "row"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "row", "rank", "similarity")


def eligible_search(
    queries: DataFrame, query_id: str, index: DataFrame, row_id: str, vector: str, eligible: DataFrame,
    on: str | list[str], k: int, **kw
) -> DataFrame:
    """As exact_search over the rows whose `on`, a column or several, is eligible, decided before anything is ranked: no eligible rows, no hits."""
    on = [on] if isinstance(on, str) else on
    return exact_search(
        queries, query_id, index.join(eligible.select(*on).distinct(), on, "left_semi"), row_id, vector, k, **kw
    )


def reciprocal_rank_fusion(
    rankings: list[DataFrame], group: str, item: str, rank: str, k: int, constant: int = 60
) -> DataFrame:
    """(group, item, score, rank, sources): the sum of 1 / (constant + rank) over the rankings, ties by item.

    sources holds the positions of the rankings that have the item, from 0. An item is counted at its best rank in each.
    """
    rows = None
    for i, r in enumerate(rankings):
        x = r.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(rank).alias("r"), F.lit(i).alias("s"))
        rows = x if rows is None else rows.unionByName(x)
    per = rows.groupBy("g", "i", "s").agg(F.min("r").alias("r"))
    fused = per.groupBy("g", "i").agg(
        F.sum(1 / (F.lit(constant) + F.col("r"))).alias("score"), F.array_sort(F.collect_set("s")).alias("sources")
    )
    fused = fused.withColumn("score", F.round("score", 12))
    pos = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "i"))
    return fused.withColumn("rank", pos).where(F.col("rank") <= k).select(
        F.col("g").alias(group), F.col("i").alias(item), "score", "rank", "sources"
    )


def best_evidence(df: DataFrame, group: str, item: str, hop: str, similarity: str, k: int) -> DataFrame:
    """Items of each group by (hop, greatest similarity, id), each at its first occurrence."""
    once = first_per_key(df, [group, item], F.asc(hop), F.desc(similarity))
    pos = F.row_number().over(Window.partitionBy(group).orderBy(F.asc(hop), F.desc(similarity), F.asc(item)))
    return once.withColumn("rank", pos).where(F.col("rank") <= k)
