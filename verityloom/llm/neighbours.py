"""The most similar vectors of every vector, by balanced posting lists.

Centroids are fitted on a bounded sample with a price on crowded lists, which the assignment pays too. Every vector is
entered in its nearest list and, if it lies near a boundary, in further ones, as far as their distances stay within a ratio
of the nearest. The lists of a vector are found by a best-first walk on a graph of the centroids that is held in memory. A vector meets all
that share one of its lists in blocks of matrix products; the best of each list are merged.

Equal vectors are one entry, so copies neither fill a list nor square it; their ids come back when the result is written.
Lists that outgrow a block are compared block against block in separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verityloom.llm.tokens import mix
from verityloom.session import cut_lineage

SAMPLE = 262_144  # about as many vectors, drawn by hash, are what the centroids are fitted on: 33 MB on the driver
MAX_LISTS = 65_536  # bounds what is broadcast: centroids with their price and the graph, 30 MB
BLOCK = 8_192
NEAR, BACK = 24, 24  # links of a centroid in the graph: its own, and those of others to it
POOL, FAR = 96, 64  # candidates for its own links: the nearest, and others drawn at random
ENTRIES = 64  # centroids that every walk is begun from, drawn at random


def _unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors): without null, wrong length, null or non-finite numbers, and all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = column.offsets.to_numpy().astype(np.int64)
    ok = np.asarray(column.is_valid()) & (np.diff(off) == dim)
    at = np.flatnonzero(ok)
    if not len(at):
        return at, np.zeros((0, dim), dtype=np.float32)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = values[off[at][:, None] + np.arange(dim)]
    scale = np.abs(x).max(axis=1)
    fine = np.isfinite(scale) & (scale > 0)
    at, x = at[fine], x[fine] / scale[fine, None]
    return at, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _entries(df: DataFrame, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _unit_rows(b.column(1), dim)
            h = x.view(np.uint32).astype(np.uint64)
            vid = mix(
                (h * mix(np.arange(1, dim + 1, dtype=np.uint64))).sum(axis=1)
            ) if len(at) else np.zeros(0, dtype=np.uint64)
            v = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(dim * 2), len(at), [None, pa.py_buffer(x.astype(np.float16).tobytes())]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(vid.astype(np.int64)), v], names=["id", "vid", "v"]
            )

    return df.mapInArrow(run, "id string, vid long, v binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float16).reshape(-1, dim).astype(np.float32)


def _priced_means(x: np.ndarray, lists: int, seed: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, the one that each row falls to): spherical k-means with a price on crowded lists."""
    lists = max(1, min(lists, len(x)))
    c = x[np.argsort(mix(np.arange(len(x), dtype=np.uint64) + np.uint64(77 + seed)))[:lists]].copy()
    price = np.zeros(lists, dtype=np.float32)
    for left in range(rounds, -1, -1):
        near = np.concatenate([(x[i : i + 4096] @ c.T - price).argmax(1) for i in range(0, len(x), 4096)])
        if not left:
            return c, near
        n = np.bincount(near, minlength=lists)
        price = _dearer(price, n)
        order = np.argsort(near, kind="stable")
        first = np.searchsorted(near[order], np.arange(lists))
        total = np.add.reduceat(x[order], np.minimum(first, len(x) - 1), axis=0)
        norm = np.linalg.norm(total, axis=1)
        use = (n > 0) & (norm > 0)
        c[use] = total[use] / norm[use, None]


def _dearer(price: np.ndarray, n: np.ndarray) -> np.ndarray:
    return 0.5 * price + np.float32(0.02) * np.log((n + 1) * len(n) / max(1, n.sum())).clip(-2, 3).astype(np.float32)


def link(c: np.ndarray, seed: int = 1) -> np.ndarray:
    """The graph of the centroids: per row the ids it may go on to.

    Of the nearest and of some drawn at random a centroid links to those that are nearer to it than to any it has chosen
    before, so that links lead in all directions and clusters stay reachable; others' links to it are followed back.
    """
    n, degree = len(c), min(NEAR, len(c) - 1)
    if not degree:
        return np.zeros((n, 1), dtype=np.int32)
    random, own = np.random.default_rng(seed), np.empty((n, degree), dtype=np.int64)
    for a in range(0, n, 1024):
        s = c[a : a + 1024] @ c.T
        rows = np.arange(len(s))
        s[rows, a + rows] = -9
        cand = np.argpartition(-s, min(POOL, n - 1) - 1, axis=1)[:, : min(POOL, n - 1)]
        cand = np.concatenate([cand, random.integers(0, n, (len(s), FAR))], axis=1)
        sims = np.take_along_axis(s, cand, 1)
        order = np.argsort(-sims, axis=1)
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        chosen, vectors, count = cand[:, :degree].copy(), np.zeros(
            (len(s), degree, c.shape[1]), dtype=np.float32
        ), np.zeros(len(s), dtype=np.int64)
        for j in range(cand.shape[1]):
            v = c[cand[:, j]]
            nearer = np.einsum("ijk,ik->ij", vectors, v) > sims[:, j][:, None]
            here = np.arange(degree) < count[:, None]
            use = np.flatnonzero(~(nearer & here).any(1) & (sims[:, j] > -2) & (count < degree))
            chosen[use, count[use]], vectors[use, count[use]] = cand[use, j], v[use]
            count[use] += 1
        own[a : a + 1024] = chosen
    # back links: of those that chose a centroid the nearest
    src, dst = np.repeat(np.arange(n), degree), own.ravel()
    near = np.concatenate(
        [np.einsum("ij,ij->i", c[src[i : i + 65536]], c[dst[i : i + 65536]]) for i in range(0, len(src), 65536)]
    )
    order = np.lexsort((-near, dst))
    src, dst = src[order], dst[order]
    place = np.arange(len(dst)) - np.searchsorted(dst, dst)
    back = np.broadcast_to(np.arange(n)[:, None], (n, BACK)).copy()
    back[dst[place < BACK], place[place < BACK]] = src[place < BACK]
    return np.concatenate([own, back], axis=1).astype(np.int32)


def fit_lists(x: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroids, each with its price as a last number that is taken off a product; their graph; entry points).

    Balanced k-means in two levels: about the root of the number of lists first, then each part by itself into its share
    of them. Prices, which go with the assignment, are fitted on the whole sample by walks of the graph.
    """
    top, near = _priced_means(x, round(max(1, lists) ** 0.5), 0)
    n = np.bincount(near, minlength=len(top))
    c = np.concatenate(
        [_priced_means(x[near == g], max(1, round(n[g] * lists / len(x))), g + 1)[0] for g in np.flatnonzero(n)]
    )
    graph = link(c)
    entries = np.argsort(mix(np.arange(len(c), dtype=np.uint64) + np.uint64(5)))[:ENTRIES].astype(np.int32)
    price = np.zeros(len(c), dtype=np.float32)
    for _ in range(4):
        priced, first = np.concatenate([c, -price[:, None]], axis=1), []
        for a in range(0, len(x), 2048):
            first.append(walk(x[a : a + 2048], priced, graph, entries, 1)[0][:, 0])
        price = _dearer(price, np.bincount(np.concatenate(first), minlength=len(c)))
    return np.concatenate([c, -price[:, None]], axis=1), graph, entries


def walk(
    q: np.ndarray, c: np.ndarray, graph: np.ndarray, entries: np.ndarray, want: int, beam: int = 32, expand: int = 4,
    hops: int = 24
) -> tuple[np.ndarray, np.ndarray]:
    """(list ids, priced cosines) of about the best `want` centroids of each query, best first; -1 where there are fewer.

    A best-first walk: from the entry points on, the best of the beam that were not yet left are left for all their
    neighbours, until every one in the beam has been left.
    """
    beam, m = max(beam, want), len(q)
    q = np.concatenate([q, np.ones((m, 1), dtype=np.float32)], axis=1) if q.shape[1] < c.shape[1] else q
    if m * len(c) > 1 << 26 and m > 1:  # what has been seen is a bit for every query and centroid
        halves = [walk(h, c, graph, entries, want, beam, expand, hops) for h in (q[: m // 2], q[m // 2 :])]
        return np.concatenate([h[0] for h in halves]), np.concatenate([h[1] for h in halves])
    s = q @ c[entries].T
    b = min(beam, len(entries))
    top = np.argpartition(-s, b - 1, axis=1)[:, :b]
    ids, sims = np.full((m, beam), -1, dtype=np.int32), np.full((m, beam), -9, dtype=np.float32)
    ids[:, :b], sims[:, :b] = entries[top], np.take_along_axis(s, top, 1)
    new = ids >= 0
    seen = np.zeros((m, len(c)), dtype=bool)
    seen[:, entries] = True
    for _ in range(hops):
        going = np.flatnonzero(new.any(1))
        if not len(going):
            break
        best = np.argpartition(np.where(new[going], -sims[going], 9), expand - 1, axis=1)[:, :expand]
        query = np.broadcast_to(going[:, None], best.shape)
        use = new[query, best]
        query, best = query[use], best[use]
        new[query, best] = False
        links = graph[ids[query, best]]
        query, found = np.repeat(query, links.shape[1]), links.ravel()
        fresh = ~seen[query, found]
        pair = np.unique(query[fresh].astype(np.int64) * len(c) + found[fresh])
        query, found = pair // len(c), pair % len(c)
        seen[query, found] = True
        got = np.einsum("ij,ij->i", q[query], c[found])
        better = got > sims.min(1)[query]
        query, found, got = query[better], found[better], got[better]
        n = np.bincount(query, minlength=m)
        rows, width = np.flatnonzero(n), int(n.max()) if m else 0
        if not width:
            continue
        place = np.arange(len(query)) - (np.cumsum(n) - n)[query]
        more_ids, more_sims = np.full((m, width), -1, dtype=np.int32), np.full((m, width), -9, dtype=np.float32)
        more_ids[query, place], more_sims[query, place] = found, got
        all_ids, all_sims = np.concatenate([ids[rows], more_ids[rows]], axis=1), np.concatenate(
            [sims[rows], more_sims[rows]], axis=1
        )
        all_new = np.concatenate([new[rows], more_ids[rows] >= 0], axis=1)
        keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[rows], sims[rows], new[rows] = (np.take_along_axis(z, keep, 1) for z in (all_ids, all_sims, all_new))
    order = np.argsort(-sims, axis=1, kind="stable")[:, :want]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _assign(entries: DataFrame, model: tuple, dim: int, replicas: int, ratio: float) -> DataFrame:
    shared = entries.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, graph, start = shared.value
        for b in batches:
            x = _matrix(b.column(1), dim)
            for a in range(0, len(x), 2048):
                ids, sims = walk(x[a : a + 2048], c, graph, start, replicas)
                far = np.sqrt(np.maximum(0, 2 - 2 * sims))
                use = (ids >= 0) & (far <= far[:, :1] * ratio + 1e-6)
                off = pa.array(np.r_[0, np.cumsum(use.sum(1))].astype(np.int32))
                part = b.slice(a, 2048)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1),
                        pa.ListArray.from_arrays(off, pa.array(ids[use].astype(np.int32)))
                    ],
                    names=["id", "v", "lists"]
                )

    return entries.mapInArrow(run, "id string, v binary, lists array<int>")


def best_rows(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exactly the k best products of each row of q with the rows of x: first the groups that can hold them, then the rows."""
    s = q @ x.T
    width, n = 16, s.shape[1]
    if n > 4 * k * width:
        s = np.pad(s, ((0, 0), (0, -n % width)), constant_values=-9)
        tops = s.reshape(len(q), -1, width).max(2)
        g = np.argpartition(-tops, k - 1, axis=1)[:, :k]
        at = (g[:, :, None] * width + np.arange(width)).reshape(len(q), -1)
    else:
        at = np.broadcast_to(np.arange(n), s.shape)
    v = np.take_along_axis(s, at, 1)
    m = min(k, v.shape[1])
    top = np.argpartition(-v, m - 1, axis=1)[:, :m]
    return np.take_along_axis(at, top, 1), np.take_along_axis(v, top, 1)


def _meet(k: int, dim: int, least: float):
    def pairs(ids: pa.Array, x: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(left), 512):
            mine = left[a : a + 512]
            at, sims = best_rows(x[mine], x[right], k + 1)
            at = right[at]
            use = (at != mine[:, None]) & (sims >= least)
            some = use.any(1)
            if some.any():
                off = pa.array(np.r_[0, np.cumsum(use.sum(1)[some])].astype(np.int32))
                near = pa.ListArray.from_arrays(off, ids.take(pa.array(at[use])))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(mine[some])), near,
                        pa.ListArray.from_arrays(off, pa.array(sims[use].astype(np.float32)))
                    ],
                    names=["id", "near", "sims"]
                )

    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        side, ids, x = t["side"].to_numpy(), t["id"].combine_chunks(), _matrix(t["v"].combine_chunks(), dim)
        every = np.arange(len(x))
        if (side < 2).all():
            yield from pairs(ids, x, every, every)
        else:  # two blocks of one list: each against the other
            yield from pairs(ids, x, every[side == 2], every[side == 3])
            yield from pairs(ids, x, every[side == 3], every[side == 2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            k_ = b.column("list").to_numpy()
            cuts = np.r_[0, np.flatnonzero(k_[1:] != k_[:-1]) + 1, len(k_)]
            for a, z in zip(cuts[:-1], cuts[1:]):
                if z > a:
                    if held and k_[a] != key:
                        yield from whole(held)
                        held = []
                    key = k_[a]
                    held.append(b.slice(a, z - a))
        if held:
            yield from whole(held)

    return run


def _spread(assigned: DataFrame) -> DataFrame:
    """(list, side, id, v): side 1 in lists of one block; lists of more blocks become pairs of blocks, sides 2 and 3.

    The sizes of the long lists, at most MAX_LISTS rows, go to every task by broadcast.
    """
    rows = assigned.select("id", "v", F.explode("lists").alias("l"))
    long = rows.groupBy("l").agg(F.ceil(F.count("*") / BLOCK).alias("n")).where("n > 1")
    rows = rows.join(F.broadcast(long), "l", "left").withColumn(
        "n", F.coalesce("n", F.lit(1).cast("long"))
    ).withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")))
    key = lambda i, j: F.col("l").cast("long") * (1 << 46) + i * (1 << 23) + j
    own = F.array(F.struct(key(F.col("b"), F.col("b")).alias("list"), F.lit(1).alias("side")))
    others = F.transform(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda j: j != F.col("b")),
        lambda j: F.struct(
            key(F.least(j, "b"), F.greatest(j, "b")).alias("list"),
            F.when(F.col("b") < j, F.lit(2)).otherwise(F.lit(3)).alias("side")
        )
    )
    return rows.select(
        F.explode(F.concat(own, F.coalesce(others, F.array()))).alias("m"), "id", "v"
    ).select("m.*", "id", "v")


def nearest(
    df: DataFrame, id_col: str, vector: str, k: int = 5, dim: int = 64, list_rows: int = 900, replicas: int = 5,
    ratio: float = 1.25, min_similarity: float = -1.0
) -> DataFrame:
    """(id, neighbour, rank, similarity): for every id the k other ids of greatest cosine, ties by id.

    min_similarity leaves out neighbours below it before anything is merged; the ranks of the others are the same.

    Vectors that are null, all zero, not of `dim` numbers or not finite take no part, rows with a null id neither. Rows
    repeated under one id with the same vector count once; of different vectors under one id each takes part and the id's
    best neighbours over all of them are returned. Equal vectors under different ids are neighbours of similarity 1. An
    empty table gives no rows. Vectors are compared as 16-bit floats, which moves a cosine by about 0.0002. Other columns
    are ignored.
    """
    src = df.select(
        F.col(id_col).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("x")
    ).where("id is not null and x is not null")
    # the k + 1 least ids of equal vectors stand for them all; the limit is applied before the shuffle too
    rank = F.row_number().over(Window.partitionBy("vid").orderBy("id"))
    entries = _entries(src, dim)
    shown = cut_lineage(entries.dropDuplicates(["vid", "id"]).withColumn("rn", rank).where(F.col("rn") <= k + 1))
    reps = shown.where("rn = 1").select("id", "v", "vid")
    n = reps.count()
    lists = max(1, min(MAX_LISTS, -(-n // list_rows)))
    share = min(1.0, min(SAMPLE, max(20_000, 64 * lists)) / max(1, n))  # the hash decides who is in: no order of rows, no cut
    sample = [
        r[0] for r in reps.where(
            F.pmod(F.xxhash64("vid"), F.lit(1 << 30)) < int(share * (1 << 30))
        ).select("v").collect()
    ]
    x = np.frombuffer(
        b"".join(sample), dtype=np.float16
    ).reshape(-1, dim).astype(np.float32) if sample else np.eye(1, dim, dtype=np.float32)
    assigned = cut_lineage(_assign(reps.select("id", "v"), fit_lists(x, lists), dim, replicas, ratio))
    met = _spread(assigned).repartition("list").sortWithinPartitions("list").mapInArrow(
        _meet(k, dim, min_similarity), "id string, near array<string>, sims array<float>"
    )
    best = met.select(
        "id", F.explode(F.arrays_zip("near", "sims")).alias("p")
    ).where("id <> p.near").groupBy("id", F.col("p.near").alias("near")).agg(F.max("p.sims").alias("sim"))
    order = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "near"))
    best = best.withColumn("rank", order).where(F.col("rank") <= k).select("id", "near", "sim", "rank")
    if shown.where("rn = 2").isEmpty():  # no vector occurs under two ids, so there is nothing to hand back to copies
        return best.select(
            "id", F.col("near").alias("neighbour"), "rank",
            F.least(F.lit(1.0), F.col("sim").cast("double")).alias("similarity")
        )
    copies = shown.groupBy("vid").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    few = copies.select(F.col("ids")[0].alias("rep"), "ids")
    # neighbours that stand for copies are replaced by them
    wide = best.join(few.withColumnRenamed("rep", "near"), "near", "left").select(
        "id", F.explode(F.coalesce("ids", F.array("near"))).alias("near"), "sim"
    )
    # and every copy has the neighbours of its class, and its fellows
    members = entries.select("vid", "id").distinct().join(copies, "vid").select(
        "id", F.col("ids")[0].alias("rep"), "ids"
    )
    theirs = members.where("id <> rep").join(wide.withColumnRenamed("id", "rep"), "rep").select("id", "near", "sim")
    fellows = members.select("id", F.explode("ids").alias("near"), F.lit(1.0).cast("float").alias("sim"))
    all_ = wide.union(theirs).union(fellows).where("id <> near").groupBy("id", "near").agg(F.max("sim").alias("sim"))
    return all_.withColumn("rank", order).where(F.col("rank") <= k).select(
        "id", F.col("near").alias("neighbour"), "rank",
        F.least(F.lit(1.0), F.col("sim").cast("double")).alias("similarity")
    )


def mutual_pairs(found: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: pairs of which at least one is among the other's neighbours with at least this similarity."""
    return found.where(F.col("similarity") >= least).select(
        F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")
    ).distinct()
