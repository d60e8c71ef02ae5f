"""Near-duplicate texts: fingerprint buckets, pivot distance tables, exact verification.

Texts are sets of n-word shingles; equal sets are one class. Each class has minima under many hash functions, whose bands
are the bucket keys and one bit of each of which makes the fingerprint. Classes that meet in a bucket are compared through
a table of Hamming distances to reference fingerprints: by the triangle inequality two fingerprints are at least as far
apart as their distances to any reference differ, so a pair whose greatest coordinate difference exceeds the bound is
discarded unseen. Survivors are verified on their whole shingle sets.

Buckets too large for one task are cut into blocks ordered by nearest reference. Whole pairs of blocks are discarded by the
ranges of their coordinates, and what is left is compared block against block in as many tasks as needed: nothing is
dropped, capped or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verityloom.llm import tokens
from verityloom.session import cut_lineage

BUCKET_ROWS = 256
PIVOTS = 64
_FILTER_BITS = 1 << 28
SEGMENT = 1 << 20  # bits of the filter that are built at a time


def _multipliers(k: int) -> np.ndarray:
    return tokens.mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def _sets(texts: list[str | None], n: int, min_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions of texts with enough words, their shingle sets end to end, bounds)."""
    for w in tokens.words(texts):
        h, t = tokens.shingles(w, n)
        h, bounds = tokens.distinct_per_text(h, t, len(w.bounds) - 1)
        enough = (np.diff(w.bounds) >= min_words) & (np.diff(bounds) > 0)
        if enough.any():
            sizes = np.diff(bounds)
            h = h[np.repeat(enough, sizes)]
            yield np.flatnonzero(enough) + w.first, h, np.r_[0, np.cumsum(sizes[enough])]


def _class_ids(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, the same for equal sets."""
    total = np.add.reduceat(tokens.mix(h ^ np.uint64(0x5DEECE66D)), bounds[:-1])
    return tokens.mix(total + np.diff(bounds).astype(np.uint64)).astype(np.int64)


def _minima(h: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(bounds) - 1, k), dtype=np.uint64)
    for i, a in enumerate(_multipliers(k)):
        out[:, i] = np.minimum.reduceat(h * a + (a >> np.uint64(7)), bounds[:-1])
    return out


def _fingerprints(minima: np.ndarray) -> np.ndarray:
    """One bit of each minimum, packed into 64-bit numbers."""
    bits = (tokens.mix(minima) >> np.uint64(40)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)


def _bands(df: DataFrame, n: int, min_words: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = tokens.mix(np.arange(1, bands + 1, dtype=np.uint64))
        for b in batches:
            for _, h, bounds in _sets(b.column(1).to_pylist(), n, min_words):
                sid, first = np.unique(_class_ids(h, bounds), return_index=True)
                m = _minima(h, bounds, bands * rows)[first].reshape(len(sid), bands, rows)
                key = np.broadcast_to(salt, (len(sid), bands)).copy()
                for r in range(rows):
                    key = tokens.mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel().astype(np.int64)), pa.array(np.repeat(sid, bands))], names=["key", "sid"]
                )

    return df.mapInArrow(run, "key long, sid long")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, sid) in key order: pairs (null, a, b) of small buckets, rows (key, a, null) of large ones."""

    def out(key: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays(
            [none if key is None else pa.array(key), pa.array(a), none if b is None else pa.array(b)],
            names=["key", "a", "b"]
        )

    def flush(key: np.ndarray, sid: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.r_[start, len(key)])
        found = []
        for s in np.unique(size[(size > 1) & (size <= BUCKET_ROWS)]):
            rows = sid[start[size == s][:, None] + np.arange(s)]
            i, j = np.triu_indices(s, 1)
            found.append(np.stack([rows[:, i].ravel(), rows[:, j].ravel()], axis=1))
        if found:
            p = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            p = p[p[:, 0] != p[:, 1]]
            yield out(None, p[:, 0], p[:, 1])
        large = np.repeat(size > BUCKET_ROWS, size)
        if large.any():
            yield out(key[large], sid[large], None)

    key, sid, streaming = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), None
    for b in batches:
        k, s = b.column(0).to_numpy(), b.column(1).to_numpy()
        if streaming is not None:  # the rest of a bucket that is known to be large
            n = int(np.searchsorted(k != streaming, True)) if (k != streaming).any() else len(k)
            if n:
                yield out(k[:n], s[:n], None)
            k, s = k[n:], s[n:]
            if not len(k):
                continue
            streaming = None
        key, sid = np.r_[key, k], np.r_[sid, s]
        if len(key) < 200_000:
            continue
        last = int(
            np.searchsorted(key != key[-1], False)
        ) if (key == key[-1]).all() else len(key) - int(np.argmax(key[::-1] != key[-1]))
        yield from flush(key[:last], sid[:last])
        key, sid = key[last:], sid[last:]
        if len(key) > BUCKET_ROWS:
            yield out(key, sid, None)
            streaming, key, sid = int(key[-1]), key[:0], sid[:0]
    yield from flush(key, sid)


def _filter_of(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the column `sid`, at most 32 MB whatever the number of ids; past that it only lets more through.

    Each task builds whole segments of SEGMENT bits, so the work spreads over as many tasks as there are segments and the
    driver receives every bit once.
    """
    bits = int(min(_FILTER_BITS, max(SEGMENT, 1 << int(np.ceil(np.log2(16 * max(1, ids.count())))))))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(_spots(b.column(0).to_numpy(), bits)))], names=["spot"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            spot = b.column("spot").to_numpy()
            for k in np.unique(spot // SEGMENT).tolist():
                held.setdefault(k, np.zeros(SEGMENT, dtype=bool))[spot[spot // SEGMENT == k] % SEGMENT] = True
        for k, seen in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k]), pa.array([np.packbits(seen).tobytes()])], names=["segment", "m"]
            )

    total = np.zeros(bits // 8, dtype=np.uint8)
    spots = ids.select("sid").mapInArrow(spread, "spot long").distinct()
    for r in spots.withColumn(
        "segment", F.floor(F.col("spot") / SEGMENT)
    ).repartition("segment").mapInArrow(run, "segment long, m binary").toLocalIterator():
        total[r["segment"] * SEGMENT // 8 :][: SEGMENT // 8] = np.frombuffer(r["m"], dtype=np.uint8)
    return total, bits


def _spots(sid: np.ndarray, bits: int) -> list[np.ndarray]:
    u = sid.astype(np.uint64)
    return [
        (
            tokens.mix(u * np.uint64(c)) % np.uint64(bits)
        ).astype(np.int64) for c in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
    ]


def _members(df: DataFrame, n: int, min_words: int, k: int, wanted: tuple[np.ndarray, int]) -> DataFrame:
    """(id, sid, fp, words): fp and the shingle set only for classes that the filter lets through."""
    shared = df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, bits = shared.value
        for b in batches:
            for at, h, bounds in _sets(b.column(1).to_pylist(), n, min_words):
                sid = _class_ids(h, bounds)
                hit = np.ones(len(sid), dtype=bool)
                for spot in _spots(sid, bits):
                    hit &= (packed[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1).astype(bool)
                size = np.where(hit, np.diff(bounds), 0)
                flat = h[np.repeat(hit, np.diff(bounds))]
                fp = np.zeros((len(sid), k // 64), dtype=np.int64)
                if hit.any():
                    fp[hit] = _fingerprints(_minima(flat, np.r_[0, np.cumsum(size[hit])], k))
                off = lambda s: pa.array(np.r_[0, np.cumsum(s)].astype(np.int32), mask=np.r_[~hit, False])
                fps = pa.ListArray.from_arrays(off(np.where(hit, k // 64, 0)), pa.array(fp[hit].ravel()))
                sets = pa.ListArray.from_arrays(off(size), pa.array(flat.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array(sid), fps, sets], names=["id", "sid", "fp", "words"]
                )

    return df.mapInArrow(run, "id string, sid long, fp array<long>, words array<long>")


def _hamming(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x
    )


def _far(a: str, b: str) -> Column:
    """The greatest coordinate difference of two rows of the pivot table."""
    return F.array_max(F.zip_with(F.col(a), F.col(b), lambda x, y: F.abs(x - y)))


def _pivot_table(classes: DataFrame) -> DataFrame:
    """(sid, fp, coords): Hamming distances to PIVOTS reference fingerprints, drawn from the candidates by hash order."""
    picked = [
        list(r[0]) for r in classes.select(
            "fp", F.xxhash64("sid").alias("x"), "sid"
        ).orderBy("x", "sid").limit(PIVOTS).select("fp").collect()
    ]
    at = F.array(
        *(F.array(*(F.lit(int(x)).cast("long") for x in p)) for p in picked)
    ) if picked else F.lit(None).cast("array<array<bigint>>")
    return classes.select("sid", "fp", F.transform(at, lambda p: _hamming(F.col("fp"), p)).alias("coords"))


def _large_buckets(rows: DataFrame, table: DataFrame, bound: int) -> DataFrame:
    """Candidate pairs (a, b) of the buckets in rows(key, a), block against block."""
    r = rows.select("key", F.col("a").alias("sid")).distinct().join(table, "sid")
    near = F.array_position("coords", F.array_min("coords")).cast("int")
    r = r.withColumn("cell", near)
    sizes = r.groupBy("key", "cell").agg(F.count("*").alias("_n"))
    r = r.join(sizes, ["key", "cell"]).withColumn(
        "block", F.concat_ws("-", "cell", F.pmod(F.xxhash64("sid"), F.ceil(F.col("_n") / BUCKET_ROWS)).cast("string"))
    )
    r = cut_lineage(r.select("key", "block", "sid", "fp", "coords"))
    ranges = r.groupBy("key", "block").agg(
        F.array(*(F.min(F.col("coords")[i]) for i in range(PIVOTS))).alias("lo"),
        F.array(*(F.max(F.col("coords")[i]) for i in range(PIVOTS))).alias("hi")
    )
    gap = F.array_max(
        F.zip_with(
            F.zip_with("lo", "hi2", lambda x, y: x - y), F.zip_with("lo2", "hi", lambda x, y: x - y), lambda x,
            y: F.greatest(x, y)
        )
    )
    other = ranges.select("key", F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    blocks = ranges.join(other, "key").where("block <= block2").where(
        F.coalesce(gap, F.lit(0)) <= bound
    ).select("key", "block", "block2")
    left = blocks.join(r, ["key", "block"]).select(
        "key", "block", "block2", F.col("sid").alias("a"), F.col("fp").alias("fa"), F.col("coords").alias("ca")
    )
    right = r.select(
        "key", F.col("block").alias("block2"), F.col("sid").alias("b"), F.col("fp").alias("fb"),
        F.col("coords").alias("cb")
    )
    met = left.join(right, ["key", "block2"]).where("block < block2 or a < b")
    return met.where(_far("ca", "cb") <= bound).where(_hamming(F.col("fa"), F.col("fb")) <= bound).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()


def links(
    df: DataFrame, id_col: str, text_col: str, shingle: int = 5, threshold: float = 0.8, min_words: int = 5,
    bands: int = 40, rows: int = 4
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the near-duplicate texts.

    members: (id, sid, copies, representative), one row per distinct (id, set of shingles); sid is the class of equal sets,
    copies its number of ids, representative its least id. links: (a, b, similarity) between different classes, a < b,
    whose Jaccard similarity of shingle sets is at least `threshold`.

    Texts that are null or have fewer than min_words or `shingle` words take part in nothing; rows with a null id neither.
    Repeated rows count once. Empty tables give no rows. Other columns are ignored. Bands and rows set the chance that a
    pair of similarity s meets, 1 - (1 - s**rows)**bands: 0.9996 at 0.65 and 0.996 at 0.6 for the defaults. The class id has 64 bits.
    """
    src = df.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")
    ).where("id is not null and t is not null")
    k = -(-bands * rows // 64) * 64
    met = cut_lineage(
        _bands(
            src, shingle, min_words, bands, rows
        ).repartition("key").sortWithinPartitions("key", "sid").mapInArrow(_meet, "key long, a long, b long")
    )
    pairs, large = met.where("b is not null").select("a", "b").distinct(), met.where("b is null").select("key", "a")
    sids = met.select(F.explode(F.array("a", "b")).alias("sid")).where("sid is not null").distinct()
    members = cut_lineage(_members(src, shingle, min_words, k, _filter_of(sids)))
    classes = members.where("words is not null").groupBy("sid").agg(
        F.any_value("fp").alias("fp"), F.any_value("words").alias("words")
    )
    # at the threshold a share (1 - threshold) / 2 of the bits differ; six standard deviations more lose one pair in 10**9
    p = (1 - threshold) / 2
    bound = int(k * p + 6 * (k * p * (1 - p)) ** 0.5) + 1
    table = _pivot_table(classes)
    if not large.isEmpty():
        pairs = pairs.union(_large_buckets(large, table, bound)).distinct()
    coords = lambda c: table.select(F.col("sid").alias(c), F.col("coords").alias(f"c{c}"))
    kept = pairs.join(coords("a"), "a").join(coords("b"), "b").where(_far("ca", "cb") <= bound).select("a", "b")
    words = lambda c: classes.select(F.col("sid").alias(c), F.col("words").alias(f"w{c}"))
    both = F.size(F.array_intersect("wa", "wb"))
    found = kept.join(words("a"), "a").join(words("b"), "b").select(
        "a", "b", (both / (F.size("wa") + F.size("wb") - both)).alias("similarity")
    ).where(F.col("similarity") >= threshold)
    ids = members.select("id", "sid").distinct()
    per = ids.groupBy("sid").agg(F.count("*").alias("copies"), F.min("id").alias("representative"))
    return ids.join(per, "sid"), found


def similar_pairs(members: DataFrame, found: DataFrame, expand: int | None = None) -> DataFrame:
    """(a, b): pairs of different ids, a < b, whose texts are equal or linked.

    With expand=None every pair is written, as many as there are. With a number, classes of more copies are written as
    pairs of their representative with every other copy, and their links as those of the representative: with `members`,
    which holds every id's class, no link between different texts is lost and no group is squared.
    """
    large = F.lit(False) if expand is None else F.col("copies") > expand
    shown = members.where(~large | (F.col("id") == F.col("representative"))).select("sid", "id")
    side = lambda c: shown.select(F.col("sid").alias(c), F.col("id").alias(f"i{c}"))
    across = found.select("a", "b").join(side("a"), "a").join(side("b"), "b").select(
        F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")
    ).where("a <> b")
    some = members.where(~large & (F.col("copies") > 1)).select("sid", "id")
    within = some.select("sid", F.col("id").alias("a")).join(
        some.select("sid", F.col("id").alias("b")), "sid"
    ).where("a < b").select("a", "b")
    star = members.where(large & (F.col("id") != F.col("representative"))).select(
        F.col("representative").alias("a"), F.col("id").alias("b")
    )
    return across.union(within).union(star).distinct()


def groups(members: DataFrame, found: DataFrame) -> DataFrame:
    """(id, class_id, group_id, copies, links): one row per text; groups are the connected components of the links.

    group_id is the least id that the group's classes are represented by. Components are found by alternating stars on
    the classes that have links: each node's neighbours hang on the least of them, until nothing changes.
    """
    edges = cut_lineage(found.select("a", "b"))
    degree = edges.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("links"))
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        small = large.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b")
        low = small.groupBy("a").agg(F.min("b").alias("m"))
        new = small.join(low, "a").select(
            F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")
        ).select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct()
        new = cut_lineage(new)
        same = new.count() == edges.count() and new.exceptAll(edges).isEmpty()
        edges = new
        if same:
            break
    of = edges.select(F.col("a").alias("sid"), F.col("b").alias("root"))
    labelled = members.join(of, "sid", "left").join(degree, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    names = labelled.groupBy("root").agg(F.min("representative").alias("group_id"))
    return labelled.join(names, "root").select(
        "id", F.col("representative").alias("class_id"), "group_id", "copies",
        F.coalesce("links", F.lit(0)).alias("links")
    )
