"""Evaluation texts inside training text, by latent semantic retrieval with exact checks.

Documents are cut into passages of two consecutive blocks of BLOCK words, so that every run of BLOCK words lies whole in one
passage. Hashed TF-IDF rows of all passages go through a distributed randomised SVD in two passes: each task multiplies its
passages into a matrix of RANK + OVER columns and back, and the products are summed by rows of the term table. The first
pass begins with random columns and gives an orthonormal basis of the range; the second gives the small matrix of the data in
that basis, whose eigenvectors turn the basis into the leading singular vectors. Windows of the test items are searched among
all passages by cosine there. Candidates are then checked exactly: for runs of consecutive words of an item, and for paraphrases
by answer words and longest common subsequence. Runs are looked up in the pairs that are no candidates too, so that no run
depends on the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verityloom.llm import tokens
from verityloom.session import cut_lineage

TERMS = 1 << 15
RANK = 64
OVER = 8  # columns of the random matrix beyond RANK
BLOCK = 12
ROWS = 512  # rows of the term table that are summed by one task
SLICE = 1 << 17  # words that are multiplied at a time
CELLS = 1 << 22  # cosines that are held at a time
ITEMS_AT_A_TIME = 4_096


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes end to end, bounds) of a binary column of 32-bit hashes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(
        data, dtype=np.uint8
    )[off[0] : off[-1]].view(np.uint32) if data is not None and off[-1] > off[0] else np.zeros(0, dtype=np.uint32)
    return flat, (off - off[0]).astype(np.int64) // 4


def _parts(flat: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, words, bounds) in slices of about SLICE words; no text is cut."""
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + SLICE, "right")) - 1)
        yield a, flat[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        a = b


class Passages(NamedTuple):
    """Blocks and the passages made of them: block k has the words start[k] on; passage i is the blocks left[i] and right[i]."""

    start: np.ndarray
    left: np.ndarray
    right: np.ndarray
    text: np.ndarray


def passages(bounds: np.ndarray) -> Passages:
    n = np.diff(bounds)
    blocks = -(-n // BLOCK)
    first = np.r_[0, np.cumsum(blocks)]
    of = np.repeat(np.arange(len(n)), blocks)
    start = bounds[of] + (np.arange(first[-1]) - first[of]) * BLOCK
    i = np.arange(first[-1])
    more = np.r_[of[1:] == of[:-1], False] if len(of) else np.zeros(0, dtype=bool)
    lone = blocks[of] == 1
    left = i[more | lone]
    return Passages(start, left, np.where(lone[left], left, left + 1), of[left])


def _sums(words: np.ndarray, start: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The sum of the table's rows over the words of each block, place by place of the blocks."""
    table = np.vstack([table, np.zeros((1, table.shape[1]), dtype=np.float32)])
    end = np.r_[start[1:], len(words)]
    out = np.empty((len(start), table.shape[1]), dtype=np.float32)
    for a in range(0, len(start), 2048):
        at = start[a : a + 2048, None] + np.arange(BLOCK)
        term = np.where(at < end[a : a + 2048, None], words[np.minimum(at, len(words) - 1)] % TERMS, TERMS)
        total = table[term[:, 0]]
        for j in range(1, BLOCK):
            total += table[term[:, j]]
        out[a : a + 2048] = total
    return out


def _add_rows(total: np.ndarray, term: np.ndarray, row: np.ndarray, rows: np.ndarray, often: int = 32) -> None:
    """total[term] += rows[row] for terms that occur again and again: the frequent each by a sum, the others by their n-th occurrences."""
    order = np.argsort(term, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(term[order]) != 0])
    n = np.diff(np.r_[at, len(order)])
    for i in np.flatnonzero(n >= often):
        mine = order[at[i] : at[i] + n[i]]
        for a in range(0, len(mine), 8192):
            total[term[mine[0]]] += rows[row[mine[a : a + 8192]]].sum(axis=0)
    few = n < often
    at, n = at[few], n[few]
    for k in range(int(n.max()) if len(n) else 0):
        mine = order[at[n > k] + k]
        total[term[mine]] += rows[row[mine]]


def _pairs(blocks: np.ndarray, p: Passages) -> np.ndarray:
    return blocks[p.left] + np.where((p.left == p.right)[:, None], 0, blocks[p.right])


def _idf(pages: DataFrame) -> np.ndarray:
    """Inverse document frequency of every hashed term, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros(TERMS, dtype=np.int64), 0
        for b in batches:
            for _, words, bounds in _parts(*_texts(b.column(0))):
                text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                seen += np.bincount(np.unique(text * TERMS + (words % TERMS).astype(np.int64)) % TERMS, minlength=TERMS)
                docs += len(bounds) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, TERMS, dtype=np.int32)), pa.array(np.r_[docs, seen])], names=["term", "n"]
        )

    got = pages.select("words").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(TERMS + 1)
    n[got["term"].to_numpy() + 1] = got["n"].to_numpy()
    return np.log((n[0] + 1) / (n[1:] + 1)).astype(np.float32) + np.float32(0.1)


def _through(pages: DataFrame, idf: np.ndarray, columns: np.ndarray | int) -> np.ndarray:
    """(TERMS, columns): the normalised TF-IDF rows A of all passages as A'A times columns, which are random if an int is given."""
    shared, width = pages.sparkSession.sparkContext.broadcast((idf, columns)), columns if isinstance(columns, int) else columns.shape[1]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, right = shared.value
        if isinstance(right, int):
            right = np.random.default_rng(7).standard_normal((TERMS, right)).astype(np.float32)
        right, squares = right * w[:, None], (w * w)[:, None]
        total = np.zeros((TERMS, width), dtype=np.float32)
        for b in batches:
            for _, words, bounds in _parts(*_texts(b.column(0))):
                p = passages(bounds)
                if not len(p.left):
                    continue
                size = _pairs(_sums(words, p.start, squares), p)
                y = _pairs(_sums(words, p.start, right), p) / np.maximum(size, 1e-9)
                back = np.zeros((len(p.start), width), dtype=np.float32)
                back[p.left] += y
                two = p.left != p.right
                back[p.right[two]] += y[two]
                block = np.repeat(np.arange(len(p.start)), np.diff(np.r_[p.start, len(words)]))
                term = (words % TERMS).astype(np.uint16)
                _add_rows(total, term, block, back)
        total *= w[:, None]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(TERMS // ROWS, dtype=np.int32)),
                pa.array([x.tobytes() for x in np.split(total, TERMS // ROWS)], pa.binary())
            ],
            names=["part", "m"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, m in zip(b.column(0).to_pylist(), b.column(1)):
                total[k] = total.get(k, 0) + np.frombuffer(m.as_py(), dtype=np.float32).astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(total), pa.int32()),
                    pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())
                ],
                names=["part", "m"]
            )

    z = np.zeros((TERMS // ROWS, ROWS * width))
    for r in pages.select("words").mapInArrow(
        multiply, "part int, m binary"
    ).repartition("part").mapInArrow(add, "part int, m binary").collect():
        z[r["part"]] = np.frombuffer(r["m"], dtype=np.float32)
    return z.reshape(TERMS, width)


def latent_basis(pages: DataFrame, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((TERMS, RANK) idf times the leading right singular vectors of all passages' TF-IDF rows, to project counts with; their singular values)."""
    q, _ = np.linalg.qr(_through(pages, idf, RANK + OVER))
    small = q.T @ _through(pages, idf, q.astype(np.float32))
    value, vector = np.linalg.eigh((small + small.T) / 2)
    first = np.argsort(-value)[:RANK]
    return (q @ vector[:, first] * idf[:, None]).astype(np.float32), np.sqrt(np.maximum(value[first], 0))


class Queries(NamedTuple):
    """The test texts: text t is of item[t]; its windows are first[t] on in latent, its runs those with run_text t, in order of hash."""

    names: list[str]
    item: np.ndarray
    words: list[np.ndarray]
    first: np.ndarray
    latent: np.ndarray
    runs: np.ndarray
    run_text: np.ndarray
    rare: list[np.ndarray]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def runs_of(words: np.ndarray, n: int = BLOCK) -> np.ndarray:
    """Hashes of n consecutive words, by doubling."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out, width, h = np.full(
        len(words) - n + 1, n, dtype=np.uint64
    ), 1, tokens.mix(words.astype(np.uint64) + np.uint64(1))
    done, m = 0, n
    while m:
        if m & 1:
            out = tokens.mix(out * np.uint64(0x9E3779B97F4A7C15) + h[done : done + len(out)])
            done += width
        m >>= 1
        if m:
            h = tokens.mix(h[:-width] * np.uint64(0xD6E8FEB86659FD93) + h[width:])
            width *= 2
    return out


def queries(rows: list[tuple[str, str | None]], basis: np.ndarray, idf: np.ndarray) -> Queries | None:
    """Windows of the items' texts with their latent vectors, and their runs; None if no text has a run."""
    names = sorted({r[0] for r in rows})
    place = {n: k for k, n in enumerate(names)}
    hashed = [(place[i], next(tokens.words([t])).hashes.astype(np.uint32)) for i, t in rows if t]
    hashed = [(i, w) for i, w in hashed if len(w) >= BLOCK]
    if not hashed:
        return None
    starts = [np.unique(np.r_[np.arange(0, len(w) - BLOCK + 1, BLOCK // 2), len(w) - BLOCK]) for _, w in hashed]
    cut = np.concatenate([w[a[:, None] + np.arange(BLOCK)] for (_, w), a in zip(hashed, starts)])
    latent = np.concatenate([_unit(basis[cut[a : a + 8192] % TERMS].sum(1)) for a in range(0, len(cut), 8192)])
    runs = [runs_of(w) for _, w in hashed]
    of = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    order = np.argsort(np.concatenate(runs), kind="stable")
    rare = []
    for _, w in hashed:
        u = np.unique(w)
        rare.append(u[np.argsort(-idf[u % TERMS], kind="stable")[: max(3, len(u) // 4)]])
    first = np.cumsum([0, *(len(a) for a in starts[:-1])])
    return Queries(
        names, np.array([i for i, _ in hashed]), [w for _, w in hashed], first, latent, np.concatenate(runs)[order],
        of[order], rare
    )


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit per word of a."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    every = v = (1 << len(a)) - 1
    for x in b.tolist():
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & every
    return len(a) - v.bit_count()


def _search(
    pages: DataFrame, basis: np.ndarray, q: Queries, key: str, candidate: float, near: float, min_lcs: float,
    min_answers: float
) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast((basis, q))

    def candidates(latent: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, test text, cosine to its nearest window) wherever that is at least `candidate`."""
        step, found = max(16, CELLS // len(q.latent)), []
        for a in range(0, len(latent), step):
            every = q.latent @ latent[a : a + step].T
            c = np.empty((len(q.first), every.shape[1]), dtype=np.float32)
            for k, (x, y) in enumerate(zip(q.first, [*q.first[1:], len(every)])):
                every[x:y].max(axis=0, out=c[k])
            t, i = np.nonzero(c >= candidate)
            found.append((a + i, t, c[t, i]))
        return tuple(
            np.concatenate(x) for x in zip(*found)
        ) if found else (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.float32),)

    def cosine(latent: np.ndarray, text: np.ndarray, q: Queries, d: int, t: int) -> float:
        """The greatest cosine of a passage of document d with a window of test text t."""
        a, b = np.searchsorted(text, [d, d + 1])
        windows = q.latent[q.first[t] : q.first[t + 1] if t + 1 < len(q.first) else None]
        return max(
            float((windows @ latent[x : min(b, x + 4096)].T).max()) for x in range(a, b, 4096)
        ) if b > a else -1.0

    def consecutive(h: np.ndarray, bounds: np.ndarray, q: Queries, wanted: np.ndarray) -> dict[tuple[int, int], int]:
        """The longest run of words in common of each pair of a wanted document and a test text, from BLOCK words on; h: the document's runs."""
        where = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        spot = np.flatnonzero(
            (where[: len(h)] == where[BLOCK - 1 :]) & wanted[where[: len(h)]]
        ) if len(h) else np.zeros(0, dtype=np.int64)
        lo, hi = np.searchsorted(q.runs, h[spot], "left"), np.searchsorted(q.runs, h[spot], "right")
        longest: dict[tuple[int, int], int] = {}
        last: dict[tuple[int, int], tuple[int, int]] = {}
        for s, x, y in zip(spot[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
            for t in set(q.run_text[x:y].tolist()):
                k = (int(where[s]), t)
                before, n = last.get(k, (-2, 0))
                last[k] = (s, n + 1 if s == before + 1 else BLOCK)
                longest[k] = max(longest.get(k, 0), last[k][1])
        return longest

    def paraphrases(
        words: np.ndarray, bounds: np.ndarray, p: Passages, q: Queries, passage: np.ndarray, text: np.ndarray,
        known: dict
    ) -> Iterator[tuple[int, int, float, float]]:
        """(document, test text, common subsequence, answer words) of the best of the passages that pass, of each pair without a common run."""
        best: dict[tuple[int, int], tuple[float, float]] = {}
        for i, t in zip(passage.tolist(), text.tolist()):
            d = int(p.text[i])
            if (d, t) in known:
                continue
            at = p.start[p.left[i]]
            around, rare = words[max(bounds[d], at - BLOCK) : min(bounds[d + 1], at + 3 * BLOCK)], q.rare[t]
            answers = float(np.isin(rare, around).mean())
            if answers >= min_answers:
                lcs = common_subsequence(q.words[t], around) / min(len(q.words[t]), len(around))
                if lcs >= min_lcs:
                    best[d, t] = max(best.get((d, t), (0.0, 0.0)), (lcs, answers))
        yield from ((d, t, lcs, answers) for (d, t), (lcs, answers) in best.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, q = shared.value
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
        for b in batches:
            rows: list[int] = []
            out: list[tuple] = []
            for start, words, bounds in _parts(*_texts(b.column(1))):
                p = passages(bounds)
                latent = _unit(
                    _pairs(_sums(words, p.start, basis), p)
                ) if len(p.left) else np.zeros((0, RANK), dtype=np.float32)
                passage, text, c = candidates(latent, q)
                pairs = np.sort(p.text[passage] * len(q.item) + text)
                h, near_some = runs_of(words), np.zeros(len(bounds) - 1, dtype=bool)
                near_some[p.text[passage]] = True
                runs = consecutive(h, bounds, q, near_some)
                runs |= consecutive(h, bounds, q, ~near_some)  # documents that the search gave nothing for: no run is left out
                key = np.array([d * len(q.item) + t for d, t in runs], dtype=np.int64)
                given = np.searchsorted(pairs, key, "right") > np.searchsorted(pairs, key, "left")
                found = [
                    (d, t, "verbatim", "latent" if g else "pass", n, 0.0, 0.0) for ((d, t), n),
                    g in zip(runs.items(), given.tolist())
                ]
                found += [
                    (d, t, "paraphrase", "latent", 0, lcs, answers) for d, t, lcs,
                    answers in paraphrases(words, bounds, p, q, passage[c >= near], text[c >= near], runs)
                ]
                rows += [start + f[0] for f in found]
                out += [(q.names[q.item[f[1]]], *f[2:], cosine(latent, p.text, q, f[0], f[1])) for f in found]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(rows)),
                        *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))
                    ],
                    names=["doc", "item", "kind", "found_by", "run_words", "lcs_share", "answer_share", "cosine"]
                )

    return pages.mapInArrow(
        run,
        f"doc {key}, item string, kind string, found_by string, run_words int, lcs_share double, answer_share double, cosine double"
    )


def leaks(
    df: DataFrame, doc: str, text: str, items: DataFrame, item: str, parts: list[str], candidate: float = 0.5,
    near: float = 0.8, min_lcs: float = 0.6, min_answers: float = 0.5
) -> DataFrame:
    """(doc, item, kind, found_by, run_words, lcs_share, answer_share, cosine): the items found in each document.

    kind is 'verbatim' if the document holds at least BLOCK consecutive words of one of the item's texts, run_words being
    the most; else 'paraphrase', if a passage with a cosine of at least `near` has at least min_answers of the
    item's rarest words and a common subsequence of at least min_lcs of the shorter of the two; of several such passages the
    one with the longest common subsequence counts. cosine is that of the nearest passage. One row per document and item.
    found_by is 'latent' where the search in the latent space gave the pair, at a cosine of at least `candidate`, and 'pass'
    where only the exact pass for runs over all pairs did: no run depends on a threshold.

    Words are compared as 32-bit hashes. Null, empty and short texts, of documents or items, match nothing; items of
    fewer than BLOCK words are not searched. Rows with a null item are left out. Repeated rows count once. Ids of documents
    may be null. Empty tables give no rows. Items are searched in blocks of ITEMS_AT_A_TIME, which bounds what is broadcast.
    """
    if near < candidate:
        raise ValueError("near must be at least candidate")
    key = df.schema[doc].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for w in tokens.words(b.column(1).to_pylist()):
                n = len(w.bounds) - 1
                col = pa.Array.from_buffers(
                    pa.binary(), n,
                    [
                        None, pa.py_buffer((w.bounds * 4).astype(np.int32).tobytes()),
                        pa.py_buffer(w.hashes.astype(np.uint32).tobytes())
                    ]
                )
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, n), col], names=["doc", "words"])
                done += n

    pages = cut_lineage(
        df.select(F.col(doc).alias("doc"), F.col(text).alias("t")).mapInArrow(read, f"doc {key}, words binary")
    )
    idf = _idf(pages)
    basis, _ = latent_basis(pages, idf)
    long = items.where(F.col(item).isNotNull()).select(
        F.col(item).cast("string").alias("item"), F.explode(F.array(*(F.col(p) for p in parts))).alias("t")
    ).where("t is not null").distinct()
    out, block = None, []

    def search(rows: list[tuple[str, str]]) -> None:
        nonlocal out
        q = queries(rows, basis, idf)
        if q is not None:
            got = _search(pages, basis, q, key, candidate, near, min_lcs, min_answers)
            out = got if out is None else out.unionByName(got)

    held: set[str] = set()
    for r in long.orderBy("item").toLocalIterator():
        if r["item"] not in held and len(held) == ITEMS_AT_A_TIME:
            search(block)
            block, held = [], set()
        held.add(r["item"])
        block.append((r["item"], r["t"]))
    search(block)
    if out is None:
        out = df.sparkSession.createDataFrame(
            [],
            f"doc {key}, item string, kind string, found_by string, run_words int, lcs_share double, answer_share double, cosine double"
        )
    best = F.struct(F.col("run_words"), F.col("lcs_share"), F.col("cosine"), F.col("answer_share"), F.col("found_by"))
    return out.groupBy("doc", "item").agg(F.max(best).alias("b")).select(
        "doc", "item", F.when(F.col("b.run_words") > 0, "verbatim").otherwise("paraphrase").alias("kind"), "b.found_by",
        "b.run_words", "b.lcs_share", "b.answer_share", "b.cosine"
    )
