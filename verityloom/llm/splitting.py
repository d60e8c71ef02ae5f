"""Cutting oversized items into pieces under a limit, by content-defined chunking that snaps to natural boundaries.

A rolling hash over the last 32 characters marks landmarks. From each cut, the first landmark between the least and the
greatest piece size is sought and moved to the nearest boundary of the coarsest kind that the stretch offers: blank line,
sentence end, white space, or the landmark itself. A cut thus depends on the text near it only, so that an edit alters
the pieces around it and the later ones fall back into step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verityloom.llm.tokens import code_points, mix

# White space is blank, tab, CR, LF; a blank line is two LF with nothing but white space between.
_BLANK_LINE = re.compile(r"\n[ \t\r\n]*\n")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t\r\n]+")
_SPACE = re.compile(r"[ \t\r\n]+")
KINDS = ("none", "word", "sentence", "paragraph")
_WINDOW = 32


def landmarks(text: str, mean_gap: int) -> np.ndarray:
    """Positions after which the hash of the last 32 characters falls to one in mean_gap, ascending."""
    h = mix(code_points(text).astype(np.uint64) + np.uint64(0x51ED27)) >> np.uint64(32)
    width = 1
    while width < _WINDOW:
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] if len(h) > width else h[:0]
        h, width = h + (shifted << np.uint64(width)), width * 2
    return np.flatnonzero(mix(h & np.uint64(0xFFFFFFFF)) % np.uint64(max(1, mean_gap)) == 0) + 1


def _stretches(text: str, spans: list[tuple[int, int]]) -> int:
    """The longest stretch between the spans, which are ascending and may overlap."""
    longest = at = 0
    for a, b in spans:
        longest, at = max(longest, a - at), max(at, b)
    return max(longest, len(text) - at)


def boundaries(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of white space at which the text may be cut, by kind; each finer kind holds the coarser ones."""
    blank = [m.span() for m in _BLANK_LINE.finditer(text)]
    ends = [m.span() for m in _SENTENCE.finditer(text)]
    return {"paragraph": blank, "sentence": sorted(blank + ends), "word": [m.span() for m in _SPACE.finditer(text)]}


def coarsest(text: str, limit: int, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The coarsest kind of boundary that alone leaves no stretch over the limit; 'none' if no kind does."""
    return next((k for k in ("paragraph", "sentence", "word") if _stretches(text, spans[k]) <= limit), "none")


def pieces(text: str, limit: int, overlap: int, least: int) -> tuple[str, list[tuple[int, int, int, str]]]:
    """(coarsest sufficient boundary, [(start with overlap, own start, end, kind of cut at the end)]).

    The own parts follow each other without a gap and make up the text; each piece is at most `limit` characters with
    its overlap, which begins at a white space or, where there is none, inside a word. Own parts have at least `least`
    characters, but for a last part that would not leave room for it.
    """
    spans = boundaries(text)
    room = limit - overlap
    cuts = {k: np.array([b for _, b in spans[k]], dtype=np.int64) for k in spans}
    marks = landmarks(text, max(1, (room - least) // 2))
    starts = cuts["word"]
    out, at, n = [], 0, len(text)
    back = 0
    while True:
        if n - at <= limit - (at - back):
            out.append((back, at, n, "end"))
            return coarsest(text, limit, spans), out
        low = at + least
        high = max(low, min(at + room, n - least))  # what is left is no smaller than the least size
        i = np.searchsorted(marks, low)
        mark = int(marks[i]) if i < len(marks) and marks[i] <= high else high
        kind, cut = "none", mark
        for k in ("paragraph", "sentence", "word"):
            a, b = np.searchsorted(cuts[k], [low, high + 1])
            if a < b:
                near = cuts[k][a:b]
                kind, cut = k, int(near[np.argmin(np.abs(near - mark))])
                break
        out.append((back, at, cut, kind))
        a, b = np.searchsorted(starts, [max(at, cut - overlap), cut])
        back = int(starts[a]) if a < b else max(at, cut - overlap)
        at = cut


def split_oversized(
    df: DataFrame, keys: list[str], text: str, limit: int = 1200, overlap: int = 120, least: int = 300,
    only_oversized: bool = False
) -> DataFrame:
    """Pieces of at most `limit` characters (code points) of every item.

    Returns the key columns and (boundary, piece_index, own_start, piece_start, piece_end, cut, piece_text): the piece is
    text[piece_start:piece_end], of which up to `overlap` characters before own_start repeat the piece before; the own parts
    put together are the text. `boundary` is the coarsest kind of boundary that suffices alone, 'whole' for items within
    the limit; `cut` is the kind of boundary at the piece's end.

    Rows repeated under the same keys count once; of different texts under one key the greatest is taken. A null text
    gives no rows and an empty text one empty piece. Keys may be null. Other columns are ignored, whatever their names.
    """
    if not 0 <= overlap < limit or not 0 < least <= limit - overlap:
        raise ValueError("0 <= overlap < limit and 0 < least <= limit - overlap are required")
    rows = df.select(
        *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(text).alias("t")
    ).where("t is not null")
    rows = rows.where(F.length("t") > limit) if only_oversized else rows
    rows = rows.groupBy(*(f"k{i}" for i in range(len(keys)))).agg(F.max("t").alias("t"))
    key_types = [f"{c} {t}" for c, t in rows.dtypes if c != "t"]
    tail = "boundary string, piece_index int, own_start int, piece_start int, piece_end int, cut string, piece_text string"
    names = [*(f"k{i}" for i in range(len(keys))), *(c.split()[0] for c in tail.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.utf8_length(b.column(b.num_columns - 1)).to_numpy(zero_copy_only=False)
            short = b.filter(pa.array(size <= limit))
            if short.num_rows:  # one piece each, as it is
                m, text = short.num_rows, short.column(short.num_columns - 1)
                zero = pa.array(np.zeros(m, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *short.columns[: len(keys)], pa.array(["whole"] * m), zero, zero, zero,
                        pa.array(size[size <= limit].astype(np.int32)), pa.array(["end"] * m), text
                    ],
                    names=names
                )
            for row in np.flatnonzero(size > limit).tolist():
                t = b.column(b.num_columns - 1)[row].as_py()
                boundary, found = pieces(t, limit, overlap, least)
                for first in range(0, len(found), 1000):  # a very long text leaves in several batches
                    part = found[first : first + 1000]
                    m = len(part)
                    at = pa.array(np.full(m, row))
                    back, own, end = (pa.array([p[i] for p in part], pa.int32()) for i in (0, 1, 2))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(b.column(i).take(at) for i in range(len(keys))), pa.array([boundary] * m),
                            pa.array(range(first, first + m), pa.int32()), own, back, end,
                            pa.array([p[3] for p in part]), pa.array([t[p[0] : p[2]] for p in part])
                        ],
                        names=names
                    )

    out = rows.mapInArrow(run, ", ".join([*key_types, tail]))
    return out.select(
        *(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)),
        *[c for c in out.columns if not re.fullmatch(r"k\d+", c)]
    )
