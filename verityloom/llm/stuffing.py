"""Keyword-stuffed and link-list pages, by the perplexity of function-word and word-class sequences.

Every word becomes a symbol of its class (the kind of function word, plain, capitalised, number, identifier, part of an
address, tag) and of what stands before it (blank, comma, line end, sentence end, other mark). A trigram model of these
symbols is trained on the prose of the whole collection. A page's words are scored by their mean surprise over a window;
words in windows that are abnormally surprising, or abnormally predictable, against prose count as stuffing, and a page
is flagged if they are more than half of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verityloom.llm import tokens
from verityloom.session import cut_lineage

# Common function words of English, French, German and Spanish by kind.
FUNCTION_WORDS = {
    "article": "a an the no each every any this that these those le la les l un une des du au aux der die das den dem des ein eine einen einem einer kein keine jeder jede jeden el los las un una unos unas al del cada le ses son sa su sus",
    "preposition": "of in on at by for with from to into until under over within without against after before since as per between during d de à en dans par pour sur sous avec sans après avant depuis jusqu selon von vom zu zum zur mit nach bei bis seit für auf aus im am an über unter durch gegen gemäß innerhalb por para con sin sobre desde hasta tras según ante entre",
    "conjunction": "and or but if so because while whenever although than et ou mais si que qu ainsi und oder aber wenn falls solange sowie weil dass y o e pero mientras como porque",
    "verb": "is are was were be has have had may can cannot could must shall will does do est sont a ont peut doit être ist sind war wird werden hat haben kann muss darf es son fue ha han puede debe sea",
    "pronoun": "it its they their who which what where when how we our you your not only both il elle ils se ce qui ne pas er sie es sich wer was wie nicht wir uns se lo que quien cual no",
}
_KINDS = list(FUNCTION_WORDS)
PLAIN, CAPITAL, NUMBER, ADDRESS, TAG, IDENTIFIER, FRAGMENT = range(len(_KINDS), len(_KINDS) + 7)
CLASSES = len(_KINDS) + 7
BEFORE = ("start", "blank", "comma", "line", "sentence", "joined", "mark")
SYMBOLS = CLASSES * len(BEFORE)
_SPACE, _LINE, _STOP, _COMMA, _SLASH, _HYPHEN, _APOSTROPHE, _LIST = (1 << i for i in range(8))
# The marks that tell what stands between two words.
_MARKS = {
    _SPACE: " \t\r\u00a0\u2009\u202f", _LINE: "\n", _STOP: ".!?", _COMMA: ",;", _SLASH: "/=&?@",
    _HYPHEN: "-\u2010\u2011\u2013\u2212", _APOSTROPHE: "'\u2019", _LIST: ":|/\u2022\u00bb\u00ab\u00b7()[]<>{}\"#*"
}

SLICE = 1 << 17  # words that are scored at a time
WINDOW = 15  # words over which surprise is averaged
RUN = 8  # words since the last function word or identifier count up to this
SIDE, NEEDED = 10, 2  # a word stands in prose if as many words on either side hold as many function words
RARE = 1e-3  # contexts rarer than this share of all words are taken as unknown
SPREADS = 2.3  # what is farther from prose's median than this many times the way to its 95th (5th) percentile is abnormal
BINS, BIN = 2000, 0.01
_HISTORIES = SYMBOLS * RUN * CLASSES


@lru_cache(maxsize=2)
def _tables(words: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, ...]:
    lower = np.arange(0x110000, dtype=np.uint32)
    upper = np.zeros(0x110000, dtype=bool)
    digit = np.zeros(0x110000, dtype=bool)
    for i in range(0x110000):
        c = chr(i)
        small = c.lower()
        if small != c:
            upper[i] = True
            if len(small) == 1:
                lower[i] = ord(small)
        digit[i] = c.isdigit()
    pairs = sorted(
        {
            tokens.word_hash(w): k for k,
            kind in reversed(list(enumerate(_KINDS))) for w in dict(words).get(kind, "").split()
        }.items()
    )
    marks = np.zeros(0x110000, dtype=np.uint8)
    for bit, found in _MARKS.items():
        marks[[ord(c) for c in found]] |= bit
    return lower, upper, digit, np.array(
        [h for h, _ in pairs], dtype=np.uint64
    ), np.array([k for _, k in pairs], dtype=np.int8), marks


class Symbols(NamedTuple):
    first: int
    bounds: np.ndarray
    symbol: np.ndarray


def symbols(texts: list[str | None], function_words: dict[str, str] = FUNCTION_WORDS) -> Iterator[Symbols]:
    """The symbol of every word of every text, in slices."""
    lower, upper, digit, hashes, kinds, marks = _tables(tuple(sorted(function_words.items())))
    for w in tokens.words(texts, lower=False):
        n, chars, start, end = len(w.start), w.chars, w.start, w.end
        if not n:
            yield Symbols(w.first, w.bounds, np.zeros(0, dtype=np.int64))
            continue
        h = tokens.span_hashes(lower[chars], start, end)
        spot = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
        cls = np.where(hashes[spot] == h, kinds[spot], PLAIN).astype(np.int64) if len(hashes) else np.full(n, PLAIN)
        numeric = np.zeros(len(chars) + 1, dtype=np.int32)
        np.cumsum(digit[chars], out=numeric[1:])
        digits = (numeric[end] - numeric[start]) > 0
        large = np.zeros(len(chars) + 1, dtype=np.int32)
        np.cumsum(upper[chars], out=large[1:])
        shouted = (end - start > 1) & (large[end] - large[start] == end - start)
        cls[(cls == PLAIN) & upper[chars[start]] & ~shouted] = CAPITAL
        cls[digits] = NUMBER
        # what stands between a word and the one before it
        width = np.r_[0, start[1:] - end[:-1]]
        fresh = np.zeros(n, dtype=bool)
        fresh[w.bounds[:-1][w.bounds[:-1] < n]] = True
        between = np.zeros(n, dtype=np.uint8)
        if n > 1:
            between[1:] = np.bitwise_or.reduceat(marks[chars], np.stack([end[:-1], start[1:]], axis=1).ravel())[::2]
        has = lambda bit: (between & bit) > 0
        space, line, stop, comma = has(_SPACE | _LINE), has(_LINE), has(_STOP), has(_COMMA)
        slash = has(_SLASH) | (stop & ~space)
        hyphen = has(_HYPHEN) & (width <= 2) & ~space
        apostrophe = has(_APOSTROPHE) & (width == 1)
        before = np.full(n, BEFORE.index("mark"))
        before[space & (width == 1)] = BEFORE.index("blank")
        before[between == _SPACE] = BEFORE.index("blank")
        before[comma] = BEFORE.index("comma")
        before[stop & space] = BEFORE.index("sentence")
        before[line & ~(stop & space)] = BEFORE.index("line")
        joined = ~space & (hyphen | slash | apostrophe)
        before[joined] = BEFORE.index("joined")
        before[fresh] = BEFORE.index("start")
        # pieces of words that hold marks, as after a bad conversion
        odd = ~space & ~fresh & ~joined & ~comma & ~has(_LIST)
        # addresses: words joined by dots, slashes and the like; identifiers: words joined by hyphens, one with a digit
        link = ~space & slash & ~fresh
        word_run = np.cumsum(~(joined & ~fresh))
        in_address = np.isin(word_run, word_run[link])
        cls[in_address] = ADDRESS
        in_identifier = np.isin(word_run, word_run[digits & hyphen]) & ~in_address & (np.r_[hyphen[1:], False] | hyphen)
        cls[in_identifier] = IDENTIFIER
        tagged = chars[np.maximum(start - 1, 0)] == ord("#")
        cls[tagged & ~in_address] = TAG
        cls[odd & ~in_address & ~in_identifier] = FRAGMENT
        yield Symbols(w.first, w.bounds, cls * len(BEFORE) + before)


class Pages(NamedTuple):
    """Words of several texts end to end, with where the text of each word begins and ends."""

    bounds: np.ndarray
    symbol: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def _cells(p: Pages) -> np.ndarray:
    """The model cell of every word: (previous symbol, run since a function word, class before that, symbol)."""
    cls, i = p.symbol // len(BEFORE), np.arange(len(p.symbol))
    last = np.maximum(p.begin - 1, np.maximum.accumulate(np.where((cls < len(_KINDS)) | (cls == IDENTIFIER), i, -1)))
    run = np.minimum(i - last, RUN - 1)
    first, second = i == p.begin, i <= p.begin + 1
    prev, prev_run = np.where(first, 0, np.roll(p.symbol, 1)), np.where(first, 0, np.roll(run, 1))
    return ((prev * RUN + prev_run) * CLASSES + np.where(second, 0, np.roll(cls, 2))) * SYMBOLS + p.symbol


def _in_prose(p: Pages) -> np.ndarray:
    i = np.arange(len(p.symbol))
    c = np.r_[0, np.cumsum(p.symbol // len(BEFORE) < len(_KINDS))]
    left, right = c[i + 1] - c[np.maximum(p.begin, i + 1 - SIDE)], c[np.minimum(p.end, i + SIDE)] - c[i]
    return np.where(i + 1 < p.begin + SIDE, right, np.where(i + SIDE > p.end, left, np.minimum(left, right))) >= NEEDED


def _scored(p: Pages) -> np.ndarray:
    """Words that say something of the text's manner: all but identifiers and pieces of broken words."""
    return p.symbol // len(BEFORE) < IDENTIFIER


def _smooth(surprise: np.ndarray, scored: np.ndarray, p: Pages) -> np.ndarray:
    """Mean surprise of the scored words of the window around each word; NaN where there are none."""
    i = np.arange(len(surprise))
    total, count = np.r_[0, np.cumsum(np.where(scored, surprise, 0).astype(np.float64))], np.r_[0, np.cumsum(scored)]
    a = np.maximum(p.begin, np.minimum(i - WINDOW // 2, p.end - WINDOW))
    b = np.minimum(p.end, a + WINDOW)
    k = count[b] - count[a]
    return np.where(k > 0, (total[b] - total[a]) / np.maximum(k, 1), np.nan)


def fit(counts: np.ndarray) -> np.ndarray:
    """Surprise in bits of every cell, from counts of cells: trigrams backed off to (previous symbol, run), then to nothing known."""
    total = max(1.0, float(counts.sum()))
    tri = counts.reshape(_HISTORIES, SYMBOLS).astype(np.float64)
    bi = tri.reshape(-1, CLASSES, SYMBOLS).sum(axis=1)
    p2 = (bi + RARE * total / SYMBOLS) / (bi.sum(axis=1, keepdims=True) + RARE * total)
    p3 = (tri + RARE * total * np.repeat(p2, CLASSES, axis=0)) / (tri.sum(axis=1, keepdims=True) + RARE * total)
    return -np.log2(p3).ravel().astype(np.float32)


def _pages(column: pa.Array) -> Iterator[Pages]:
    """The texts of a binary column of symbols, some at a time; none is cut."""
    off = np.frombuffer(column.buffers()[1], dtype=np.int32)[
        column.offset : column.offset + len(column) + 1
    ].astype(np.int64)
    data = np.frombuffer(
        column.buffers()[2], dtype=np.uint8
    ) if column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(off, off[a] + SLICE, "right")) - 1)
        bounds = off[a : b + 1] - off[a]
        n = np.diff(bounds)
        yield Pages(bounds, data[off[a] : off[b]].astype(np.int64), np.repeat(bounds[:-1], n), np.repeat(bounds[1:], n))
        a = b


def stuffed_pages(
    df: DataFrame, id_col: str, text_col: str, function_words: dict[str, str] = FUNCTION_WORDS
) -> DataFrame:
    """(id, words, stuffed_words, mean_surprise, stuffed) of every row.

    mean_surprise is the text's mean bits per scored word, whose power of two is its perplexity; null without such words.
    The model, and the quantiles of prose that the thresholds follow from, are counted over all rows. A null or empty
    text has no words and is not stuffed. Rows repeated under one id are scored each and returned once if they agree.
    Ids may be null. An empty table gives no rows. Other columns are ignored.

    function_words gives the words of each kind of FUNCTION_WORDS, of all languages of the collection in one list; a kind may
    be empty. A page in a language without words there has no function words at all, looks like a list of keywords and is
    mostly flagged: give the lists of every language that is to be judged, and judge no others.
    """
    unknown = set(function_words) - set(_KINDS)
    if unknown:
        raise ValueError(f"kinds of function words are {', '.join(_KINDS)}, not {', '.join(sorted(unknown))}")
    key = df.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for s in symbols(b.column(1).to_pylist(), function_words):
                n = len(s.bounds) - 1
                data = pa.py_buffer(s.symbol.astype(np.uint8).tobytes())
                col = pa.Array.from_buffers(
                    pa.binary(), n, [None, pa.py_buffer(s.bounds.astype(np.int32).tobytes()), data]
                )
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, n), col], names=["id", "symbols"])
                done += n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_HISTORIES * SYMBOLS, dtype=np.int64)
        for b in batches:
            for p in _pages(b.column(0)):
                cell, n = np.unique(_cells(p)[_in_prose(p)], return_counts=True)
                total[cell] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    def gather(rows: DataFrame, size: int) -> np.ndarray:
        """Sums of n by cell; there are at most `size` cells however many rows."""
        got = rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(size, dtype=np.int64)
        out[got["cell"].to_numpy()] = got["n"].to_numpy()
        return out

    pages = cut_lineage(
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(read, f"id {key}, symbols binary")
    )
    model = df.sparkSession.sparkContext.broadcast(
        fit(gather(pages.select("symbols").mapInArrow(count, "cell int, n long"), _HISTORIES * SYMBOLS))
    )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, dtype=np.int64)
        for b in batches:
            for p in _pages(b.column(0)):
                use = _scored(p)
                v = _smooth(model.value[_cells(p)], use, p)[_in_prose(p) & use]
                total += np.bincount(np.minimum(BINS - 1, v / BIN).astype(np.int64), minlength=BINS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BINS, dtype=np.int32)), pa.array(total)], names=["cell", "n"]
        )

    prose = np.cumsum(gather(pages.select("symbols").mapInArrow(spread, "cell int, n long"), BINS))
    low, mid, high = (float(np.searchsorted(prose, q * prose[-1])) * BIN for q in (0.05, 0.5, 0.95))
    least, most = mid - SPREADS * (mid - low), mid + SPREADS * (high - mid)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for p in _pages(b.column(1)):
                use, surprise = _scored(p), model.value[_cells(p)].astype(np.float64)
                v = _smooth(surprise, use, p)
                text = np.repeat(np.arange(len(p.bounds) - 1), np.diff(p.bounds))
                of = lambda x: np.bincount(text, x, minlength=len(p.bounds) - 1)  # noqa: E731,B023
                n = of(use)
                found.append(
                    np.stack(
                        [
                            np.diff(p.bounds), of(((v > most) | (v < least)) & use),
                            np.divide(of(np.where(use, surprise, 0)), n, out=np.full(len(n), np.nan), where=n > 0)
                        ]
                    )
                )
            words, bad, mean = np.concatenate(found, axis=1) if found else np.zeros((3, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(words.astype(np.int64)), pa.array(bad.astype(np.int64)),
                    pa.array(mean, mask=np.isnan(mean)), pa.array(2 * bad > words)
                ],
                names=["id", "words", "stuffed_words", "mean_surprise", "stuffed"]
            )

    return pages.mapInArrow(
        score, f"id {key}, words long, stuffed_words long, mean_surprise double, stuffed boolean"
    ).distinct()
