"""Words of whole text columns as flat numpy arrays, and the hashes built on them.

A word is a run of letters and digits, of any script, of the lower-cased text. Texts of an Arrow batch are laid end to end
as code points and cut and hashed in vectorised passes, in slices of bounded size, so that cost is per character and no
Python object is made per word. A text is never cut: one longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np

SLICE_CHARS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _is_word() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Words(NamedTuple):
    """The words of the texts [first, first + len(bounds) - 1): text i has the words bounds[i] to bounds[i + 1]."""

    first: int
    bounds: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    chars: np.ndarray
    text_at: np.ndarray


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > limit:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def words(texts: list[str | None], lower: bool = True) -> Iterator[Words]:
    """The words of all texts, in slices; a null text has none."""
    table = _is_word()
    for a, b in slices(texts):
        part = [t or "" for t in texts[a:b]]
        if lower:
            part = [t.lower() for t in part]
        text_at = np.r_[0, np.cumsum([len(t) + 1 for t in part])]
        chars = code_points("\n".join(part) + "\n")
        inside = table[chars]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        yield Words(a, np.searchsorted(start, text_at), span_hashes(chars, start, end), start, end, chars, text_at)


def span_hashes(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of characters, equal for equal stretches."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    n = 1 << int(np.ceil(np.log2(len(chars) + 1)))
    up, down = _powers(n)
    total = np.zeros(len(chars) + 1, dtype=np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[: len(chars)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hash(word: str) -> int:
    """The hash that words() gives this word."""
    c = code_points(word)
    return int(span_hashes(c, np.array([0]), np.array([len(c)]))[0])


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words and the text each lies in; a text of fewer words has none."""
    h = w.hashes
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    m = len(h) - n + 1
    out = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        out = mix(out * _BASE + h[i : i + m])
    text = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    whole = text[:m] == text[n - 1 :]
    return out[whole], text[:m][whole]


def distinct_per_text(hashes: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text in ascending order, and the bounds of each text in them."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    h, t = h[keep], t[keep]
    return h, np.searchsorted(t, np.arange(texts + 1))
