import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verityloom.llm.splitting import pieces, split_oversized


def prose(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(300)]
    return "".join(r.choice(words) + r.choice([" ", " ", " ", " ", ". ", "\n\n", "! "]) for _ in range(n))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n\r\t!", max_size=400), st.integers(20, 60), st.integers(0, 9))
def test_own_parts_make_up_the_text(text, limit, overlap):
    _, got = pieces(text, limit, overlap, 5)
    assert "".join(text[own:end] for _, own, end, _ in got) == text
    for i, (start, own, end, _) in enumerate(got):
        assert end - start <= limit and 0 <= own - start <= overlap
        assert start == 0 if i == 0 else start >= got[i - 1][1]


def longest(text, rx):
    return max(map(len, re.split(rx, text)))


@pytest.mark.parametrize("seed", range(6))
def test_boundary_is_the_coarsest_that_suffices(seed):
    text = prose(seed, 700)
    for limit in (30, 60, 200, 1000):
        p, s, w = r"\n[ \t\r\n]*\n", r"\n[ \t\r\n]*\n|(?<=[.!?])[ \t\r\n]+", r"[ \t\r\n]+"
        want = next(
            (k for k, rx in (("paragraph", p), ("sentence", s), ("word", w)) if longest(text, rx) <= limit), "none"
        )
        assert pieces(text, limit, 10, 10)[0] == want


def test_an_edit_alters_only_the_pieces_near_it():
    text = prose(9, 6000)
    at = len(text) // 2
    before, after = (
        set(
            t[own:end] for _, own, end, _ in pieces(t, 1200, 120, 300)[1]
        ) for t in (text, text[:at] + "inserted words " + text[at:])
    )
    assert len(before) > 25 and len(before - after) <= 4


def test_table(spark):
    long = prose(1, 500)
    rows = [
        ("d", 0, long, "x"), ("d", 0, long, "x"), ("d", 1, "short", "y"), ("d", 2, None, "z"),
        (None, 3, "x" * 3000, "z"), ("e", 0, "", "z")
    ]
    df = spark.createDataFrame(rows, "document_id string, chunk_index int, chunk_text string, boundary string")
    got = split_oversized(df, ["document_id", "chunk_index"], "chunk_text").collect()
    by = {}
    for r in sorted(got, key=lambda r: r.piece_index):
        by.setdefault((r.document_id, r.chunk_index), []).append(r)
    assert set(by) == {("d", 0), ("d", 1), (None, 3), ("e", 0)}
    assert "".join(r.piece_text[r.own_start - r.piece_start :] for r in by["d", 0]) == long
    assert [r.boundary for r in by["d", 1] + by["e", 0]] == ["whole", "whole"] and by[None, 3][0].boundary == "none"
    assert max(len(r.piece_text) for r in got) <= 1200
    assert split_oversized(df.limit(0), ["document_id"], "chunk_text").collect() == []
    assert len(
        {
            (r.document_id, r.chunk_index) for r in split_oversized(
                df, ["document_id", "chunk_index"], "chunk_text", only_oversized=True
            ).collect()
        }
    ) == 2


def test_a_very_long_text(spark):
    text = prose(4, 120_000)
    df = spark.createDataFrame([(1, text)], "k int, t string")
    got = sorted(split_oversized(df, ["k"], "t").collect(), key=lambda r: r.piece_index)
    assert "".join(r.piece_text[r.own_start - r.piece_start :] for r in got) == text


def test_an_edit_alters_only_the_pieces_near_it():
    """A word added at one place: but for the pieces around it all own parts stay as they were."""
    r = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 10))) for _ in range(6000)]
    text = " ".join(w + "." if i % 11 == 10 else w for i, w in enumerate(words))
    at = len(text) // 2
    own = lambda t: [t[s:e] for _, s, e, _ in pieces(t, 1200, 120, 300)[1]]
    a, b = own(text), own(text[:at] + " inserted words here " + text[at:])
    assert len(set(a) - set(b)) <= 4 and len(set(b) - set(a)) <= 5 and len(a) > 30


def test_no_piece_is_smaller_than_the_least_size():
    for n in range(1150, 3000, 37):
        text = ("word " * 1000)[:n]
        parts = pieces(text, 1200, 120, 300)[1]
        assert "".join(text[s:e] for _, s, e, _ in parts) == text
        assert all(e - s >= 300 and e - back <= 1200 for back, s, e, _ in parts)
