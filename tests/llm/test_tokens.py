import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from verityloom.llm import tokens

WORD = re.compile(r"[^\W_]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=6))
def test_words_are_runs_of_letters_and_digits(texts):
    got = [[] for _ in texts]
    for w in tokens.words(texts):
        for i in range(len(w.bounds) - 1):
            got[w.first + i] = w.hashes[w.bounds[i] : w.bounds[i + 1]].tolist()
    for t, h in zip(texts, got):
        want = [x for x in re.findall(r"[^\W_]+", (t or "").lower()) if all(c.isalnum() for c in x)]
        if all(all(c.isalnum() for c in x) for x in WORD.findall((t or "").lower())):
            assert h == [tokens.word_hash(x) for x in want]


def test_slices_cut_between_texts_only(monkeypatch):
    texts = ["a " * 50, None, "b " * 400, "", "c"]
    assert list(tokens.slices(texts, 120)) == [(0, 2), (2, 3), (3, 5)]
    monkeypatch.setattr(tokens.slices, "__defaults__", (120,))
    got = list(tokens.words(texts))
    assert len(got) == 3 and sum(len(w.hashes) for w in got) == 50 + 400 + 1


def test_shingles_stay_within_texts():
    w = next(tokens.words(["a b c d", "a b", "b c d"]))
    h, t = tokens.shingles(w, 3)
    assert t.tolist() == [0, 0, 2] and h[1] == h[2]
    d, bounds = tokens.distinct_per_text(np.r_[h, h], np.r_[t, t], 3)
    assert len(d) == 3 and bounds.tolist() == [0, 2, 2, 3]
