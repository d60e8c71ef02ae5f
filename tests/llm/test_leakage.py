import random
import re

import numpy as np

from verityloom.llm import leakage, tokens

WORD = re.compile(r"[^\W_]+")


def sentences(r, vocab, n):
    return " ".join(r.choice(vocab) for _ in range(n))


def longest_run(a, b):
    a, b = (WORD.findall((t or "").lower()) for t in (a, b))
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


def test_runs_match_brute_force(spark):
    r = random.Random(2)
    common = [f"c{i}" for i in range(150)]
    rare = [f"r{i}" for i in range(4000)]
    vocab = common * 40 + rare
    items = [(f"i{k}", sentences(r, vocab, 20), sentences(r, vocab, 40)) for k in range(12)] + [
        ("short", "one two three", None), (None, "x " * 20, "y " * 20), ("i0", "again", None)
    ]
    docs = []
    for d in range(300):
        words = sentences(r, vocab, r.randint(5, 120)).split()
        if d % 3 == 0:
            _, a, b = items[r.randrange(12)]
            src = (b if d % 2 else a).split()
            n = r.choice([8, 11, 12, 13, 15, 20])
            at = r.randrange(len(src) - n + 1)
            where = r.randrange(len(words) + 1)
            words[where:where] = src[at : at + n]
        docs.append((d, " ".join(words).replace("c1 ", "C1,\n"), "x"))
    docs += [(900, None, ""), (901, "", ""), (902, items[0][2] + " " + "pad " * 30_000, ""), (0, docs[0][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item string")
    it = spark.createDataFrame(items, "item_id string, q string, p string")
    got = leakage.leaks(df, "doc_id", "text", it, "item_id", ["q", "p"]).collect()
    want = {
        (d, i): max(longest_run(t, q), longest_run(t, p)) for d, t, _ in docs for i, q,
        p in items if i and i != "short" and q != "again" and max(longest_run(t, q), longest_run(t, p)) >= 12
    }
    assert {(x.doc, x.item): x.run_words for x in got if x.kind == "verbatim"} == want and len(want) > 40


def test_paraphrase_and_answers(spark):
    r = random.Random(4)
    common = [f"c{i}" for i in range(60)]
    passage = " ".join(f"{r.choice(common)} answer{i} {r.choice(common)}" for i in range(12)).split()
    changed = list(passage)
    for i in range(4, len(changed), 9):
        changed[i] = "other"
    docs = [(1, " ".join(changed)), (2, sentences(r, common, 60))] + [
        (10 + i, sentences(r, common + [f"x{i}{j}" for j in range(20)], 60)) for i in range(60)
    ]
    df = spark.createDataFrame(docs, "d long, t string")
    it = spark.createDataFrame([("i", " ".join(passage))], "i string, p string")
    got = {x.doc: x for x in leakage.leaks(df, "d", "t", it, "i", ["p"], near=0.5).collect()}
    assert set(got) == {1} and got[1].kind == "paraphrase" and got[1].lcs_share > 0.8


def test_basis_is_that_of_an_exact_decomposition(spark):
    """Singular values and space against numpy's own decomposition of the whole TF-IDF matrix."""
    r = random.Random(6)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(30)]
    texts = [" ".join(r.choice(topics[d % 30]) for _ in range(r.randint(5, 60))) for d in range(900)]
    df = spark.createDataFrame(
        [(next(tokens.words([t])).hashes.astype(np.uint32).tobytes(),) for t in texts], "words binary"
    )
    idf = leakage._idf(df)
    basis, value = leakage.latent_basis(df, idf)
    rows = []
    for t in texts:
        w = next(tokens.words([t])).hashes.astype(np.uint32)
        p = leakage.passages(np.array([0, len(w)]))
        for a, b in zip(p.left, p.right):
            v = np.bincount(
                np.concatenate([w[p.start[k] : p.start[k] + leakage.BLOCK] for k in {a, b}]) % leakage.TERMS,
                minlength=leakage.TERMS
            ) * idf
            n = np.concatenate([w[p.start[k] : p.start[k] + leakage.BLOCK] for k in {a, b}]) % leakage.TERMS
            rows.append(v / np.sqrt((idf[n] ** 2).sum()))
    a = np.array(rows)
    used = np.flatnonzero(a.any(0))
    want = np.linalg.svd(a[:, used], full_matrices=False)
    assert np.allclose(value[:25], want[1][:25], rtol=0.03)
    space = (basis[used] / idf[used, None])[:, :25]
    assert np.linalg.svd(space.T @ want[2][:30].T)[1].min() > 0.97


def test_recall_of_paraphrases(spark):
    """Items with every sixth word replaced and two neighbours swapped in every ten, hidden in other text: at least nine of ten are found, and nothing else."""
    r = random.Random(9)
    common, rare = [f"c{i}" for i in range(200)], [f"r{i}" for i in range(3000)]
    items = [[r.choice(common) if r.random() < 0.5 else r.choice(rare) for _ in range(36)] for _ in range(60)]
    docs = []
    for d, words in enumerate(items):
        w = [r.choice(rare) if i % 6 == 3 else x for i, x in enumerate(words)]
        for i in range(0, len(w) - 1, 10):
            w[i], w[i + 1] = w[i + 1], w[i]
        pad = lambda: [r.choice(common) if r.random() < 0.5 else r.choice(rare) for _ in range(r.randint(20, 60))]
        docs.append((d, " ".join(pad() + w + pad())))
    docs += [
        (
            1000 + d, " ".join(r.choice(common) if r.random() < 0.5 else r.choice(rare) for _ in range(100))
        ) for d in range(300)
    ]
    df = spark.createDataFrame(docs, "d long, t string")
    it = spark.createDataFrame([(f"i{k:02}", " ".join(w)) for k, w in enumerate(items)], "i string, p string")
    got = {(x.doc, x.item) for x in leakage.leaks(df, "d", "t", it, "i", ["p"], near=0.6).collect()}
    true = {(k, f"i{k:02}") for k in range(60)}
    assert len(got & true) >= 54 and not got - true


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c " * 20)], "d long, t string")
    it = spark.createDataFrame([("i", "a b c " * 20)], "i string, p string")
    assert leakage.leaks(df.limit(0), "d", "t", it, "i", ["p"]).collect() == []
    assert leakage.leaks(df, "d", "t", it.limit(0), "i", ["p"]).collect() == []
    assert [x.kind for x in leakage.leaks(df, "d", "t", it, "i", ["p"]).collect()] == ["verbatim"]


def test_items_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEMS_AT_A_TIME", 1)
    texts = [" ".join(f"{p}{i}" for i in range(15)) for p in "abc"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "d long, t string")
    it = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(texts)], "i string, p string")
    assert {
        (x.doc, x.item) for x in leakage.leaks(df, "d", "t", it, "i", ["p"]).collect()
    } == {(k, f"i{k}") for k in range(3)}


def test_every_run_of_a_block_lies_in_a_passage():
    n = leakage.BLOCK
    for size in (1, n - 1, n, n + 1, 5 * n + 3):
        p = leakage.passages(np.array([0, 4, 4, 4 + size]))
        spans = [
            (
                p.start[a],
                (
                    p.start[b + 1] if b + 1 < len(p.start) and p.start[b] + n == p.start[b + 1] else 4 + size
                ) if t == 2 else 4
            ) for a,
            b, t in zip(p.left, p.right, p.text)
        ]
        for s in range(4, 4 + size - n + 1):
            assert any(a <= s and s + n <= e for a, e in spans)


def test_common_subsequence_and_runs():
    r = np.random.default_rng(0)
    for _ in range(50):
        a, b = r.integers(0, 6, r.integers(1, 30)), r.integers(0, 6, r.integers(1, 30))
        t = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert leakage.common_subsequence(a, b) == t[-1, -1]
    w = next(tokens.words(["a b c d e f g h i j k l m n a b c d e f g h i j k l"])).hashes.astype(np.uint32)
    h = leakage.runs_of(w)
    assert h[0] == h[14] and len(np.unique(h)) == len(h) - 1
