"""Leaks that the nearest passages alone do not show."""

import random

from verityloom.llm import leakage


def test_no_lone_run_is_lost_below_the_threshold(spark):
    r = random.Random(11)
    vocab = [f"c{i}" for i in range(150)] * 40 + [f"r{i}" for i in range(4000)]
    some = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(f"i{k}", some(60)) for k in range(8)]
    docs, want = [], set()
    for d in range(400):
        name, words = items[d % 8]
        at = r.randrange(len(words) - leakage.BLOCK + 1)
        docs.append((d, " ".join(some(r.randint(12, 40)) + words[at : at + leakage.BLOCK] + some(r.randint(12, 40)))))
        want.add((d, name))
    df = spark.createDataFrame(docs, "d long, t string")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "i string, p string")
    assert {
        (x.doc, x.item) for x in leakage.leaks(df, "d", "t", it, "i", ["p"]).collect() if x.kind == "verbatim"
    } == want


def test_a_paraphrase_behind_a_nearer_passage(spark):
    r = random.Random(4)
    common = [f"c{i}" for i in range(60)]
    passage = " ".join(f"{r.choice(common)} answer{i} {r.choice(common)}" for i in range(12)).split()
    changed = list(passage)
    for i in range(4, len(changed), 9):
        changed[i] = "other"
    lure = passage[:24]  # the same words, so a cosine of 1 to a window, but in another order
    r.shuffle(lure)
    pad = [r.choice(common) for _ in range(60)]
    docs = [(1, " ".join(changed)), (2, " ".join(lure[:24] + pad + changed))]
    docs += [
        (10 + i, " ".join(r.choice(common + [f"x{i}{j}" for j in range(20)]) for _ in range(60))) for i in range(60)
    ]
    df = spark.createDataFrame(docs, "d long, t string")
    it = spark.createDataFrame([("i", " ".join(passage))], "i string, p string")
    got = {x.doc: x for x in leakage.leaks(df, "d", "t", it, "i", ["p"], near=0.5).collect()}
    assert set(got) == {1, 2} and got[2].kind == "paraphrase" and got[2].lcs_share > 0.8
