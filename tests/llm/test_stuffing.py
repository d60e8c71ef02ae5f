import random

import pytest

from verityloom.llm import stuffing


def prose(r, n):
    subjects = [
        "the board", "a member of the team", "each service", "the owner of the record", "every change to the plan",
        "an audit"
    ]
    verbs = ["reviews", "closes", "delays", "replaces", "confirms", "supports"]
    objects = [
        "the report that the office keeps", "a copy of the policy", "any file older than {} days",
        "the test under C-{}", "both the plan and the ladder", "parts of O-{}"
    ]
    tails = [
        "in line with the rule", "before the desk signs off", "so that work can resume", "within {} days",
        "because the log was late", ""
    ]
    return " ".join(
        f"{r.choice(subjects)} {r.choice(verbs)} {r.choice(objects)} {r.choice(tails)}".format(
            *(r.randint(1, 900) for _ in range(3))
        ).strip().capitalize() + r.choice([". ", ".\n\n"]) for _ in range(n)
    )


def keywords(r, n):
    terms = [
        "cheap license", "coupon", "best price", "ebook", "starter pack", "helpdesk", "audit tool", "trial version"
    ]
    return r.choice([", ", " ", " | ", "\n"]).join(r.choice(terms) for _ in range(n))


def links(r, n):
    return "\n".join(
        f"* [{r.choice(['coupon', 'ebook', 'sale'])}](https://shop{r.randint(1, 99)}.example/{r.choice('abc')}-item?id={r.randint(1, 999)})" for _ in range(n)
    )


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, words int")
    return {r.id: r for r in stuffing.stuffed_pages(df, "doc_id", "text").collect()}


def test_held_out_accuracy(spark):
    r = random.Random(6)
    rows, truth = [], set()
    for i in range(500):
        kind = r.random()
        if kind < 0.05:
            rows.append((i, keywords(r, r.randint(40, 90))))
            truth.add(i)
        elif kind < 0.09:
            rows.append((i, links(r, r.randint(10, 30))))
            truth.add(i)
        elif kind < 0.14:  # prose with a few tags or links
            rows.append((i, prose(r, 14) + "\nTags: " + keywords(r, 4) + "\n" + links(r, 1)))
        elif kind < 0.17:  # a list of identifiers
            rows.append((i, prose(r, 3) + ",".join(f"C-{r.randint(1, 999)}" for _ in range(80))))
        else:
            rows.append((i, prose(r, r.randint(4, 25))))
    got = run(spark, rows)
    found = {i for i, x in got.items() if x.stuffed}
    assert len(found & truth) >= 0.95 * len(truth), sorted(truth - found)
    assert len(found - truth) <= 0.05 * len(truth), sorted(found - truth)


def test_dirt(spark):
    r = random.Random(7)
    long = prose(r, 4000)
    rows = [(i, prose(r, 10)) for i in range(50)] + [
        (100, None), (101, ""), (102, "?!"), (103, long), (104, "coupon"), (1, prose(random.Random(1), 5)),
        (None, "a b")
    ]
    got = run(spark, rows)
    assert got[100].words == got[101].words == got[102].words == 0 and got[100].mean_surprise is None
    assert not any(got[i].stuffed for i in (100, 101, 102, 103)) and got[None].words == 2
    assert got[103].words > 20_000


def test_repeated_rows_and_empty_table(spark):
    r = random.Random(8)
    t = prose(r, 10)
    df = spark.createDataFrame([(1, t), (1, t), (2, prose(r, 5))], "doc_id long, text string")
    assert stuffing.stuffed_pages(df, "doc_id", "text").count() == 2
    assert stuffing.stuffed_pages(df.limit(0), "doc_id", "text").collect() == []


def test_symbols():
    s = next(stuffing.symbols(["The C-12a service, see www.x.example/a?id=1 #Tag NOW voilÃ la", None, ""]))
    cls = [x // len(stuffing.BEFORE) for x in s.symbol]
    assert s.bounds.tolist()[-3:] == [len(cls)] * 3
    assert cls[0] == 0 and cls[1] == cls[2] == stuffing.IDENTIFIER and cls[3] == stuffing.PLAIN
    assert cls[5:11] == [stuffing.ADDRESS] * 6
    assert stuffing.TAG in cls and cls[12] == stuffing.PLAIN


def test_function_words_are_a_parameter(spark):
    prose = "lun fanu ves a kelo ves i manu lun tari ves lun soko i pela ves lun garo. "
    rows = [(i, (prose * 6)) for i in range(200)] + [
        (900 + i, "best cheap toolkit bundle deal " * 20) for i in range(6)
    ]
    df = spark.createDataFrame(rows, "id long, t string")
    words = {"article": "lun", "preposition": "ves a", "conjunction": "i"}
    got = {r.id for r in stuffing.stuffed_pages(df, "id", "t", words).where("stuffed").collect()}
    assert not any(i < 900 for i in got)
    with pytest.raises(ValueError, match="kinds of function words"):
        stuffing.stuffed_pages(df, "id", "t", {"adverb": "x"})
