import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from verityloom.functions import hashing, text, vectors
from verityloom.operators import elements, graph, keyed, metrics, search, temporal
from verityloom.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_cosine_zero_null_and_length(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 2.0]), (None, [1.0, 1.0])], "a array<double>, b array<double>"
    )
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None]
    with pytest.raises(Exception, match="different lengths"):
        spark.createDataFrame(
            [([1.0], [1.0, 2.0])], "a array<double>, b array<double>"
        ).select(vectors.cosine(F.col("a"), F.col("b"))).collect()


def test_canonical_json_matches_python(spark):
    import hashlib

    df = spark.createDataFrame([("Ä\"b", None, 3)], "x string, y string, n int")
    want = hashlib.sha256(
        json.dumps({"n": 3, "x": "Ä\"b", "y": None}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    ).hexdigest()
    assert df.select(hashing.content_id(x=F.col("x"), y=F.col("y"), n=F.col("n"))).first()[0] == want


def test_set_hash_is_order_free(spark):
    a = spark.range(100).repartition(7)
    h = lambda d: d.agg(hashing.set_hash(F.col("id"))).first()[0]
    assert h(a) == h(a.orderBy(F.desc("id"))) != h(a.where("id > 0"))


def test_hashed_embedding_is_a_unit_vector(spark):
    v = spark.createDataFrame([("abc",)], "t string").select(vectors.hashed_embedding(F.col("t"))).first()[0]
    assert len(v) == 32 and abs(sum(x * x for x in v) - 1) < 1e-9


def test_text_functions(spark):
    df = spark.createDataFrame(
        [("  The  C-88a and C-88\r\n\tc-88 XC-881 ", "The Control Foo  business Service")], "t string, n string"
    )
    r = df.select(
        text.squashed(F.col("t")), text.identifiers(F.col("t")), text.occurrences(F.col("t"), F.lit("C-88")),
        text.entity_key(F.col("n")), text.folded(F.lit("Straße")), text.html_text(F.lit("<a&'b'>")),
        text.as_percent(F.lit(None).cast("double")), text.markdown_cell(F.lit("a|b"))
    ).first()
    assert r[0] == "the c-88a and c-88\nc-88 xc-881" and r[1] == ["C-88A", "C-88", "XC-881"] and r[2] == 1
    assert r[3] == "foo" and r[4] == "strasse" and r[5] == "&lt;a&amp;&#x27;b&#x27;&gt;" and r[6] == "n/a" and r[7] == "a\\|b"


def test_upsert_is_idempotent_and_null_keys_are_keys(spark):
    t = spark.createDataFrame([("a", 1, 0), (None, 2, 0)], "k string, v int, at int")
    c = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), ("b", 7, 1), (None, 8, 1)], "k string, v int, at int")
    once = keyed.upsert(t, c, ["k"], F.desc("at"))
    assert rows(once) == rows(keyed.upsert(once, c, ["k"], F.desc("at"))) == sorted(
        [("a", 6, 2), ("b", 7, 1), (None, 8, 1)], key=str
    )
    assert rows(keyed.insert_if_absent(t, c, ["k"], "at")) == sorted([("a", 1, 0), (None, 2, 0), ("b", 7, 1)], key=str)


def test_numbered_is_gap_free_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = keyed.numbered(df, "n", "x").collect()
    assert all(r.n == r.x + 1 for r in got) and len(got) == 1000
    assert keyed.numbered(df.limit(0), "n", "x").collect() == []


def test_change_counts_second_run_changes_nothing(spark):
    t = spark.createDataFrame([("a", "h1", "x"), ("b", "h2", " \n"), ("c", "h3", None)], "k string, h string, t string")
    first = keyed.change_counts(t.limit(0), t, "k", "h", "t").first()
    assert tuple(first) == (3, 2, 0, 0, 1)
    assert tuple(keyed.change_counts(t, t, "k", "h", "t").first()) == (3, 2, 1, 0, 0)


def test_search_breaks_ties_by_id_and_ranks_only_the_eligible(spark):
    e = spark.createDataFrame(
        [(i, [1.0, 0.0], i % 2) for i in range(6)] + [(9, [0.0, 0.0], 0), (10, None, 0)],
        "id long, v array<double>, ok int"
    )
    q = e.where("id = 0")
    assert [r.row for r in search.exact_search(q, "id", e, "id", "v", 3, dim=2).orderBy("rank").collect()] == [1, 2, 3]
    good = spark.createDataFrame([(1,)], "ok int")
    assert [
        r.row for r in search.eligible_search(q, "id", e, "id", "v", good, "ok", 9, dim=2).orderBy("rank").collect()
    ] == [1, 3, 5]
    assert search.eligible_search(q, "id", e, "id", "v", good.limit(0), "ok", 9, dim=2).collect() == []
    assert search.exact_search(q.limit(0), "id", e, "id", "v", 3, dim=2).collect() == []


def test_fusion(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "g string, i string, r int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "g string, i string, r int")
    got = search.reciprocal_rank_fusion([a, b], "g", "i", "r", 5).orderBy("rank").collect()
    assert [(r.i, r.sources) for r in got] == [("y", [0, 1]), ("x", [0]), ("z", [1])]


def test_best_evidence(spark):
    df = spark.createDataFrame(
        [("g", "a", 2, 0.9), ("g", "a", 1, 0.1), ("g", "b", 1, 0.5), ("g", "c", 1, 0.5)],
        "g string, i string, hop int, s double"
    )
    assert [r.i for r in search.best_evidence(df, "g", "i", "hop", "s", 2).orderBy("rank").collect()] == ["b", "c"]


def test_as_of_half_open_and_gaps(spark):
    day = lambda n: dt.date(2020, 1, n)
    p = spark.createDataFrame(
        [
            ("a", day(1), day(5), "p1"), ("a", day(5), None, "p2"), ("b", day(3), day(4), "p3"),
            ("b", day(3), day(3), "empty")
        ],
        "k string, f date, t date, id string"
    )
    x = spark.createDataFrame(
        [(1, "a", day(4)), (2, "a", day(5)), (3, "b", day(4)), (4, "b", day(3)), (5, "c", day(1)), (6, "a", None)],
        "n int, k string, d date"
    )
    assert {
        r.n: r.id for r in temporal.as_of(x, "k", "d", p, "k", "f", "t").collect()
    } == {1: "p1", 2: "p2", 3: None, 4: "p3", 5: None, 6: None}


def test_chain_problems(spark):
    day = lambda n: dt.date(2020, 1, n)
    p = spark.createDataFrame(
        [
            ("d", "r1", day(1), day(5), None, "superseded"), ("d", "r2", day(5), day(9), "r1", "superseded"),
            ("d", "r9", day(1), None, "r7", None)
        ],
        "doc string, rev string, f date, t date, pre string, why string"
    )
    reg = spark.createDataFrame([("r1", "d"), ("r2", "other")], "rev string, doc string")
    got = {(r.problem, r.rev) for r in temporal.chain_problems(p, reg, "doc", "rev", "f", "t", "pre", "why").collect()}
    assert got == {
        ("orphaned_period", "r9"), ("period_document_mismatch", "r2"), ("missing_predecessor", "r9"),
        ("missing_successor", "r2")
    }


def test_metrics_keep_null_apart_from_zero(spark):
    hits = spark.createDataFrame(
        [("q1", "a", 1), ("q1", "b", 2), ("q2", "a", 1)], "query string, item string, rank int"
    )
    judged = spark.createDataFrame(
        [("q1", "b", "required"), ("q1", "z", "required"), ("q2", "a", "forbidden"), ("q3", "c", "required")],
        "query string, item string, kind string"
    )
    got = {(r.query, r.k): r for r in metrics.question_metrics(hits, judged, [1, 2]).collect()}
    assert got["q1", 2].coverage == 0.5 and got["q1", 1].coverage == 0 and got["q1", 1].reciprocal_rank == 0.5 and got["q1", 2].matched == "b"
    assert got["q2", 1].coverage is None and got["q2", 1].ndcg is None and got["q2", 1].forbidden_share == 1
    assert got["q3", 2].coverage == 0 and got["q3", 2].reciprocal_rank == 0
    agg = {r.k: r for r in metrics.aggregate_metrics(metrics.question_metrics(hits, judged, [1, 2])).collect()}
    assert agg[2].mean_coverage == 0.25 and agg[2].queries == 3


def test_scorecard_is_null_over_nothing(spark):
    f = spark.createDataFrame(
        [("x", "m", True, False), ("x", "m", False, False), ("y", "m", True, True)],
        "b string, m string, h boolean, e boolean"
    )
    got = {(r.bucket, r.metric): r.score for r in metrics.scorecard(f, "b", "m", "h", "e").collect()}
    assert got == {("x", "m"): 0.5, ("y", "m"): None, ("overall", "m"): 0.5}


def test_citations(spark):
    c = spark.createDataFrame([("q", 1, ["a", "z"]), ("q", 2, [])], "query string, claim int, cited array<string>")
    got = spark.createDataFrame([("q", "a")], "query string, item string")
    r = metrics.citation_checks(
        c, got, spark.createDataFrame([("q", "a"), ("q", "b")], "query string, item string")
    ).first()
    assert (r.claims, r.uncited, r.cited, r.invalid, r.coverage) == (2, 1, 2, 1, 0.5)


def test_paths_raise_at_the_ceiling(spark):
    e = spark.createDataFrame([(a, b) for a in "abcdef" for b in "abcdef" if a < b], "src string, dst string")
    s = spark.createDataFrame([("a",)], "node string")
    with pytest.raises(ValueError, match="more than 20"):
        graph.simple_paths(e, s, 5, 20)
    assert graph.simple_paths(e, s, 2, 100).count() == 5 + 20


def test_distances_and_maximal_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("x", "y")], "src string, dst string")
    s = spark.createDataFrame([("a",)], "node string")
    d = graph.distances(e, s, 2)
    assert rows(d) == [("a", 0), ("b", 1), ("c", 2)]
    assert {
        (r.src, r.dst): r.hop for r in graph.edge_hops(e, d).collect()
    } == {("a", "b"): 0, ("c", "b"): 1, ("c", "d"): 2}
    assert [r.path for r in graph.maximal_paths(e, s, 4).collect()] == ["a > b > c > d"]


def test_heading_paths(spark):
    t = "1 Scope\ntext\n1.1 Detail\n- item\n2 Other\n\nlast. line"
    els = elements.elements(spark.createDataFrame([(1, t), (2, None), (3, "")], "doc int, t string"), "doc", "t")
    got = {r.order_index: (r.kind, r.heading_path) for r in elements.heading_paths(els, "doc").collect()}
    assert got == {
        0: ("heading", "1 Scope"), 1: ("paragraph", "1 Scope"), 2: ("heading", "1 Scope > 1.1 Detail"),
        3: ("list_item", "1 Scope > 1.1 Detail"), 4: ("heading", "2 Other"), 6: ("paragraph", "2 Other")
    }


def test_outlines_of_any_depth(spark):
    t = "\n".join([".".join("1" * n) + f" H{n}" for n in range(1, 13)] + ["text", "1.1.2 Again", "2 Other"])
    els = elements.elements(spark.createDataFrame([(1, t)], "doc int, t string"), "doc", "t")
    got = [r.heading_path for r in elements.heading_paths(els, "doc").orderBy("order_index").collect()]
    deep = [".".join("1" * n) + f" H{n}" for n in range(1, 13)]
    assert got[11] == got[12] == " > ".join(deep) and got[13] == " > ".join(
        [*deep[:2], "1.1.2 Again"]
    ) and got[14] == "2 Other"
    long = elements.elements(spark.createDataFrame([(1, "1 A" + "b" * 500 + "\nx")], "doc int, t string"), "doc", "t")
    assert [r.kind for r in long.orderBy("order_index").collect()] == ["heading", "paragraph"]


def test_packs_begin_anew_at_breaks(spark):
    df = spark.createDataFrame(
        [("d", i, "x" * n, b) for i, (n, b) in enumerate([(2, True), (2, False), (2, True)])] + [("d", 3, None, None)],
        "doc string, i int, t string, b boolean"
    )
    assert [
        r.pack_index for r in elements.pack(df, "doc", "i", "t", 10, breaks="b").orderBy("i").collect()
    ] == [0, 0, 1, 1]


def test_long_texts_are_cut_between_sentences_then_words(spark):
    texts = ["One two. Three four.  Five", "word " * 8 + "end. " + "Tail.", "x" * 50, "", None, "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in elements.split_long(df, "t", 12).orderBy("i", "part").collect():
        got.setdefault(r.i, []).append(r.part_text)
    assert got[0] == ["One two. ", "Three ", "four.  ", "Five"]  # the white space after a sentence counts
    assert all(
        "".join(got[i]) == t for i, t in enumerate(texts) if t
    ) and got[2] == ["x" * 50] and got[3] == [""] and got[4] == [None] and got[5] == ["a b"]
    assert all(len(p) <= 12 for i in (0, 1) for p in got[i])
    assert elements.split_long(df.limit(0), "t", 12).collect() == []
    f = spark.createDataFrame(
        [("A b. \n\nC! d",), ("",), (None,), ("x.y. z",)], "t string"
    ).select(elements.fragments(F.col("t"))).collect()
    assert [r[0] for r in f] == [["A b. \n\n", "C! ", "d"], [], None, ["x.y. ", "z"]]


def test_packing_keeps_oversized_units_alone(spark):
    df = spark.createDataFrame(
        [("d", i, "x" * n, "p") for i, n in enumerate([4, 5, 30, 2, 3, 4])] + [("e", 0, None, "p")],
        "doc string, i int, t string, k string"
    )
    got = {(r.doc, r.i): r.pack_index for r in elements.pack(df, "doc", "i", "t", 10).collect()}
    assert [got["d", i] for i in range(6)] == [0, 0, 1, 2, 2, 3] and got["e", 0] == 0


def test_one_to_one(spark):
    a = spark.createDataFrame([("k", 1), ("k", 3)], "k string, x int")
    b = spark.createDataFrame([("k", 1), ("l", 2)], "k string, y int")
    assert rows(elements.one_to_one(a, b, ["k"], "x", "y")) == sorted(
        [("k", 1, 1, 1), ("k", 2, 3, None), ("l", 1, None, 2)], key=str
    )


def test_contained_in_several_passes(spark):
    n = spark.createDataFrame([("n1", "ab"), ("n2", "bc"), ("n3", ""), ("n4", "ab")], "i string, n string")
    t = spark.createDataFrame([(1, "xabc"), (2, None), (3, "ab")], "d int, t string")
    want = [("n1", 1), ("n1", 3), ("n2", 1), ("n4", 1), ("n4", 3)]
    assert rows(elements.contained(n, "i", "n", t, "d", "t")) == rows(
        elements.contained(n, "i", "n", t, "d", "t", limit=1)
    ) == want


def test_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"x")
    (tmp_path / "b.bin").write_bytes(b"y")
    m = spark.createDataFrame(
        [("a.bin", hashlib.sha256(b"x").hexdigest()), ("b.bin", "0"), ("c.bin", "0")], "file string, sha256 string"
    )
    assert rows(files.verified_files(spark, str(tmp_path), m)) == [("b.bin", "changed"), ("c.bin", "missing")]
    page = spark.createDataFrame(
        [(1, "<h1>A &amp; B</h1><p>one <b>two</b></p><ul><li>x</li></ul>"), (2, None)], "id int, html string"
    )
    assert [
        (r.kind, r.level, r.text) for r in files.html_elements(page, "id", "html").orderBy("order_index").collect()
    ] == [("heading", 1, "A & B"), ("paragraph", None, "one two"), ("list_item", None, "x")]
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert files.read_contract(spark, str(tmp_path / "c.json"), "a int").first().a == 1
    assert files.markdown_table(spark.createDataFrame([("a|b", None)], "x string, y string")).endswith("| a\\|b |  |")


def test_assembly(spark):
    from verityloom.operators import assembly

    items = spark.createDataFrame([("d", i, n) for i, n in enumerate([0, 1, 2, 1, 0, 2])], "doc string, o int, n int")
    assert [
        r.parent_order for r in assembly.list_parents(items, "doc", "o", "n").orderBy("o").collect()
    ] == [None, 0, 1, 0, None, 4]
    t = spark.createDataFrame([("H", "s", None), (None, " ", None), (None, "s", "m")], "h string, s string, m string")
    assert [
        r[0] for r in t.select(assembly.retrieval_text(F.col("h"), F.col("s"), F.col("m"))).collect()
    ] == ["H\n\ns", None, "s\n\nModel-derived (unverified):\nm"]
    a, b = (spark.createDataFrame([(x,) for x in s], "x string") for s in ("aab", "bc"))
    assert tuple(assembly.same_sets(a, b).first()) == (1, 1, False) and assembly.same_sets(a, a).first().equal
    with pytest.raises(ValueError, match="twice: a"):
        assembly.no_duplicates(a, ["x"], "twice")
    with pytest.raises(ValueError, match="bad: b, c"):
        assembly.require_none(b, "x", "bad")
    lines = spark.createDataFrame(
        [
            (["the recovery", "plan ends"], "recovery plan"), (["recovery", "planned"], "recovery plan"),
            (["a+b"], "a+b")
        ],
        "l array<string>, p string"
    )
    assert [
        r[0] for r in lines.select(assembly.phrase_in_lines(F.col("l"), F.col("p"))).collect()
    ] == [True, False, True]
    e = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g2", "z")], "g string, i string")
    o = spark.createDataFrame([("o2", "a"), ("o1", "b"), ("o3", "c")], "g string, i string")
    assert rows(assembly.best_overlap(e, o, "g", "i")) == [("g1", "o1", 1)]


def _feed(spark, path, schema, parts):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streams_drop_late_rows_and_keep_only_open_windows(spark, tmp_path):
    from verityloom.streaming import events

    day = lambda n: dt.datetime(2020, 1, n)
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "u long, ts timestamp, k string"
    s = _feed(
        spark, src, schema,
        [[(1, day(1), "a"), (2, day(1), "b")], [(1, day(20), "a"), (1, day(19), "a")], [(1, day(20), "a")]]
    )
    counts = events.windowed_counts(s, "ts", ["k"], "1 day", "5 days")
    assert rows(events.run_to_end(counts, "w", ["window_start", "k"], out)) == [
        (day(1), "a", 1), (day(1), "b", 1), (day(19), "a", 1), (day(20), "a", 2)
    ]
    _feed(spark, src, schema, [[(3, day(2), "late"), (3, day(21), "a")]])  # the run goes on in its folder; day 2 is behind the watermark
    assert rows(events.run_to_end(counts, "w", ["window_start", "k"], out))[-1] == (day(21), "a", 1)
    got = rows(events.run_to_end(counts, "w", ["window_start", "k"], out))
    assert not any(r[1] == "late" for r in got) and len(got) == 5
    q = counts.writeStream.outputMode("update").format("noop").option(
        "checkpointLocation", f"{out}/state2"
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < 5  # closed windows are evicted


def test_latest_rows_survive_a_restart(spark, tmp_path, monkeypatch):
    from verityloom.streaming import events

    monkeypatch.setattr(events, "COMPACT", 2)
    day = lambda n: dt.datetime(2020, 1, n)
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "u long, ts timestamp, k string"
    s = _feed(
        spark, src, schema,
        [[(1, day(1), "a"), (2, day(1), "b")], [(1, day(3), "a"), (1, day(2), "a")], [(4, day(1), "c")]]
    )
    assert rows(
        events.keep_latest(s, "t", ["u"], "ts", out).select("u", "ts")
    ) == [(1, day(3)), (2, day(1)), (4, day(1))]
    _feed(spark, src, schema, [[(2, day(5), "b")]])
    for _ in range(2):  # a second run without new rows changes nothing
        assert rows(
            events.keep_latest(s, "t", ["u"], "ts", out).select("u", "ts")
        ) == [(1, day(3)), (2, day(5)), (4, day(1))]
