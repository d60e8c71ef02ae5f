import json

import pytest
from pyspark.sql import functions as F

from verityloom.functions import rendering
from verityloom.operators import assembly, elements, evaluation
from verityloom.sources import contracts


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_matches_by_text_kind_and_level(spark):
    facts = spark.createDataFrame(
        [
            ("d", "f1", "heading", 1, "n1"), ("d", "f2", "heading", 2, "n2"), ("d", "f3", "paragraph", None, "n3"),
            ("e", "f4", "paragraph", None, "n1")
        ],
        "doc string, fact_id string, kind string, level int, norm string"
    )
    seen = spark.createDataFrame(
        [("d", 3, "heading", 1, "n1"), ("d", 1, "paragraph", None, "n1"), ("d", 2, "heading", 3, "n2")],
        "doc string, at int, kind string, level int, norm string"
    )
    got = {
        r.fact_id: (
            r.copies, r.first_at, r.same_kind, r.same_level
        ) for r in evaluation.text_matches(facts, seen, "doc").collect()
    }
    assert got == {
        "f1": (2, 1, True, True), "f2": (1, 2, True, False), "f3": (0, None, False, False),
        "f4": (0, None, False, False)
    }


def test_scores_count_partials_in_the_denominator_only(spark):
    f = spark.createDataFrame(
        [
            ("b", "1", True, False, False), ("b", "2", False, True, False), (None, "3", False, False, False),
            ("b", "4", False, False, True)
        ],
        "bucket string, id string, h boolean, p boolean, e boolean"
    )
    x = evaluation.as_facts(f, "bucket", "m", "id", F.col("h"), F.col("p"), F.col("e"))
    got = {r.bucket: (r.hits, r.partials, r.misses, r.excluded, r.score) for r in evaluation.evaluation(x).collect()}
    assert got == {"b": (1, 1, 0, 1, 0.5), "none": (0, 0, 1, 0, 0.0), "overall": (1, 1, 1, 1, 0.333333)}
    assert evaluation.evaluation(x.where("excluded")).where("bucket = 'b'").first().score is None
    same = lambda d: [r.matched for r in evaluation.evaluation(d).where("bucket = 'overall'").collect()]
    assert same(x) == same(x.where("hit")) and evaluation.evaluation(x.limit(0)).where(
        "bucket <> 'overall'"
    ).collect() == []


def test_why_facts_are_absent(spark):
    missing = spark.createDataFrame(
        [("d", "h1", "split line"), ("d", "h2", "moved"), ("d", "h3", "gone"), ("z", "h9", "no chunks")],
        "doc string, norm string, said string"
    )
    joined = spark.createDataFrame([("d", "a split line b")], "doc string, whole string")
    other = spark.createDataFrame([("e", "h2"), ("d", "h3")], "doc string, norm string")
    assert {
        r.norm: r.reason for r in evaluation.absence(missing, "doc", joined, other).collect()
    } == {"h1": "split", "h2": "elsewhere", "h3": "lost", "h9": "lost"}


def test_following_spans_and_claims(spark):
    a = spark.createDataFrame([("d", 1), ("d", 5), ("d", 9), ("e", 1)], "doc string, o int")
    b = spark.createDataFrame(
        [("d", 0, "before"), ("d", 2, "one"), ("d", 3, "two"), ("d", 9, "same place"), ("f", 1, "x")],
        "doc string, o int, t string"
    )
    assert rows(evaluation.following(a, b, "doc", "o", "t")) == [
        ("d", 1, "one"), ("d", 5, None), ("d", 9, "same place"), ("e", 1, None)
    ]
    e = spark.createDataFrame([("d", "C-88"), ("d", "C-88"), ("d", "C-9")], "doc string, i string")
    o = spark.createDataFrame([("d", "C-88"), ("d", "C-88a"), ("d", "C-7")], "doc string, i string")
    got = {r.i: (r.matched, r.missing, r.extra, r.merged) for r in evaluation.span_scores(e, o, ["doc"], "i").collect()}
    assert got == {"C-88": (1, 1, 0, 1), "C-9": (0, 1, 0, 0), "C-88a": (0, 0, 1, 0), "C-7": (0, 0, 1, 0)}
    c = spark.createDataFrame(
        [("k", "17.0", "Yes "), ("k", "18", "yes"), ("k", None, None), (None, "17", "yes")],
        "k string, v string, t string"
    )
    f = spark.createDataFrame(
        [("k", "17", "yes"), ("k", None, None), ("k", "17", "yes")], "k string, v string, t string"
    )
    assert sorted(
        (str(r.v), r.supported) for r in evaluation.supported_claims(c, f, ["k"], ["v", "t"]).collect()
    ) == [("17", False), ("17.0", True), ("18", False), ("None", True)]


def test_catalogues_must_know_each_fact_once(spark):
    w = spark.createDataFrame([("g", "a")], "g string, f string")
    one = spark.createDataFrame([("a", 1)], "f string, v int")
    assert rows(evaluation.resolved_facts(w, one, "g", "f")) == [("a", "g", 1)]
    with pytest.raises(ValueError, match="more than once: a"):
        evaluation.resolved_facts(w, one.union(one), "g", "f")
    with pytest.raises(ValueError, match="unknown facts: a"):
        evaluation.resolved_facts(w, one.limit(0), "g", "f")


def test_rendering(spark):
    df = spark.createDataFrame([([["a|b", None], ["x", "y"]], "t", 2)], "r array<array<string>>, t string, n int")
    r = df.select(
        rendering.table_text(F.col("r")), rendering.list_item(F.col("t"), F.col("n"), F.lit(True), F.lit(3)),
        rendering.list_item(F.lit(None), F.lit(None), F.lit(False), F.lit(None)),
        rendering.visual_fact(F.lit("s"), F.lit("a"), F.lit("1"), F.lit(None)),
        rendering.diagram_edge(F.lit("x"), F.lit("to"), F.lit("y")),
        rendering.diagram_edge(F.lit("x"), F.lit(None), F.lit("y"))
    ).first()
    assert tuple(r) == ("| a\\|b |  |\n| x | y |", "    3. t", "- ", "s: a = 1", "x -[to]-> y", "x -> y")
    p = spark.createDataFrame(
        [("a/b.txt",), ("/a",), ("a/../b",), ("C:/a",), ("a\\b",), ("",), (None,), ("..a/b",)], "p string"
    )
    assert [
        x[0] for x in p.select(rendering.portable_path(F.col("p"))).collect()
    ] == [True, False, False, False, False, False, False, True]
    a = spark.createDataFrame(
        [
            ("d", 2, "ocr", "two", True), ("d", 1, "caption", "one", False), ("d", 3, "identifier", "C-1", False),
            ("e", 1, "identifier", "C-1", True)
        ],
        "d string, o int, kind string, text string, derived boolean"
    )
    assert rows(assembly.grouped_annotations(a, ["d"], "o")) == [("d", "Caption: one", "Text in picture: two")]
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, h string")
    was = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3")], "k string, h string")
    assert rows(assembly.changed_rows(now, was, "k", "h")) == [("b", "changed"), ("c", "missing")]


def test_chunking_under_a_config(spark):
    t = "1 A\n" + "one two. " * 4 + "\n2 B\nx\ny"
    els = elements.elements(
        spark.createDataFrame([("d", t), ("e", None)], "doc string, t string"), "doc", "t"
    ).withColumn("page", F.when(F.col("text") == "y", 2).otherwise(1))
    got = elements.chunk(els, "doc", elements.ChunkingConfig(max_chars=20), "page").orderBy("chunk_index").collect()
    assert [r.chunk_text for r in got] == [
        "1 A", "one two. one two. ", "one two. one two."
    ] + ["2 B\nx", "y"] and [r.heading_path for r in got][-1] == "2 B"
    whole = elements.chunk(
        els, "doc", elements.ChunkingConfig(max_chars=20, split_oversized=False, cross_unit=True), "page"
    ).orderBy("chunk_index").collect()
    assert [r.chunk_text for r in whole] == ["1 A", ("one two. " * 4).strip(), "2 B\nx\ny"]
    c = elements.ChunkingConfig()
    assert c.config_hash() == elements.ChunkingConfig().config_hash() != elements.ChunkingConfig(max_chars=9).config_hash()
    with pytest.raises(ValueError):
        elements.ChunkingConfig(max_chars=0)


def test_contracts(spark, tmp_path):
    folder = str(tmp_path / "corpus")
    contracts.create_tables(spark, folder)
    assert contracts.insert(
        spark, folder, "edges", [("e1", "a", "runs", "b")]
    ) == 1 and rows(contracts.read(spark, folder, "edges")) == [("e1", "a", "runs", "b")]
    with pytest.raises(ValueError, match="null in one of"):
        contracts.insert(
            spark, folder, "entities",
            spark.createDataFrame(
                [(None, "t", "n", ["x"])],
                "entity_id string, entity_type string, canonical_name string, aliases array<string>"
            )
        )
    with pytest.raises(Exception, match="exists"):
        contracts.create_tables(spark, folder, replace=False)
    p = spark.createDataFrame(
        [
            ("a", "x", ["f1", "f1", "f9"]), ("b", "format_comparison", ["f1", "f3"]),
            ("c", "format_comparison", ["f1", "f2"]), ("c", "x", ["f3"]), ("d", "x", [])
        ],
        "profile string, kind string, fixtures array<string>"
    )
    f = spark.createDataFrame([("f1", "d1"), ("f2", "d1"), ("f3", "d2")], "fixture string, document string")
    assert {(r.profile, r.problem) for r in contracts.profile_problems(p, f).collect()} == {
        ("a", "repeated_fixture"), ("a", "unknown_fixture"), ("b", "not_one_fixture"), ("c", "repeated_profile"),
        ("d", "empty")
    }
    for n in ("f2", "f1"):
        (tmp_path / f"{n}.jsonl").write_text(json.dumps({"chunk_id": n}) + "\n")
    got = contracts.load_chunks(spark, str(tmp_path), [("f2", "d1", "pdf"), ("f1", "d1", "docx")], "chunk_id string")
    assert [
        tuple(r) for r in got.orderBy("place").select("chunk_id", "place", "fixture", "format").collect()
    ] == [("f2", 0, "f2", "pdf"), ("f1", 1, "f1", "docx")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        contracts.load_chunks(spark, str(tmp_path), [("nowhere", "d", "k")], "chunk_id string").collect()
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "a.json").write_text('{"n": 3}')
    assert [r.document.n for r in contracts.load_artifacts(spark, str(tmp_path / "json"), "n int").collect()] == [3]
    contracts.write_reports(
        spark.createDataFrame([("a|b", None, 1.5)], "x string, y string, z double"), str(tmp_path / "out"), "T & U"
    )
    assert "| a\\|b |  | 1.5 |" in (tmp_path / "out" / "report.md").read_text() and json.loads(
        (tmp_path / "out" / "report.json").read_text()
    )["rows"][0]["z"] == 1.5 and "T &amp; U" in (tmp_path / "out" / "report.html").read_text()
    with pytest.raises(ValueError, match="more than 1 rows"):
        contracts.write_reports(spark.range(3), str(tmp_path / "out"), "T", limit=1)
