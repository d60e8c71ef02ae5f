"""Whole passages, whole titles and all identifiers are sought."""

from verityloom.plans import documents, evidence


def write(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")


def test_whole_passages_titles_and_all_identifiers(spark, tmp_path):
    docs = [
        ("d1", "Field notes", "One fact. Another fact AB-1 and CD-2, CD-2 again"),
        ("d2", "One fact", "One fact. Field\nnotes. AB-12"), ("d3", "Field notes", "see Field\nnotes")
    ]
    write(spark, tmp_path, "documents", docs, "doc_id string, title string, text string")
    write(
        spark, tmp_path, "evaluation_items", [("i1", "One fact. Another fact"), ("i2", "see Field"), ("i3", None)],
        "item_id string, expected_supporting_passage string"
    )
    assert sorted(
        map(tuple, documents.passage_alignment(spark, str(tmp_path)).collect())
    ) == [("i1", 1, "d1"), ("i2", 1, "d3")]
    assert dict(
        map(tuple, evidence.phrases_recovered(spark, str(tmp_path)).collect())
    ) == {"d1": False, "d2": True, "d3": True}
    assert sorted(
        map(tuple, documents.identifier_occurrences(spark, str(tmp_path)).collect())
    ) == [("d1", "AB-1", 1), ("d1", "CD-2", 2), ("d2", "AB-12", 1)]
