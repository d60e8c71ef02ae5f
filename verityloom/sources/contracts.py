"""Tables by declared schema, corpora by profile, artifacts by manifest: what comes in is checked before it is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verityloom.sources import files

#: The tables of a corpus with its graph, by name.
SCHEMAS = {
    "documents": "document_id string not null, title string, document_type string, created_at timestamp",
    "chunks": "chunk_id string not null, document_id string not null, chunk_index int, chunk_text string, embedding array<float>",
    "entities": "entity_id string not null, entity_type string, canonical_name string, aliases array<string>",
    "edges": "edge_id string not null, source_entity_id string not null, relationship_type string, target_entity_id string not null",
    "evidence": "edge_id string not null, chunk_id string not null, evidence_text string",
    "artifacts": "artifact_id string not null, kind string, content string, embedding array<float>",
}


def create_tables(spark: SparkSession, folder: str, replace: bool = True) -> None:
    """Empty tables of all SCHEMAS below a folder; replace=False raises where one is there."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("overwrite" if replace else "error").parquet(f"{folder}/{name}")


def insert(spark: SparkSession, folder: str, name: str, rows: DataFrame | list[tuple]) -> int:
    """Append rows to a table under its schema and return how many; a null in a column that may have none raises."""
    schema = SCHEMAS[name]
    fields = [c.split()[0] for c in schema.replace("<", " <").split(", ")]
    df = spark.createDataFrame(rows, schema) if isinstance(rows, list) else rows.select(*fields)
    must = [c.split()[0] for c in schema.split(", ") if c.endswith("not null")]
    bad = F.lit(False)
    for c in must:
        bad = bad | F.col(c).isNull()
    if not df.where(bad).isEmpty():
        raise ValueError(f"{name}: null in one of {', '.join(must)}")
    n = df.count()
    df.write.mode("append").parquet(f"{folder}/{name}")
    return n


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def profile_problems(profiles: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(profile, problem, detail) of corpus profiles(profile, kind, fixtures array): an intact set gives no rows.

    repeated_fixture: a fixture twice in a profile; unknown_fixture: one that fixtures(fixture, ...) lacks; not_one_fixture: a
    profile of kind format_comparison whose fixtures are not of just one document(fixture, document); repeated_profile; empty.
    """
    each = profiles.select("profile", "kind", F.explode_outer("fixtures").alias("fixture"))
    n = each.where("fixture is not null").groupBy("profile", "fixture").agg(F.count("*").alias("n"))
    repeated = n.where("n > 1").select(
        "profile", F.lit("repeated_fixture").alias("problem"), F.col("fixture").alias("detail")
    )
    unknown = n.join(
        fixtures.select("fixture").distinct(), "fixture", "left_anti"
    ).select("profile", F.lit("unknown_fixture"), "fixture")
    docs = each.where("kind = 'format_comparison'").join(
        fixtures.select("fixture", "document").distinct(), "fixture", "left"
    ).groupBy("profile").agg(F.count_distinct("document").alias("d"))
    several = docs.where("d <> 1").select("profile", F.lit("not_one_fixture"), F.col("d").cast("string"))
    twice = profiles.groupBy("profile").agg(F.count("*").alias("n")).where("n > 1").select(
        "profile", F.lit("repeated_profile"), F.col("n").cast("string")
    )
    empty = profiles.where(F.coalesce(F.size("fixtures"), F.lit(0)) <= 0).select(
        "profile", F.lit("empty"), F.lit(None).cast("string")
    )
    return repeated.union(unknown).union(several).union(twice).union(empty)


def load_chunks(spark: SparkSession, root: str, fixtures: list[tuple[str, str, str]], schema: str) -> DataFrame:
    """JSON lines of (fixture, document, format) in the declared order, tagged with all three and their place; a missing file raises.

    The files are root/fixture.jsonl.
    """
    order = spark.createDataFrame(
        [(f"{f}.jsonl", i, f, d, k) for i, (f, d, k) in enumerate(fixtures)],
        "source_file string, place int, fixture string, document string, format string"
    )
    rows = files.read_json_lines(spark, [f"{root.rstrip('/')}/{f}.jsonl" for f, _, _ in fixtures], schema)
    return rows.join(F.broadcast(order), "source_file").drop("source_file")  # one row per declared fixture


def load_artifacts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(file, sha256, document) of every JSON file of a folder: the hash is of the bytes as they are; one that does not parse raises."""
    raw = spark.read.format("binaryFile").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"),
        F.from_json(F.col("content").cast("string"), schema, {"mode": "FAILFAST"}).alias("document")
    )
    return raw


def write_reports(df: DataFrame, folder: str, title: str, limit: int = 1000) -> None:
    """A small result three ways from one read: folder/report.md, .json and .html; more than `limit` rows raise rather than being cut."""
    import html
    import json
    import os

    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write them with df.write instead")
    os.makedirs(folder, exist_ok=True)
    cells = [["" if r[c] is None else str(r[c]) for c in df.columns] for r in rows]
    mark = lambda x: x.replace("|", "\\|").replace("\n", " ")
    lines = [
        f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns),
        *("| " + " | ".join(map(mark, r)) + " |" for r in cells)
    ]
    row = lambda tag, r: "<tr>" + "".join(f"<{tag}>{html.escape(x)}</{tag}>" for x in r) + "</tr>"
    page = f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{row('th', df.columns)}{''.join(row('td', r) for r in cells)}</table>"
    for name, text in (
        ("md", "\n".join(lines) + "\n"),
        ("json", json.dumps({"title": title, "rows": rows}, default=str, ensure_ascii=False)), ("html", page)
    ):
        with open(os.path.join(folder, f"report.{name}"), "w", encoding="utf-8") as f:
            f.write(text)
