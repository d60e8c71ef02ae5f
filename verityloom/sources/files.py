"""Files in and out: JSON contracts, JSON lines, checked binary files, HTML pages, Markdown and JSON reports."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_contract(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document with a strict schema; malformed files raise."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_json_lines(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """JSON lines of all files with their file name; a missing file raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths).withColumn(
        "source_file", F.element_at(F.split(F.input_file_name(), "/"), -1)
    )


def verified_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(file, problem): files whose SHA-256 differs from manifest(file, sha256), that it lacks, or that are missing."""
    got = spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("got")
    )
    x = got.join(manifest.select("file", "sha256"), "file", "full_outer")
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(
        F.col("got") != F.col("sha256"), "changed"
    )
    return x.select("file", problem.alias("problem")).where("problem is not null")


_BLOCK = re.compile(r"<(h[1-6]|p|li|td|th|caption)\b[^>]*>(.*?)</\1\s*>", re.I | re.S)


def html_elements(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, order_index, kind, level, text): headings, paragraphs, list items, cells and captions of HTML pages in order."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for at, page in enumerate(b.column(1).to_pylist()):
                for i, m in enumerate(_BLOCK.finditer(page or "")):
                    tag = m.group(1).lower()
                    text = html.unescape(re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", m.group(2)))).strip()
                    name = "heading" if tag[0] == "h" else {
                        "p": "paragraph", "li": "list_item", "td": "cell", "th": "header_cell", "caption": "caption"
                    }[tag]
                    rows.append((at, i, name, int(tag[1]) if tag[0] == "h" else None, text))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                    *(
                        pa.array([r[k] for r in rows], t) for k,
                        t in ((1, pa.int32()), (2, pa.string()), (3, pa.int32()), (4, pa.string()))
                    )
                ],
                names=["key", "order_index", "kind", "level", "text"]
            )

    return pages.select(key, markup).mapInArrow(
        run, f"key {kind}, order_index int, kind string, level int, text string"
    ).withColumnRenamed("key", key)


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; more than `limit` rows raise rather than being cut off."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write them with df.write instead")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    return "\n".join(
        [
            "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns),
            *("| " + " | ".join(map(cell, r)) + " |" for r in rows)
        ]
    )
