"""Texts as ordered elements: kinds, reading order, heading paths, packing, spans and one-to-one matching."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How the kinds of lines look.
LIST_ITEM = r"^\s*([-*\x{2022}]|\d+[.)])\s+\S"
HEADING = r"^\s*(\d+(\.\d+)*)\s+\p{Lu}[^.!?]*$"
DATED = r"^\s*\[?\d{4}-\d{2}-\d{2}\]?\s"


# Which of the elements at one place comes first.
TYPE_RANK = ("heading", "paragraph", "list_item", "dated_entry", "table", "picture")


def reading_order(df: DataFrame, doc: str, unit: str, order: str, kind: str, row_id: str) -> DataFrame:
    """df with position: by unit, place in it with what has none last, rank of the kind, and id."""
    rank = F.coalesce(*(F.when(F.col(kind) == k, F.lit(i)) for i, k in enumerate(TYPE_RANK)), F.lit(len(TYPE_RANK)))
    return df.withColumn(
        "position", F.row_number().over(Window.partitionBy(doc).orderBy(unit, F.asc_nulls_last(order), rank, row_id))
    )


@dataclass(frozen=True)
class ChunkingConfig:
    """How documents are put into chunks; its hash tells runs apart."""

    max_chars: int = 1200
    split_oversized: bool = True
    cross_unit: bool = False
    flush_on_heading: bool = True
    joint: str = "\n"

    def __post_init__(self) -> None:
        if self.max_chars < 1:
            raise ValueError("max_chars must be at least 1")

    def config_hash(self) -> str:
        return hashlib.sha256(
            json.dumps(asdict(self), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
        ).hexdigest()


def chunk(els: DataFrame, doc: str, config: ChunkingConfig = ChunkingConfig(), unit: str | None = None) -> DataFrame:
    """(doc, chunk_index, elements, first, heading_path, chunk_text): els(doc, order_index, kind, level, text) packed under a config.

    Oversized elements are split first, if the config says so, else kept whole. A heading begins a chunk, and so does a new
    unit (page or slide) unless chunks may cross units. A chunk has the heading path of its first element.
    """
    x = heading_paths(els, doc)
    x = split_long(
        x, "text", config.max_chars
    ).drop("text").withColumnRenamed("part_text", "text") if config.split_oversized else x.withColumn("part", F.lit(0))
    w = Window.partitionBy(doc).orderBy("order_index", "part")
    flush = (F.col("kind") == "heading") & (F.col("part") == 0) if config.flush_on_heading else F.lit(False)
    if unit and not config.cross_unit:
        flush = flush | ~F.col(unit).eqNullSafe(F.lag(unit).over(w))
    x = x.withColumn("_o", F.struct("order_index", "part")).withColumn("_f", flush)
    p = pack(x, doc, "_o", "text", config.max_chars, len(config.joint), "_f")
    said = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_o", "text"))), lambda s: s["text"]), config.joint
    )
    return p.groupBy(doc, F.col("pack_index").alias("chunk_index")).agg(
        F.count("*").alias("elements"), F.min("order_index").alias("first"),
        F.min_by("heading_path", "_o").alias("heading_path"), said.alias("chunk_text")
    )


def elements(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, order_index, kind, level, text): the non-blank lines of each text in order.

    kind is heading, list_item, dated_entry or paragraph. level is the depth of a numbered heading, and the indent of a
    list item in steps of two blanks. Built from JVM expressions only.
    """
    lines = df.select(
        F.col(doc), F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("order_index", "text")
    ).where(F.trim("text") != "")
    number = F.regexp_extract("text", HEADING, 1)
    kind = F.when(F.col("text").rlike(HEADING), "heading").when(
        F.col("text").rlike(LIST_ITEM), "list_item"
    ).when(F.col("text").rlike(DATED), "dated_entry").otherwise("paragraph")
    x = lines.withColumn("kind", kind)
    level = F.when(F.col("kind") == "heading", F.size(F.split(number, r"\."))).when(
        F.col("kind") == "list_item", (F.length(F.regexp_extract("text", r"^( *)", 1)) / 2).cast("int")
    )
    return x.select(doc, "order_index", "kind", level.alias("level"), F.trim("text").alias("text"))


def _streamed(df: DataFrame, doc: str, order: list[str], uses: list[str], state, schema: str) -> DataFrame:
    """df with new columns worked out row by row in the order of each doc, whose rows stream through sorted partitions.

    state() makes a function from (doc, values of the columns `uses`, of a whole batch) to the arrays of the new columns
    and is kept over batches, so a document of any number of rows needs no more memory than a batch and its state.
    """
    rows = df.repartition(doc).sortWithinPartitions(doc, *order)
    at = [rows.columns.index(c) for c in (doc, *uses)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = state()
        for b in batches:
            new = step(*(b.column(i).to_pylist() for i in at))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *new], names=[*b.schema.names, *(c.split()[0] for c in schema.split(","))]
            )

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", {schema}")


def outline(df: DataFrame, doc: str, order: str, level: str, label: str) -> DataFrame:
    """df with parent_order and label_path: where each row hangs in the outline that the levels make, of any depth.

    A row of level n ends those of level n and deeper before it; its parent is the last row before it of a lesser level,
    and its path the labels from the top down to its own, joined by ' > '. A row without a level hangs on the row before
    that is still open and has its path.
    """

    def state():
        doc_, open_ = object(), []

        def step(docs: list, orders: list, levels: list, labels: list) -> list[pa.Array]:
            nonlocal doc_, open_
            parents, paths = [], []
            for k, o, n, t in zip(docs, orders, levels, labels):
                if k != doc_:
                    doc_, open_ = k, []
                if n is not None:
                    while open_ and open_[-1][0] >= n:
                        open_.pop()
                parents.append(open_[-1][1] if open_ else None)
                if n is not None:
                    open_.append((n, o, f"{open_[-1][2]} > {t}" if open_ else t))
                paths.append(open_[-1][2] if open_ else "")
            return [pa.array(parents, pa.int32()), pa.array(paths, pa.string())]

        return step

    return _streamed(df, doc, [order], [order, level, label], state, "parent_order int, label_path string")


def heading_paths(els: DataFrame, doc: str) -> DataFrame:
    """els with heading_path, the headings above each element joined by ' > '; a heading ends those of its level and deeper."""
    x = els.withColumn("_l", F.when(F.col("kind") == "heading", F.col("level")))
    return outline(
        x, doc, "order_index", "_l", "text"
    ).drop("_l", "parent_order").withColumnRenamed("label_path", "heading_path")


def pack(
    df: DataFrame, doc: str, order: str, text: str, max_chars: int, joint: int = 1, breaks: str | None = None
) -> DataFrame:
    """df with pack_index: consecutive units of a document put together while their joined length stays within max_chars.

    A unit over the limit is a pack of its own. Where the boolean column `breaks` is true, as at a heading, a new unit of
    the source or a table that stands alone, a new pack begins whatever the length. A null text has no length.
    """
    x = df.withColumn("_n", F.coalesce(F.length(text), F.lit(0))).withColumn(
        "_b", F.coalesce(F.col(breaks), F.lit(False)) if breaks else F.lit(False)
    )

    def state():
        key, size, index = object(), 0, 0

        def step(docs: list, sizes: list, cut: list) -> list[pa.Array]:
            nonlocal key, size, index
            out = np.empty(len(docs), dtype=np.int32)
            for i, (k, n, b) in enumerate(zip(docs, sizes, cut)):
                if k != key:
                    key, size, index = k, n, 0
                elif b or size + joint + n > max_chars:
                    size, index = n, index + 1
                else:
                    size += joint + n
                out[i] = index
            return [pa.array(out)]

        return step

    return _streamed(x, doc, [order], ["_n", "_b"], state, "pack_index int").drop("_n", "_b")


def fragments(text: Column) -> Column:
    """array of sentences, each with the white space after it; put together they are the text. Built-in expressions only."""
    return F.regexp_extract_all(text, F.lit(r"(?s).*?[.!?]\s+(?=\S)|.+"), 0)


def split_long(df: DataFrame, text: str, limit: int) -> DataFrame:
    """df with (part, part_start, part_text): every text in parts of at most `limit` characters, cut between sentences.

    Sentences are put together while they fit. One over the limit is cut at white space, and a word over the limit stays
    whole: no word is ever cut. Together the parts are the text. A null or empty text gives one part, itself.
    """
    import re

    at = df.columns.index(text)
    sentence, word = re.compile(r"(?<=[.!?])\s+", re.ASCII), re.compile(r"\s+", re.ASCII)

    def cut(t: str, begin: int, end: int, rx: re.Pattern) -> list[tuple[int, int]]:
        ends = [m.end() for m in rx.finditer(t, begin, end) if m.end() < end]
        return list(zip([begin, *ends], [*ends, end]))

    def packed(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for a, z in spans:
            if out and z - out[-1][0] <= limit:
                out[-1] = (out[-1][0], z)
            else:
                out.append((a, z))
        return out

    def parts(t: str | None) -> list[tuple[int, int]]:
        if t is None or len(t) <= limit:
            return [(0, len(t or ""))]
        out: list[tuple[int, int]] = []
        for a, z in packed(cut(t, 0, len(t), sentence)):
            out += [(a, z)] if z - a <= limit else packed(cut(t, a, z, word))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            found = [parts(t) for t in texts]
            row = pa.array(np.repeat(np.arange(len(texts)), [len(f) for f in found]))
            number = pa.array([i for f in found for i in range(len(f))], pa.int32())
            start = pa.array([a for f in found for a, _ in f], pa.int32())
            piece = pa.array([None if t is None else t[a:z] for t, f in zip(texts, found) for a, z in f], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(row) for c in b.columns), number, start, piece],
                names=[*b.schema.names, "part", "part_start", "part_text"]
            )

    return df.mapInArrow(
        run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", part int, part_start int, part_text string"
    )


def one_to_one(
    expected: DataFrame, observed: DataFrame, keys: list[str], order_expected: str, order_observed: str
) -> DataFrame:
    """(keys, ordinal, expected, observed): the n-th expected of a key with its n-th observed; null where one side has no more."""
    nth = lambda df, c, name: df.select(
        *keys, F.row_number().over(Window.partitionBy(*keys).orderBy(c)).alias("ordinal"), F.col(c).alias(name)
    )
    return nth(expected, order_expected, "expected").join(
        nth(observed, order_observed, "observed"), [*keys, "ordinal"], "full_outer"
    )


def matched_by_value(
    expected: DataFrame, observed: DataFrame, keys: list[str], value: str, position: list[str]
) -> DataFrame:
    """(keys, value, expected, observed): one-to-one matches of equal value within a key, at the same position where there is one.

    expected and observed are structs of the position columns; null where one side has no more. Equal positions are matched
    first, the others in order of position. Null keys, values and positions are equal to each other.
    """
    on = [*keys, value]
    nth = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*on, *by).orderBy(*position)))

    def pair(a: DataFrame, b: DataFrame, by: list[str], how: str) -> DataFrame:
        a = nth(a, *by).select(
            *(F.col(c).alias(f"_a{c}") for c in [*on, *by, "_n"]), F.struct(*position).alias("expected")
        )
        b = nth(b, *by).select(
            *(F.col(c).alias(f"_b{c}") for c in [*on, *by, "_n"]), F.struct(*position).alias("observed")
        )
        j = a.join(b, [F.col(f"_a{c}").eqNullSafe(F.col(f"_b{c}")) for c in [*on, *by, "_n"]], how)
        return j.select(
            *(F.when(F.col("expected").isNull(), F.col(f"_b{c}")).otherwise(F.col(f"_a{c}")).alias(c) for c in on),
            "expected", "observed"
        )

    same = pair(expected, observed, position, "full_outer")
    left = same.where("observed is null").select(*on, "expected.*")
    right = same.where("expected is null").select(*on, "observed.*")
    return same.where("expected is not null and observed is not null").unionByName(pair(left, right, [], "full_outer"))


def contained(
    needles: DataFrame, needle_id: str, needle: str, df: DataFrame, doc: str, text: str, limit: int = 4_000_000
) -> DataFrame:
    """(needle_id, doc): which needles stand in which texts, by one pass of an automaton of all needles over each text.

    Needles of up to `limit` characters together are broadcast at a time, a longer one by itself; more are taken in as many
    passes as needed. Empty needles match nothing.
    """
    key = df.schema[doc].dataType.simpleString()
    out, block, size = None, [], 0

    def scan(rows: list[tuple[str, str]]) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            auto, by = ahocorasick.Automaton(), {}
            for i, n in shared.value:
                by.setdefault(n, []).append(i)
            for n, ids in by.items():
                auto.add_word(n, ids)
            auto.make_automaton()
            for b in batches:
                at, ids = [], []
                for row, t in enumerate(b.column(1).to_pylist()):
                    if t:
                        found = {i for _, group in auto.iter(t) for i in group}
                        ids += sorted(found)
                        at += [row] * len(found)
                if at:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.string()), b.column(0).take(pa.array(at))], names=["needle", "doc"]
                    )

        return df.select(doc, text).mapInArrow(run, f"needle string, doc {key}")

    for r in needles.select(
        F.col(needle_id).cast("string").alias("i"), F.col(needle).alias("n")
    ).where("n <> ''").toLocalIterator():
        if block and size + len(r["n"]) > limit:
            out, block, size = (scan(block) if out is None else out.unionByName(scan(block))), [], 0
        block.append((r["i"], r["n"]))
        size += len(r["n"])
    if block:
        out = scan(block) if out is None else out.unionByName(scan(block))
    if out is None:
        out = df.select(F.lit("").alias("needle"), F.col(doc).alias("doc")).limit(0)
    return out.distinct().select(F.col("needle").alias(needle_id), F.col("doc").alias(doc))
