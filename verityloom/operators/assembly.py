"""Records put together from elements and edges: evidence joins, rendering, inverted maps, guards and set comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verityloom.functions.rendering import annotation
from verityloom.operators.elements import outline
from verityloom.operators.keyed import first_per_key

# Fixed value: the line above derived text.
DERIVED = "Model-derived (unverified):\n"


def flip_box(x0: Column, y0: Column, x1: Column, y1: Column, height: Column) -> Column:
    """A box measured from the bottom left as one measured from the top left."""
    return F.struct(x0.alias("x0"), (height - y1).alias("y0"), x1.alias("x1"), (height - y0).alias("y1"))


def list_parents(items: DataFrame, doc: str, order: str, indent: str) -> DataFrame:
    """items with parent_order: the last item before it of less indent, whatever the depth; null at the top."""
    return outline(items.withColumn("_t", F.lit("")), doc, order, indent, "_t").drop("_t", "label_path")


def edges_with_evidence(edges: DataFrame, names: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges with the names of both ends and their least evidence, which may be missing."""
    n = lambda c: names.select(F.col("node_id").alias(c), F.col("name").alias(f"{c}_name"))
    first = first_per_key(evidence.select("edge_id", "evidence"), ["edge_id"], "evidence")
    return edges.join(n("src"), "src").join(n("dst"), "dst").join(first, "edge_id", "left").select(
        "edge_id",
        F.concat_ws(
            " ", F.col("src_name"), F.concat(F.lit("--["), F.col("predicate"), F.lit("]-->")), F.col("dst_name")
        ).alias("path"),
        "evidence"
    )


def retrieval_text(heading: Column, source: Column, derived: Column) -> Column:
    """What is embedded of a chunk: headings, source text and derived text, those that are there, apart by a blank line; null if none."""
    parts = F.array_compact(
        F.array(
            *(
                F.when(F.coalesce(F.trim(c), F.lit("")) != "", c) for c in (
                    heading, source, F.concat(F.lit(DERIVED), derived)
                )
            )
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n\n"))


def grouped_annotations(annotations: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, source_text, derived_text): annotations(kind, text, derived) of each element as they are shown, in order, by derivation.

    Identifiers are never shown; an element with nothing of a kind has null there.
    """
    x = annotations.withColumn("_s", annotation(F.col("kind"), F.col("text"), F.lit(False))).where("_s is not null")
    of = lambda on: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(on, F.struct(order, "_s")))), lambda s: s["_s"]), "\n"
    )
    g = x.groupBy(*keys).agg(of(~F.col("derived")).alias("source_text"), of(F.col("derived")).alias("derived_text"))
    return g.select(*keys, *(F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("source_text", "derived_text")))


def changed_rows(now: DataFrame, frozen: DataFrame, key: str, content: str) -> DataFrame:
    """(key, problem): rows whose content hash is not what frozen(key, content) says: changed, missing or unlisted."""
    x = now.select(key, F.col(content).alias("_n")).join(
        frozen.select(key, F.col(content).alias("_f")), key, "full_outer"
    )
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_f").isNull(), "unlisted").when(
        F.col("_n") != F.col("_f"), "changed"
    )
    return x.select(key, problem.alias("problem")).where("problem is not null")


def verdict(vector_hit: Column, graph_hit: Column) -> Column:
    """PASS if only the graph found the target; else who fell short."""
    return F.when(graph_hit & ~vector_hit, "PASS").when(
        ~graph_hit, "FAIL: graph did not find it"
    ).otherwise("FAIL: vector found it too")


def payload_hash(row_id: Column, vector: Column) -> Column:
    """Hash of an id with its vector written to eight places."""
    return F.sha2(
        F.concat(
            row_id.cast("string"), F.lit("|["),
            F.array_join(F.transform(vector.cast("array<double>"), lambda x: F.format_string("%.8f", x)), ","),
            F.lit("]")
        ),
        256
    )


def prompt(question: Column, blocks: Column) -> Column:
    """A question with its numbered evidence blocks."""
    numbered = F.array_join(
        F.transform(blocks, lambda b, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), b)), "\n"
    )
    return F.concat(F.lit("Question: "), question, F.lit("\nEvidence:\n"), numbered)


def no_duplicates(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """df, or an error that names up to five of the keys that occur more than once."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").orderBy(*keys).limit(5).collect()
    if twice:
        raise ValueError(f"{what}: " + ", ".join("/".join(str(r[k]) for k in keys) for r in twice))
    return df


def require_none(df: DataFrame, key: str, what: str) -> None:
    """Raise if df has rows, naming up to five."""
    bad = [str(r[0]) for r in df.select(key).distinct().orderBy(key).limit(5).collect()]
    if bad:
        raise ValueError(f"{what}: {', '.join(bad)}")


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many distinct rows only a and only b have, and whether the two are equal as sets."""
    a, b = a.distinct(), b.distinct()
    x = a.withColumn("_s", F.lit(1)).unionByName(
        b.withColumn("_s", F.lit(2))
    ).groupBy(*a.columns).agg(F.sum("_s").alias("s"))
    return x.agg(
        F.count_if(F.col("s") == 1).alias("only_left"), F.count_if(F.col("s") == 2).alias("only_right")
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def best_overlap(expected: DataFrame, observed: DataFrame, group: str, item: str) -> DataFrame:
    """(expected_group, observed_group, shared): the observed group that shares most items, ties by the least; none if none does."""
    e = expected.select(F.col(group).alias("expected_group"), item).distinct()
    o = observed.select(F.col(group).alias("observed_group"), item).distinct()
    shared = e.join(o, item).groupBy("expected_group", "observed_group").agg(F.count("*").alias("shared"))
    return first_per_key(shared, ["expected_group"], F.desc("shared"), "observed_group")


def first_on_path(paths: DataFrame, group: str, rank: str, edges: str, evidence: DataFrame) -> DataFrame:
    """(group, item, rank): items of the ranked paths' edges, each at its first occurrence by path rank and place on the path."""
    e = paths.select(
        group, rank, F.posexplode(edges).alias("pos", "edge_id")
    ).join(evidence.select("edge_id", "item"), "edge_id")
    once = e.groupBy(group, "item").agg(F.min(F.struct(rank, "pos")).alias("at"))
    return once.select(
        group, "item", F.row_number().over(Window.partitionBy(group).orderBy("at", "item")).alias("rank")
    )


def phrase_in_lines(lines: Column, phrase: Column) -> Column:
    """A phrase stands at word borders in the lines put together by blanks, so in one line or across lines that follow each other.

    Runs of white space count as one blank, in the phrase and in the lines, and case does not count.
    """
    one = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    quoted = F.concat(F.lit(r"(^|[^\p{L}\p{N}])\Q"), one(phrase), F.lit(r"\E($|[^\p{L}\p{N}])"))
    joined = one(F.array_join(lines, " "))
    return F.regexp_like(joined, quoted)
