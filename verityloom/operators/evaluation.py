"""How much of expected documents an ingestion has kept: facts, matches, structure, and why what is absent is absent.

Facts are rows (bucket, metric, id, hit, partial, excluded): what was expected, whether it was found, and what it is
counted under. All scores are sums over such rows, so every part of an evaluation is one union and one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verityloom.functions import hashing
from verityloom.functions.rendering import fact_matches
from verityloom.operators.assembly import no_duplicates, require_none


def fact_catalog(elements: DataFrame, document: str, keep: list[str]) -> DataFrame:
    """(keep..., fact_id, kind, level, order_index, norm): one fact per element, its identity from document, kind, place and norm.

    elements has document, kind, level, order_index and norm, a hash of the text as it is compared.
    """
    ident = hashing.content_id(
        document=F.col(document), kind=F.col("kind"), order_index=F.col("order_index"), text=F.col("norm")
    )
    return elements.select(*keep, ident.alias("fact_id"), "kind", "level", "order_index", "norm")


def text_matches(facts: DataFrame, observed: DataFrame, document: str) -> DataFrame:
    """facts with copies, first_at, same_kind and same_level: how an observed text of the document equals the fact's.

    observed(document, at, kind, level, norm) are the elements of the chunks. copies counts the equal ones, first_at is the
    least place of one; same_kind and same_level say whether any has the fact's kind, and its kind and level.
    """
    o = observed.groupBy(document, "norm", "kind", "level").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    f = facts.select(document, "norm", "kind", "level").distinct()
    j = f.join(
        o.select(document, "norm", F.col("kind").alias("ok"), F.col("level").alias("ol"), "n", "at"), [document, "norm"]
    )
    kind = F.col("kind") == F.col("ok")
    m = j.groupBy(document, "norm", "kind", "level").agg(
        F.sum("n").alias("copies"), F.min("at").alias("first_at"), F.bool_or(kind).alias("same_kind"),
        F.bool_or(kind & F.col("level").eqNullSafe(F.col("ol"))).alias("same_level")
    )
    on = (F.col("f.norm") == F.col("m.norm")) & (
        F.col(f"f.{document}") == F.col(f"m.{document}")
    ) & (F.col("f.kind") == F.col("m.kind")) & F.col("f.level").eqNullSafe(F.col("m.level"))
    x = facts.alias("f").join(m.alias("m"), on, "left")
    return x.select(
        "f.*", F.coalesce("m.copies", F.lit(0)).alias("copies"), "m.first_at",
        F.coalesce("m.same_kind", F.lit(False)).alias("same_kind"),
        F.coalesce("m.same_level", F.lit(False)).alias("same_level")
    )


def as_facts(
    df: DataFrame, bucket: Column | str, metric: str, fact_id: Column | str, hit: Column, partial: Column | None = None,
    excluded: Column | None = None
) -> DataFrame:
    no = F.lit(False)
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(
        c(bucket).alias("bucket"), F.lit(metric).alias("metric"), c(fact_id).cast("string").alias("id"),
        F.coalesce(hit, no).alias("hit"), F.coalesce(partial if partial is not None else no, no).alias("partial"),
        F.coalesce(excluded if excluded is not None else no, no).alias("excluded")
    )


def evaluation(facts: DataFrame) -> DataFrame:
    """(bucket, metric, hits, partials, misses, excluded, score, matched, missed) by bucket and metric, and overall.

    A partial match counts in the denominator only. matched and missed are order-free hashes of the id sets, which may be
    of any size; the score is null over nothing. A null bucket is 'none'.
    """
    hit, part, out = F.col("hit") & ~F.col("excluded"), F.col("partial") & ~F.col("hit") & ~F.col("excluded"), F.col("excluded")
    miss = ~F.col("hit") & ~F.col("partial") & ~out
    word = lambda on: hashing.set_hash(F.col("id"), where=on)
    g = facts.groupingSets([[F.col("bucket"), F.col("metric")], [F.col("metric")]], "bucket", "metric").agg(
        F.count_if(hit).alias("hits"), F.count_if(part).alias("partials"), F.count_if(miss).alias("misses"), F.count_if(out).alias("excluded"), word(hit).alias("matched"), word(miss).alias("missed"), F.grouping("bucket").alias("g")
    )
    score = F.round(F.try_divide(F.col("hits"), F.col("hits") + F.col("partials") + F.col("misses")), 6)
    return g.select(
        F.when(F.col("g") == 1, "overall").otherwise(F.coalesce("bucket", F.lit("none"))).alias("bucket"), "metric",
        "hits", "partials", "misses", "excluded", score.alias("score"), "matched", "missed"
    )


def absence(missing: DataFrame, document: str, joined: DataFrame, everywhere: DataFrame) -> DataFrame:
    """missing(document, norm, said, ...) with `reason`: what became of facts that no chunk holds as they are.

    split: the fact's text stands in the document's chunks put together, joined(document, whole), both normalised alike;
    elsewhere: another document's chunks hold it, everywhere(document, norm); lost: neither.
    """
    other = missing.select(document, "norm").distinct().join(
        everywhere.select(F.col(document).alias("_d"), "norm").distinct(), "norm"
    ).where(F.col("_d") != F.col(document)).select(document, "norm").distinct().withColumn("_e", F.lit(True))
    x = missing.join(joined, document, "left").join(other, [document, "norm"], "left")
    reason = F.when(
        F.coalesce(F.contains("whole", F.col("said")), F.lit(False)), "split"
    ).when(F.col("_e"), "elsewhere").otherwise("lost")
    return x.withColumn("reason", reason).drop("whole", "_e")


def following(anchors: DataFrame, others: DataFrame, document: str, order: str, carry: str) -> DataFrame:
    """anchors with `carry` of the first row of others that follows each before the next anchor, as a caption follows its picture; null if none."""
    both = anchors.select(
        document, order, F.lit(True).alias("_a"), F.lit(None).cast(others.schema[carry].dataType).alias("_c")
    ).unionByName(others.select(document, order, F.lit(False).alias("_a"), F.col(carry).alias("_c")))
    w = Window.partitionBy(document).orderBy(order, F.desc("_a"))
    x = both.withColumn("_n", F.sum(F.col("_a").cast("int")).over(w))
    first = x.where(~F.col("_a")).groupBy(document, "_n").agg(F.min_by("_c", order).alias(carry))
    return x.where("_a").join(first, [document, "_n"], "left").select(document, order, carry)


def span_scores(expected: DataFrame, observed: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, item, expected, observed, matched, missing, extra, merged): occurrences of identifiers matched one to one by count.

    missing ones whose place was taken by a longer identifier that begins with them and is in surplus are `merged`, as C-88
    read as C-88a.
    """
    c = lambda df, n: df.groupBy(*keys, item).agg(F.count("*").alias(n))
    x = c(expected, "expected").join(
        c(observed, "observed"), [*keys, item], "full_outer"
    ).fillna(0, ["expected", "observed"])
    x = x.withColumn("matched", F.least("expected", "observed")).withColumn(
        "missing", F.col("expected") - F.col("matched")
    ).withColumn("extra", F.col("observed") - F.col("matched"))
    stem = F.regexp_replace(item, "[A-Za-z]$", "")
    longer = x.where(
        (F.col("extra") > 0) & (stem != F.col(item))
    ).select(*keys, stem.alias(item), "extra").groupBy(*keys, item).agg(F.sum("extra").alias("_long"))
    x = x.join(longer, [*keys, item], "left")
    return x.withColumn("merged", F.least("missing", F.coalesce("_long", F.lit(0)))).drop("_long")


def supported_claims(claims: DataFrame, facts: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """claims with `supported`: whether some fact of the same keys agrees in all fields, numbers as numbers and else as text."""
    f = facts.select(*(F.col(k).alias(f"_k{k}") for k in keys), *(F.col(c).alias(f"_f{c}") for c in fields)).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys] + [
        fact_matches({c: F.col(c) for c in fields}, {c: F.col(f"_f{c}") for c in fields})
    ]
    asked = [*keys, *fields]
    yes = claims.select(*asked).distinct().join(f, on, "left_semi").select(
        *(F.col(c).alias(f"_y{c}") for c in asked), F.lit(True).alias("_yes")
    )
    return claims.join(yes, [F.col(c).eqNullSafe(F.col(f"_y{c}")) for c in asked], "left").select(
        *claims.columns, F.coalesce("_yes", F.lit(False)).alias("supported")
    )


def resolved_facts(wanted: DataFrame, catalog: DataFrame, group: str, fact: str) -> DataFrame:
    """wanted(group, fact) joined to the catalogue's row; a fact that the catalogue has twice or not at all raises, naming up to five."""
    no_duplicates(catalog.select(fact), [fact], "facts that occur more than once")
    require_none(wanted.select(fact).distinct().join(catalog.select(fact), fact, "left_anti"), fact, "unknown facts")
    return wanted.join(catalog, fact)
