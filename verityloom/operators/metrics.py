"""Retrieval metrics for all queries and depths at once, with nulls kept apart from zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def question_metrics(hits: DataFrame, judged: DataFrame, ks: list[int]) -> DataFrame:
    """One row per query and depth: required, coverage, all_found, forbidden_share, reciprocal_rank, ndcg, matched.

    hits(query, item, rank); judged(query, item, kind) with kind 'required' or 'forbidden'. A query without required items
    has null coverage, all_found and ndcg; one without forbidden items has forbidden_share 0; the reciprocal rank is over the
    whole list and 0 without a hit. Judged rows repeated count once; only pairs that are both judged and hit are joined.
    """
    j = judged.select("query", "item", "kind").distinct()
    need = j.groupBy("query").agg(
        F.count_if(F.col("kind") == "required").alias("required"),
        F.count_if(F.col("kind") == "forbidden").alias("forbidden")
    )
    return scored_metrics(need, hits.join(j, ["query", "item"]), ks)


def scored_metrics(need: DataFrame, scored: DataFrame, ks: list[int]) -> DataFrame:
    """As question_metrics, from need(query, required, forbidden), how many items are judged so, and the judged hits alone.

    scored(query, item, rank, kind). Where what is judged follows a rule, as by a label, its pairs need never be written.
    `leaked` are the forbidden items among the hits.
    """
    rel, gain = F.col("kind") == "required", 1 / F.log2(F.col("rank") + 1)
    aggs = [F.coalesce(1 / F.min(F.when(rel, F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank")]
    for k in ks:
        at = F.col("rank") <= k
        aggs += [
            F.count_if(rel & at).alias(f"r{k}"), F.count_if(~rel & at).alias(f"f{k}"),
            F.coalesce(F.sum(F.when(rel & at, gain)), F.lit(0.0)).alias(f"d{k}"),
            F.array_sort(F.collect_set(F.when(rel & at, F.col("item")))).alias(f"m{k}"),
            F.array_sort(F.collect_set(F.when(~rel & at, F.col("item")))).alias(f"l{k}")
        ]
    per = need.join(scored.groupBy("query").agg(*aggs), "query", "left")
    each = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(k).alias("k"), F.coalesce(f"r{k}", F.lit(0)).alias("r"),
                    F.coalesce(f"f{k}", F.lit(0)).alias("f"), F.coalesce(f"d{k}", F.lit(0.0)).alias("d"),
                    F.coalesce(F.array_join(f"m{k}", ","), F.lit("")).alias("m"),
                    F.coalesce(F.array_join(f"l{k}", ","), F.lit("")).alias("l")
                ) for k in ks
            )
        )
    ).alias("e")
    ideal = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.least("k", "required").cast("int")), lambda i: 1 / F.log2(i + 1)),
        F.lit(0.0), lambda s, x: s + x
    )
    has = F.col("required") > 0
    return per.select("query", "required", "forbidden", F.coalesce("reciprocal_rank", F.lit(0.0)).alias("reciprocal_rank"), each).select("query", "required", "forbidden", "reciprocal_rank", "e.*").select(
        "query", "k", "required", F.round(F.try_divide("r", "required"), 6).alias("coverage"), F.when(has, F.col("r") == F.col("required")).alias("all_found"),
        F.round(F.coalesce(F.try_divide("f", "forbidden"), F.lit(0.0)), 6).alias("forbidden_share"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"),
        F.when(has, F.round(F.col("d") / ideal, 6)).alias("ndcg"), F.col("m").alias("matched"), F.col("l").alias("leaked"),
    )


def aggregate_metrics(per_question: DataFrame) -> DataFrame:
    """Means per depth: of coverage, all_found and ndcg over queries that have them (null if none), of the others 0 if none."""
    return per_question.groupBy("k").agg(
        F.count("*").alias("queries"), F.round(F.avg("coverage"), 6).alias("mean_coverage"), F.round(F.avg(F.col("all_found").cast("double")), 6).alias("all_rate"), F.round(F.avg("ndcg"), 6).alias("mean_ndcg"),
        F.round(F.coalesce(F.avg("forbidden_share"), F.lit(0.0)), 6).alias("mean_forbidden"), F.round(F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)), 6).alias("mrr"),
    )


def scorecard(facts: DataFrame, bucket: str, metric: str, hit: str, excluded: str) -> DataFrame:
    """Numerator, denominator, excluded and score per (bucket, metric) and over all buckets; the score is null over nothing."""
    sets = facts.groupingSets([[F.col(bucket), F.col(metric)], [F.col(metric)]], bucket, metric).agg(
        F.count_if(F.col(hit) & ~F.col(excluded)).alias("numerator"), F.count_if(~F.col(excluded)).alias("denominator"),
        F.count_if(F.col(excluded)).alias("excluded"), F.grouping(bucket).alias("g")
    )
    return sets.select(
        F.when(F.col("g") == 1, "overall").otherwise(F.coalesce(bucket, F.lit("none"))).alias("bucket"),
        F.col(metric).alias("metric"), "numerator", "denominator", "excluded",
        F.round(F.try_divide("numerator", "denominator"), 6).alias("score")
    )


def compare_runs(a: DataFrame, b: DataFrame, key: str, score: str, tolerance: float = 1e-9) -> DataFrame:
    """(key, a, b, outcome): improved, unchanged or regressed from a to b; null where either lacks a score."""
    x = a.select(key, F.col(score).alias("a")).join(b.select(key, F.col(score).alias("b")), key, "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return x.withColumn(
        "outcome",
        F.when(both & (F.col("b") > F.col("a") + tolerance), "improved").when(
            both & (F.col("b") < F.col("a") - tolerance), "regressed"
        ).when(both, "unchanged")
    )


def citation_checks(claims: DataFrame, retrieved: DataFrame, required: DataFrame) -> DataFrame:
    """Per query: claims, uncited, cited, invalid (not retrieved), required_cited and citation coverage (null if none required).

    claims(query, claim, cited array), retrieved(query, item), required(query, item).
    """
    cited = claims.select("query", F.explode("cited").alias("item")).distinct()
    per = claims.groupBy("query").agg(
        F.count("*").alias("claims"), F.count_if(F.coalesce(F.size("cited"), F.lit(0)) == 0).alias("uncited")
    )
    ok = cited.join(
        retrieved.select("query", "item", F.lit(True).alias("got")).distinct(), ["query", "item"], "left"
    ).groupBy("query").agg(F.count("*").alias("cited"), F.count_if(F.col("got").isNull()).alias("invalid"))
    need = required.select("query", "item").distinct().join(
        cited.withColumn("hit", F.lit(True)), ["query", "item"], "left"
    ).groupBy("query").agg(
        F.count("*").alias("required"), F.count_if("hit").alias("required_cited")
    )
    x = per.join(ok, "query", "left").join(need, "query", "left").fillna(
        0, ["cited", "invalid", "required", "required_cited"]
    )
    return x.withColumn("coverage", F.round(F.try_divide("required_cited", "required"), 6))


def chunk_scores(queries: DataFrame, hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query, required, found, coverage, all_found, reciprocal_rank, ndcg, outcome) at depth k, counted in chunks.

    queries(query), hits(query, item, rank), gold(query, item). Here a query without gold has coverage 1 and ndcg 0. The outcome
    is solved with all the gold, partial with some, failed with none of it.
    """
    g = gold.select("query", "item").distinct()
    need = queries.select("query").distinct().join(
        g.groupBy("query").agg(F.count("*").alias("required")), "query", "left"
    ).fillna(0, ["required"])
    got = hits.where(F.col("rank") <= k).join(g, ["query", "item"], "left_semi").groupBy("query").agg(
        F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("gain")
    )
    x = need.join(got, "query", "left").fillna(0, ["found"])
    ideal = F.aggregate(
        F.transform(
            F.sequence(F.lit(1), F.least(F.lit(k), F.col("required")).cast("int")), lambda i: 1 / F.log2(i + 1)
        ),
        F.lit(0.0), lambda s, y: s + y
    )
    some = F.col("required") > 0
    return x.select(
        "query", "required", "found", F.when(some, F.round(F.col("found") / F.col("required"), 6)).otherwise(1.0).alias("coverage"), (F.col("found") == F.col("required")).alias("all_found"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.when(some, F.round(F.coalesce("gain", F.lit(0.0)) / ideal, 6)).otherwise(0.0).alias("ndcg"),
        F.when(F.col("found") == F.col("required"), "solved").when(F.col("found") > 0, "partial").otherwise("failed").alias("outcome"),
    )
