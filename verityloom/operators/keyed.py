"""Keyed tables: latest row per key, upserts, insert-if-absent, append logs, change counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verityloom.session import cut_lineage


def first_per_key(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in a total order; null keys are keys. Windows with a rank limit prune before the shuffle."""
    return df.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ).where("_rn = 1").drop("_rn")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], *latest: Column | str) -> DataFrame:
    """Target with the changes written over it: per key the latest change replaces the row, new keys are added."""
    newest = first_per_key(changes, keys, *latest)
    cond = [target[k].eqNullSafe(newest[k]) for k in keys]
    return target.join(newest, cond, "left_anti").unionByName(newest, allowMissingColumns=True)


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: list[str], *first: Column | str) -> DataFrame:
    """Target with the rows whose keys it lacks; of several such rows of a key the first in order is taken."""
    fresh = first_per_key(rows, keys, *first)
    return target.unionByName(fresh.join(target, [fresh[k].eqNullSafe(target[k]) for k in keys], "left_anti"))


def numbered(df: DataFrame, name: str, *order: Column | str, start: int = 1) -> DataFrame:
    """A gap-free serial number in the given order, by a range sort and per-partition offsets rather than one task.

    The sorted rows are checkpointed first: a lost executor must not lead to other ranges. The order must be total, else
    equal rows take their numbers in any order.
    """
    parts = cut_lineage(
        df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    )
    sizes = parts.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect()  # one row per partition
    before, offsets = start, []
    for r in sizes:
        offsets.append((r["_p"], before))
        before += r["n"]
    at = F.broadcast(df.sparkSession.createDataFrame(offsets, "_p int, _at long"))
    return parts.join(at, "_p").select(
        *df.columns, (F.col("_at") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))).alias(name)
    )


def append_numbered(target: DataFrame, rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """A log with rows appended to it: they take the serial numbers after the greatest there is, in the given order, without a gap."""
    last = target.agg(F.max(name)).first()[0] or 0
    return target.unionByName(numbered(rows, name, *order, start=last + 1))


def change_counts(existing: DataFrame, incoming: DataFrame, key: str, content: str, text: str) -> DataFrame:
    """One row: candidates, blank, unchanged, changed, added. A second run over its own result counts no change."""
    old = existing.select(F.col(key).alias("_k"), F.col(content).alias("_c"))
    blank = F.coalesce(F.regexp_replace(text, r"\s+", ""), F.lit("")) == ""
    x = incoming.join(old, incoming[key] == F.col("_k"), "left")
    same = F.col("_k").isNotNull() & F.col(content).eqNullSafe(F.col("_c"))
    return x.agg(
        F.count("*").alias("candidates"), F.count_if(blank).alias("blank"),
        F.count_if(~blank & same).alias("unchanged"),
        F.count_if(~blank & F.col("_k").isNotNull() & ~same).alias("changed"),
        F.count_if(~blank & F.col("_k").isNull()).alias("added")
    )
