"""Mixing sources to target weights over a time-varying curriculum.

Each source has a weight schedule over the training time from 0 to 1. Its integral is the source's cumulative demand of
tokens; the documents of the source, laid end to end and repeated as allowed, are given the time at which the demand
reaches their first token, which is the inverse of that integral. The mix is the range-sort of all sources by that time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANK_BYTES = 1 << 24
BUCKETS = 1024
LISTED = 10_000  # as many listed sources are broadcast; more are joined by a shuffle


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=pairs, special_tokens={})


def token_counts(df: DataFrame, doc: str, source: str, text: str, tokenizer: str | None = None) -> DataFrame:
    """(doc, source, tokens) of every row: the tokens of the whole text; 0 for a null text.

    The vocabulary is a rank file that only the driver reads; its bytes are broadcast, and one of more than RANK_BYTES
    raises. Its path is `tokenizer`, else the session's spark.verityloom.tokenizer, else TOKENIZER.
    """
    key, spark = df.schema[doc].dataType.simpleString(), df.sparkSession
    path = tokenizer or spark.conf.get("spark.verityloom.tokenizer", TOKENIZER)
    with open(path, "rb") as f:
        ranks = f.read(RANK_BYTES + 1)
    if len(ranks) > RANK_BYTES:
        raise ValueError(f"{path} has more than {RANK_BYTES} bytes")
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(shared.value, PATTERN)
        for b in batches:
            n = np.fromiter(
                (len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()), dtype=np.int64,
                count=b.num_rows
            )
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], names=["doc", "source", "tokens"])

    return df.select(
        F.col(doc).alias("doc"), F.col(source).cast("string").alias("source"), F.col(text).alias("t")
    ).mapInArrow(run, f"doc {key}, source string, tokens long")


def demands(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per listed source: what it is to give.

    (source, target_weight, max_repeats, documents, tokens, budget, wanted, due). The budget is the tokens of all rows of
    listed sources; wanted is the weight's part of it, and due the lesser of it and the tokens times max_repeats.

    Rows with a null or unlisted source take no part. A null weight or number of repeats counts as 0 and so does a
    source's lack of documents. A source listed more than once counts once, with its greatest weight and repeats.
    """
    t = targets.where("source is not null").groupBy(F.col("source").cast("string").alias("source")).agg(
        F.coalesce(F.max("target_weight"), F.lit(0.0)).alias("target_weight"),
        F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats")
    )
    per = counts.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    r = t.join(per, "source", "left").fillna(0, ["documents", "tokens"])
    one = Window.partitionBy(F.lit(1))  # rows here are listed sources, not documents
    r = r.withColumn("budget", F.sum("tokens").over(one)).withColumn("wanted", F.col("target_weight") * F.col("budget"))
    return r.withColumn("due", F.least("wanted", (F.col("tokens") * F.col("max_repeats")).cast("double")))


def shares(drawn: DataFrame, demand: DataFrame) -> DataFrame:
    """One row per listed source: what the rows drawn by `curriculum` really reach.

    The columns of `demands` without due, then drawn (copies), used (their tokens), last_position, repeats (used over the
    source's tokens), actual_share (of all used tokens) and falls_short: the source's copies run out before its demand
    does, so that the used tokens are fewer than wanted. Sources without a drawn row have used 0 and no last_position.
    """
    per = drawn.groupBy("source").agg(
        F.count("*").alias("drawn"), F.sum("tokens").alias("used"), F.max("position").alias("last_position")
    )
    r = demand.drop("due").join(per, "source", "left").fillna(0, ["drawn", "used"])
    all_ = F.sum("used").over(Window.partitionBy(F.lit(1)))  # listed sources again
    return r.select(
        "*", F.coalesce(F.try_divide("used", "tokens"), F.lit(0.0)).alias("repeats"),
        F.coalesce(F.try_divide("used", all_), F.lit(0.0)).alias("actual_share"),
        (F.col("used") < F.col("wanted")).alias("falls_short")
    )


def ramp(share: DataFrame, tilt: float = 0.5) -> DataFrame:
    """A schedule (source, time, factor): sources of great weight fade from 1 + tilt to 1 - tilt, those of small weight rise."""
    order = F.percent_rank().over(Window.partitionBy(F.lit(1)).orderBy("target_weight", "source"))
    lean = (2 * F.col("order") - 1) * tilt
    return share.select("source", order.alias("order")).select(
        "source",
        F.explode(
            F.array(
                F.struct(F.lit(0.0).alias("time"), (1 + lean).alias("factor")),
                F.struct(F.lit(1.0).alias("time"), (1 - lean).alias("factor"))
            )
        ).alias("s")
    ).select("source", "s.*")


def _segments(share: DataFrame, schedule: DataFrame) -> DataFrame:
    """(source, segs): per source the linear pieces of its schedule with the demand up to each, scaled to the tokens due."""
    w = Window.partitionBy("source").orderBy("time")
    s = schedule.select(
        "source", F.col("time").alias("t0"), F.col("factor").alias("f0"), F.lead("time").over(w).alias("t1"),
        F.lead("factor").over(w).alias("f1")
    ).where("t1 > t0")
    area = (F.col("f0") + F.col("f1")) / 2 * (F.col("t1") - F.col("t0"))
    s = s.withColumn("area", area).withColumn(
        "d0", F.sum("area").over(Window.partitionBy("source").orderBy("t0")) - F.col("area")
    ).withColumn("whole", F.sum("area").over(Window.partitionBy("source")))
    packed = s.where("whole > 0 and area > 0").groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct("d0", "t0", "t1", "f0", "f1", "area"))).alias("segs"),
        F.first("whole").alias("whole")
    )
    return share.select("source", "due", F.col("tokens").alias("whole_tokens"), "max_repeats").join(packed, "source")


def _time(demand: Column, segs: Column) -> Column:
    """The time at which the integral of the schedule reaches demand: a root of the quadratic of its segment."""
    seg = F.element_at(F.filter(segs, lambda s: s["d0"] <= demand), -1)
    slope = (seg["f1"] - seg["f0"]) / (seg["t1"] - seg["t0"])
    x = demand - seg["d0"]
    root = F.sqrt(F.greatest(F.lit(0.0), seg["f0"] * seg["f0"] + 2 * slope * x))
    return seg["t0"] + F.coalesce(F.try_divide(2 * x, seg["f0"] + root), F.lit(0.0))


def curriculum(
    counts: DataFrame, targets: DataFrame, schedule: DataFrame | None = None, demand: DataFrame | None = None
) -> DataFrame:
    """(position, source, doc, copy, tokens), sorted by position: the mix in training order.

    position is the training time in [0, 1) at which the document begins; a document appears once per copy, at most
    max_repeats times, and the copies of a source end where the tokens due (see demands) do, so the last may overshoot
    by less than one document. schedule(source, time, factor) gives piecewise linear weights, by default `ramp`.

    Within a source documents follow the hash of their id. The running sums are taken within hash buckets and over the
    bounded number of buckets, so a source that holds most rows is spread over tasks. Rows with a null or unlisted
    source, and documents without tokens, are not drawn.
    """
    demand = demands(counts, targets) if demand is None else demand
    segs = _segments(demand, ramp(demand) if schedule is None else schedule).where("due > 0 and max_repeats > 0")
    if targets.select("source").distinct().count() <= LISTED:
        segs = F.broadcast(segs)
    docs = counts.where(
        "source is not null and tokens > 0"
    ).withColumn("h", F.xxhash64("doc")).withColumn("b", F.pmod("h", F.lit(BUCKETS)))
    base = docs.groupBy("source", "b").agg(F.sum("tokens").alias("s"))
    base = base.select(
        "source", "b", (F.sum("s").over(Window.partitionBy("source").orderBy("b")) - F.col("s")).alias("base")
    )
    inner = F.sum("tokens").over(
        Window.partitionBy("source", "b").orderBy("h", "doc").rowsBetween(Window.unboundedPreceding, -1)
    )
    at = docs.withColumn("inner", F.coalesce(inner, F.lit(0))).join(base, ["source", "b"]).select(
        "source", "doc", F.col("tokens").alias("n"), (F.col("base") + F.col("inner")).alias("at")
    )
    most = F.least(F.col("max_repeats") - 1, F.ceil(F.col("due") / F.col("whole_tokens")) - 1).cast("int")
    drawn = at.join(segs, "source").withColumn("copy", F.explode(F.sequence(F.lit(0), most)))
    start = F.col("at") + F.col("copy").cast("long") * F.col("whole_tokens")
    drawn = drawn.where(start < F.col("due"))
    return drawn.select(
        _time(start / F.col("due") * F.col("whole"), F.col("segs")).alias("position"), "source", "doc", "copy",
        F.col("n").alias("tokens")
    ).orderBy("position", "source", "doc", "copy")
