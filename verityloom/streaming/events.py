"""Streams: windowed counts with a watermark, and a keyed table kept up to date batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verityloom.operators.keyed import first_per_key
from verityloom.session import shared_root

COMPACT = 16  # batches after which the changes are written as one new base


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can reach it: below spark.checkpoint.dir, or a temporary one in a local session."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def _complete(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Numbers of the folders `kind`=n that were written to the end, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [
        n for n in names if n.startswith(f"{kind}=") and fs.exists(
            spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")
        )
    ]
    return sorted(int(n.split("=")[1]) for n in done)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """(window_start, keys, n): rows per tumbling window; rows later than `late` behind the newest are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("window_start"), *keys, "n"
    )


def run_to_end(stream: DataFrame, name: str, keys: list[str], folder: str | None = None) -> DataFrame:
    """Run an aggregating stream over what is there now and return its rows, one per key.

    In update mode: a batch writes the groups that it changed, the watermark evicts the state of closed ones and keeps late
    rows out. A batch that is replayed overwrites its own folder. With a `folder` of an earlier run the stream goes on there.
    """
    spark = stream.sparkSession
    out = folder or shared_folder(spark, name)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    q = stream.writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", f"{out}/state"
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    done = _complete(spark, out, "batch")
    if not done:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema).option("basePath", out).parquet(
        *(f"{out}/batch={n}" for n in done)
    ).withColumn(
        "batch", F.regexp_extract("_metadata.file_path", r"batch=(\d+)", 1).cast("long")
    )
    return first_per_key(rows, keys, F.desc("batch")).drop("batch")


def keep_latest(stream: DataFrame, name: str, keys: list[str], version: str, folder: str | None = None) -> DataFrame:
    """The newest row of every key of a stream. Replaying a batch changes nothing.

    A batch writes only its own newest row per key, in a folder of its own; every COMPACT batches these are merged into a
    new base. What counts is read from the folders that were written to the end: the greatest base and the batches after
    it. With a `folder` of an earlier run, after a restart too, the stream goes on where it was.
    """
    spark = stream.sparkSession
    out = folder or shared_folder(spark, name)
    newest = lambda df: first_per_key(df, keys, F.desc(version), F.asc(F.xxhash64(*stream.columns)))

    def current(upto: int) -> DataFrame | None:
        base = [n for n in _complete(spark, out, "base") if n <= upto]
        parts = [f"{out}/base={n}" for n in base[-1:]] + [
            f"{out}/batch={n}" for n in _complete(spark, out, "batch") if n <= upto and not (base and n <= base[-1])
        ]
        return newest(spark.read.schema(stream.schema).parquet(*parts)) if parts else None

    def merge(batch: DataFrame, n: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")
        if n % COMPACT == COMPACT - 1:
            current(n).write.mode("overwrite").parquet(f"{out}/base={n}")

    q = stream.writeStream.foreachBatch(merge).option(
        "checkpointLocation", f"{out}/state"
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    got = current(1 << 62)
    return spark.createDataFrame([], stream.schema) if got is None else got
