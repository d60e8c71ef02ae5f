"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is all zero, an error if their lengths differ, null if either is null."""
    same = F.when(a.isNull() | b.isNull() | (F.size(a) == F.size(b)), dot(a, b)).otherwise(
        F.raise_error(F.lit("vectors of different lengths")).cast("double")
    )
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(
        F.coalesce(F.try_divide(same, norm(a) * norm(b)), F.lit(0.0))
    )


def hashed_embedding(text: Column, dim: int = 32) -> Column:
    """A deterministic unit vector of a text from SHA-256, four bytes a number: for tests of retrieval without a model."""
    blocks = -(-dim * 8 // 64)
    hexes = F.concat(*(F.sha2(F.concat(text, F.lit(f"|{i}")), 256) for i in range(blocks)))
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.conv(F.substring(hexes, i * 8 + 1, F.lit(8)), 16, 10).cast("double") / F.lit(2.0**31) - 1
    )
    once = F.array(F.struct(raw.alias("r"), norm(raw).alias("n")))  # so that the length is not worked out for every number
    return F.transform(once, lambda s: F.transform(s["r"], lambda x: x / s["n"]))[0]
