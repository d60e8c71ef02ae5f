"""Content-derived identities: SHA-256 over canonical JSON, built from column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """Compact JSON of the fields with sorted keys, nulls kept and non-ASCII characters unescaped."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def content_id(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def short_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """prefix + the first hex digits of the SHA-256 of the parts joined by '|'."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length))


def set_hash(*parts: Column, where: Column | None = None) -> Column:
    """Aggregate: an order-free hash of a group's rows, or of those for which `where` holds.

    Each row is hashed for itself and the first 60 bits of the row hashes are added up with their count, so partial
    sums combine in any order and no group is ever collected into one place.
    """
    row = F.conv(
        F.substring(
            F.sha2(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts)), 256), 1, 15
        ),
        16, 10
    ).cast("decimal(38,0)")
    if where is not None:
        return F.sha2(F.concat_ws("|", F.count_if(where).cast("string"), F.sum(F.when(where, row)).cast("string")), 256)
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.sum(row).cast("string")), 256)


def ordered_hash(order: Column, *parts: Column) -> Column:
    """Aggregate: a hash of a document's rows in their order, from the rows' own hashes; a document is small, a table is not."""
    row = F.sha2(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts)), 256)
    return F.sha2(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), row.alias("h")))), lambda s: s["h"]), "|"
        ),
        256
    )
