"""Digests that name things."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(kind: str, *parts: Column) -> Column:
    """kind:<24 hex digits> of the parts' JSON array; null parts are null there."""
    each = [F.coalesce(F.to_json(F.array(p.cast("string"))), F.lit("[null]")) for p in parts]
    inner = F.concat_ws(",", *[F.when(p.isNull(), F.lit("null")).otherwise(e.substr(F.lit(2), F.length(e) - 2)) for p, e in zip(parts, each, strict=True)])
    return F.concat(F.lit(kind + ":"), F.substring(F.sha2(F.concat(F.lit("["), inner, F.lit("]")), 256), 1, 24))


def content_hash(**fields: Column) -> Column:
    """Digest of the fields as compact JSON, names in order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def joined_hash(*parts: Column) -> Column:
    """Digest of the parts joined by NUL: keys of nodes, edges and documents."""
    return F.sha2(F.concat_ws("\u0000", *[p.cast("string") for p in parts]), 256)


def set_hash(keys: Column) -> Column:
    """Aggregate: digest of the sorted distinct keys as a JSON array. The group's keys meet in one row: for bounded groups."""
    return F.sha2(F.to_json(F.array_sort(F.collect_set(keys))), 256)


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))
