"""Joins and set operations that keep an order or explain what is missing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.routes import ancestors


def longest_prefix(df: DataFrame, route: str, prefixes: DataFrame, prefix: str, value: str) -> DataFrame:
    """df with the value of the longest prefix that is the route or lies above it, whole segments only; else null.

    Each route is joined on its ancestors by equality, so nothing is compared with every prefix.
    """
    up = df.select(F.col(route).alias("_r")).distinct().withColumn("_p", F.explode(ancestors(F.col("_r"))))
    found = up.join(prefixes.select(F.col(prefix).alias("_p"), F.col(value).alias("_v")), "_p").groupBy("_r").agg(F.max_by("_v", F.length("_p")).alias(value))
    return df.join(found, df[route] == found["_r"], "left").drop("_r")


def dangling(children: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows of children whose key is set and has no parent."""
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def foreign_key_edges(tables: Mapping[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(source, target, type) from {type: (rows, source expression, target expression, type of edge)}; null ends give none."""
    out = None
    for rows, source, target, kind in tables.values():
        edges = rows.select(F.expr(source).alias("source"), F.expr(target).alias("target"), F.lit(kind).alias("type")).where("source is not null and target is not null")
        out = edges if out is None else out.unionByName(edges)
    return out


def projected_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id)."""
    source, target = nodes.select(F.col("id").alias("source")), nodes.select(F.col("id").alias("target"))
    return edges.join(source, "source", "left_semi").join(target, "target", "left_semi")


def in_given_order(ids: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Items of the ids, with the ids' positions: ids are (pos, key)."""
    return ids.join(items, key)


def ordered_union(*arrays: Column) -> Column:
    return F.array_distinct(F.concat(*arrays))


def distinct_ignoring_case(values: Column) -> Column:
    """The first spelling of each value, in order."""
    return F.aggregate(values, F.array().cast("array<string>"), lambda s, v: F.when(F.exists(s, lambda x: F.lower(x) == F.lower(v)), s).otherwise(F.concat(s, F.array(v))))


def bounded(values: Column, most: int) -> Column:
    """struct(kept, overflow): sorted distinct values, cut."""
    sorted_ = F.array_sort(F.array_distinct(values))
    return F.struct(F.slice(sorted_, 1, most).alias("kept"), (F.size(sorted_) > most).alias("overflow"))


def stale(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys that are stored and no longer wanted."""
    return current.select(key).distinct().join(new.select(key), key, "left_anti")


def carried_forward(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """new with the review that an unchanged predecessor had: status, correction and the action that records it.

    new has keys and content_hash; old also status and correction. Only equal hashes carry. A correction is recorded as
    correct, an approval as approve, any other decision as reject; pending rows without a correction carry nothing.
    """
    previous = old.select(*keys, F.col("content_hash").alias("_hash"), F.col("status").alias("_status"), F.col("correction").alias("_correction"))
    joined = new.join(previous, keys, "left")
    same = F.coalesce(F.col("content_hash") == F.col("_hash"), F.lit(False))
    carries = same & ((F.col("_status") != "pending") | F.col("_correction").isNotNull())
    action = F.when(carries, F.when(F.col("_correction").isNotNull(), "correct").when(F.col("_status") == "approved", "approve").otherwise("reject"))
    return joined.withColumns({
        "status": F.when(carries, F.col("_status")).otherwise("pending"), "correction": F.when(carries, F.col("_correction")), "action": action, "revision": F.when(carries, 1).otherwise(0),
    }).drop("_hash", "_status", "_correction")


def set_or_reset(log: DataFrame, key: str, order: Column, payload: Column, is_reset: Column) -> DataFrame:
    """(key, payload): the correction in force after a log, null if none or reset. Other actions change nothing.

    One aggregation: of the rows that set or reset, the last tells. No window, so a key with a third of all rows is
    pre-aggregated like any other.
    """
    last = F.max_by(F.struct(is_reset.alias("reset"), payload.alias("payload")), order)
    told = log.where(is_reset | payload.isNotNull()).groupBy(key).agg(last.alias("l"))
    return told.select(key, F.when(~F.col("l.reset"), F.col("l.payload")).alias("payload"))
