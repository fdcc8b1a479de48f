"""Latest rows, quotas, runs and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order, which must have no ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def latest_or_mixed(df: DataFrame, key: str, at: str, kind: Column) -> DataFrame:
    """For each key the kind of its newest rows, or MIXED if those that share the newest time differ.

    The newest time and the kinds at it are found by one aggregation of (time, kinds) pairs: no window over a hot key.
    """
    by_time = df.groupBy(key, at).agg(F.count_distinct(kind).alias("kinds"), F.min(kind).alias("kind"))
    newest = by_time.groupBy(key).agg(F.max_by(F.struct("kinds", "kind"), at).alias("l"))
    return newest.select(key, F.when(F.col("l.kinds") > 1, "MIXED").otherwise(F.col("l.kind")).alias("state"))


def quota_selection(df: DataFrame, group: str, category: str, order: Sequence[Column], per_category: int, total: int) -> DataFrame:
    """df with `selected` and `excluded_by` (null, category_quota or total_quota).

    In order, a row is taken while its category and its group have room. A row over its category's quota takes no room in
    the group. Once the group is full, a category counts only what was taken from it, so the reason may be either.
    """
    by_category = Window.partitionBy(group, category).orderBy(*order)
    ranked = df.withColumn("_c", F.row_number().over(by_category))
    survivors = F.when(F.col("_c") <= per_category, 1)
    ranked = ranked.withColumn("_g", F.count(survivors).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("selected", (F.col("_c") <= per_category) & (F.col("_g") <= total))
    taken = F.count(F.when(F.col("selected"), 1)).over(Window.partitionBy(group, category))
    reason = F.when(~F.col("selected"), F.when(F.least(F.col("_c") - 1, taken) >= per_category, "category_quota").otherwise("total_quota"))
    return ranked.withColumn("excluded_by", reason).drop("_c", "_g")


def reserved_quota(df: DataFrame, group: str, decision: str, order: Sequence[Column], most: int) -> DataFrame:
    """At most `most` allowed rows, of which denied and to-review rows keep max(10, most // 3) places each for themselves."""
    reserve = max(10, most // 3)
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(group, decision).orderBy(*order)))
    count = lambda d: F.least(F.count(F.when(F.col(decision) == d, 1)).over(Window.partitionBy(group)), F.lit(reserve))
    room = F.when(F.col(decision).isin("deny", "review"), F.lit(reserve)).otherwise(F.greatest(F.lit(0), F.lit(most) - count("deny") - count("review")))
    return ranked.withColumn("_room", room).where("_r <= _room").drop("_r", "_room")


def runs(df: DataFrame, key: str, order: Sequence[Column], value: str) -> DataFrame:
    """(key, run, value, n): maximal runs of equal values in order."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(w).cast("long"))
    return marked.groupBy(key, "run").agg(F.first(value).alias(value), F.count("*").alias("n"))


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int, most: int = 1000) -> DataFrame:
    """Rows offset+1 to offset+limit, limit held to `most`. order must have no ties."""
    return df.orderBy(*order).offset(offset).limit(min(limit, most))


def neighbours(df: DataFrame, group: str, order: Sequence[Column], key: str) -> DataFrame:
    """key, its place in the group, and the keys before and after it. A null group is a group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.select(key, group, F.row_number().over(w).cast("long").alias("place"), F.lag(key).over(w).alias("previous"), F.lead(key).over(w).alias("next"))


def order_index(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """A small dimension numbered from 0."""
    return df.withColumn("position", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
