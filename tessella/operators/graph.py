"""Property graphs as tables of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Relations that paths may follow.
ALLOWED = ("HAS_MODULE", "HAS_SCREEN", "HAS_STATE", "HAS_FIELD", "HAS_CONTROL", "HAS_TABLE", "HAS_COLUMN", "HAS_LINK", "HAS_EVENT", "FROM_STATE", "TO_STATE", "TRIGGERED_BY")


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge from both ends: (a, b, key, type). The key tells edges apart."""
    key = F.concat_ws("|", "source", "type", "target")
    one = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), key.alias("key"), "type")
    return one.union(edges.select(F.col("target").alias("a"), F.col("source").alias("b"), key.alias("key"), "type"))


def paths(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, id, length, keys): undirected paths of one to `hops` edges from seeds (id), no edge twice, not back to the
    seed. Seeds are few; edges are joined by equality each hop."""
    both = symmetric(edges)
    step = seeds.select(F.col("id").alias("seed")).distinct().join(both, F.col("seed") == F.col("a")).select("seed", F.col("b").alias("id"), F.array("key").alias("keys"))
    out = step
    for _ in range(hops - 1):
        nxt = both.select(F.col("a").alias("id"), F.col("b").alias("to"), "key")
        step = step.join(nxt, "id").where(~F.array_contains("keys", F.col("key"))).select("seed", F.col("to").alias("id"), F.concat("keys", F.array("key")).alias("keys"))
        out = out.union(step)
    return out.where("id <> seed").withColumn("length", F.size("keys"))


def expanded(seeds: DataFrame, edges: DataFrame, limit: int, hops: int = 2) -> DataFrame:
    """The first `limit` paths by length, end, seed and edges."""
    return paths(seeds, edges, hops).withColumn("trail", F.array_join("keys", ";")).orderBy("length", "id", "seed", "trail").limit(limit).drop("keys")


def reachable(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(id, depth): least number of directed steps from roots (id), up to depth. One join a level, seen nodes left out."""
    level = roots.select("id").distinct().withColumn("depth", F.lit(0))
    seen = level
    for d in range(1, depth + 1):
        new = level.join(edges, F.col("id") == F.col("source")).select(F.col("target").alias("id")).distinct()
        level = new.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.union(level)
    return seen


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    touched = edges.select(F.col("source").alias("id")).union(edges.select("target"))
    return nodes.join(touched, "id", "left_anti")


def valid_paths(walks: DataFrame, approved: DataFrame) -> DataFrame:
    """Paths (path_id, nodes) all of whose nodes are among approved (id)."""
    nodes = walks.select("path_id", F.explode("nodes").alias("id"))
    bad = nodes.join(approved.select("id"), "id", "left_anti").select("path_id").distinct()
    return walks.join(bad, "path_id", "left_anti")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count_distinct("id").alias("nodes"))
    e = edges.agg(F.count_distinct("source", "type", "target").alias("edges"), F.count_distinct("type").alias("types"))
    return n.join(e)  # one row each


def upserted(old: DataFrame, new: DataFrame, key: str, properties: list[str]) -> DataFrame:
    """Merge of nodes: new properties win, old ones that new lacks stay."""
    o = old.select(key, *[F.col(p).alias(f"_{p}") for p in properties])
    return new.join(o, key, "full_outer").select(key, *[F.coalesce(F.col(p), F.col(f"_{p}")).alias(p) for p in properties])
