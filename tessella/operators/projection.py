"""A knowledge base as a property graph: nodes that may be projected, edges from references, and a plan that can be checked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import hashing, privacy

# Each type's label, the properties that a node of it may carry, and the edges that its references make.
LABELS = {
    "erp_system": "ERPSystem", "module": "Module", "screen": "Screen", "ui_state": "UIState", "field": "Field", "control": "Control", "table": "Table",
    "table_column": "TableColumn", "link": "Link", "event": "Event", "transition": "Transition", "evidence": "Evidence",
}
PROPERTIES = {
    "erp_system": ("slug", "name", "profile_name", "adapter"),
    "module": ("name", "normalized_name", "route_prefix", "description"),
    "screen": ("title", "normalized_title", "route", "description"),
    "ui_state": ("route", "depth", "title", "is_route_root"),
    "field": ("label", "normalized_label", "input_type", "placeholder", "required", "readonly", "disabled"),
    "control": ("label", "normalized_label", "control_type", "event_category", "safety_decision", "mutative", "target_route"),
    "table": ("name", "normalized_name"),
    "table_column": ("name", "normalized_name", "position"),
    "link": ("label", "normalized_label", "target_route"),
    "event": ("label", "normalized_label", "category", "policy_decision", "mutative"),
    "transition": ("category", "changed", "route_changed", "depth", "observed"),
    "evidence": ("evidence_type", "artifact_path", "source_entity_type"),
}
OWN = "canonical_id"
EDGES = {
    "module": (("HAS_MODULE", "erp_id", OWN),),
    "screen": (("HAS_SCREEN", "erp_id", OWN), ("HAS_SCREEN", "module_id", OWN)),
    "ui_state": (("HAS_STATE", "screen_id", OWN),),
    "field": (("HAS_FIELD", "screen_id", OWN),),
    "control": (("HAS_CONTROL", "screen_id", OWN),),
    "table": (("HAS_TABLE", "screen_id", OWN),),
    "table_column": (("HAS_COLUMN", "table_id", OWN),),
    "link": (("HAS_LINK", "screen_id", OWN), ("TARGETS", OWN, "target_screen_id")),
    "event": (("HAS_EVENT", "screen_id", OWN), ("FROM_STATE", OWN, "source_state_id")),
    "transition": (("FROM_STATE", OWN, "source_state_id"), ("TO_STATE", OWN, "target_state_id"), ("TRIGGERED_BY", OWN, "event_id")),
    "evidence": (("HAS_EVIDENCE", "source_entity_id", OWN),),
}


def properties(entities: DataFrame) -> Column:
    """Map of the filled properties that the row's type may carry; columns that entities lack are absent."""
    known = sorted({p for ps in PROPERTIES.values() for p in ps} & set(entities.columns))
    pairs = [F.struct(F.lit(p).alias("key"), F.col(p).cast("string").alias("value"), F.col("entity_type").isin(*[t for t, ps in PROPERTIES.items() if p in ps]).alias("ok")) for p in known]
    return F.map_from_entries(F.transform(F.filter(F.array(*pairs), lambda x: x["ok"] & x["value"].isNotNull()), lambda x: F.struct(x["key"], x["value"])))


def node_error() -> Column:
    """Why an entity may not become a node, the first reason, or null. One such row spoils the whole plan."""
    sensitive = F.exists(F.map_values("properties"), privacy.is_sensitive)
    return (
        F.when(~F.coalesce(F.col("entity_type").isin(*LABELS), F.lit(False)), "unsupported_type").when(~F.coalesce(F.col("status").isin("approved", "corrected"), F.lit(False)), "status_not_eligible")
        .when(F.coalesce("canonical_id", F.lit("")) == "", "missing_id").when(sensitive, "sensitive_property")
    )


def nodes(entities: DataFrame, scope: tuple[Column, Column]) -> DataFrame:
    """entities with node_key, node_label, properties and error. scope: system and version, part of every key."""
    kind = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    out = entities.withColumn("properties", properties(entities)).withColumn("node_key", hashing.joined_hash(*scope, F.col("canonical_id")))
    return out.withColumn("node_label", F.try_element_at(kind, F.col("entity_type"))).withColumn("error", node_error())


def candidate_edges(entities: DataFrame) -> DataFrame:
    """(type, source, target) of every reference that is set, for all rules of all types in one pass over the entities."""

    def rule(kind: str, edge: tuple[str, str, str]) -> Column:
        name, source, target = edge
        ok = F.col("entity_type") == kind
        if kind == "evidence":
            ok = ok & (F.col("source_entity_type") == "screen")
        return F.when(ok & (F.col(source) != "") & (F.col(target) != ""), F.struct(F.lit(name).alias("type"), F.col(source).alias("source"), F.col(target).alias("target")))

    every = F.array_compact(F.array(*[rule(kind, edge) for kind, edges in EDGES.items() for edge in edges]))
    return entities.select(F.inline(every))


def split_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with `skipped`: null, or endpoint_not_projected where an end isn't among kept (canonical_id). Files of ids are far
    smaller than their rows, so a plan by their bytes would send all of them to the driver: both joins are merges."""
    ids = kept.select("canonical_id").distinct()
    side = lambda k: ids.select(F.col("canonical_id").alias(k), F.lit(True).alias(f"_{k}")).hint("merge")
    both = edges.join(side("source"), "source", "left").join(side("target"), "target", "left")
    return both.withColumn("skipped", F.when(F.col("_source").isNull() | F.col("_target").isNull(), "endpoint_not_projected")).drop("_source", "_target")


def keyed_edges(edges: DataFrame, scope: tuple[Column, Column]) -> DataFrame:
    """Distinct edges with their ends' node keys and a key of their own."""
    source, target = (hashing.joined_hash(*scope, F.col(k)) for k in ("source", "target"))
    return edges.select("type", source.alias("source_key"), target.alias("target_key")).distinct().withColumn("relationship_key", hashing.joined_hash(F.col("source_key"), F.col("type"), F.col("target_key")))


def digest_of(keys: DataFrame, key: str, buckets: int = 1 << 16) -> DataFrame:
    """One row: digest and n of a table's distinct keys, whatever their order or partitions.

    Keys are hashed in buckets of their first 16 bits, then the buckets' digests in order, so no task holds more than a
    65536th of the keys, and the last row has a bounded number of digests."""
    bucket = F.conv(F.substring(F.sha2(F.col("k"), 256), 1, 4), 16, 10).cast("int") % buckets
    each = keys.select(F.col(key).alias("k")).distinct().groupBy(bucket.alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), "\n"), 256).alias("d"), F.count("*").alias("n"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]), "\n")
    return each.agg(F.sha2(said, 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def skip_reasons(*tables: tuple[DataFrame, str]) -> DataFrame:
    """(reason, n) over the reason columns of several tables, nulls left out."""
    each = [df.select(F.col(reason).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")) for df, reason in tables]
    return reduce(DataFrame.unionByName, each).groupBy("reason").agg(F.sum("n").alias("n"))
