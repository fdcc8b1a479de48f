"""References between entities, all paths in one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which columns of a kind refer to which kind; evidence is referred to by every kind, with an array.
PATHS = (
    ("module", "erp_id", "erp_system"), ("screen", "erp_id", "erp_system"), ("screen", "module_id", "module"), ("field", "screen_id", "screen"),
    ("control", "screen_id", "screen"), ("table", "screen_id", "screen"), ("link", "screen_id", "screen"), ("event", "screen_id", "screen"),
    ("ui_state", "screen_id", "screen"), ("table_column", "table_id", "table"), ("transition", "source_state_id", "ui_state"),
    ("transition", "target_state_id", "ui_state"), ("transition", "event_id", "event"),
)
OPTIONAL = (("screen", "module_id"), ("transition", "event_id"))
EVIDENCE = "evidence_ids"


def references(entities: DataFrame) -> DataFrame:
    """(path, subject, kind, target): each reference of each entity, a missing one that must be there with a null target."""
    found: list[Column] = []
    for kind, column, to in PATHS:
        asked = F.col("entity_type") == kind
        if (kind, column) in OPTIONAL:
            asked &= F.coalesce(F.col(column), F.lit("")) != ""
        found.append(F.when(asked, F.struct(F.lit(f"{kind}.{column}").alias("path"), F.lit(to).alias("kind"), F.col(column).alias("target"))))
    every = F.array_compact(F.array(*found))
    if EVIDENCE in entities.columns:
        own = F.transform(F.coalesce(EVIDENCE, F.array().cast("array<string>")), lambda e: F.struct(F.concat(F.col("entity_type"), F.lit(f".{EVIDENCE}")).alias("path"), F.lit("evidence").alias("kind"), e.alias("target")))
        every = F.concat(every, own)
    return entities.select(F.col("canonical_id").alias("subject"), F.inline(every))


def dangling(entities: DataFrame) -> DataFrame:
    """(path, subject, target) of references to entities that are not there. One anti join serves all paths: an entity is known
    by its kind and id, and a kind that very many refer to is no group."""
    known = entities.select(F.col("entity_type").alias("kind"), F.col("canonical_id").alias("target"))
    return references(entities).join(known, ["kind", "target"], "left_anti").select("path", "subject", "target")
