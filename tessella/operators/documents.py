"""Entities as texts for a vector store: labels without personal data, looked-up relatives, scoped upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import hashing, privacy
from tessella.sources.shared import written_once

# Names of types in texts, and the properties that name an entity, in order.
TYPE_NAMES = {
    "erp_system": "ERP", "module": "Módulo", "screen": "Pantalla", "ui_state": "Estado de interfaz", "field": "Campo", "control": "Control", "table": "Tabla",
    "table_column": "Columna de tabla", "link": "Enlace", "event": "Evento", "transition": "Transición",
}
LABEL_KEYS = {
    "erp_system": ("name",), "module": ("name",), "screen": ("title",), "ui_state": ("title",), "field": ("label", "name"), "control": ("label",),
    "table": ("name",), "table_column": ("name",), "link": ("label",), "event": ("label",), "transition": ("category",),
}
RETRIEVED_KEYS = {"screen": ("title",), "field": ("label", "name"), "control": ("label",), "table": ("name",), "table_column": ("name",), "module": ("name",)}
ANY_KEYS = ("label", "name", "title")


def safe(value: Column, limit: int = 500) -> Column:
    """value squeezed and cut, or null if it is blank or holds something sensitive."""
    return F.when(~privacy.is_sensitive(value), F.nullif(F.substring(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")), 1, limit), F.lit("")))


def label(keys: dict[str, tuple[str, ...]], prefix: str = "", limit: int = 240, kind: str = "entity_type") -> Column:
    """The first safe one of the columns that name an entity of the row's type."""
    by_type = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, columns in keys.items():
        by_type = by_type.when(F.col(kind) == name, F.coalesce(*[safe(F.col(prefix + c), limit) for c in columns]))
    return by_type.otherwise(F.coalesce(*[safe(F.col(prefix + c), limit) for c in ANY_KEYS]))


def labelled(entities: DataFrame, keys: dict[str, tuple[str, ...]] = LABEL_KEYS) -> DataFrame:
    return entities.withColumn("safe_label", label(keys))


def rendered(entities: DataFrame, erp: str, erp_name: Column, version: str, known: set[str] | None = None) -> DataFrame:
    """(id, canonical_id, text, metadata, skipped) of each entity: a line for each thing that is known and safe.

    Relatives (screen, its module, table, parent, source and target state) are looked up by id, among rows of their types
    only; each lookup is a join on one key. Entities without a safe label are skipped.
    """
    rows = written_once(labelled(entities), "labelled")  # labels are cleaned once, the lookups below read them
    names = rows.select(F.col("canonical_id").alias("_id"), F.col("safe_label").alias("_label"), F.col("entity_type").alias("_type"))

    def with_name(df: DataFrame, key: str, name: str, *types: str) -> DataFrame:
        found = names.where(F.col("_type").isin(*types)) if types else names
        return df.join(found.select(F.col("_id").alias(key), F.col("_label").alias(name)), key, "left")

    screens = rows.where("entity_type = 'screen'").select(F.col("canonical_id").alias("_screen"), F.col("safe_label").alias("screen_name"), F.col("module_id").alias("_module"), F.col("route").alias("_route"))
    out = rows.withColumn("_screen", F.coalesce("screen_id", F.when(F.col("entity_type") == "screen", F.col("canonical_id")))).join(screens, "_screen", "left")
    out = out.withColumn("_module", F.coalesce("_module", "module_id")).withColumn("_route", F.coalesce("route", "_route"))
    out = out.withColumn("_parent", F.coalesce("module_id", "screen_id", "table_id", "source_state_id", "erp_id"))
    for key, name, *types in (("_module", "module_name", "module"), ("_parent", "parent_name"), ("table_id", "table_name", "table"), ("source_state_id", "from_name", "ui_state"), ("target_state_id", "to_name", "ui_state")):
        out = with_name(out, key, name, *types)
    kind = F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv])
    type_name = F.coalesce(F.try_element_at(kind, F.col("entity_type")), F.col("entity_type"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), safe(value))
    told = F.coalesce(line("Descripción", F.col("description")), F.when(F.coalesce("description", F.lit("")) == "", F.concat(F.lit("Descripción estructural: "), F.coalesce(F.try_element_at(kind, F.col("entity_type")), F.lit("Entidad")), F.lit(" disponible en el ERP."))))
    lines = F.array_compact(F.array(
        F.concat(F.lit("Tipo: "), type_name), F.concat(F.lit("Nombre: "), F.col("safe_label")), F.concat(F.lit("ERP: "), erp_name), line("Módulo", F.col("module_name")), line("Pantalla", F.col("screen_name")), line("Ruta", F.col("_route")),
        line("Entidad padre", F.col("parent_name")), line("Tabla asociada", F.col("table_name")), line("Estado origen", F.col("from_name")), line("Estado destino", F.col("to_name")), told,
    ))
    metadata = {"erp_id": F.lit(erp), "knowledge_version": F.lit(version), "canonical_id": F.col("canonical_id"), "entity_type": F.col("entity_type"), "review_status": F.col("status"), "content_hash": F.col("content_hash"), "parent_canonical_id": F.col("_parent"), "screen_id": F.col("_screen"), "screen_route": F.col("_route")}
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in metadata.items()]), lambda x: F.coalesce(x["value"], F.lit("")) != "")
    missing = F.col("safe_label").isNull()
    return out.select(
        hashing.joined_hash(F.lit(erp), F.lit(version), F.col("canonical_id")).alias("id"), "canonical_id", F.when(~missing, F.array_join(lines, "\n")).alias("text"), F.map_from_entries(pairs).alias("metadata"),
        F.when(missing, "missing_safe_label").alias("skipped"),
    )


def upserted(current: DataFrame, new: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows, counts) after a scope's documents are replaced: new rows win, stale ones go; counts has upserted, removed."""
    removed = current.select(key).distinct().join(new.select(key), key, "left_anti").agg(F.count("*").alias("removed"))
    written = new.select(key).distinct().agg(F.count("*").alias("upserted"))
    return new.dropDuplicates([key]), written.crossJoin(removed)  # one row each
