"""The driver's tables read as one knowledge base: entities of every type with their references, and relations.

Columns are written once, as expressions that Spark and other SQL engines read alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import load

COLUMNS = {
    "canonical_id": "string", "entity_type": "string", "status": "string", "seq": "bigint", "erp_id": "string", "module_id": "string", "screen_id": "string", "table_id": "string",
    "source_state_id": "string", "target_state_id": "string", "event_id": "string", "target_screen_id": "string", "source_entity_type": "string", "source_entity_id": "string",
    "name": "string", "title": "string", "label": "string", "route": "string", "category": "string", "description": "string", "depth": "int",
}


def _status(k: str) -> str:
    return f"CASE WHEN {k} % 5 = 4 THEN 'pending' WHEN {k} % 7 = 3 THEN 'corrected' ELSE 'approved' END"


def _part(kind: str, turn: int, **more: str) -> tuple[str, str, dict[str, str]]:
    own = {"canonical_id": f"'{kind}:' || p_partkey", "entity_type": f"'{kind}'", "status": _status("p_partkey"), "seq": "p_partkey", "screen_id": "'screen:' || (p_partkey % 91 + 1)"}
    return "part", f"p_partkey % 6 = {turn}", own | more


_LABEL = "CASE WHEN p_partkey % 29 = 0 THEN 'mail me@example.org' WHEN p_partkey % 31 = 0 THEN '' ELSE p_name END"
#: (table, condition, expression of each column); columns that are left out are null.
SOURCES: list[tuple[str, str, dict[str, str]]] = [
    ("region", "true", {"canonical_id": "'erp:' || r_regionkey", "entity_type": "'erp_system'", "status": "'approved'", "seq": "r_regionkey", "name": "r_name"}),
    ("nation", "true", {"canonical_id": "'module:' || n_nationkey", "entity_type": "'module'", "status": _status("n_nationkey"), "seq": "n_nationkey", "erp_id": "'erp:' || n_regionkey", "name": "n_name", "route": "'/' || lower(n_name)"}),
    ("customer", "true", {
        "canonical_id": "'screen:' || c_custkey", "entity_type": "'screen'", "status": _status("c_custkey"), "seq": "c_custkey", "erp_id": "'erp:' || (c_nationkey % 5)", "module_id": "CASE WHEN c_custkey % 11 <> 0 THEN 'module:' || c_nationkey END",
        "title": "CASE WHEN c_custkey % 23 = 0 THEN 'write to me@example.org' ELSE 'Screen ' || c_custkey || ' ' || c_mktsegment END", "route": "'/c/' || c_custkey", "description": "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END",
    }),
    ("supplier", "true", {"canonical_id": "'ui_state:' || s_suppkey", "entity_type": "'ui_state'", "status": _status("s_suppkey"), "seq": "s_suppkey", "screen_id": "'screen:' || (s_suppkey % 91 + 1)", "title": "'State ' || s_suppkey", "depth": "CAST(s_suppkey % 4 AS INT)", "route": "'/s/' || s_suppkey"}),
    _part("field", 0, label=_LABEL, name="p_brand"),
    _part("control", 1, label=f"CASE p_partkey % 24 WHEN 1 THEN 'Nuevo registro' WHEN 7 THEN 'Buscar ahora' WHEN 19 THEN 'Eliminar fila' ELSE {_LABEL} END", category="p_type"),
    _part("table", 2, name=_LABEL),
    _part("event", 3, label=_LABEL, category="p_type", source_state_id="CASE WHEN p_partkey % 4 <> 0 THEN 'ui_state:' || (p_partkey % 12 + 1) END"),
    _part("link", 4, label=_LABEL, target_screen_id="CASE WHEN p_partkey % 3 = 0 THEN 'screen:' || (p_partkey % 50 + 1) END"),
    ("part", "p_partkey % 6 = 5", {"canonical_id": "'transition:' || p_partkey", "entity_type": "'transition'", "status": _status("p_partkey"), "seq": "p_partkey", "category": "p_type", "source_state_id": "'ui_state:' || (p_partkey % 12 + 1)", "target_state_id": "'ui_state:' || (p_partkey % 15 + 1)", "event_id": "'event:' || (p_partkey % 40 * 6 + 3)"}),
    ("orders", "true", {"canonical_id": "'table_column:' || o_orderkey", "entity_type": "'table_column'", "status": _status("o_orderkey"), "seq": "o_orderkey", "table_id": "'table:' || (o_orderkey % 200 * 6 + 2)", "name": "o_orderpriority || ' ' || (o_orderkey % 70)"}),
    ("supplier", "true", {"canonical_id": "'evidence:' || s_suppkey", "entity_type": "'evidence'", "status": "'approved'", "seq": "s_suppkey", "source_entity_type": "CASE WHEN s_suppkey % 2 = 0 THEN 'screen' ELSE 'field' END", "source_entity_id": "'screen:' || (s_suppkey % 91 + 1)", "name": "'evidence'"}),
]


def _select(columns: dict[str, str]) -> list[str]:
    return [f"CAST({columns.get(c, 'NULL')} AS {t}) AS {c}" for c, t in COLUMNS.items()]


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Every entity, with a hash of what it says."""
    rows = reduce(DataFrame.union, [load(spark, sf, table).where(condition).selectExpr(*_select(columns)) for table, condition, columns in SOURCES])
    return rows.withColumn("content_hash", F.sha2(F.concat_ws("|", "canonical_id", F.coalesce("title", "label", "name", "category")), 256))


ENTITIES = "ent AS (SELECT *, sha256(concat_ws('|', canonical_id, coalesce(title, label, name, category))) AS content_hash FROM (" + " UNION ALL ".join(
    f"SELECT {', '.join(_select(columns)).replace('AS string)', 'AS VARCHAR)')} FROM {table} WHERE {condition}" for table, condition, columns in SOURCES) + "))"
