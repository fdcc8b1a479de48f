"""The knowledge base projected as a graph and as documents for a vector store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import documents, projection
from tessella.plans.base import ENTITIES, entities
from tessella.plans.registry import query
from tessella.session import load
from tessella.sources.shared import written_once



def scope() -> tuple[Column, Column]:
    return F.lit("erp:1"), F.lit("v1")


_GOOD = "status IN ('approved', 'corrected')"
_SAFE = "CASE WHEN contains({0}, '@') OR trim({0}) = '' THEN NULL ELSE trim(regexp_replace({0}, '\\s+', ' ', 'g')) END"
_PROPS = "concat_ws('|', " + ", ".join(
    f"CASE WHEN entity_type IN ({', '.join(repr(t) for t, ps in projection.PROPERTIES.items() if p in ps)}) THEN '{p}=' || {p}::VARCHAR END" for p in sorted({"category", "depth", "description", "label", "name", "route", "source_entity_type", "title"})) + ")"


@query(f"""
WITH {ENTITIES}, n AS (SELECT *, {_PROPS} AS properties FROM ent)
SELECT canonical_id, sha256('erp:1' || chr(0) || 'v1' || chr(0) || canonical_id) AS node_key, properties, CASE WHEN NOT {_GOOD} THEN 'status_not_eligible' WHEN contains(properties, '@') THEN 'sensitive_property' END AS error FROM n
""")
def projection_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every entity as a node, with its whitelisted properties and what forbids it."""
    made = projection.nodes(entities(spark, sf), scope())
    said = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return made.select("canonical_id", "node_key", said.alias("properties"), "error")


_RULES = " UNION ALL ".join(
    f"SELECT '{name}' AS type, {source} AS source, {target} AS target FROM ok WHERE entity_type = '{kind}' AND {source} IS NOT NULL AND {target} IS NOT NULL" + (" AND source_entity_type = 'screen'" if kind == "evidence" else "")
    for kind, edges in projection.EDGES.items() for name, source, target in edges)
_EDGES = f"ok AS (SELECT * FROM ent WHERE {_GOOD} AND NOT contains(coalesce(title, label, name, ''), '@')), rules AS ({_RULES}), edges AS (SELECT *, CASE WHEN source NOT IN (SELECT canonical_id FROM ok) OR target NOT IN (SELECT canonical_id FROM ok) THEN 'endpoint_not_projected' END AS skipped FROM rules)"


def projected(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges); what nodes say is checked once, and their ids and references are written."""
    references = sorted({c for edges in projection.EDGES.values() for edge in edges for c in edge[1:]})
    kept = written_once(projection.nodes(entities(spark, sf), scope()).where("error is null").select("entity_type", "source_entity_type", *references), "nodes")
    return kept, projection.split_edges(projection.candidate_edges(kept), kept)


@query(f"WITH {ENTITIES}, {_EDGES} SELECT type, source, target, skipped FROM edges")
def projection_edges(spark: SparkSession, sf: str) -> DataFrame:
    return projected(spark, sf)[1].select("type", "source", "target", "skipped")


@query(f"""
WITH {ENTITIES}, {_EDGES}, k AS (SELECT sha256('erp:1' || chr(0) || 'v1' || chr(0) || source) AS s, type, sha256('erp:1' || chr(0) || 'v1' || chr(0) || target) AS t FROM edges WHERE skipped IS NULL)
SELECT DISTINCT type, s AS source_key, t AS target_key, sha256(s || chr(0) || type || chr(0) || t) AS relationship_key FROM k
""")
def projection_relationships(spark: SparkSession, sf: str) -> DataFrame:
    return projection.keyed_edges(projected(spark, sf)[1].where("skipped is null"), scope())


@query(f"""
WITH {ENTITIES}, {_EDGES} SELECT (SELECT count(*) FROM ok) AS nodes, (SELECT count(DISTINCT (type, source, target)) FROM edges WHERE skipped IS NULL) AS relationships, (SELECT count(*) FROM edges WHERE skipped IS NOT NULL) AS skipped, true AS same_digest
""")
def projection_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the plan, and that its digest doesn't depend on the order of rows or partitions."""
    kept, edges = projected(spark, sf)
    edges = written_once(edges, "edges")
    keys = written_once(projection.keyed_edges(edges.where("skipped is null"), scope()), "keys")
    one = projection.digest_of(keys, "relationship_key")
    again = projection.digest_of(keys.repartition("target_key").sortWithinPartitions(F.desc("relationship_key")), "relationship_key").select(F.col("digest").alias("other"))
    count = kept.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count_if(F.col("skipped").isNotNull()).alias("skipped")))  # one row each
    return count.crossJoin(one).crossJoin(again).select("nodes", F.col("n").alias("relationships"), "skipped", (F.col("digest") == F.col("other")).alias("same_digest"))


@query(f"""
WITH {ENTITIES}, {_EDGES} SELECT reason, sum(n)::BIGINT AS n FROM (SELECT skipped AS reason, count(*) AS n FROM edges WHERE skipped IS NOT NULL GROUP BY 1
UNION ALL SELECT CASE WHEN NOT {_GOOD} THEN 'status_not_eligible' WHEN contains({_PROPS}, '@') THEN 'sensitive_property' END, count(*) FROM ent GROUP BY 1) WHERE reason IS NOT NULL GROUP BY reason
""")
def projection_skips(spark: SparkSession, sf: str) -> DataFrame:
    return projection.skip_reasons((projected(spark, sf)[1], "skipped"), (projection.nodes(entities(spark, sf), scope()), "error"))


@query(f"WITH {ENTITIES}, {_EDGES} SELECT entity_type, count(*) AS n FROM ok GROUP BY entity_type")
def nodes_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return projected(spark, sf)[0].groupBy("entity_type").agg(F.count("*").alias("n"))


@query(f"WITH {ENTITIES} SELECT module_id, count(*) AS screens FROM ent WHERE entity_type = 'screen' GROUP BY module_id")
def screens_per_module(spark: SparkSession, sf: str) -> DataFrame:
    """Whatever their status; a null module has its count too."""
    return entities(spark, sf).where("entity_type = 'screen'").groupBy("module_id").agg(F.count("*").alias("screens"))


_LABELS = " ".join(f"WHEN '{t}' THEN coalesce({', '.join(_SAFE.format(c) for c in cs)})" for t, cs in documents.LABEL_KEYS.items())
_KINDS = " ".join(f"WHEN '{t}' THEN '{n}'" for t, n in documents.TYPE_NAMES.items())
_DOCS = f"""lab AS (SELECT *, CASE entity_type {_LABELS} ELSE coalesce({', '.join(_SAFE.format(c) for c in documents.ANY_KEYS)}) END AS l, coalesce(CASE entity_type {_KINDS} END, entity_type) AS kind FROM ent WHERE {_GOOD}),
x AS (SELECT e.*, s.l AS sl, m.l AS ml, p.l AS pl, t.l AS tl, f.l AS fl, o.l AS ol, coalesce(e.route, s.route) AS r, coalesce(e.screen_id, CASE WHEN e.entity_type = 'screen' THEN e.canonical_id END) AS sid, coalesce(e.module_id, e.screen_id, e.table_id, e.source_state_id, e.erp_id) AS pid
  FROM lab e LEFT JOIN lab s ON s.entity_type = 'screen' AND s.canonical_id = coalesce(e.screen_id, CASE WHEN e.entity_type = 'screen' THEN e.canonical_id END)
  LEFT JOIN lab m ON m.entity_type = 'module' AND m.canonical_id = coalesce(s.module_id, e.module_id) LEFT JOIN lab p ON p.canonical_id = coalesce(e.module_id, e.screen_id, e.table_id, e.source_state_id, e.erp_id)
  LEFT JOIN lab t ON t.entity_type = 'table' AND t.canonical_id = e.table_id LEFT JOIN lab f ON f.entity_type = 'ui_state' AND f.canonical_id = e.source_state_id LEFT JOIN lab o ON o.entity_type = 'ui_state' AND o.canonical_id = e.target_state_id),
doc AS (SELECT sha256('erp:1' || chr(0) || 'v1' || chr(0) || canonical_id) AS id, canonical_id, CASE WHEN l IS NOT NULL THEN concat_ws(chr(10), 'Tipo: ' || kind, 'Nombre: ' || l, 'ERP: Demo', 'Módulo: ' || ml, 'Pantalla: ' || sl, 'Ruta: ' || r, 'Entidad padre: ' || pl, 'Tabla asociada: ' || tl, 'Estado origen: ' || fl, 'Estado destino: ' || ol,
  CASE WHEN description IS NOT NULL THEN 'Descripción: ' || description ELSE 'Descripción estructural: ' || coalesce(CASE entity_type {_KINDS} END, 'Entidad') || ' disponible en el ERP.' END) END AS text,
  concat_ws('|', 'canonical_id=' || canonical_id, 'content_hash=' || content_hash, 'entity_type=' || entity_type, 'erp_id=erp:1', 'knowledge_version=v1', 'parent_canonical_id=' || pid, 'review_status=' || status, 'screen_id=' || sid, 'screen_route=' || r) AS metadata,
  CASE WHEN l IS NULL THEN 'missing_safe_label' END AS skipped FROM x)"""


def rendered(spark: SparkSession, sf: str) -> DataFrame:
    good = entities(spark, sf).where(F.col("status").isin("approved", "corrected"))
    return documents.rendered(good, "erp:1", F.lit("Demo"), "v1")


@query(f"WITH {ENTITIES}, {_DOCS} SELECT id, canonical_id, text, metadata, skipped FROM doc")
def vector_documents(spark: SparkSession, sf: str) -> DataFrame:
    said = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return rendered(spark, sf).withColumn("metadata", said)


@query("""
WITH n AS (SELECT vec_id FROM embeddings WHERE label = 3 AND vec_id % 2 = 0), o AS (SELECT vec_id FROM embeddings WHERE label = 3 AND vec_id % 3 <> 0)
SELECT (SELECT count(*) FROM n) AS upserted, (SELECT count(*) FROM o WHERE vec_id NOT IN (SELECT vec_id FROM n)) AS removed
""")
def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A scope of vectors is replaced: what the new set lacks goes."""
    scope = load(spark, sf, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"), "embedding")
    return documents.upserted(scope.where("id % 3 <> 0"), scope.where("id % 2 = 0"))[1]
