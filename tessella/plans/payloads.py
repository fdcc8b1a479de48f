"""Typed reading of payloads that are made of the given tables, some of them broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import payloads
from tessella.plans.registry import query
from tessella.session import load


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as screens, their orders as controls, states, events and transitions, nations as tables with columns."""
    orders, customer = load(spark, sf, "orders"), load(spark, sf, "customer")
    item = lambda df, kind, key, body: df.select(F.expr(key).alias("canonical_id"), F.lit(kind).alias("entity_type"), F.expr(body).alias("payload"))
    screen = "concat('screen:', o_custkey)"
    json = lambda fields: f"to_json(named_struct({fields}))"
    control = item(orders, "control", "concat('control:', o_orderkey)", f"""CASE o_orderkey % 7 WHEN 0 THEN '[]' WHEN 1 THEN {json(f"'screen_id', {screen}, 'label', o_orderkey")}
      WHEN 2 THEN {json(f"'screen_id', {screen}, 'label', o_orderpriority, 'mutative', 'yes'")} WHEN 3 THEN {json(f"'screen_id', {screen}")}
      ELSE {json(f"'screen_id', {screen}, 'label', o_orderpriority, 'mutative', o_orderstatus = 'F', 'evidence_ids', array(concat('evidence:', o_orderpriority), ' ')")} END""")
    state = item(orders, "ui_state", "concat('state:', o_orderkey)", f"CASE WHEN o_orderkey % 5 = 0 THEN {json(f'''\'screen_id\', {screen}, \'title\', 1''')} ELSE {json(f'''\'screen_id\', {screen}, \'title\', o_orderstatus, \'depth\', cast(o_orderkey % 4 as int)''')} END")
    move = item(orders, "transition", "concat('transition:', o_orderkey)", f"""CASE o_orderkey % 6 WHEN 0 THEN {json("'source_state_id', concat('state:', o_orderkey)")}
      WHEN 1 THEN {json("'category', 'tab', 'source_state_id', concat('state:', o_orderkey), 'trigger_control_id', concat('control:', o_orderkey)")}
      ELSE {json("'category', o_orderpriority, 'source_state_id', concat('state:', o_orderkey), 'target_state_id', 'state:none'")} END""")
    table = item(customer, "table", "concat('table:', c_custkey)", f"CASE WHEN c_custkey % 4 = 0 THEN {json('''\'screen_id\', concat(\'screen:\', c_custkey), \'name\', true''')} WHEN c_custkey % 4 = 1 THEN {json('''\'screen_id\', concat(\'screen:\', c_custkey)''')} ELSE {json('''\'screen_id\', concat(\'screen:\', c_custkey), \'name\', c_mktsegment''')} END")
    column = item(customer, "table_column", "concat('column:', c_custkey)", f"CASE WHEN c_custkey % 3 = 0 THEN {json('''\'table_id\', concat(\'table:\', c_custkey), \'name\', 2''')} WHEN c_custkey % 3 = 1 THEN '{{broken' ELSE {json('''\'table_id\', concat(\'table:\', c_custkey), \'name\', c_name''')} END")
    return control.union(state).union(move).union(table).union(column)


_ITEMS = """
c AS (SELECT 'screen:' || o_custkey AS screen_id, 'control' AS kind, 'control:' || o_orderkey AS id, o_orderpriority AS label, o_orderkey % 7 AS i, o_orderkey, o_orderstatus, 'evidence:' || o_orderpriority AS ev FROM orders),
s AS (SELECT 'screen:' || o_custkey AS screen_id, 'ui_state' AS kind, 'state:' || o_orderkey AS id, o_orderstatus AS label, o_orderkey % 5 <> 0 AS ok, o_orderkey FROM orders),
t AS (SELECT 'screen:' || o_custkey AS screen_id, 'transition:' || o_orderkey AS id, CASE WHEN o_orderkey % 6 = 1 THEN 'tab' ELSE o_orderpriority END AS label, o_orderkey % 5 <> 0 AS sound, o_orderkey % 7 > 3 AS known, o_orderkey % 6 AS i FROM orders),
b AS (SELECT 'screen:' || c_custkey AS screen_id, 'table:' || c_custkey AS id, CASE WHEN c_custkey % 4 = 1 THEN 'Tabla' ELSE c_mktsegment END AS label, c_custkey % 4 <> 0 AS ok, c_custkey FROM customer),
good AS (
  SELECT screen_id, kind, id, NULL AS parent_id, label FROM c WHERE i > 3 UNION ALL SELECT screen_id, kind, id, NULL, label FROM s WHERE ok UNION ALL SELECT screen_id, 'table', id, NULL, label FROM b WHERE ok
  UNION ALL SELECT screen_id, 'transition', id, NULL, label FROM t WHERE i <> 0 AND sound AND (i <> 1 OR known)
  UNION ALL SELECT 'screen:' || c_custkey, 'table_column', 'column:' || c_custkey, 'table:' || c_custkey, c_name FROM customer WHERE c_custkey % 3 = 2
)
"""


@query(f"WITH {_ITEMS} SELECT * FROM good")
def typed_structures(spark: SparkSession, sf: str) -> DataFrame:
    """What the screens consist of, from JSON alone."""
    return payloads.structures(_items(spark, sf)).children.select("screen_id", "kind", "id", "parent_id", "label")


@query(f"""
WITH {_ITEMS}
SELECT CASE WHEN i > 0 THEN screen_id END AS screen_id, 'control' AS kind, id, CASE i WHEN 0 THEN 'payload' WHEN 1 THEN 'label: type' WHEN 2 THEN 'mutative: type' ELSE 'label: missing' END AS reason FROM c WHERE i <= 3
UNION ALL SELECT screen_id, 'ui_state', id, 'title: type' FROM s WHERE NOT ok UNION ALL SELECT screen_id, 'table', id, 'name: type' FROM b WHERE NOT ok
UNION ALL SELECT screen_id, 'transition', id, CASE WHEN i = 0 THEN 'category: missing' WHEN NOT sound THEN 'source_state_id: unknown' ELSE 'trigger_control_id: unknown' END FROM t WHERE i = 0 OR NOT sound OR (i = 1 AND NOT known)
UNION ALL SELECT CASE WHEN c_custkey % 3 = 0 THEN 'screen:' || c_custkey END, 'table_column', 'column:' || c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'name: type' ELSE 'payload' END FROM customer WHERE c_custkey % 3 < 2
""")
def payload_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """What does not fit its type, and why."""
    return payloads.structures(_items(spark, sf)).warnings


@query(f"WITH {_ITEMS} SELECT DISTINCT screen_id, ev AS evidence_id FROM c WHERE i > 3")
def structure_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.structures(_items(spark, sf)).evidence


@query(f"""
WITH {_ITEMS}, g AS (SELECT screen_id, string_agg(kind || id || label, '|' ORDER BY kind, id) AS k, count(*) AS n FROM good GROUP BY 1)
SELECT screen_id, n, true AS same FROM g
""")
def structure_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of structures don't depend on the order of their items."""
    items = _items(spark, sf)
    one, two = (payloads.structure_hashes(payloads.structures(x).children) for x in (items, items.orderBy(F.desc("canonical_id"))))
    other = two.select("screen_id", F.col("structure_hash").alias("other"))
    return one.join(other, "screen_id").select("screen_id", "n", (F.col("structure_hash") == F.col("other")).alias("same"))


@query("""
WITH l AS (SELECT l_orderkey, max_by(l_partkey, l_linenumber * 1000000 + l_partkey) AS p FROM lineitem GROUP BY 1)
SELECT o_orderkey AS canonical_id, CASE WHEN o_orderkey % 3 = 0 AND p % 4 > 1 THEN 'Title ' || p ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 3 = 0 AND p % 4 = 3 THEN '/p/' || p ELSE '/o/' || o_orderkey END AS route FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
""")
def effective_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and routes in force: of the last correction's JSON, where it has them."""
    status = F.when(F.col("o_orderkey") % 3 == 0, "corrected").otherwise("approved")
    items = load(spark, sf, "orders").select(F.col("o_orderkey").alias("canonical_id"), status.alias("status"), F.col("o_orderpriority").alias("title"), F.expr("concat('/o/', o_orderkey)").alias("route"))
    body = """CASE l_partkey % 4 WHEN 0 THEN '{"title": 5, "route": null}' WHEN 1 THEN 'no json' WHEN 2 THEN to_json(named_struct('title', concat('Title ', l_partkey)))
      ELSE to_json(named_struct('title', concat('Title ', l_partkey), 'route', concat('/p/', l_partkey))) END"""
    corrections = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("canonical_id"), F.expr("l_linenumber * 1000000L + l_partkey").alias("seq"), F.expr(body).alias("payload"))
    return payloads.effective(items, corrections, "title", "route").select("canonical_id", "title", "route")


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'payload' WHEN 1 THEN 'title: missing' WHEN 2 THEN 'route: type' WHEN 3 THEN 'module_id: type' END AS reason FROM customer
""")
def screen_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each screen's payload has the fields of a screen."""
    body = """CASE c_custkey % 5 WHEN 0 THEN '"text"' WHEN 1 THEN '{"route": "/x", "title": null}' WHEN 2 THEN to_json(named_struct('title', c_name, 'route', c_custkey))
      WHEN 3 THEN to_json(named_struct('title', c_name, 'route', '/', 'module_id', array(1))) ELSE to_json(named_struct('title', c_name, 'route', '/', 'module_id', c_mktsegment)) END"""
    items = payloads.opened(load(spark, sf, "customer").select("c_custkey", F.expr(body).alias("payload")))
    return items.select("c_custkey", payloads.problem("doc", payloads.SCREEN).alias("reason"))
