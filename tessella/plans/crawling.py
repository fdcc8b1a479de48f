"""Folds of crawls, drafts about screens, and small lookups, over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import privacy, text
from tessella.operators import audits, crawl, drafts, relations
from tessella.plans.base import ENTITIES, entities
from tessella.plans.registry import query
from tessella.session import load
from tessella.sources.shared import dealt, written_once

_ITEMS = """i AS (SELECT p_partkey % 40 AS screen, p_partkey AS seq, (['Ventas', ' ventas ', 'Compras  y pagos', '', 'Menu de navegación', 'x', 'Inicio'])[(p_partkey % 7 + 1)::INT] || CASE WHEN p_partkey % 13 = 0 THEN repeat('y', 90) ELSE '' END AS t,
  (['nav-group', 'NAV-ITEM', 'div'])[(p_partkey % 3 + 1)::INT] AS tag, 's' || p_partkey AS selector FROM part)"""


@query(f"""
WITH {_ITEMS}, k AS (SELECT *, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS label, CASE lower(tag) WHEN 'nav-group' THEN 'collapsable_menu' WHEN 'nav-item' THEN 'basic_menu_item' END AS kind FROM i)
SELECT screen, seq, label, kind, selector FROM k WHERE kind IS NOT NULL AND label NOT IN ('', 'x') AND length(label) <= 80 AND NOT starts_with(lower(label), 'menu de navegaci')
QUALIFY row_number() OVER (PARTITION BY screen, lower(label) ORDER BY seq) = 1
""")
def menu_entries(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    label = F.concat(pick(["Ventas", " ventas ", "Compras  y pagos", "", "Menu de navegación", "x", "Inicio"]), F.when(k % 13 == 0, "y" * 90).otherwise(""))
    items = load(spark, sf, "part").select((k % 40).alias("screen"), k.alias("seq"), label.alias("text"), pick(["nav-group", "NAV-ITEM", "div"]).alias("tag"), F.concat(F.lit("s"), k).alias("selector"))
    return crawl.menus(items, ("nav-group",), ("nav-item",), ("x",))


_LINKS = "l AS (SELECT event_id AS seq, '/u/' || (user_id % 20) AS source, '/u/' || (event_id % 23) AS target, CASE WHEN event_type IN ('view', 'click') THEN 'global_navigation' WHEN event_type = 'error' THEN NULL ELSE 'main_content' END AS region FROM events)"


@query(f"""
WITH {_LINKS}, r AS (SELECT *, target IN ('/u/1', '/u/2') OR seq > min(seq) OVER (PARTITION BY target) AS known FROM l WHERE source <> target AND NOT starts_with(target, '/u/22'))
SELECT seq, source, target FROM r WHERE NOT (region = 'global_navigation' AND source <> '/u/0' AND known) OR region IS NULL
""")
def link_registration(spark: SparkSession, sf: str) -> DataFrame:
    """Events as links between routes: repeated global ones make edges from home only."""
    e = F.col("event_type")
    region = F.when(e.isin("view", "click"), "global_navigation").when(e == "error", None).otherwise("main_content")
    links = load(spark, sf, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("/u/"), F.col("user_id") % 20).alias("source"), F.concat(F.lit("/u/"), F.col("event_id") % 23).alias("target"), region.alias("region"))
    known = spark.createDataFrame([("/u/1",), ("/u/2",)], "route string")
    return crawl.registered_links(links, "/u/0", known, block=("/u/22",)).select("seq", "source", "target")


@query("""
WITH e AS (SELECT event_id AS seq, sha256((event_id % 200)::VARCHAR) AS signature, user_id % 5 AS d, event_type AS label, value > 20 AS changed FROM events),
b AS (SELECT * FROM e WHERE changed AND signature NOT IN (SELECT sha256(x::VARCHAR) FROM range(0, 50) t(x)) QUALIFY row_number() OVER (PARTITION BY signature ORDER BY d, seq) = 1)
SELECT '/app#state:' || substr(signature, 1, 12) AS node, (d + 1)::INT AS depth, d + 1 < 3 AS enqueue, repeat('s>', d::INT) || label AS path FROM b
""")
def state_registration(spark: SparkSession, sf: str) -> DataFrame:
    """Events reach states by their signatures; a quarter of the signatures is known."""
    sign = lambda c: F.sha2(c.cast("string"), 256)
    events = load(spark, sf, "events").select(F.col("event_id").alias("seq"), sign(F.col("event_id") % 200).alias("signature"), F.array_repeat(F.lit("s"), (F.col("user_id") % 5).cast("int")).alias("source_path"), F.col("event_type").alias("label"), (F.col("value") > 20).alias("changed"))
    known = spark.range(50).select(sign(F.col("id")).alias("signature"))
    new = crawl.reached_states(events, known, 3)
    nodes = crawl.dynamic_nodes(new.select(F.lit("/app").alias("route"), "signature", F.lit("/app").alias("source"), F.col("signature").alias("label")))
    return new.join(nodes.select("node", F.col("label").alias("signature")), "signature").select("node", "depth", "enqueue", F.array_join("path", ">").alias("path"))


@query("""
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unstable_observation' WHEN user_id % 3 <> event_id % 3 THEN 'changed' WHEN value > 50 THEN 'data_changed' ELSE 'unchanged' END AS outcome FROM events
""")
def change_detection(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select("event_id", (F.col("user_id") % 3).alias("before"), (F.col("event_id") % 3).alias("after"), F.lit(0).alias("before_exact"), F.when(F.col("value") > 50, 1).otherwise(0).alias("after_exact"), (F.col("event_id") % 11 != 0).alias("stable"))
    return crawl.changes(rows).select("event_id", "outcome")


@query("""
WITH e AS (SELECT 'menu' || (user_id % 12) AS selector, CASE user_id % 12 WHEN 3 THEN 'Ventas' WHEN 4 THEN 'ventas' ELSE 'Menu ' || (user_id % 12) END AS label, CASE WHEN user_id % 12 = 7 THEN NULL ELSE '/p/' || (event_id % 9) END AS target, CASE WHEN user_id % 5 = 0 THEN '/x' ELSE '/home' END AS state_route FROM events),
p AS (SELECT selector, min(label) AS name, count(DISTINCT target) AS screens FROM e WHERE state_route = '/home' AND target IS NOT NULL GROUP BY 1)
SELECT selector AS module, name, screens, CASE WHEN count(*) OVER (PARTITION BY lower(name)) > 1 THEN selector END AS discriminator FROM p
""")
def module_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """Menus of home as modules; two of them share a name, one has no screens."""
    m = F.col("user_id") % 12
    label = F.when(m == 3, "Ventas").when(m == 4, "ventas").otherwise(F.concat(F.lit("Menu "), m))
    rows = load(spark, sf, "events").select(F.concat(F.lit("menu"), m).alias("selector"), label.alias("label"), F.when(m != 7, F.concat(F.lit("/p/"), F.col("event_id") % 9)).alias("target"), F.when(F.col("user_id") % 5 == 0, "/x").otherwise("/home").alias("state_route"))
    return crawl.discovered_modules(rows, "/home")


@query(f"""
WITH RECURSIVE {_LINKS}, s(route) AS (SELECT '/u/0' UNION SELECT target FROM s JOIN l ON s.route = l.source) SELECT route FROM s
""")
def frontier_fixed_point(spark: SparkSession, sf: str) -> DataFrame:
    """Routes reached from home when links are followed until nothing is new."""
    edges = load(spark, sf, "events").select(F.concat(F.lit("/u/"), F.col("user_id") % 20).alias("source"), F.concat(F.lit("/u/"), F.col("event_id") % 23).alias("target")).distinct()
    step = lambda seen: seen.union(seen.join(edges, seen["route"] == edges["source"]).select(F.col("target").alias("route"))).distinct()
    return crawl.fixed_point(spark.createDataFrame([("/u/0",)], "route string"), step, lambda old, new: old.count() == new.count())[0]


@query("""
SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM pages WHERE url LIKE '%1%') AS titled, (SELECT count(*) FROM events) AS edges, (SELECT count(DISTINCT event_type) FROM events) AS kinds, (SELECT count(*) FROM events WHERE event_type = 'error') AS failures
""")
def crawl_summary(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    return crawl.summary(load(spark, sf, "pages").select(F.when(F.col("url").contains("1"), "t").alias("title")), events.select(F.col("event_type").alias("kind")), events.where("event_type = 'error'"))


_LAST, _NONE = 2**31, "chr(65535)"
_WORD = lambda *cs: f"coalesce({', '.join(f"nullif({c}, '')" for c in cs)}, {_NONE})"
_PLACE = f"coalesce(position, {_LAST})"
_ORDERED = {
    "ui_state": f"CASE WHEN coalesce(depth, {_LAST}) <> 0 THEN 1 ELSE 0 END, coalesce(depth, {_LAST})", "table": f"{_PLACE}, coalesce(name, '')", "table_column": f"{_PLACE}, coalesce(name, '')",
    "field": f"{_PLACE}, {_WORD('label')}, {_WORD('name')}", "control": f"{_PLACE}, {_WORD('category')}, {_WORD('label')}", "link": f"{_PLACE}, {_WORD('label')}, {_WORD('route', 'target_screen_id')}",
    "event": f"{_WORD('category')}, {_WORD('source_state_id', 'screen_id')}", "transition": f"{_WORD('source_state_id')}, {_WORD('target_state_id')}, {_WORD('event_id')}",
}
_OWNER = "coalesce(table_id, screen_id, source_state_id, '')"


@query(f"""
WITH {ENTITIES}, e AS (SELECT *, CASE WHEN seq % 3 <> 0 THEN seq % 10 END AS position, {_OWNER} AS owner FROM ent)
{" UNION ALL ".join(f"SELECT canonical_id, row_number() OVER (PARTITION BY owner ORDER BY {o}, canonical_id) AS place FROM e WHERE entity_type = '{k}'" for k, o in _ORDERED.items())}
""")
def planner_order(spark: SparkSession, sf: str) -> DataFrame:
    """Each kind's rows in the order of a plan, within the screen, table or state that they belong to."""
    from pyspark.sql import Window

    none = F.lit(None).cast("string")
    rows = written_once(entities(spark, sf), "entities").withColumns({"position": F.when(F.col("seq") % 3 != 0, F.col("seq") % 10), "owner": F.expr(_OWNER), "control_type": F.col("category"), "event_type": none, "control_id": none, "link_id": none, "target_route": F.col("target_screen_id")})
    rows = rows.withColumnsRenamed({"label": "normalized_label", "name": "normalized_name"})
    each = [rows.where(F.col("entity_type") == k).withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy(*crawl.planner_order(k)))).select("canonical_id", "place") for k in _ORDERED]
    return reduce(DataFrame.unionByName, each)


@query("""
WITH d AS (SELECT o_orderkey AS screen_id, CASE o_orderkey % 9 WHEN 0 THEN '```{}```' WHEN 1 THEN 'no json' WHEN 2 THEN 'empty' WHEN 3 THEN 'other' WHEN 4 THEN 'mismatch' WHEN 5 THEN 'action' WHEN 6 THEN 'refs' WHEN 7 THEN 'statement' ELSE 'ok' END AS c FROM orders)
SELECT screen_id, CASE c WHEN '```{}```' THEN 'not_pure_json' WHEN 'no json' THEN 'invalid_json' WHEN 'empty' THEN 'no_supported_capabilities_generated' WHEN 'other' THEN 'schema' WHEN 'mismatch' THEN 'screen_mismatch' WHEN 'action' THEN 'declared_action_not_supported'
  WHEN 'refs' THEN 'declared_action_reference_not_permitted' WHEN 'statement' THEN 'declared_action_statement_mismatch' END AS error, CASE WHEN c = 'ok' THEN 'Permite buscar pedidos' END AS statement FROM d
""")
def draft_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Drafts each of which is wrong in one way, or right."""
    k = F.col("o_orderkey")
    draft = lambda kind, ident, action, statement, ref: F.concat(F.lit(f'{{"semantic_type":"{kind}","screen_id":"'), ident, F.lit(f'","supported_capabilities":[{{"action":"{action}","statement":"{statement}","evidence_refs":["{ref}"]}}]}}'))
    own = k.cast("string")
    fine = ("screen_purpose", own, "search", "Permite buscar pedidos", "control:1")
    variants = [F.lit("```{}```"), F.lit("no json"), F.lit('{"supported_capabilities":[]}'), draft("note", *fine[1:]), draft(fine[0], F.lit("0x"), *fine[2:]), draft(fine[0], own, "delete", *fine[3:]), draft(*fine[:4], "control:9"), draft(*fine[:3], "Permite eliminar pedidos", fine[4]), draft(*fine)]
    raw = F.element_at(F.array(*variants), (k % 9 + 1).cast("int"))
    orders = load(spark, sf, "orders")
    plan = orders.select(k.alias("screen_id"), F.lit("search").alias("action"), F.lit("direct").alias("support"), F.array(F.lit("control:1")).alias("refs"))
    return drafts.parsed(orders.select(k.alias("screen_id"), raw.alias("raw")), plan).select("screen_id", "error", F.array_join("statements", ";").alias("statement"))


@query("""
WITH a AS (SELECT c_custkey, c_name AS t, c_custkey % 8 AS m FROM customer)
SELECT c_custkey, CASE WHEN m % 4 = 1 THEN 'Permite buscar ' || lower(t[1]) || t[2:] || ' desde la pantalla.' WHEN m % 4 = 2 THEN 'Permite navegar entre las páginas de resultados de ' || lower(t[1]) || t[2:] || '.'
  WHEN m % 4 = 3 THEN 'Permite buscar y consultar ' || lower(t[1]) || t[2:] || ', así como navegar entre las páginas de resultados.' ELSE '' END || CASE WHEN m >= 4 THEN CASE WHEN m % 4 > 0 THEN ' ' ELSE '' END || 'La pantalla ' || t || ' presenta una opción relacionada con editar.' ELSE '' END AS summary FROM a
""")
def purpose_summaries(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("c_custkey") % 8
    direct = F.when(m % 4 == 1, F.array(F.lit("search"))).when(m % 4 == 2, F.array(F.lit("navigate"))).when(m % 4 == 3, F.array(*map(F.lit, ("search", "navigate", "view")))).otherwise(F.array().cast("array<string>"))
    prudent = F.when(m >= 4, F.array(F.lit("edit"))).otherwise(F.array().cast("array<string>"))
    return load(spark, sf, "customer").select("c_custkey", drafts.purpose(F.col("c_name"), direct, prudent).alias("summary"))


@query("""
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_custkey % 5 = 0 THEN 'evidence_hash' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'evidence_ids' END, CASE WHEN o_custkey % 11 = 0 THEN 'generated_content_hash' END,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'generation_model' END, CASE WHEN o_orderkey % 13 = 0 THEN 'generation_parameters' END, CASE WHEN o_orderkey % 17 = 0 THEN 'generation_parameters_hash' END, CASE WHEN o_orderkey % 19 = 0 THEN 'prompt_hash' END,
  CASE WHEN year(o_orderdate) = 1995 THEN 'prompt_version' END, CASE WHEN o_orderkey % 7 = 0 THEN 'references' END, CASE WHEN o_orderkey % 3 = 0 THEN 'screen_id' END, CASE WHEN o_orderstatus = 'F' THEN 'semantic_type' END,
  CASE WHEN o_custkey % 7 = 0 THEN 'structured_output_mode' END], lambda x: x IS NOT NULL), ',') AS failed FROM orders
""")
def candidate_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as generated candidates, each held against the package of its customer."""
    rows = load(spark, sf, "orders").selectExpr(
        "o_orderkey", """named_struct('screen_id', concat('screen:', o_custkey), 'evidence_hash', sha2(cast(o_custkey as string), 256), 'evidence_ids', array(o_orderstatus, 'e'), 'refs', array('control:1', concat('field:', o_custkey))) AS package""",
        """named_struct('prompt_version', 'v3', 'prompt_hash', 'p', 'generation_parameters', '{"temperature":0}', 'generation_parameters_hash', 'g', 'generation_model', 'm') AS expected""",
        """named_struct('semantic_type', if(o_orderstatus = 'F', 'other', 'screen_purpose'), 'screen_id', if(o_orderkey % 3 = 0, null, concat('screen:', o_custkey)), 'evidence_hash', sha2(cast(o_custkey - if(o_custkey % 5 = 0, 1, 0) as string), 256),
          'evidence_ids', if(o_orderpriority = '1-URGENT', array('e', o_orderstatus), array(o_orderstatus, 'e')), 'inference', to_json(named_struct('of', o_orderkey)),
          'generated_content_hash', sha2(if(o_custkey % 11 = 0, '{}', to_json(named_struct('of', o_orderkey))), 256), 'prompt_version', if(year(o_orderdate) = 1995, 'v2', 'v3'), 'prompt_hash', if(o_orderkey % 19 = 0, null, 'p'),
          'generation_parameters', if(o_orderkey % 13 = 0, '{}', '{"temperature":0}'), 'generation_parameters_hash', if(o_orderkey % 17 = 0, 'x', 'g'), 'generation_model', if(o_orderpriority = '5-LOW', 'n', 'm'),
          'structured_output_mode', if(o_custkey % 7 = 0, 'text', 'json'), 'refs', if(o_orderkey % 7 = 0, array('control:1', 'control:2'), array(concat('field:', o_custkey)))) AS candidate""",
    )
    checks = drafts.proposal_checks(F.col("candidate"), F.col("package"), F.col("expected"))
    return rows.select("o_orderkey", F.array_join(drafts.mismatches(checks), ",").alias("failed"))


_INTENT = ("locate", "fields", "buttons", "tables", "describe", "unknown")


@query("""
WITH a AS (SELECT p_partkey AS k, p_name AS t, p_partkey % 3 AS f, p_partkey % 2 AS b, p_partkey % 4 AS n FROM part), l AS (SELECT *, list_transform(range(0, f), lambda i: 'c' || i) AS fs, list_transform(range(0, b), lambda i: 'b' || i) AS bs FROM a),
s AS (SELECT *, CASE f WHEN 0 THEN '' WHEN 1 THEN 'c0' ELSE 'c0 y c1' END AS fj, CASE b WHEN 0 THEN '' ELSE 'b0' END AS bj, list_filter([CASE WHEN f > 0 THEN f || ' campos' END, CASE WHEN b > 0 THEN b || ' botón visible' END, CASE WHEN n = 1 THEN '1 tabla' WHEN n > 1 THEN n || ' tablas' END], lambda x: x IS NOT NULL) AS p FROM l)
SELECT k, CASE k % 6 WHEN 0 THEN 'Puedes encontrar ' || t || ' en la ruta Ventas por mayor → ' || t || '.' WHEN 1 THEN CASE WHEN f > 0 THEN 'En la pantalla ' || t || ' se identificaron los campos: ' || fj || '.' END WHEN 2 THEN CASE WHEN b > 0 THEN 'En la pantalla ' || t || ' se identificaron los botones visibles: ' || bj || '.' END
  WHEN 3 THEN CASE WHEN b > 0 THEN 'La tabla de ' || t || ' contiene las columnas: ' || bj || '.' END WHEN 4 THEN CASE WHEN len(p) > 0 THEN 'La pantalla ' || t || ' contiene ' || CASE len(p) WHEN 1 THEN p[1] WHEN 2 THEN p[1] || ' y ' || p[2] ELSE p[1] || ', ' || p[2] || ' y ' || p[3] END || '.' END END AS answer,
  array_to_string(list_filter([CASE WHEN k % 6 <> 1 AND f > 0 THEN '¿Qué campos tiene la pantalla ' || t || '?' END, CASE WHEN k % 6 <> 3 AND n > 0 THEN '¿Qué tabla tiene la pantalla ' || t || '?' END, '¿Cómo regreso al Dashboard?'], lambda x: x IS NOT NULL)[1:2], '|') AS more FROM s
""")
def page_answers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    intent = F.element_at(F.array(*map(F.lit, _INTENT)), (k % 6 + 1).cast("int"))
    names = lambda letter, n: F.transform(F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: i < n), lambda i: F.concat(F.lit(letter), i.cast("string")))
    fields, buttons, tables = names("c", k % 3), names("b", k % 2), k % 4
    answer = drafts.page_answer(intent, F.col("p_name"), F.lit("/app/ventasxmayor/lista"), fields, buttons, buttons, tables, F.array().cast("array<string>"))
    return load(spark, sf, "part").select(k.alias("k"), answer.alias("answer"), F.array_join(drafts.suggestions(intent, F.col("p_name"), fields, tables), "|").alias("more"))


_RAW = (
    ("not_an_object", '[1]'), ("operational_key:updated_at", '{"a": [{"Updated_At": 2, "b": 1}]}'), ("sensitive_key:token", '{"a": {"Token": "x"}}'),
    ("executable_markup", '{"a": {"b": "<Script>"}}'), ("sensitive_value", '{"a": "write to me@example.org"}'), ("sensitive_value", '{"b": [{"a": "at 10.20.30.40"}]}'),
    ("sensitive_value", '{"a": "el 3 de", "b": "USD $ 1.200,50"}'), ("", '{"a": ["me@example.org"], "b": "Ver"}'),
)


@query(f"""
WITH p AS (SELECT o_orderkey, o_orderkey % 10 AS i FROM orders)
SELECT o_orderkey, CASE i {" ".join(f"WHEN {i} THEN nullif('{e}', '')" for i, (e, _) in enumerate(_RAW))} WHEN 8 THEN 'too_large' END AS error,
  CASE i WHEN 0 THEN '[1]' WHEN 1 THEN '{{"a":[{{"b":1}}]}}' WHEN 2 THEN '{{"a":{{"Token":"x"}}}}' WHEN 3 THEN '{{"a":{{"b":"<Script>"}}}}' WHEN 4 THEN '{{"a":"write to me@example.org"}}'
    WHEN 5 THEN '{{"b":[{{"a":"at 10.20.30.40"}}]}}' WHEN 6 THEN '{{"a":"el 3 de","b":"USD $ 1.200,50"}}' WHEN 7 THEN '{{"a":["me@example.org"],"b":"Ver"}}' WHEN 8 THEN '{{"a":"' || repeat('ab ', 150) || '"}}'
    ELSE '{{"a":' || o_orderkey || ',"z":null}}' END AS functional FROM p
""")
def payload_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Corrections each of which is wrong in one way, and what is left of them without bookkeeping."""
    k = F.col("o_orderkey")
    large, fine = F.concat(F.lit('{"a": "'), F.repeat(F.lit("ab "), 150), F.lit('"}')), F.concat(F.lit('{"z": null, "a": '), k.cast("string"), F.lit("}"))
    raw = F.element_at(F.array(*(F.lit(raw) for _, raw in _RAW), large, fine), (k % 10 + 1).cast("int"))
    return load(spark, sf, "orders").select("o_orderkey", drafts.payload_error(raw, 300).alias("error"), drafts.functional(raw).alias("functional"))


@query("""
WITH m AS (SELECT p_partkey, 'brand' AS k, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'Token', 'x' FROM part UNION ALL SELECT p_partkey, 'note', CASE WHEN p_partkey % 3 = 0 THEN 'mail me@example.org' WHEN p_partkey % 3 = 1 THEN repeat('ab ', 200) ELSE 'fine' END FROM part)
SELECT p_partkey, string_agg(k || '=' || v, ',' ORDER BY k) AS kept FROM m WHERE k <> 'Token' AND NOT contains(v, '@') AND length(v) <= 500 GROUP BY p_partkey
""")
def safe_properties(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    note = F.when(k % 3 == 0, "mail me@example.org").when(k % 3 == 1, F.repeat(F.lit("ab "), 200)).otherwise("fine")
    kept = privacy.safe_metadata(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("Token"), F.lit("x"), F.lit("note"), note))
    return dealt(load(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey").select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("kept"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'row-<volatile>' ELSE 'row-' || (p_partkey % 1000) || 'x' END AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS shown FROM part
""")
def technical_ids(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.when(k % 2 == 0, F.concat(F.lit("row-"), (k + 10000).cast("string"))).otherwise(F.concat(F.lit("row-"), (k % 1000).cast("string"), F.lit("x")))
    return load(spark, sf, "part").select("p_partkey", privacy.without_number(raw).alias("id"), text.first_filled(F.when(k % 2 == 0, F.col("p_name")).otherwise("  "), F.col("p_brand")).alias("shown"))


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 2 = 0 THEN upper('part ' || (l_partkey % 9)) ELSE 'part ' || (l_partkey % 9) END AS v FROM lineitem),
f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY l_orderkey, lower(v) ORDER BY l_linenumber, l_partkey) = 1)
SELECT l_orderkey, string_agg(v, ',' ORDER BY l_linenumber, l_partkey) AS spellings FROM f GROUP BY 1
""")
def first_spellings(spark: SparkSession, sf: str) -> DataFrame:
    """Values of an order, each as it is first spelled."""
    k = F.col("l_partkey")
    v = F.concat(F.lit("part "), k % 9)
    rows = load(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", F.when(k % 2 == 0, F.upper(v)).otherwise(v).alias("v")).alias("x"))
    listed = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("vs"))
    return listed.select("l_orderkey", F.array_join(relations.distinct_ignoring_case(F.col("vs")), ",").alias("spellings"))


@query("""
WITH s AS (SELECT o_orderkey AS state_id, o_orderkey % 4 AS depth FROM orders), t AS (SELECT l_orderkey AS target, l_linenumber = 1 AS changed_route FROM lineitem WHERE l_orderkey % 3 = 0)
SELECT (SELECT count(*) FROM s) AS states, (SELECT max(depth) FROM s)::BIGINT AS deepest, (SELECT count(*) FROM s WHERE state_id NOT IN (SELECT target FROM t)) AS roots, (SELECT count(*) FROM t) AS transitions, (SELECT count(*) FROM t WHERE changed_route) AS route_changes
""")
def flow_profile(spark: SparkSession, sf: str) -> DataFrame:
    states = load(spark, sf, "orders").select(F.col("o_orderkey").alias("state_id"), (F.col("o_orderkey") % 4).alias("depth"))
    moves = load(spark, sf, "lineitem").where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("target"), (F.col("l_linenumber") == 1).alias("changed_route"))
    return audits.flow_profile(states, moves)


@query("""
SELECT user_id AS state_id, count(*) AS results, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase' AND value > 50) AS changed, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id
""")
def state_results(spark: SparkSession, sf: str) -> DataFrame:
    """What came of the events of each state."""
    e = F.col("event_type")
    return load(spark, sf, "events").groupBy(F.col("user_id").alias("state_id")).agg(
        F.count("*").alias("results"), F.count_if(e == "error").alias("failed"), F.count_if((e == "purchase") & (F.col("value") > 50)).alias("changed"), F.array_join(F.array_sort(F.collect_set(e)), ",").alias("kinds"))


@query("""
SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS proposals FROM orders GROUP BY o_custkey
""")
def proposals_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Each screen's proposals, oldest first."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string"))
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(listed, ",").alias("proposals"))


@query(f"""
WITH {ENTITIES} SELECT count(*) FILTER (entity_type = 'screen') AS screens, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (entity_type = 'screen' AND module_id IS NULL) AS without_module, count(*) FILTER (entity_type = 'event' AND source_state_id IS NULL) AS events_without_state, count(*) FILTER (status = 'corrected') AS corrected FROM ent
""")
def knowledge_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("entity_type")
    return entities(spark, sf).agg(
        F.count_if(e == "screen").alias("screens"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if((e == "screen") & F.col("module_id").isNull()).alias("without_module"),
        F.count_if((e == "event") & F.col("source_state_id").isNull()).alias("events_without_state"), F.count_if(F.col("status") == "corrected").alias("corrected"))


@query("""
SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 3 = 0 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1000
""")
def proposal_list(spark: SparkSession, sf: str) -> DataFrame:
    """Open proposals of some screens, newest first, a thousand at most."""
    from tessella.operators import ranking

    rows = load(spark, sf, "orders").where("o_orderstatus = 'O' and o_custkey % 3 = 0")
    return ranking.page(rows, [F.desc("o_orderdate"), F.desc("o_orderkey")], 0, 5000).select("o_orderkey", "o_custkey", "o_orderdate")


@query("""
SELECT n_name AS label, array_to_string([lower(n_name), substr(n_name, 1, 3)], ',') AS aliases FROM nation WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE ends_with('xx-' || (SELECT lower(n_name) FROM nation WHERE n_nationkey = 7), lower(n_name)))
""")
def profile_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases of the profile whose code the system's id ends in."""
    from tessella.sources.documents import aliases_for

    nation = load(spark, sf, "nation")
    code = nation.where("n_nationkey = 7").select(F.lower("n_name")).first()[0]
    profiles = nation.select(F.format_string("%03d.yaml", "n_nationkey").alias("file"), F.concat(F.lit("erp"), "n_nationkey").alias("id"), F.col("n_name").alias("code"), F.lit("x").alias("name"), F.create_map(F.col("n_name"), F.array(F.lower("n_name"), F.substring("n_name", 1, 3))).alias("aliases"))
    return aliases_for(profiles, f"xx-{code}").select("label", F.array_join("aliases", ",").alias("aliases"))


@query("""
SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 30
""")
def entity_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Entities by id; some ids are unknown."""
    from tessella.sources.documents import looked_up

    nation = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_name", "n_regionkey")
    return looked_up(nation, load(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 30).cast("long").alias("id")), "id").select("c_custkey", "n_name", "n_regionkey")


@query("""
WITH o AS (SELECT n_regionkey AS source, n_nationkey AS target FROM nation WHERE n_nationkey < 10), n AS (SELECT n_regionkey AS source, n_nationkey + (n_nationkey % 2) * 100 AS target FROM nation)
SELECT 'r' || source AS source, 'HAS' AS type, 'n' || target AS target FROM o UNION SELECT 'r' || source, 'HAS', 'n' || target FROM n WHERE target < 100
""")
def relationship_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Edges after an upsert: those without both ends are asked for and not written."""
    from tessella.sources.documents import merged_edges

    nation = load(spark, sf, "nation")
    k = F.col("n_nationkey")
    edge = lambda target: [F.concat(F.lit("r"), "n_regionkey").alias("source"), F.lit("HAS").alias("type"), F.concat(F.lit("n"), target).alias("target")]
    nodes = nation.select(F.concat(F.lit("n"), k).alias("id")).union(nation.select(F.concat(F.lit("r"), "n_regionkey")).distinct())
    return merged_edges(nation.where("n_nationkey < 10").select(*edge(k)), nation.select(*edge(k + (k % 2) * 100)), nodes)[0]
