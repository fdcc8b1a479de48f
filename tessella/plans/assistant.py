"""Questions about screens answered from what the projected graph holds around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import documents, projection, retrieval, search
from tessella.plans.base import ENTITIES, entities
from tessella.plans.publishing import _SAFE
from tessella.plans.registry import query
from tessella.session import load
from tessella.sources.shared import written_once

ALIASES = {"nuevo registro": ("alta", "agregar")}
_TEXTS = (
    "'Eliminar algo'", "'Crear dato'", "'Quiero buscar por ' || label", "'Que campos tiene Screen ' || k", "'Donde aparece la identificacion ' || label",
    "'En que modulo esta la pantalla Screen ' || k || ' ' || segment", "'Que hace el boton alta'", "'Columnas de la tabla'", "'Pagina siguiente'", "'Hola'", "'Aprobar Screen ' || k",
)
_QUESTION = "CASE k % 11 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_TEXTS)) + " END"
_LABEL = "CASE entity_type " + " ".join(f"WHEN '{t}' THEN coalesce({', '.join(_SAFE.format(c) for c in cs)})" for t, cs in documents.RETRIEVED_KEYS.items()) + f" ELSE coalesce({', '.join(_SAFE.format(c) for c in documents.ANY_KEYS)}) END"
_KEY = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_RULES = " UNION ALL ".join(f"SELECT '{n}' AS type, {a} AS source, {b} AS target FROM ent WHERE entity_type = '{kind}' AND {a} IS NOT NULL AND {b} IS NOT NULL" for kind, es in projection.EDGES.items() if kind != "evidence" for n, a, b in es if n != "TARGETS")
_BASE = f"""{ENTITIES},
good AS (SELECT *, coalesce({_LABEL}, 'Entidad validada') AS safe_label FROM ent WHERE status IN ('approved', 'corrected')), e0 AS (SELECT DISTINCT * FROM ({_RULES})),
q AS (SELECT k AS question_id, {_QUESTION} AS question FROM (SELECT c_custkey AS k, c_mktsegment AS segment, coalesce(p_name, 'x') AS label FROM customer LEFT JOIN part ON p_partkey = c_custkey - 1)),
one AS (SELECT question_id, source || '|' || type || '|' || target AS path_id, CASE WHEN source = 'screen:' || question_id THEN target ELSE source END AS ends, [struct_pack(source := source, type := type, target := target)] AS edges FROM q JOIN e0 ON source = 'screen:' || question_id OR target = 'screen:' || question_id),
two AS (SELECT o.question_id, o.path_id || ';' || e.source || '|' || e.type || '|' || e.target AS path_id, e.target AS ends, list_append(o.edges, struct_pack(source := e.source, type := e.type, target := e.target)) AS edges FROM one o JOIN e0 e ON o.ends = e.source AND e.type IN ('HAS_COLUMN', 'FROM_STATE') AND starts_with(o.path_id, 'screen:')),
walks AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY len(edges), path_id) AS seq FROM (SELECT * FROM one UNION ALL SELECT * FROM two)),
hits AS (SELECT question_id, 'screen:' || question_id AS canonical_id, 0.5::DOUBLE AS score, 1 AS seq FROM q WHERE question_id % 4 <> 0 UNION ALL SELECT question_id, 'field:' || (question_id - 1), 0.25::DOUBLE, 2 FROM q WHERE question_id % 6 = 1),
ids AS (SELECT question_id, canonical_id, min(o) AS o FROM (SELECT question_id, canonical_id, (0, seq, 0) AS o FROM hits UNION ALL SELECT question_id, ends, (1, seq, 0) FROM walks
  UNION ALL SELECT question_id, n, (2, seq, p) FROM (SELECT question_id, seq, unnest(list_concat(list_transform(edges, lambda x: x.source), list_transform(edges, lambda x: x.target))) AS n,
    unnest(list_concat(list_transform(range(0, len(edges)), lambda i: 2 * i), list_transform(range(0, len(edges)), lambda i: 2 * i + 1))) AS p FROM walks)) GROUP BY ALL),
place AS (SELECT question_id, canonical_id, row_number() OVER (PARTITION BY question_id ORDER BY o) AS place FROM ids),
src AS (SELECT p.question_id, place, g.canonical_id, entity_type, safe_label, route, h.score, CASE WHEN h.score IS NOT NULL AND w.ends IS NOT NULL THEN 'semantic+graph' WHEN h.score IS NOT NULL THEN 'semantic' ELSE 'graph' END AS origin
  FROM place p JOIN good g USING (canonical_id) LEFT JOIN hits h ON h.question_id = p.question_id AND h.canonical_id = p.canonical_id LEFT JOIN (SELECT DISTINCT question_id, ends FROM walks) w ON w.question_id = p.question_id AND w.ends = p.canonical_id),
steps AS (SELECT question_id, path_id, seq, unnest(edges) AS e, unnest(range(0, len(edges))) AS p FROM walks),
bad AS (SELECT DISTINCT question_id, path_id FROM steps WHERE e.source NOT IN (SELECT canonical_id FROM good) OR e.target NOT IN (SELECT canonical_id FROM good)),
rel0 AS (SELECT question_id, e.source AS source, e.type AS type, e.target AS target, min((seq, p)) AS o FROM steps WHERE (question_id, path_id) NOT IN (SELECT (question_id, path_id) FROM bad) GROUP BY ALL),
rel AS (SELECT r.question_id, r.source, r.type, r.target, row_number() OVER (PARTITION BY r.question_id ORDER BY o) AS seq, a.safe_label AS source_label, b.safe_label AS target_label, a.entity_type AS source_type, b.entity_type AS target_type
  FROM rel0 r JOIN good a ON a.canonical_id = source JOIN good b ON b.canonical_id = target)"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part").select(F.col("p_partkey").alias("_p"), "p_name")
    rows = load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    rows = rows.join(part, F.col("k") - 1 == F.col("_p"), "left").withColumn("label", F.coalesce("p_name", F.lit("x"))).selectExpr("k AS question_id", f"{_QUESTION} AS question")
    return rows.withColumn("key", text.question_key(F.col("question"))).withColumn("intent", search.intent(F.col("question")))


def approved(spark: SparkSession, sf: str) -> DataFrame:
    good = entities(spark, sf).where(F.col("status").isin("approved", "corrected"))
    return documents.labelled(good, documents.RETRIEVED_KEYS).withColumn("safe_label", F.coalesce("safe_label", F.lit("Entidad validada")))


def walked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(hits, walks): a question is about the screen with its number; walks go one step, or two through tables and events."""
    q = questions(spark, sf).select("question_id", F.concat(F.lit("screen:"), "question_id").alias("id"))
    edges = written_once(projection.candidate_edges(entities(spark, sf)).where("type <> 'TARGETS' and type <> 'HAS_EVIDENCE'").distinct(), "edges")
    edge = F.struct("source", "type", "target")
    path = F.concat_ws("|", "source", "type", "target")
    out = q.join(edges, F.col("id") == F.col("source")).select("question_id", path.alias("path_id"), F.col("target").alias("ends"), F.array(edge).alias("edges"))
    back = q.join(edges, F.col("id") == F.col("target")).select("question_id", path.alias("path_id"), F.col("source").alias("ends"), F.array(edge).alias("edges"))
    more = edges.where(F.col("type").isin("HAS_COLUMN", "FROM_STATE"))
    two = out.join(more, F.col("ends") == F.col("source")).select("question_id", F.concat_ws(";", "path_id", path).alias("path_id"), F.col("target").alias("ends"), F.concat("edges", F.array(edge)).alias("edges"))
    every = out.union(back).union(two).withColumn("seq", F.expr("row_number() over (partition by question_id order by size(edges), path_id)"))
    seeds = q.where("question_id % 4 <> 0").select("question_id", F.col("id").alias("canonical_id"), F.lit(0.5).alias("score"), F.lit(1).alias("seq"))
    fields = q.where("question_id % 6 = 1").select("question_id", F.concat(F.lit("field:"), F.col("question_id") - 1).alias("canonical_id"), F.lit(0.25).alias("score"), F.lit(2).alias("seq"))
    return seeds.union(fields), every


def _known(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, walks, approved entities), the last two written once, with no more columns than retrieval reads."""
    hits, walks = walked(spark, sf)
    return hits, written_once(walks, "walks"), written_once(approved(spark, sf).select("canonical_id", "entity_type", "safe_label", "route"), "approved")


def retrieved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    hits, walks, known = _known(spark, sf)
    found = written_once(retrieval.sources(retrieval.candidate_ids(hits, walks), hits, walks, known), "sources")
    return found, written_once(retrieval.relations(walks, known), "relations"), hits, known


_ROUTED = """first AS (SELECT question_id, target, min_by(source, seq) AS source FROM rel WHERE type IN ('HAS_FIELD', 'HAS_CONTROL', 'HAS_TABLE') GROUP BY ALL),
routed AS (SELECT s.* REPLACE (coalesce(s.route, r.route) AS route) FROM src s LEFT JOIN first f ON f.question_id = s.question_id AND f.target = s.canonical_id LEFT JOIN src r ON r.question_id = s.question_id AND r.canonical_id = f.source AND r.entity_type = 'screen')"""


@query(f"WITH {_BASE}, {_ROUTED} SELECT question_id, place, canonical_id, safe_label, route, origin, score FROM routed")
def retrieved_sources(spark: SparkSession, sf: str) -> DataFrame:
    """What search and graph found for each question, approved only, with routes filled from their screens."""
    found, edges, *_ = retrieved(spark, sf)
    return retrieval.with_routes(found, edges).select("question_id", "place", "canonical_id", "safe_label", "route", "origin", "score")


@query(f"WITH {_BASE} SELECT question_id, seq, source, type, target, source_label, target_label FROM rel")
def retrieved_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Sources are not looked for."""
    _, walks, known = _known(spark, sf)
    return retrieval.relations(walks, known).select("question_id", "seq", "source", "type", "target", "source_label", "target_label")


_FACTS = "CASE type WHEN 'HAS_SCREEN' THEN 'El ' || CASE source_type WHEN 'erp_system' THEN 'ERP' WHEN 'module' THEN 'módulo' ELSE source_type END || ' \"' || source_label || '\" contiene la pantalla \"' || target_label || '\".' " + " ".join(
    f"WHEN '{k}' THEN '{a}' || source_label || '{b}' || target_label || '{c}'" for k, (a, b, c) in retrieval.FACTS.items()) + " ELSE '\"' || source_label || '\" se relaciona mediante ' || type || ' con \"' || target_label || '\".' END"


@query(f"""
WITH {_BASE}, h AS (SELECT h.question_id, string_agg('- ' || g.entity_type || ': ' || g.safe_label, chr(10) ORDER BY h.seq) AS h FROM hits h JOIN good g USING (canonical_id) GROUP BY 1),
s AS (SELECT question_id, string_agg('- ' || entity_type || ': ' || safe_label, chr(10) ORDER BY place) AS s FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY place) AS r FROM src) WHERE r <= 10 GROUP BY 1),
f AS (SELECT question_id, string_agg({_FACTS}, chr(10) ORDER BY seq) AS f FROM rel WHERE seq <= 12 GROUP BY 1)
SELECT question_id, substr('COINCIDENCIAS SEMÁNTICAS' || chr(10) || coalesce(h, '') || chr(10) || chr(10) || 'ENTIDADES VALIDADAS' || chr(10) || coalesce(s, '') || chr(10) || chr(10) || 'RELACIONES VALIDADAS' || chr(10) || coalesce(f, ''), 1, 6000) AS context
FROM h FULL JOIN s USING (question_id) FULL JOIN f USING (question_id)
""")
def retrieval_contexts(spark: SparkSession, sf: str) -> DataFrame:
    found, edges, hits, known = retrieved(spark, sf)
    named = hits.join(known.select("canonical_id", "entity_type", "safe_label"), "canonical_id")
    return retrieval.contexts(found, named, edges)


_INTENTS = " ".join(f"WHEN regexp_matches(lower(question), '{p.removeprefix('(?U)')}') THEN '{n}'" for n, p in search.INTENTS)
_NAMED = f"(contains(key, {_KEY.format('target_label')}) OR {_KEY.format('target_label')} = 'nuevo registro' AND (contains(key, 'alta') OR contains(key, 'agregar')))"
_FOCAL = f"""asked AS (SELECT *, {_KEY.format('question')} AS key, CASE {_INTENTS} END AS intent FROM q),
touch AS (SELECT r.question_id, CASE WHEN type = 'HAS_SCREEN' THEN target ELSE source END AS id FROM rel r JOIN src s ON s.question_id = r.question_id AND s.canonical_id IN (r.source, r.target) WHERE type IN ('HAS_FIELD', 'HAS_CONTROL', 'HAS_TABLE', 'HAS_SCREEN')),
cand AS (SELECT question_id, id, max(name) AS name FROM (SELECT question_id, canonical_id AS id, safe_label AS name FROM src WHERE entity_type = 'screen' UNION ALL SELECT question_id, source, source_label FROM rel WHERE type = 'HAS_FIELD' UNION ALL SELECT question_id, id, NULL FROM touch) GROUP BY ALL),
deg AS (SELECT c.question_id, c.id, count(r.source) AS n FROM cand c LEFT JOIN rel r ON r.question_id = c.question_id AND c.id IN (r.source, r.target) GROUP BY ALL),
focal AS (SELECT question_id, arg_min(id, (CASE WHEN coalesce({_KEY.format('name')}, '') <> '' AND contains(key, {_KEY.format('name')}) THEN 0 ELSE 1 END, -n, id)) AS focal FROM cand JOIN deg USING (question_id, id) JOIN asked USING (question_id) GROUP BY 1),
r AS (SELECT rel.*, source = focal AS here, {_NAMED} AS named, regexp_matches({_KEY.format('target_label')}, 'buscar|search|filtrar|filtro') AS searches, regexp_matches({_KEY.format('target_label')}, 'buscar|search|filtro') AS lists, question, intent
  FROM rel JOIN asked USING (question_id) LEFT JOIN focal USING (question_id))"""
_PICK = "(SELECT list(struct_pack(source := source, target := target, sl := source_label, tl := target_label) ORDER BY seq) FROM r WHERE r.question_id = a.question_id AND {0})"
_PLANS = f"""{_FOCAL},
l AS (SELECT a.question_id, a.question, a.intent, {_PICK.format("type = 'HAS_FIELD' AND here")} AS fa, {_PICK.format("type = 'HAS_FIELD' AND named")} AS fn, {_PICK.format("type = 'HAS_FIELD' AND here AND named")} AS fb, {_PICK.format("type = 'HAS_CONTROL' AND here")} AS ca,
  {_PICK.format("type = 'HAS_CONTROL' AND here AND searches")} AS cs, {_PICK.format("type = 'HAS_CONTROL' AND here AND (named OR lists)")} AS cb, {_PICK.format("type = 'HAS_CONTROL' AND named")} AS cn, {_PICK.format("type = 'HAS_SCREEN' AND named")} AS sn,
  {_PICK.format("type = 'HAS_COLUMN' AND source IN (SELECT t.target FROM r t WHERE t.question_id = a.question_id AND t.type = 'HAS_TABLE' AND t.here)")} AS co, {_PICK.format("type IN ('HAS_EVENT', 'FROM_STATE', 'TO_STATE', 'TRIGGERED_BY')")} AS mv,
  {_PICK.format("type IN ('HAS_CONTROL', 'HAS_EVENT', 'TRIGGERED_BY')")} AS ac, {_PICK.format("type = 'HAS_SCREEN'")} AS hs FROM asked a),
m AS (SELECT *, list_filter(hs, lambda x: x.target = fn[1].source)[1] AS home, coalesce(cb[1], CASE WHEN len(ca) = 1 THEN ca[1] END) AS beside,
  regexp_matches(lower(question), '(^|[^\\w])cre') AND len(list_filter(ac, lambda x: regexp_matches(lower(x.tl), 'nuevo|nueva|new|crear|agregar|añadir|registrar'))) > 0
  OR regexp_matches(lower(question), '(^|[^\\w])(elimin|borr)') AND len(list_filter(ac, lambda x: regexp_matches(lower(x.tl), 'eliminar|borrar|remover'))) > 0 AS backed FROM l),
n AS (SELECT *, CASE intent WHEN 'MUTATIVE_ACTION' THEN coalesce(backed, false) WHEN 'SEARCH_BY_FIELD' THEN len(fb) > 0 AND len(cs) > 0 WHEN 'LIST_FIELDS' THEN len(fa) > 0 WHEN 'LOCATE_FIELD' THEN len(fn) > 0 WHEN 'LOCATE_SCREEN' THEN len(sn) > 0
  WHEN 'FIND_CONTROL' THEN len(cn) > 0 WHEN 'LIST_COLUMNS' THEN len(co) > 0 WHEN 'NAVIGATION_EVENT' THEN len(mv) > 0 ELSE false END AS ok FROM m),
p AS (SELECT question_id, question, intent, coalesce(ok, false) AS supported, CASE WHEN ok THEN CASE intent WHEN 'MUTATIVE_ACTION' THEN ac[1:1] WHEN 'SEARCH_BY_FIELD' THEN list_concat(fb[1:1], cs[1:1]) WHEN 'LIST_FIELDS' THEN fa WHEN 'LOCATE_FIELD' THEN CASE WHEN home IS NULL THEN fn[1:1] ELSE list_append(fn[1:1], home) END
    WHEN 'LOCATE_SCREEN' THEN sn[1:1] WHEN 'FIND_CONTROL' THEN cn WHEN 'LIST_COLUMNS' THEN co ELSE mv END END AS ev,
  CASE WHEN ok THEN CASE intent WHEN 'MUTATIVE_ACTION' THEN 'La acción está respaldada por el control "' || ac[1].tl || '".'
    WHEN 'SEARCH_BY_FIELD' THEN 'Para buscar por "' || fb[1].tl || '", la pantalla "' || fb[1].sl || '" dispone del campo "' || fb[1].tl || '" y del control "' || cs[1].tl || '".'
    WHEN 'LIST_FIELDS' THEN 'En la pantalla "' || fa[1].sl || '" aparecen los campos ' || {{fields}} || coalesce(', junto al control "' || beside.tl || '"', '') || '.'
    WHEN 'LOCATE_FIELD' THEN 'El campo "' || fn[1].tl || '" se encuentra en la pantalla "' || fn[1].sl || '"' || coalesce(', dentro del módulo "' || home.sl || '"', '') || '.' WHEN 'LOCATE_SCREEN' THEN 'La pantalla "' || sn[1].tl || '" está dentro del módulo "' || sn[1].sl || '".'
    WHEN 'FIND_CONTROL' THEN 'El control "' || cn[1].tl || '" está en la pantalla "' || cn[1].sl || '".' WHEN 'LIST_COLUMNS' THEN 'La tabla "' || co[1].sl || '" contiene las columnas ' || {{columns}} || '.'
    ELSE 'La navegación validada incluye eventos y estados relacionados en la pantalla recuperada.' END WHEN intent = 'MUTATIVE_ACTION' THEN 'No encontré conocimiento validado suficiente para responder esa pregunta.' END AS answer,
  CASE WHEN ok AND intent = 'NAVIGATION_EVENT' THEN 'medium' WHEN ok OR intent = 'MUTATIVE_ACTION' THEN 'high' ELSE 'low' END AS confidence FROM n)"""


def _spoken(xs: str) -> str:
    """First spellings of labels, in order, as a spoken list."""
    d = f"list_transform(list_filter(range(1, len({xs}) + 1), lambda i: list_position(list_transform({xs}, lambda x: x.tl), {xs}[i].tl) = i), lambda i: {xs}[i].tl)"
    return f"(CASE WHEN len({d}) = 1 THEN ({d})[1] ELSE array_to_string(({d})[1:len({d}) - 1], ', ') || ' y ' || ({d})[len({d})] END)"


_PLANS = _PLANS.replace("{fields}", _spoken("fa")).replace("{columns}", _spoken("co"))
_FIRSTS = "array_to_string(list_transform(list_filter(range(1, len(ids) + 1), lambda i: list_position(ids, ids[i]) = i), lambda i: ids[i]), ',')"


@query(f"""
WITH {_BASE}, {_PLANS}, w AS (SELECT *, flatten(list_transform(ev, lambda x: [x.source, x.target])) AS ids FROM p)
SELECT question_id, intent, supported, answer, coalesce({_FIRSTS}, '') AS evidence, confidence FROM w
""")
def grounded_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic answers for eight intents, and what supports them."""
    found, edges, *_ = retrieved(spark, sf)
    return retrieval.plans(questions(spark, sf), found, edges, ALIASES).withColumn("evidence", F.array_join("evidence", ","))


_WORDS = "regexp_extract_all(lower(question), '[\\wáéíóúñ]+')"
_ASKED = " OR ".join(f"len(list_filter(ws, lambda w: regexp_full_match(w, '{f}'))) > 0" for f in retrieval.VERB_FORMS.values())
_BACKED = " OR ".join(f"len(list_filter(ws, lambda w: regexp_full_match(w, '{f}'))) > 0 AND coalesce(regexp_matches(lower(acts), '{'|'.join(retrieval.SUPPORTED_BY.get(v, (v,)))}'), false)" for v, f in retrieval.VERB_FORMS.items())


@query(f"""
WITH {_BASE}, {_PLANS}, acts AS (SELECT question_id, string_agg(safe_label, chr(10)) FILTER (entity_type IN ('control', 'event', 'transition')) AS acts, count(*) AS n FROM src GROUP BY 1),
o AS (SELECT p.*, acts, n, {_WORDS} AS ws FROM p LEFT JOIN acts USING (question_id)), z AS (SELECT *, n IS NULL OR ({_ASKED}) AND NOT ({_BACKED}) AS lacking FROM o)
SELECT question_id, CASE WHEN supported THEN 'deterministic_graph' WHEN intent = 'MUTATIVE_ACTION' THEN 'policy_abstention' WHEN lacking THEN 'insufficient_evidence' ELSE 'ollama_grounded' END AS answer_mode,
  CASE WHEN supported THEN answer WHEN intent = 'MUTATIVE_ACTION' OR lacking THEN 'No encontré conocimiento validado suficiente para responder esa pregunta.' END AS answer FROM z
""")
def grounded_answers(spark: SparkSession, sf: str) -> DataFrame:
    found, edges, *_ = retrieved(spark, sf)
    asked = questions(spark, sf)
    return retrieval.outcomes(retrieval.plans(asked, found, edges, ALIASES), asked, found).select("question_id", "answer_mode", "answer")
