"""Answers grounded in retrieved entities: sources, relations, facts, context, plans by intent, abstention.

Retrieved rows are (question_id, canonical_id, entity_type, safe_label, score, seq); walks are (question_id, path_id, seq, ends,
edges array<struct<source, type, target>>). seq is the order in which the graph gave them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators.answers import ABSTAIN

# Sentences for relations, names of types in them, forms of verbs that change data, and words that support them.
FACTS = {
    "HAS_MODULE": ('El ERP "', '" contiene el módulo "', '".'), "HAS_FIELD": ('La pantalla "', '" contiene el campo "', '".'), "HAS_CONTROL": ('La pantalla "', '" contiene el control "', '".'),
    "HAS_TABLE": ('La pantalla "', '" contiene la tabla "', '".'), "HAS_COLUMN": ('La tabla "', '" contiene la columna "', '".'),
}
TYPE_NAMES = {
    "erp_system": "ERP", "module": "módulo", "screen": "pantalla", "ui_state": "estado", "field": "campo", "control": "control", "table": "tabla",
    "table_column": "columna", "event": "evento", "transition": "transición", "link": "enlace",
}
VERB_FORMS = {
    "eliminar": r"elimin(?:ar|o|a|e|é|ando|ado)", "borrar": r"borr(?:ar|o|a|e|é|ando|ado)", "anular": r"anul(?:ar|o|a|e|é|ando|ado)",
    "modificar": r"modific(?:ar|o|a|e|ando|ado)", "editar": r"edit(?:ar|o|a|e|ando|ado)", "guardar": r"guard(?:ar|o|a|e|ando|ado)",
    "crear": r"cre(?:ar|o|a|e|ando|ado)", "registrar": r"registr(?:ar|o|a|e|ando|ado)", "aprobar": r"aprob(?:ar|o|a|e|ando|ado)",
    "confirmar": r"confirm(?:ar|o|a|e|ando|ado)",
}
SUPPORTED_BY = {
    "crear": ("crear", "nuevo", "nueva", "agregar", "añadir", "registrar"), "eliminar": ("eliminar", "borrar", "remover"),
    "guardar": ("guardar", "confirmar", "aceptar", "aplicar"),
}
STEM_SUPPORT = {"cre": ("nuevo", "nueva", "new", "crear", "agregar", "añadir", "registrar"), "elimin": ("eliminar", "borrar", "remover"), "borr": ("eliminar", "borrar", "remover")}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _some(values: Column, pattern: str) -> Column:
    """Whether one of the values matches, in lower case."""
    return F.exists(values, lambda x: F.lower(x).rlike(pattern))


def candidate_ids(hits: DataFrame, walks: DataFrame) -> DataFrame:
    """(question_id, canonical_id, place): hits first, then ends of walks, then nodes on the way, each at its first place."""
    seeds = hits.select("question_id", "canonical_id", F.struct(F.lit(0), F.col("seq"), F.lit(0)).alias("o"))
    ends = walks.select("question_id", F.col("ends").alias("canonical_id"), F.struct(F.lit(1), F.col("seq"), F.lit(0)).alias("o"))
    nodes = F.flatten(F.transform("edges", lambda e: F.array(e["source"], e["target"])))
    way = walks.select("question_id", F.posexplode(nodes).alias("p", "canonical_id"), "seq").select("question_id", "canonical_id", F.struct(F.lit(2), F.col("seq"), F.col("p")).alias("o"))
    first = seeds.union(ends).union(way).groupBy("question_id", "canonical_id").agg(F.min("o").alias("o"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("o"))).drop("o")


def sources(ids: DataFrame, hits: DataFrame, walks: DataFrame, entities: DataFrame) -> DataFrame:
    """Approved entities of the ids, in place, with label, route, score and whether search, the graph or both found them."""
    found = walks.select("question_id", F.col("ends").alias("canonical_id"), F.lit(True).alias("_g")).distinct()
    scored = hits.groupBy("question_id", "canonical_id").agg(F.max("score").alias("score"))
    out = ids.join(entities.select("canonical_id", "entity_type", "safe_label", "route"), "canonical_id").join(scored, ["question_id", "canonical_id"], "left").join(found, ["question_id", "canonical_id"], "left")
    origin = F.when(F.col("score").isNotNull() & F.col("_g").isNotNull(), "semantic+graph").when(F.col("score").isNotNull(), "semantic").otherwise("graph")
    return out.select("question_id", "place", "canonical_id", "entity_type", "safe_label", "route", origin.alias("origin"), "score")


def relations(walks: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct edges of the walks all of whose nodes are approved, in order, with labels and types of their ends."""
    steps = walks.select("question_id", "path_id", "seq", "ends", F.posexplode("edges").alias("p", "e")).select("question_id", "path_id", "seq", "p", "e.*")
    known = entities.select("canonical_id", "safe_label", "entity_type")
    side = lambda k: known.select(F.col("canonical_id").alias(k), F.col("safe_label").alias(f"{k}_label"), F.col("entity_type").alias(f"{k}_type"))
    both = steps.join(side("source"), "source", "left").join(side("target"), "target", "left")
    # a path has few steps: they are gathered with what is known of all, so that the joins above are not made twice
    paths = both.groupBy("question_id", "path_id").agg(
        F.bool_and(F.col("source_type").isNotNull() & F.col("target_type").isNotNull()).alias("ok"),
        F.collect_list(F.struct("seq", "p", "source", "type", "target", "source_label", "target_label", "source_type", "target_type")).alias("steps"))
    kept = paths.where("ok").select("question_id", F.inline("steps"))
    one = kept.groupBy("question_id", "source", "type", "target").agg(F.min(F.struct("seq", "p")).alias("o"), *[F.first(c).alias(c) for c in ("source_label", "target_label", "source_type", "target_type")])
    return one.withColumn("seq", F.row_number().over(Window.partitionBy("question_id").orderBy("o"))).drop("o")


def with_routes(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Sources without a route take that of the screen that the first of their relations comes from."""
    screens = found.where("entity_type = 'screen' and route is not null").select("question_id", F.col("canonical_id").alias("source"), F.col("route").alias("_r"))
    first = edges.where(F.col("type").isin("HAS_FIELD", "HAS_CONTROL", "HAS_TABLE")).groupBy("question_id", F.col("target").alias("canonical_id")).agg(F.min_by("source", "seq").alias("source"))
    given = first.join(screens, ["question_id", "source"]).drop("source")
    return found.join(given, ["question_id", "canonical_id"], "left").withColumn("route", F.coalesce(F.nullif("route", F.lit("")), "_r")).drop("_r")


def fact(kind: Column, source: Column, target: Column, source_type: Column) -> Column:
    """A relation as a sentence."""
    out = F.when(kind == "HAS_SCREEN", F.concat(F.lit("El "), F.coalesce(F.try_element_at(_map(TYPE_NAMES), source_type), source_type), F.lit(' "'), source, F.lit('" contiene la pantalla "'), target, F.lit('".')))
    for name, (a, b, c) in FACTS.items():
        out = out.when(kind == name, F.concat(F.lit(a), source, F.lit(b), target, F.lit(c)))
    return out.otherwise(F.concat(F.lit('"'), source, F.lit('" se relaciona mediante '), kind, F.lit(' con "'), target, F.lit('".')))


def contexts(found: DataFrame, hits: DataFrame, edges: DataFrame, characters: int = 6000) -> DataFrame:
    """(question_id, context): eight hits, ten sources and twelve facts as text, cut. Rows are cut before they are gathered."""
    entry = lambda df: F.concat(F.lit("- "), df["entity_type"], F.lit(": "), df["safe_label"])

    def lines(df: DataFrame, order: str, line: Column, most: int, name: str) -> DataFrame:
        ranked = df.select("question_id", line.alias("line"), F.row_number().over(Window.partitionBy("question_id").orderBy(order)).alias("r")).where(F.col("r") <= most)
        return ranked.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n").alias(name))

    out = lines(hits, "seq", entry(hits), 8, "_h").join(lines(found, "place", entry(found), 10, "_s"), "question_id", "full_outer")
    out = out.join(lines(edges, "seq", fact(F.col("type"), F.col("source_label"), F.col("target_label"), F.col("source_type")), 12, "_f"), "question_id", "full_outer")
    text_ = F.concat(F.lit("COINCIDENCIAS SEMÁNTICAS\n"), F.coalesce("_h", F.lit("")), F.lit("\n\nENTIDADES VALIDADAS\n"), F.coalesce("_s", F.lit("")), F.lit("\n\nRELACIONES VALIDADAS\n"), F.coalesce("_f", F.lit("")))
    return out.select("question_id", F.substring(text_, 1, characters).alias("context"))


def mentioned(question_key: Column, label_key: Column, aliases: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Whether a label, or one of its aliases, is inside the question; an empty label always is."""
    out = F.contains(question_key, F.coalesce(label_key, F.lit("")))
    for name, others in (aliases or {}).items():
        out = out | ((label_key == name) & reduce(lambda a, b: a | b, [F.contains(question_key, F.lit(o)) for o in others]))
    return out


def focal_screens(questions: DataFrame, found: DataFrame, edges: DataFrame, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(question_id, focal): of the screens that were found, or whose relations touch what was found, one that the question
    names; else the one with most relations. The smallest id among equals, and unnamed screens count as not named."""
    screens = found.where("entity_type = 'screen'").select("question_id", F.col("canonical_id").alias("id"), F.col("safe_label").alias("name"))
    owners = edges.where("type = 'HAS_FIELD'").select("question_id", F.col("source").alias("id"), F.col("source_label").alias("name"))
    near = edges.where(F.col("type").isin("HAS_FIELD", "HAS_CONTROL", "HAS_TABLE", "HAS_SCREEN"))
    ends = near.withColumn("touch", F.explode(F.array("source", "target"))).join(found.select("question_id", F.col("canonical_id").alias("touch")), ["question_id", "touch"], "left_semi")
    touched = ends.select("question_id", F.when(F.col("type") == "HAS_SCREEN", F.col("target")).otherwise(F.col("source")).alias("id"), F.lit(None).cast("string").alias("name"))
    every = screens.union(owners).union(touched).groupBy("question_id", "id").agg(F.max("name").alias("name"))
    degree = edges.withColumn("id", F.explode(F.array_distinct(F.array("source", "target")))).groupBy("question_id", "id").agg(F.count("*").alias("n"))
    rows = every.join(degree, ["question_id", "id"], "left").join(questions.select("question_id", "key"), "question_id")
    name = F.coalesce(text.question_key(F.col("name")), F.lit(""))
    rank = F.struct((~(mentioned(F.col("key"), name, aliases) & (name != ""))).cast("int"), -F.coalesce("n", F.lit(0)), F.col("id"))
    return rows.groupBy("question_id").agg(F.min_by("id", rank).alias("focal"))


def plans(questions: DataFrame, found: DataFrame, edges: DataFrame, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(question_id, intent, supported, answer, evidence, confidence): what the relations alone can answer.

    questions (question_id, question, key, intent): key is text.question_key. Each intent takes the relations it needs, of the
    focal screen where it asks about one, in order; without them nothing is supported, and a change of data that no control
    supports is refused. Evidence is gathered per question from its relations, which retrieval bounds.
    """
    asked = questions.join(focal_screens(questions, found, edges, aliases), "question_id", "left")
    c = F.col
    label = text.question_key(c("target_label"))
    rows = edges.join(asked.select("question_id", "key", "focal"), "question_id")
    # whose columns are asked for is a join: within a question's relations it would be a search for each of them
    tables = rows.where("type = 'HAS_TABLE' and source = focal").select("question_id", c("target").alias("source"), F.lit(True).alias("_table")).distinct()
    rows = rows.join(tables, ["question_id", "source"], "left")
    searches = reduce(lambda a, b: a | b, [F.contains(label, F.lit(w)) for w in ("buscar", "search", "filtrar", "filtro")])
    lists = reduce(lambda a, b: a | b, [F.contains(label, F.lit(w)) for w in ("buscar", "search", "filtro")])
    at = c("source") == c("focal")
    item = F.struct("seq", "type", "source", "target", "source_label", "target_label", (at & F.lit(True)).alias("at"), mentioned(c("key"), label, aliases).alias("named"), searches.alias("searches"), lists.alias("lists"), ((c("type") == "HAS_COLUMN") & c("_table").isNotNull()).alias("column"))
    # few bytes, much work: a given number of partitions is not merged to one task
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "question_id")
    every = dealt.groupBy("question_id").agg(F.sort_array(F.collect_list(item)).alias("rels"))
    q = asked.join(every, "question_id", "left").withColumn("rels", F.coalesce("rels", F.array().cast(every.schema["rels"].dataType)))
    pick = lambda p: F.filter("rels", p)
    first = lambda xs: F.try_element_at(xs, F.lit(1))
    one = lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(F.slice("rels", 1, 0))
    kind = lambda r, *names: r["type"].isin(*names)
    q = q.withColumns({
        "f_at": pick(lambda r: kind(r, "HAS_FIELD") & r["at"]), "f_named": pick(lambda r: kind(r, "HAS_FIELD") & r["named"]), "f_both": pick(lambda r: kind(r, "HAS_FIELD") & r["at"] & r["named"]),
        "c_at": pick(lambda r: kind(r, "HAS_CONTROL") & r["at"]), "c_named": pick(lambda r: kind(r, "HAS_CONTROL") & r["named"]), "s_named": pick(lambda r: kind(r, "HAS_SCREEN") & r["named"]),
        "moves": pick(lambda r: kind(r, "HAS_EVENT", "FROM_STATE", "TO_STATE", "TRIGGERED_BY")), "acts": pick(lambda r: kind(r, "HAS_CONTROL", "HAS_EVENT", "TRIGGERED_BY")),
    })
    words = F.regexp_extract_all(F.lower("question"), F.lit(r"(?U)([\wáéíóúñ]+)"), 1)
    labels = F.transform("acts", lambda r: r["target_label"])
    stems = [_some(words, f"^{stem}") & _some(labels, "|".join(terms)) for stem, terms in STEM_SUPPORT.items()]
    q = q.withColumn("cols", pick(lambda r: r["column"])).withColumn("search", first(F.filter("c_at", lambda r: r["searches"])))
    q = q.withColumn("beside", F.coalesce(first(F.filter("c_at", lambda r: r["named"] | r["lists"])), F.when(F.size("c_at") == 1, first(c("c_at")))))
    field = first(c("f_named"))
    home = first(pick(lambda r: kind(r, "HAS_SCREEN") & (r["target"] == field["source"])))
    quoted = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    names = lambda xs: text.spoken_list(F.array_distinct(F.transform(xs, lambda r: r["target_label"])))
    some = lambda name: F.size(name) > 0
    both = first(c("f_both"))
    screen, control, column, act = first(c("s_named")), first(c("c_named")), first(c("cols")), first(c("acts"))
    rules = (
        ("MUTATIVE_ACTION", reduce(lambda a, b: a | b, stems), quoted('La acción está respaldada por el control "', act["target_label"], '".'), one(act), "high"),
        ("SEARCH_BY_FIELD", some("f_both") & c("search").isNotNull(), quoted('Para buscar por "', both["target_label"], '", la pantalla "', both["source_label"], '" dispone del campo "', both["target_label"], '" y del control "', c("search")["target_label"], '".'), F.concat(one(both), one(c("search"))), "high"),
        ("LIST_FIELDS", some("f_at"), quoted('En la pantalla "', first(c("f_at"))["source_label"], '" aparecen los campos ', names(c("f_at")), F.coalesce(quoted(', junto al control "', c("beside")["target_label"], '"'), F.lit("")), "."), c("f_at"), "high"),
        ("LOCATE_FIELD", some("f_named"), quoted('El campo "', field["target_label"], '" se encuentra en la pantalla "', field["source_label"], '"', F.coalesce(quoted(', dentro del módulo "', home["source_label"], '"'), F.lit("")), "."), F.concat(one(field), one(home)), "high"),
        ("LOCATE_SCREEN", some("s_named"), quoted('La pantalla "', screen["target_label"], '" está dentro del módulo "', screen["source_label"], '".'), one(screen), "high"),
        ("FIND_CONTROL", some("c_named"), quoted('El control "', control["target_label"], '" está en la pantalla "', control["source_label"], '".'), c("c_named"), "high"),
        ("LIST_COLUMNS", some("cols"), quoted('La tabla "', column["source_label"], '" contiene las columnas ', names(c("cols")), "."), c("cols"), "high"),
        ("NAVIGATION_EVENT", some("moves"), F.lit("La navegación validada incluye eventos y estados relacionados en la pantalla recuperada."), c("moves"), "medium"),
    )
    supported = reduce(lambda a, r: a.when(c("intent") == r[0], r[1]), rules[1:], F.when(c("intent") == rules[0][0], rules[0][1])).otherwise(False)
    q = q.withColumn("supported", F.coalesce(supported, F.lit(False)))
    choose = lambda i: reduce(lambda a, r: a.when(c("supported") & (c("intent") == r[0]), F.lit(r[i]) if i == 4 else r[i]), rules[1:], F.when(c("supported") & (c("intent") == rules[0][0]), F.lit(rules[0][i]) if i == 4 else rules[0][i]))
    refused = ~c("supported") & (c("intent") == "MUTATIVE_ACTION")
    ids = F.array_distinct(F.flatten(F.transform(choose(3), lambda r: F.array(r["source"], r["target"]))))
    return q.select(
        "question_id", "intent", "supported", choose(2).otherwise(F.when(refused, ABSTAIN)).alias("answer"), F.coalesce(ids, F.array().cast("array<string>")).alias("evidence"),
        choose(4).otherwise(F.when(refused, "high").otherwise("low")).alias("confidence"),
    )


def needs_abstention(question: Column, labels: Column) -> Column:
    """Whether a question names an action that would change data and no label (of controls, events, transitions) supports."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"(?U)([\wáéíóúñ]+)"), 1)
    asked, backed = [], []
    for verb, forms in VERB_FORMS.items():
        said = _some(words, f"^(?:{forms})$")
        asked.append(said)
        backed.append(said & _some(labels, "|".join(SUPPORTED_BY.get(verb, (verb,)))))
    return reduce(lambda a, b: a | b, asked) & ~reduce(lambda a, b: a | b, backed)


def outcomes(planned: DataFrame, questions: DataFrame, found: DataFrame, generate: bool = False) -> DataFrame:
    """planned with answer_mode and the answer that is given without a text generator: the plan's, an abstention, or null
    where a generator would speak."""
    acts = found.where(F.col("entity_type").isin("control", "event", "transition")).groupBy("question_id").agg(F.collect_set("safe_label").alias("_acts"))
    any_ = found.groupBy("question_id").agg(F.count("*").alias("_n"))
    rows = planned.join(questions.select("question_id", "question"), "question_id").join(acts, "question_id", "left").join(any_, "question_id", "left")
    lacking = F.col("_n").isNull() | needs_abstention(F.col("question"), F.coalesce("_acts", F.array().cast("array<string>")))
    mode = F.when(F.col("supported"), "deterministic_graph").when(F.col("intent") == "MUTATIVE_ACTION", "policy_abstention").when(lacking, "insufficient_evidence").otherwise("generated" if generate else "ollama_grounded")
    answer = F.when(F.col("supported"), F.col("answer")).when((F.col("intent") == "MUTATIVE_ACTION") | lacking, ABSTAIN)
    return rows.select("question_id", "intent", "supported", mode.alias("answer_mode"), answer.alias("answer"), "evidence", "confidence")
