"""Whether what a generated description claims about a screen is backed by what the description refers to.

Statements are rows, and so are references: a statement's references are joined to what they are, and their words, kinds and
decisions meet again in one aggregation a statement. The first rule that a statement breaks is its error, and the first
statement in order that has one is that of its screen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text

# Words that name an action, those that change data, words without meaning of their own.
ACTION_WORDS = {
    "search": ("buscar", "busqueda", "consultar", "consulta", "filtrar", "filtro", "criterio"),
    "navigate": ("navegar", "navegacion", "pagina", "paginar", "siguiente", "anterior", "primera", "ultima"),
    "create": ("crear", "creacion", "nuevo", "nueva", "registrar", "registro", "guardar"),
    "edit": ("editar", "edicion", "modificar", "modificacion"),
    "delete": ("eliminar", "eliminacion", "borrar"),
    "view": ("visualizar", "visualiza", "mostrar", "listar", "lista", "ver"),
    "process": ("procesar", "procesamiento"),
    "manage": ("gestionar", "administrar"),
}
MUTATIVE = ("create", "edit", "delete", "process")
STOPWORDS = (
    "a", "al", "con", "de", "del", "el", "en", "es", "esta", "la", "las", "lo", "los", "para", "permite", "por", "que", "se", "su",
    "una", "un", "y", "interfaz", "opcion", "control", "asociado", "asociada", "presenta", "existe",
)
DETAIL = ("detalle", "detalles")
# Phrases that keep to what is seen, that deny without evidence, and that speak of the evidence itself.
PRUDENT = (
    "presenta una opcion", "muestra una opcion", "existe un control", "opcion asociada", "control asociado", "relacionada con",
    "relacionado con",
)
NEGATIVE = ("no se puede", "no puede", "no permite", "es imposible", "carece de")
EPISTEMIC = (
    "la evidencia disponible no permite confirmar", "la evidencia no permite confirmar", "la estructura observada no demuestra",
    "la estructura no demuestra", "no se identificaron controles", "no hay evidencia estructural",
)
CANONICAL_ID = r"(?iU)(?<!\w)(?:screen|module|field|control|table|column|state|event|transition|evidence):[A-Za-z0-9._-]+"
#: Parts of a description in the order in which they are looked at, and the words that a statement of each takes.
PARTS = {"capability": 3, "limitation": 2, "uncertainty": 2, "purpose": 4}
PRUDENT_ONLY, DIRECT = 1, 2


def _words(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def _actions(tokens: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(tokens, _words(w)), F.lit(a)) for a, w in sorted(ACTION_WORDS.items())]))


def _tokens(key: Column) -> Column:
    return F.array_except(F.filter(F.split(key, " "), lambda t: t != ""), _words(STOPWORDS))


def _says(key: Column, phrases: tuple[str, ...]) -> Column:
    return F.exists(_words(phrases), lambda p: F.contains(key, p))


def reference_index(screens: DataFrame, children: DataFrame) -> DataFrame:
    """(screen_id, ref, kind, label, category, mutative, decision) of everything that may be referred to: the screens
    (screen_id, title, module_id, module), their modules, and children (screen_id, ref, kind, label, category, mutative,
    decision). An id that stands for several things is the last of them by kind."""
    none, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    own = lambda ref, kind, label: screens.select("screen_id", F.col(ref).cast("string").alias("ref"), F.lit(kind).alias("kind"), F.col(label).alias("label"), none.alias("category"), no.alias("mutative"), none.alias("decision"))
    rows = own("screen_id", "screen", "title").union(own("module_id", "module", "module").where("ref is not null"))
    every = rows.union(children.select(*rows.columns))
    return every.groupBy("screen_id", "ref").agg(F.max(F.struct("kind", "label", "category", "mutative", "decision")).alias("r")).select("screen_id", "ref", "r.*")


def _with_references(statements: DataFrame, index: DataFrame) -> DataFrame:
    """statements with what their references are: words, kinds, how many are unknown, and of controls and events whether one
    changes data and which decisions there are."""
    asked = statements.where("part = 'capability'").select("screen_id", "position", F.explode(F.array_distinct("refs")).alias("ref"))
    words = _tokens(text.id_key(F.concat_ws(" ", "label", "category", "kind")))
    acting = F.col("kind").isin("control", "event")
    found = asked.join(index, ["screen_id", "ref"], "left").groupBy("screen_id", "position").agg(
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind").isNotNull(), words)))).alias("reference_tokens"),
        F.collect_set("kind").alias("kinds"), F.count_if(F.col("kind").isNull()).alias("unknown"),
        F.coalesce(F.max(acting & F.coalesce("mutative", F.lit(False))), F.lit(False)).alias("mutative"),
        F.collect_set(F.when(acting, F.lower(F.coalesce("decision", F.lit("unknown"))))).alias("decisions"),
    )
    # a statement has few references; a description's are bounded by its schema
    none = F.array().cast("array<string>")
    return statements.join(found, ["screen_id", "position"], "left").withColumns({
        "reference_tokens": F.coalesce("reference_tokens", none), "kinds": F.coalesce("kinds", none), "decisions": F.coalesce("decisions", none),
        "unknown": F.coalesce("unknown", F.lit(0)), "mutative": F.coalesce("mutative", F.lit(False)),
    })


def _hints(plan: DataFrame) -> DataFrame:
    """(screen_id, hints: map of action to its references)."""
    return plan.groupBy("screen_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "refs")))).alias("hints"))


def _narrative(statement: Column, key: Column, part: Column) -> Column:
    least = reduce(lambda c, kv: c.when(part == kv[0], kv[1]), PARTS.items(), F)
    n = F.size(F.filter(F.split(key, " "), lambda t: t != ""))
    return F.when(statement.rlike(CANONICAL_ID), "canonical_id_in_narrative").when(n < least, "insufficient_natural_language")


def checked(statements: DataFrame, index: DataFrame, plan: DataFrame, screens: DataFrame) -> DataFrame:
    """statements with `error`, the first rule that each breaks, or null, and for capabilities `support`, a map of its actions
    to their level.

    statements (screen_id, part of PARTS, position, statement, refs), index of reference_index(), plan (screen_id, action,
    refs), screens (screen_id, ...). A purpose is held against the actions that its screen's capabilities support, the actions
    that the plan has, and the words of screen, module, tables, fields and controls. Null statements are empty, null
    references none; screens without a plan support no action.
    """
    c = F.col
    given = statements.withColumns({"statement": F.coalesce("statement", F.lit("")), "refs": F.coalesce("refs", F.array().cast("array<string>"))})
    rows = given.withColumn("key", text.id_key(c("statement"))).join(_hints(plan), "screen_id", "left")
    rows = rows.withColumn("hints", F.coalesce("hints", F.create_map().cast("map<string,array<string>>")))
    rows = _with_references(rows, index)
    every, tokens = F.split(c("key"), " "), _tokens(c("key"))
    shows = F.arrays_overlap(every, _words(("muestra", "visualiza", "lista"))) | (F.array_contains(every, "presenta") & F.array_contains(every, "tabla"))
    described = F.arrays_overlap(c("kinds"), _words(("screen", "table", "column"))) & shows
    named = _actions(F.when(c("part") == "purpose", tokens).otherwise(every))
    actions = F.when((c("part") == "capability") & described, F.array_sort(F.array_union(named, _words(("view",))))).otherwise(named)
    backed = [F.when(F.arrays_overlap(c("reference_tokens"), _words(ACTION_WORDS[a])), F.lit(a)) for a in ("search", "navigate", "view", *MUTATIVE)]
    seen = F.arrays_overlap(c("reference_tokens"), _words(ACTION_WORDS["search"])) | F.arrays_overlap(c("kinds"), _words(("screen", "table", "field", "column")))
    rows = rows.withColumns({
        "tokens": tokens, "actions": actions, "supported": F.array_compact(F.array(*backed, F.when(seen, F.lit("view")))),
        "meaning": F.array_except(tokens, _words(tuple(w for ws in ACTION_WORDS.values() for w in ws))),
    })
    changing = F.array_intersect(c("actions"), _words(MUTATIVE))
    unplanned = F.array_except(c("actions"), F.map_keys("hints"))
    permitted = F.flatten(F.transform(c("actions"), lambda a: F.try_element_at("hints", a)))
    foreign = (F.size(F.array_except("refs", permitted)) > 0) | F.exists(c("actions"), lambda a: ~F.arrays_overlap(F.try_element_at("hints", a), c("refs")))
    unbacked = F.array_except("actions", "supported")
    allowed, denied = F.array_contains("decisions", "allow"), F.array_contains("decisions", "deny")
    details = lambda ts: F.arrays_overlap(ts, _words(DETAIL))
    of = lambda name, xs: F.concat(F.lit(f"{name}:"), F.array_join(xs, ","))
    narrative = _narrative(c("statement"), c("key"), c("part"))
    capability = (
        F.when(c("unknown") > 0, "unknown_reference").when(F.array_contains(c("actions"), "manage"), "generic_management_action")
        .when(F.size(unplanned) > 0, of("unsupported_action", unplanned)).when((F.size("actions") > 0) & foreign, "action_reference_not_permitted")
        .when(F.size(unbacked) > 0, of("unsupported_action", unbacked))
        .when(F.array_contains(c("actions"), "view") & details(every) & ~details(c("reference_tokens")), "unsupported_view_detail_claim")
        .when((F.size(changing) > 0) & ~c("mutative"), "missing_mutative_evidence").when((F.size(changing) > 0) & denied, "mutative_policy_denied")
        .when((F.size(changing) > 0) & ~allowed & ~_says(c("key"), PRUDENT), "mutative_wording_not_prudent")
        .when((F.size("actions") == 0) & ~F.arrays_overlap(c("meaning"), c("reference_tokens")), "semantically_irrelevant_reference")
    )
    denial = F.when((F.size("actions") > 0) & ~_says(c("key"), EPISTEMIC) & _says(c("key"), NEGATIVE), "unsupported_absolute_negative_claim")
    level = lambda a: F.when(a.isin(*MUTATIVE) & ~allowed, PRUDENT_ONLY).otherwise(DIRECT)
    rows = rows.withColumn("own", F.when(c("part") == "capability", F.transform("actions", lambda a: F.struct(a.alias("action"), level(a).alias("level")))))
    claimed = rows.where("part = 'capability'").select("screen_id", F.explode("own").alias("o")).groupBy("screen_id", "o.action").agg(F.max("o.level").alias("level"))
    claimed = claimed.groupBy("screen_id").agg(F.map_from_entries(F.collect_list(F.struct("action", "level"))).alias("claimed"))
    about = index.where(c("kind").isin("screen", "module", "table", "field", "control")).select("screen_id", F.explode(_tokens(text.id_key(F.coalesce("label", F.lit(""))))).alias("t"))
    named_things = statements.where("part = 'purpose'").select("screen_id", "position", F.explode(_tokens(text.id_key(F.coalesce("statement", F.lit(""))))).alias("t"))
    plain = [w for ws in ACTION_WORDS.values() for w in ws]
    grounded = named_things.where(~c("t").isin(plain)).join(about, ["screen_id", "t"], "left_semi").select("screen_id", "position", F.lit(True).alias("grounded")).distinct()
    rows = rows.join(claimed, "screen_id", "left").join(grounded, ["screen_id", "position"], "left")
    can = F.coalesce("claimed", F.create_map().cast("map<string,int>"))
    reach = F.when(F.map_contains_key(can, "search"), F.array_union(F.map_keys(can), _words(("view",)))).otherwise(F.map_keys(can))
    forbidden = F.array_intersect(F.array_except("actions", F.map_keys("hints")), _words(tuple(a for a in ACTION_WORDS if a != "manage")))
    careful = F.exists(changing, lambda a: F.try_element_at(can, a) == PRUDENT_ONLY)
    purpose = (
        F.when(F.array_contains(c("actions"), "manage"), "generic_management_purpose").when(F.size(forbidden) > 0, of("forbidden_action", forbidden))
        .when(F.size(F.array_except("actions", reach)) > 0, "purpose_exceeds_capabilities").when(careful & ~_says(c("key"), PRUDENT), "purpose_mutative_wording_not_prudent")
        .when(c("grounded").isNull(), "purpose_object_not_grounded")
    )
    rule = F.when(c("part") == "capability", capability).when(c("part") == "purpose", purpose).otherwise(denial)
    support = F.when(c("part") == "capability", F.map_from_entries("own"))
    return rows.select("screen_id", "part", "position", "statement", F.coalesce(narrative, rule).alias("error"), support.alias("support"))


def first_errors(found: DataFrame) -> DataFrame:
    """(screen_id, part, position, error) of the first statement of each screen that has one; screens without have nulls."""
    place = F.element_at(F.create_map(*(F.lit(x) for i, p in enumerate(PARTS) for x in (p, i))), F.col("part"))
    wrong = F.when(F.col("error").isNotNull(), F.struct(place.alias("at"), F.col("position"), F.col("part"), F.col("error")))
    return found.groupBy("screen_id").agg(F.min(wrong).alias("w")).select("screen_id", "w.part", "w.position", "w.error")
