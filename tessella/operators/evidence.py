"""Bounded evidence of a screen, and checks of what is claimed about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import privacy, text

# Most items of each kind in a package, of columns in each table, of evidence ids and warnings; characters of
# its main text; names of kinds there, in order.
LIMITS = {"fields": 50, "controls": 50, "tables": 10, "ui_states": 20, "events": 30, "transitions": 30}
COLUMNS, EVIDENCE_IDS, WARNINGS = 50, 100, 50
MAIN_TEXT = 8000
GROUPS = {"fields": "Campos", "controls": "Controles", "ui_states": "Estados", "events": "Eventos"}
# Words that name an action; actions that change data; words that show that a text speaks of evidence.
ACTIONS = {
    "search": ("buscar", "busqueda", "consultar", "consulta", "filtrar", "filtro"), "navigate": ("navegar", "navegacion", "pagina", "paginacion", "pagination", "siguiente", "anterior", "primera", "ultima"),
    "view": ("visualizar", "mostrar", "listar", "ver"), "create": ("nuevo", "nueva", "crear", "creacion", "registrar", "registro", "guardar"), "edit": ("editar", "edicion", "modificar", "modificacion"),
    "delete": ("eliminar", "eliminacion", "borrar"), "process": ("procesar", "procesamiento"),
}
MUTATIVE = ("create", "edit", "delete", "process")
# What a text says that tries to give instructions.
INJECTIONS = ("ignore previous instructions", "ignora las instrucciones", "system prompt", "act as system", "cambia tu rol")
NEGATIVE = ("no se puede", "no puede", "no permite", "es imposible", "carece de")
EPISTEMIC = ("la evidencia disponible no permite confirmar", "la evidencia no permite confirmar", "la estructura observada no demuestra", "la estructura no demuestra", "no se identificaron controles", "no hay evidencia estructural")


def related(items: DataFrame, kind: str, source: str, effective: str) -> tuple[DataFrame, DataFrame]:
    """(included, warnings) of a kind's items for every target at once.

    Included (target, items' columns): approved or corrected items whose reference in force is the target; only a corrected
    item may come from another one's children. Warnings (target, warning): items not yet approved that belong there by
    their source, and corrected ones of other places without a correction (consistent is false), which are left out.
    """
    own = items.where(F.col("entity_type") == kind)
    good = F.col("status").isin("approved", "corrected")
    moved = ~F.col(source).eqNullSafe(F.col(effective))
    usable = good & F.col("consistent") & (~moved | (F.col("status") == "corrected"))
    included = own.where(usable & F.col(effective).isNotNull()).withColumn("target", F.col(effective))
    waiting = own.where(~good & F.col(source).isNotNull()).select(F.col(source).alias("target"), F.concat_ws(":", F.lit("excluded_review_status"), "entity_type", "canonical_id").alias("warning"))
    odd = own.where(good & ~F.col("consistent") & moved & F.col(effective).isNotNull()).select(F.col(effective).alias("target"), F.concat(F.lit("ignored_inconsistent_corrected:"), F.col("entity_type")).alias("warning"))
    return included, waiting.unionByName(odd)


def integrity_errors(items: DataFrame) -> DataFrame:
    """Items that may not be used: corrected ones without a correction, or whose content names another item."""
    error = F.when((F.col("status") == "corrected") & ~F.col("consistent"), "corrected_without_history").when(~F.col("payload_id").eqNullSafe(F.col("canonical_id")), "inconsistent_payload")
    return items.withColumn("error", error).where("error is not null")


def valid_relations(rows: DataFrame, states: DataFrame, controls: DataFrame, ends: tuple[str, ...], trigger: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, warnings) of events (ends: source) or transitions (ends: source and target) against a screen's states.

    rows have target (the screen) and canonical_id; states and controls are (target, canonical_id). An event without a state
    is valid; a transition needs both, and one with a single known state is warned about. A trigger must be a known control.
    """
    out = rows
    known = lambda df, key: df.select("target", F.col("canonical_id").alias(key), F.lit(True).alias(f"_{key}")).distinct()
    for key in ends:
        out = out.join(known(states, key), ["target", key], "left")
    there = [F.coalesce(F.col(f"_{key}"), F.lit(False)) for key in ends]
    name = lambda what: F.concat_ws(":", F.lit("invalid_relation"), "canonical_id", F.lit(what))
    if len(ends) == 1:
        fault = F.when(F.col(ends[0]).isNotNull() & ~there[0], name("source_state"))
    else:
        fault = F.when(~(there[0] & there[1]) & (there[0] | there[1]), name("state")).when(~(there[0] & there[1]), "")
    if trigger:
        out = out.join(known(controls, trigger), ["target", trigger], "left")
        fault = F.coalesce(fault, F.when(F.col(trigger).isNotNull() & F.col(f"_{trigger}").isNull(), name("trigger_control")))
    out = out.withColumn("_fault", fault)
    return out.where("_fault is null").select(*rows.columns), out.where("_fault <> ''").select("target", F.col("_fault").alias("warning"))


def packages(screens: DataFrame, children: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """(screen_id, evidence map<kind, array<struct<id, label>>>, warnings): the children of each screen, within the limits.

    children (screen_id, kind, id, label). Of equal labels, whatever their case and spaces, the smallest id stays; unsafe
    labels are left out with a warning, blank ones without; items come in order of their ids, and a warning tells of a kind
    that is cut. Ranks are found in windows over what is distinct, so no more than a limit's rows of a screen and kind meet.
    Warnings are sorted and cut as well.
    """
    most = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    rows = children.where(F.col("kind").isin(*limits) & (F.trim(F.coalesce("label", F.lit(""))) != "")).withColumn("label", text.squeeze(F.col("label")))
    rows = rows.withColumn("_bad", privacy.is_sensitive(F.col("label")) | (F.length("label") > 500))
    unsafe = rows.where("_bad").select("screen_id", F.concat_ws(":", F.lit("excluded_sensitive"), "kind", "id").alias("warning"))
    distinct = rows.where("not _bad").groupBy("screen_id", "kind", F.lower("label").alias("_k")).agg(F.min(F.struct("id", "label")).alias("i"))
    ranked = distinct.select("screen_id", "kind", "i", F.element_at(most, F.col("kind")).alias("most"), F.row_number().over(Window.partitionBy("screen_id", "kind").orderBy("i")).alias("r")).where("r <= most + 1")
    over = ranked.where("r > most").select("screen_id", F.concat(F.lit("limit_exceeded:"), F.col("kind")).alias("warning"))
    kinds = ranked.where("r <= most").groupBy("screen_id", "kind").agg(F.array_sort(F.collect_list("i")).alias("items"))
    out = kinds.groupBy("screen_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "items")))).alias("evidence"))
    return screens.select("screen_id").join(out, "screen_id", "left").join(warned(unsafe.unionByName(over), "screen_id"), "screen_id", "left")


def warned(warnings: DataFrame, key: str, most: int = WARNINGS) -> DataFrame:
    """(key, warnings): the first `most` distinct warnings of each key, in order."""
    ranked = warnings.select(key, "warning").distinct().withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("warning"))).where(F.col("r") <= most)
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list("warning")).alias("warnings"))


def tables(children: DataFrame, columns: DataFrame, most: int = COLUMNS) -> DataFrame:
    """(screen_id, id, name, columns): a screen's tables with up to `most` distinct columns each, in order of their ids; a
    table without a name is called Tabla. columns (table_id, id, label)."""
    rows = columns.where(F.trim(F.coalesce("label", F.lit(""))) != "").withColumn("r", F.row_number().over(Window.partitionBy("table_id").orderBy("id"))).where(F.col("r") <= most)
    distinct = rows.groupBy("table_id", F.lower(text.squeeze(F.col("label"))).alias("_k")).agg(F.min(F.struct("id", "label")).alias("i"))
    each = distinct.groupBy("table_id").agg(F.array_sort(F.collect_list("i")).alias("columns"))
    named = children.where("kind = 'tables'").select("screen_id", "id", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("Tabla")).alias("name"))
    return named.join(each, named["id"] == each["table_id"], "left").select("screen_id", "id", "name", F.coalesce("columns", F.array().cast(each.schema["columns"].dataType)).alias("columns"))


def main_text(module: Column, title: Column, packed: Column, limit: int = MAIN_TEXT) -> Column:
    """A package in words, a line for each kind, as many whole lines as fit."""
    lines = [F.concat(F.lit("Módulo: "), module), F.concat(F.lit("Pantalla: "), title)]
    for kind, name in GROUPS.items():
        labels = F.array_distinct(F.transform(F.try_element_at(packed, F.lit(kind)), lambda x: x["label"]))
        lines.append(F.when(F.size(labels) > 0, F.concat(F.lit(f"{name}: "), F.array_join(labels, "; "))))
    return whole_lines(F.array_join(F.array_compact(F.array(*lines)), "\n"), limit)


def sealed(package: DataFrame, *columns: str) -> DataFrame:
    """package with evidence_hash over the columns' JSON, names in order, and whether a given hash is still right."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return package.withColumn("evidence_hash", F.sha2(body, 256))


def whole_lines(value: Column, limit: int = MAIN_TEXT) -> Column:
    """The lines that fit, from the first on; a line that doesn't ends it."""
    lines = F.filter(F.transform(F.split(value, "\n"), text.squeeze), lambda x: x != "")
    start = F.struct(F.lit("").alias("t"), F.lit(False).alias("full"))

    def add(s: Column, x: Column) -> Column:
        joined = F.when(s["t"] == "", x).otherwise(F.concat(s["t"], F.lit("\n"), x))
        return F.when(s["full"] | (F.length(joined) > limit), F.struct(s["t"].alias("t"), F.lit(True).alias("full"))).otherwise(F.struct(joined.alias("t"), F.lit(False).alias("full")))

    return F.aggregate(lines, start, add)["t"]


def resolved_references(asked: Column, eligible: Column) -> Column:
    """struct(known, unknown), each sorted and distinct."""
    ids = F.array_sort(F.array_distinct(F.transform(asked, lambda x: F.trim(x))))
    return F.struct(F.array_intersect(ids, eligible).alias("known"), F.array_except(ids, eligible).alias("unknown"))


def actions_in(key: Column) -> Column:
    """Actions named in a normalised text, in a fixed order."""
    words = F.split(key, " ")
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, terms))), F.lit(name)) for name, terms in ACTIONS.items()]))


def grounding_plan(references: DataFrame) -> DataFrame:
    """(screen_id, action, support, refs): what a screen's references show. Controls and events support directly, other
    kinds only prudently. references (screen_id, ref, kind, label)."""
    named = references.withColumn("action", F.explode(actions_in(text.ascii_key(F.col("label")))))
    direct = F.max(F.col("kind").isin("control", "event"))
    return named.groupBy("screen_id", "action").agg(F.when(direct, "direct").otherwise("prudent_only").alias("support"), F.array_sort(F.collect_set("ref")).alias("refs"))


def reference_error(refs: Column, allowed: Column) -> Column:
    """What is wrong with a claim's references alone, whatever it says, or null: none or unknown ones."""
    return F.when(F.coalesce(F.size(refs), F.lit(0)) <= 0, "missing_reference").when(F.size(F.array_except(refs, allowed)) > 0, "unknown_reference")


def claim_error(statement: Column, refs: Column, allowed: Column, planned: Column) -> Column:
    """The first thing wrong with a claim, or null: no or unknown references, an action that the plan lacks, a mutative
    one without its reference, an absolute denial."""
    key = text.ascii_key(statement)
    acts = actions_in(key)
    says = lambda ps: F.exists(F.array(*map(F.lit, ps)), lambda p: F.contains(key, p))
    return (
        reference_error(refs, allowed)
        .when(F.size(F.array_except(acts, planned)) > 0, F.when(F.size(F.array_intersect(F.array_except(acts, planned), F.array(*map(F.lit, MUTATIVE)))) > 0, "unsupported_mutative_action").otherwise("unsupported_action"))
        .when(says(NEGATIVE) & ~says(EPISTEMIC), "absolute_negative")
    )


def statement_error(statement: Column, longest: int = 500) -> Column:
    """Why a generated text is refused, or null: it is empty, too long, holds something sensitive, or gives instructions."""
    normal = text.squeeze(F.coalesce(statement, F.lit("")))
    injected = F.exists(F.array(*map(F.lit, INJECTIONS)), lambda p: F.contains(F.lower(normal), p))
    return (
        F.when(normal == "", "inference_empty").when(F.length(normal) > longest, "inference_length")
        .when(privacy.is_sensitive(normal), "inference_privacy").when(injected, "inference_prompt_injection")
    )


def is_safe_statement(statement: Column, longest: int = 500) -> Column:
    return statement_error(statement, longest).isNull()
