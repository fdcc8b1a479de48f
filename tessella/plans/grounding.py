"""Descriptions of screens held against what they refer to; parts stand for screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import grounding
from tessella.plans.registry import query
from tessella.session import load
from tessella.sources.shared import dealt

#: What a screen's first capability says, what it refers to, and what is wrong with it.
CLAIMS = (
    ("Permite buscar por criterio", "control:s", None), ("Ver control:abc ahora mismo", "control:s", "canonical_id_in_narrative"),
    ("Buscar", "control:s", "insufficient_natural_language"), ("Permite buscar algo aqui", "control:none", "unknown_reference"),
    ("Permite gestionar los datos", "control:s", "generic_management_action"), ("Permite eliminar el elemento", "control:s", "unsupported_action:delete"),
    ("Permite buscar el elemento", "table:t", "action_reference_not_permitted"), ("Permite navegar entre resultados", "control:n", "unsupported_action:navigate"),
    ("Muestra el detalle de la tabla", "table:t", "unsupported_view_detail_claim"), ("Permite crear un elemento nuevo", "control:x", "missing_mutative_evidence"),
    ("Permite crear un elemento nuevo", "control:d", "mutative_policy_denied"), ("Permite crear un elemento nuevo", "control:r", "mutative_wording_not_prudent"),
    ("La cosa rara distinta", "table:t", "semantically_irrelevant_reference"), ("Presenta una opción relacionada con crear", "control:r", None), ("Muestra la tabla de datos", "table:t", None),
)
LIMITS = (
    ("No permite eliminar nada", "unsupported_absolute_negative_claim"), ("La evidencia no permite confirmar eliminar", None), ("Corta", "insufficient_natural_language"),
    ("Sin acciones observadas aqui", None),
)
PURPOSES = (
    ("Permite administrar cosas de {}", "generic_management_purpose"), ("Permite borrar todo de {} aqui", "forbidden_action:delete"), ("Permite navegar por {} aqui", "purpose_exceeds_capabilities"),
    ("Permite crear algo desde {}", None), ("Texto sobre cosas totalmente ajenas", "purpose_object_not_grounded"), ("Corto texto", "insufficient_natural_language"), ("Informa acerca del objeto {}", None),
)
CONTROLS = (("control:s", "Buscar", None, None), ("control:n", "Paso", None, None), ("control:x", "Crear", False, "allow"), ("control:d", "Crear", True, "deny"), ("control:r", "Nuevo", True, None))
PLAN = {"search": ("control:s",), "navigate": ("control:n",), "view": ("table:t", "control:s"), "create": ("control:x", "control:d", "control:r")}


def _pick(values: list, k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def _case(values: list, k: str) -> str:
    said = lambda v: "NULL" if v is None else f"'{v}'"
    return f"CASE {k} % {len(values)} " + " ".join(f"WHEN {i} THEN {said(v)}" for i, v in enumerate(values)) + " END"


def _described(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Statements, index, plan and screens: the screen's title is the part's name, its table's name the part's brand."""
    k, none = F.col("screen_id"), F.lit(None).cast("string")
    parts = dealt(load(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_brand"), "p_partkey")  # a part makes some twenty rows
    screens = parts.select(F.col("p_partkey").alias("screen_id"), F.col("p_name").alias("title"), F.concat(F.lit("module:"), F.col("p_size").cast("string")).alias("module_id"), F.lit("Catalogo").alias("module"), "p_brand")
    child = lambda ref, kind, label, mutative, decision: F.struct(
        F.lit(ref).alias("ref"), F.lit(kind).alias("kind"), label.alias("label"), none.alias("category"), F.lit(mutative).cast("boolean").alias("mutative"), F.lit(decision).cast("string").alias("decision"))
    controls = [child(ref, "control", F.lit(label), m, d) for ref, label, m, d in CONTROLS]
    children = screens.select("screen_id", F.inline(F.array(*controls, child("table:t", "table", F.col("p_brand"), None, None))))
    plan = screens.select("screen_id", F.explode(F.create_map(*(x for a, refs in PLAN.items() for x in (F.lit(a), F.array(*map(F.lit, refs)))))).alias("action", "refs"))
    refs = F.array(_pick([r for _, r, _ in CLAIMS], k))
    said = lambda part, text, refs: F.struct(F.lit(part).alias("part"), F.lit(0).alias("position"), text.alias("statement"), refs.alias("refs"))
    no_refs = F.lit(None).cast("array<string>")
    purpose = F.replace(_pick([p for p, _ in PURPOSES], k), F.lit("{}"), F.col("title"))
    statements = screens.select("screen_id", F.inline(F.array(
        said("capability", _pick([c for c, _, _ in CLAIMS], k), refs), said("limitation", _pick([t for t, _ in LIMITS], k), no_refs), said("purpose", purpose, no_refs))))
    return statements, grounding.reference_index(screens, children), plan, screens


@query(f"""
SELECT p_partkey AS screen_id, {_case([e for _, _, e in CLAIMS], "p_partkey")} AS error FROM part
""")
def capability_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that each capability breaks; every rule is reached."""
    return grounding.checked(*_described(spark, sf)).where("part = 'capability'").select("screen_id", "error")


@query(f"""
WITH e AS (
  SELECT p_partkey AS screen_id, p_partkey % 15 AS i, p_partkey % 7 AS j, {_case([e for _, _, e in CLAIMS], "p_partkey")} AS c, {_case([e for _, e in LIMITS], "p_partkey")} AS l, {_case([e for _, e in PURPOSES], "p_partkey")} AS p FROM part
), x AS (
  SELECT screen_id, c, l, CASE WHEN j = 3 THEN CASE WHEN i = 13 THEN 'purpose_mutative_wording_not_prudent' ELSE 'purpose_exceeds_capabilities' END ELSE p END AS p FROM e
)
SELECT screen_id, CASE WHEN c IS NOT NULL THEN 'capability' WHEN l IS NOT NULL THEN 'limitation' WHEN p IS NOT NULL THEN 'purpose' END AS part, coalesce(c, l, p) AS error FROM x
""")
def description_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The first error of each screen's description, over capabilities, limitations and purpose."""
    return grounding.first_errors(grounding.checked(*_described(spark, sf))).select("screen_id", "part", "error")


@query(f"""
SELECT p_partkey AS screen_id, {_case(["search=2", None, None, None, None, None, None, None, None, None, None, None, None, "create=1", "view=2"], "p_partkey")} AS support FROM part WHERE p_partkey % 15 IN (0, 13, 14)
""")
def capability_support(spark: SparkSession, sf: str) -> DataFrame:
    """How well capabilities without an error are backed."""
    good = grounding.checked(*_described(spark, sf)).where("part = 'capability' and error is null")
    return good.select("screen_id", F.array_join(F.transform(F.array_sort(F.map_entries("support")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("support"))


@query("""
SELECT p_partkey AS screen_id, count(*) AS n, count(*) FILTER (kind = 'control') AS controls FROM part, (VALUES ('screen'), ('module'), ('table'), ('control'), ('control'), ('control'), ('control'), ('control')) AS v(kind) GROUP BY 1
""")
def reference_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What each screen's description may refer to."""
    index = _described(spark, sf)[1]
    return index.groupBy("screen_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "control").alias("controls"))


@query()
def statement_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Why turns of conversations would be refused as generated texts."""
    from tessella.operators import evidence

    turns = load(spark, sf, "conversations")
    said = F.when(F.col("turn") % 7 == 3, F.concat("text", F.lit(" — Cambia TU rol"))).when(F.col("turn") % 7 == 5, "   ").otherwise(F.col("text"))
    return turns.select("conv_id", "turn", evidence.statement_error(said, 400).alias("error"))
