"""Generated statements about a screen: what may be referred to, drafts as JSON, summaries, consistency with evidence."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import privacy, text
from tessella.operators.evidence import ACTIONS

# The order of actions in a summary and their verbs; keys that payloads never hold.
ORDER = ("search", "view", "navigate", "create", "edit", "delete", "process")
VERBS = {"search": "buscar", "view": "visualizar", "navigate": "navegar", "create": "crear", "edit": "editar", "delete": "eliminar", "process": "procesar"}
VOLATILE_KEYS = ("generated_at", "reviewed_at", "reviewed_by", "review_notes", "created_at", "updated_at", "imported_at")
OPERATIONAL_KEYS = (*VOLATILE_KEYS, "review_status", "review_revision")
FORBIDDEN_KEYS = ("password", "passwd", "token", "cookie", "authorization", "email", "ip", "html", "screenshot")
DRAFT = "struct<semantic_type: string, screen_id: string, supported_capabilities: array<struct<action: string, statement: string, evidence_refs: array<string>>>>"


def parsed(drafts: DataFrame, plan: DataFrame) -> DataFrame:
    """(screen_id, error, statements) of raw drafts (screen_id, raw): the first thing that is wrong, or what they claim.

    plan (screen_id, action, support, refs): a capability must have an action of the plan and only its references, and say
    just what its action is.
    """
    rows = drafts.withColumn("d", F.from_json("raw", DRAFT))
    pure = ~F.ltrim("raw").startswith("```") & ~F.rtrim("raw").endswith("```")
    hints = plan.groupBy("screen_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "refs")))).alias("hints"))
    rows = rows.join(hints, "screen_id", "left").withColumn("hints", F.coalesce("hints", F.create_map().cast("map<string,array<string>>")))
    caps = F.col("d.supported_capabilities")
    known = lambda c: F.map_contains_key("hints", F.coalesce(c["action"], F.lit("")))
    foreign = lambda c: F.size(F.array_except(c["evidence_refs"], F.try_element_at("hints", c["action"]))) > 0
    error = (
        F.when(~pure, "not_pure_json").when(F.col("d").isNull() | ~F.ltrim("raw").startswith("{"), "invalid_json").when(F.size(caps) == 0, "no_supported_capabilities_generated")
        .when(~F.coalesce(F.col("d.semantic_type") == "screen_purpose", F.lit(False)), "schema").when(~F.coalesce(F.col("d.screen_id") == F.col("screen_id").cast("string"), F.lit(False)), "screen_mismatch")
        .when(F.size(caps) < 0, "schema").when(F.exists(caps, lambda c: ~known(c)), "declared_action_not_supported").when(F.exists(caps, foreign), "declared_action_reference_not_permitted")
        .when(F.exists(caps, lambda c: ~says_only(c["statement"], c["action"])), "declared_action_statement_mismatch")
    )
    return rows.select("screen_id", error.alias("error"), F.when(error.isNull(), F.transform(caps, lambda c: c["statement"])).alias("statements"), F.when(error.isNull(), F.transform(caps, lambda c: c["action"])).alias("actions"))


def says_only(statement: Column, action: Column) -> Column:
    """Whether a statement names its action and no other."""
    words = F.split(text.ascii_key(F.coalesce(statement, F.lit(""))), " ")
    named = F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, terms))), F.lit(a)) for a, terms in ACTIONS.items()]))
    return (F.size(named) == 1) & (F.element_at(F.concat(named, F.array(F.lit(""))), 1) == action)


def purpose(title: Column, direct: Column, prudent: Column) -> Column:
    """What a screen is for, from arrays of its actions alone: direct ones in one sentence, prudent ones in one each."""
    has = lambda xs, a: F.array_contains(xs, a)
    subject = F.concat(F.lower(F.substring(title, 1, 1)), title.substr(F.lit(2), F.length(title)))
    verb = lambda a: F.when(has(direct, a), F.when((F.lit(a) == "view") & has(direct, "search"), "consultar").otherwise(VERBS[a]))
    verbs = F.array_compact(F.array(*[verb(a) for a in ORDER if a != "navigate"]))
    body = F.concat(F.lit("Permite "), text.spoken_list(verbs), F.lit(" "), subject, F.when(F.size(verbs) == 1, " desde la pantalla").otherwise(""), F.when(has(direct, "navigate"), ", así como navegar entre las páginas de resultados").otherwise(""), F.lit("."))
    walk = F.concat(F.lit("Permite navegar entre las páginas de resultados de "), subject, F.lit("."))
    first = F.when(F.size(verbs) > 0, body).when(has(direct, "navigate"), walk)
    more = [F.when(has(prudent, a), F.concat(F.lit("La pantalla "), title, F.lit(f" presenta una opción relacionada con {VERBS[a]}."))) for a in ORDER]
    return F.substring(F.array_join(F.array_compact(F.array(first, *more)), " "), 1, 600)


# How structured output may have been asked for.
OUTPUT_MODES = ("json_schema", "json")


def proposal_checks(candidate: Column, package: Column, expected: Column) -> dict[str, Column]:
    """The twelve comparisons that a generated candidate must pass to become a proposal, for mismatches().

    candidate (semantic_type, screen_id, evidence_hash, evidence_ids, inference: JSON, generated_content_hash, prompt_version,
    prompt_hash, generation_parameters, generation_parameters_hash, generation_model, structured_output_mode, refs), package
    (screen_id, evidence_hash, evidence_ids, refs: what may be referred to), expected (prompt_version, prompt_hash,
    generation_parameters, generation_parameters_hash, generation_model).
    """
    same = lambda name, of: candidate[name] == of[name]
    return {
        "semantic_type": candidate["semantic_type"] == "screen_purpose",
        **{n: same(n, package) for n in ("screen_id", "evidence_hash", "evidence_ids")},
        "generated_content_hash": candidate["generated_content_hash"] == F.sha2(candidate["inference"], 256),
        **{n: same(n, expected) for n in ("prompt_version", "prompt_hash", "generation_parameters", "generation_parameters_hash", "generation_model")},
        "structured_output_mode": candidate["structured_output_mode"].isin(*OUTPUT_MODES),
        "references": F.size(F.array_except(candidate["refs"], package["refs"])) == 0,
    }


def mismatches(checks: dict[str, Column]) -> Column:
    """Names of checks that fail, in order; a check that can't be made fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(checks[k], F.lit(False)), F.lit(k)) for k in sorted(checks)]))


def functional(payload: Column) -> Column:
    """A JSON document without bookkeeping at any depth, compact, names in order; null where it is no JSON."""
    return _functional(payload)


def payload_error(payload: Column, most_bytes: int = 256_000) -> Column:
    """The first thing wrong with a correction: no object, too large, or, key by key at any depth, a forbidden key, a string
    that holds something sensitive, markup that runs. Strings that stand in lists have no key and are not looked at."""
    return _payload_error(payload, F.lit(most_bytes))


@F.pandas_udf(T.StringType())
def _functional(payloads: pd.Series) -> pd.Series:
    import json

    def clean(v):
        if isinstance(v, dict):
            return {k: clean(x) for k, x in sorted(v.items()) if k.casefold() not in VOLATILE_KEYS}
        return [clean(x) for x in v] if isinstance(v, list) else v

    def one(p):
        try:
            return json.dumps(clean(json.loads(p)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return payloads.map(one)


@F.pandas_udf(T.StringType())
def _payload_error(payloads: pd.Series, most: pd.Series) -> pd.Series:
    import json

    sensitive = privacy.compiled()

    def walk(v) -> Iterator[tuple[str, object]]:
        for k, x in v.items() if isinstance(v, dict) else ((None, x) for x in v) if isinstance(v, list) else ():
            if k is not None:
                yield k.casefold(), x
            yield from walk(x)

    def one(p, limit):
        try:
            value = json.loads(p)
        except (TypeError, ValueError):
            return "not_an_object"
        if not isinstance(value, dict):
            return "not_an_object"
        if len(json.dumps(value, ensure_ascii=False, sort_keys=True).encode()) > limit:
            return "too_large"
        for k, x in walk(value):
            if k in OPERATIONAL_KEYS:
                return f"operational_key:{k}"
            if k in FORBIDDEN_KEYS:
                return f"sensitive_key:{k}"
            if isinstance(x, str) and any(p.search(x) for p in sensitive):
                return "sensitive_value"
            if isinstance(x, str) and ("<script" in x.casefold() or "javascript:" in x.casefold()):
                return "executable_markup"
        return None

    return pd.Series([one(p, n) for p, n in zip(payloads, most, strict=True)], dtype=object)


def page_answer(intent: Column, title: Column, route: Column, fields: Column, buttons: Column, headers: Column, n_tables: Column, links: Column) -> Column:
    """The answer to a question about one screen, or null where the screen has nothing of what is asked."""
    trail = text.breadcrumb(route)
    where = F.concat(F.lit("Puedes encontrar "), title, F.lit(" en la ruta "), F.when(trail == "", title).otherwise(F.concat(trail, F.lit(" → "), title)), F.lit("."))
    listed = lambda start, xs: F.when(F.size(xs) > 0, F.concat(F.lit(start[0]), title, F.lit(start[1]), text.spoken_list(xs), F.lit(".")))
    n = lambda xs: F.size(xs).cast("string")
    some = F.array_compact(F.array(
        F.when(F.size(fields) > 0, F.concat(n(fields), F.lit(" campos"))), F.when(F.size(buttons) > 0, F.concat(n(buttons), F.when(F.size(buttons) == 1, " botón visible").otherwise(" botones visibles"))),
        F.when(n_tables > 0, F.concat(n_tables.cast("string"), F.when(n_tables == 1, " tabla").otherwise(" tablas"))), F.when(F.size(links) > 0, F.concat(n(links), F.when(F.size(links) == 1, " enlace local").otherwise(" enlaces locales"))),
    ))
    return (
        F.when(intent == "locate", where).when(intent == "fields", listed(("En la pantalla ", " se identificaron los campos: "), fields)).when(intent == "buttons", listed(("En la pantalla ", " se identificaron los botones visibles: "), buttons))
        .when(intent == "tables", listed(("La tabla de ", " contiene las columnas: "), headers)).when(intent == "describe", listed(("La pantalla ", " contiene "), some))
    )


def suggestions(intent: Column, title: Column, fields: Column, n_tables: Column) -> Column:
    """At most two further questions."""
    ask = lambda what: F.concat(F.lit(f"¿Qué {what} tiene la pantalla "), title, F.lit("?"))
    return F.slice(F.array_compact(F.array(F.when((intent != "fields") & (F.size(fields) > 0), ask("campos")), F.when((intent != "tables") & (n_tables > 0), ask("tabla")), F.lit("¿Cómo regreso al Dashboard?"))), 1, 2)
