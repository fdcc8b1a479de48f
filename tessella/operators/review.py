"""What reviewers see: the tree of systems, modules and screens, and everything around one screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import privacy, text

# States of a screen's proposals.
STATES = ("no_proposal", "pending_review", "approved", "corrected", "rejected", "mixed", "unavailable")


def sort_key(name: Column) -> Column:
    return F.lower(text.squeeze(F.coalesce(name, F.lit(""))))


def needle_found(needle: str | None, *parts: Column, spelled_nulls: bool = True) -> Column:
    """Whether the squeezed needle is inside the joined parts. The server spells a missing title "None"; the client doesn't."""
    if not needle or not needle.strip():
        return F.lit(True)
    joined = F.concat_ws(" ", *[F.coalesce(p, F.lit("None" if spelled_nulls else "")) for p in parts])
    return F.contains(F.lower(joined), F.lit(" ".join(needle.lower().split())))


def counters(*groups: str) -> list[Column]:
    """Aggregates: screens in all and by state, 0 where a state is missing; unavailable also counts mixed; warnings."""
    state = lambda s: F.count_if(F.col("state") == s)
    out = [F.count("screen_id").alias("total"), *[state(s).alias(s) for s in STATES if s not in ("unavailable", "mixed")]]
    return [*out, (state("unavailable") + state("mixed")).alias("unavailable"), F.coalesce(F.sum("n_warnings"), F.lit(0)).cast("long").alias("warnings")]


def tree(erps: DataFrame, modules: DataFrame, screens: DataFrame, needle: str | None = None, state: str | None = None, empty_modules: bool = True) -> DataFrame:
    """One row a system: its modules in order of their names, each with its screens in order of their titles and counters;
    screens of no known module; counters over all.

    erps (erp_id, name); modules (module_id, erp_id, name, route, diagnostic); screens (screen_id, erp_id, module_id, title,
    route, state, n_warnings, diagnostic). A screen with a diagnostic is unassigned; places of modules count all modules,
    shown or not. Screens are gathered per module first, then modules per system: the nested row is what is asked for.
    """
    place = (F.row_number().over(Window.partitionBy("erp_id").orderBy(sort_key(F.col("name")), "module_id")) - 1).alias("order")
    known = modules.select("module_id", F.col("erp_id").alias("_erp"), (F.col("diagnostic").isNull()).alias("_there"))
    rows = screens.where(needle_found(needle, F.col("title"), F.col("route"), F.col("screen_id")))
    rows = rows.where(F.col("state") == state) if state else rows
    rows = rows.join(known, "module_id", "left").withColumn("module_id", F.when(F.coalesce("_there", F.lit(False)) & (F.col("_erp") == F.col("erp_id")) & F.col("diagnostic").isNull(), F.col("module_id")))
    item = F.struct(sort_key(F.col("title")).alias("key"), "screen_id", "title", "route", "state")
    each = rows.groupBy("erp_id", "module_id").agg(F.array_sort(F.collect_list(item)).alias("screens"), *counters())
    shown = modules.select("module_id", "erp_id", "name", "route", "diagnostic", place)
    full = shown.join(each.drop("erp_id").where("module_id is not null"), "module_id", "left")
    names = [c for c in each.columns if c not in ("erp_id", "module_id", "screens")]
    full = full.withColumn("screens", F.coalesce("screens", F.array().cast(each.schema["screens"].dataType))).na.fill(0, names)
    full = full if empty_modules else full.where(F.size("screens") > 0)
    nested = full.groupBy("erp_id").agg(F.array_sort(F.collect_list(F.struct("order", "module_id", F.col("name").alias("module_name"), "route", "diagnostic", "screens", F.struct(*names).alias("counters")))).alias("modules"))
    loose = each.where("module_id is null").select("erp_id", F.col("screens").alias("unassigned"))
    # counters over all are sums of those of the groups
    total = each.groupBy("erp_id").agg(*[F.sum(n).alias(n) for n in names]).select("erp_id", F.struct(*names).alias("counters"))
    return erps.join(nested, "erp_id", "left").join(loose, "erp_id", "left").join(total, "erp_id", "left")


def scope_error(erps: DataFrame, versions: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (erp_id, version) with `error`: unknown system, unknown version or one of another system, inactive version."""
    there = erps.select("erp_id", F.lit(True).alias("_erp")).distinct()
    known = versions.select("version", F.col("erp_id").alias("_owner"), F.col("status").alias("_status"))
    out = asked.join(there, "erp_id", "left").join(known, "version", "left")
    error = (
        F.when(F.col("erp_id").isNotNull() & F.col("_erp").isNull(), "erp_not_found")
        .when(F.col("version").isNotNull() & (F.col("_owner").isNull() | (F.col("erp_id").isNotNull() & (F.col("_owner") != F.col("erp_id")))), "version_not_found")
        .when(F.col("version").isNotNull() & (F.col("_status") != "active"), "version_not_active")
    )
    return out.select("erp_id", "version", error.alias("error"))


def exactly_one(rows: DataFrame, asked: DataFrame, *keys: str) -> DataFrame:
    """asked with `canonical_id` of the one row that has its keys, or `error`: not_found, ambiguous."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("canonical_id").alias("canonical_id"))
    out = asked.join(found, list(keys), "left")
    error = F.when(F.col("_n").isNull(), "not_found").when(F.col("_n") > 1, "ambiguous")
    return out.withColumn("canonical_id", F.when(F.col("_n") == 1, F.col("canonical_id"))).withColumn("error", error).drop("_n")


def neighbourhood(items: DataFrame) -> DataFrame:
    """(screen, canonical_id, entity_type): what belongs to each screen by the references in force: its fields, controls,
    tables, states and events; columns of its tables; transitions that touch its states.

    items (canonical_id, entity_type, status, screen_id, table_id, source_state_id, target_state_id), references in force.
    """
    good = items.where(F.col("status").isin("approved", "corrected"))
    own = good.where(F.col("entity_type").isin("field", "control", "table", "ui_state", "event") & F.col("screen_id").isNotNull()).select(F.col("screen_id").alias("screen"), "canonical_id", "entity_type")
    tables = own.where("entity_type = 'table'").select("screen", F.col("canonical_id").alias("table_id"))
    columns = good.where("entity_type = 'table_column'").join(tables, "table_id").select("screen", "canonical_id", "entity_type")
    states = own.where("entity_type = 'ui_state'").select("screen", F.col("canonical_id").alias("state"))
    ends = good.where("entity_type = 'transition'").select("canonical_id", "entity_type", F.explode(F.array_distinct(F.array("source_state_id", "target_state_id"))).alias("state"))
    moves = ends.join(states, "state").select("screen", "canonical_id", "entity_type").distinct()
    return own.unionByName(columns).unionByName(moves)


def structures(screens: DataFrame, around: DataFrame, labels: DataFrame) -> DataFrame:
    """(screen_id, structure_hash, n_items, omitted): digest of a screen's items in order of type and id; those without a
    label are omitted with a warning. Digests of items are hashed by type first, so a screen's row holds a few of them."""
    rows = around.join(labels.select("canonical_id", "label"), "canonical_id", "left")
    bad = F.coalesce(F.trim("label"), F.lit("")) == ""
    said = F.sha2(F.concat_ws("\u0000", "canonical_id", "label"), 256)
    by_type = rows.groupBy("screen", "entity_type").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.when(~bad, said))), ""), 256).alias("d"), F.count_if(~bad).alias("n"), F.array_sort(F.collect_list(F.when(bad, F.concat_ws(":", "entity_type", "canonical_id")))).alias("o"),
    )
    whole = by_type.where("n > 0 or size(o) > 0").groupBy("screen").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("entity_type", "d")))), lambda x: F.concat(x["entity_type"], F.lit("="), x["d"])), ";"), 256).alias("structure_hash"),
        F.sum("n").alias("n_items"), F.array_sort(F.flatten(F.collect_list("o"))).alias("omitted"),
    )
    return screens.select("screen_id").join(whole.withColumnRenamed("screen", "screen_id"), "screen_id", "left").na.fill(0, ["n_items"])


def contexts(screens: DataFrame, structure: DataFrame, proposals: DataFrame, actions: DataFrame) -> DataFrame:
    """One row a screen: state, newest proposal, whether its evidence still matches, history counts, neighbours, place.

    screens (screen_id, module_id, title, state); proposals (screen_id, proposal_id, created_at, status, evidence_hash);
    actions (proposal_id, action_id). Newest by (created_at, proposal_id).
    """
    acts = actions.groupBy("proposal_id").agg(F.count("*").alias("_a"))
    rows = proposals.join(acts, "proposal_id", "left").groupBy("screen_id").agg(
        F.count("*").alias("n_proposals"), F.coalesce(F.sum("_a"), F.lit(0)).alias("n_actions"), F.max_by(F.struct("proposal_id", "status", "evidence_hash"), F.struct("created_at", "proposal_id")).alias("l"),
    )
    w = Window.partitionBy("module_id").orderBy(sort_key(F.col("title")), "screen_id")
    peers = screens.select("screen_id", F.lag("screen_id").over(w).alias("previous"), F.lead("screen_id").over(w).alias("next"), F.row_number().over(w).cast("long").alias("position"))
    total = screens.groupBy("module_id").agg(F.count("*").alias("module_total"))
    out = screens.join(structure, "screen_id", "left").join(rows, "screen_id", "left").join(peers, "screen_id").join(total, screens["module_id"].eqNullSafe(total["module_id"])).drop(total["module_id"])
    matches = F.when(F.col("l").isNotNull(), F.coalesce(F.col("l.evidence_hash") == F.col("structure_hash"), F.lit(False)))
    return out.select(
        "screen_id", "module_id", "state", "n_items", "structure_hash", F.coalesce("n_proposals", F.lit(0)).alias("n_proposals"), F.coalesce("n_actions", F.lit(0)).alias("n_actions"),
        F.col("l.proposal_id").alias("active_proposal"), matches.alias("evidence_matches"), F.when(~matches, "evidence_differs").alias("diagnostic"), "previous", "next", "position", "module_total",
    )


def differing(left: Column, right: Column, fields: list[str]) -> Column:
    """Names of the fields in which two structs differ, nulls equal to nulls."""
    return F.array_compact(F.array(*[F.when(~left[f].eqNullSafe(right[f]), F.lit(f)) for f in fields]))


# Where review actions may come from.
SOURCES = ("cli", "admin_api", "review_panel", "migration")


def action_error(action: Column, actor: Column, source: Column, notes: Column, sources: tuple[str, ...] = SOURCES) -> Column:
    """What is wrong with a review action, the first thing: an unknown action, no actor, one that is sensitive or too long, an
    unknown source, sensitive notes, too long ones, none where they are needed."""
    said = text.squeeze(F.coalesce(actor, F.lit("")))
    rest = text.let(text.squeeze(F.coalesce(notes, F.lit(""))), lambda noted: (
        F.when(privacy.is_sensitive(noted), "sensitive_notes").when(F.length(noted) > 4000, "notes_too_long")
        .when(action.isin("reject", "correct", "reset") & (noted == ""), "notes_required")
    ))
    return (
        F.when(~F.coalesce(action.isin("approve", "reject", "correct", "reset"), F.lit(False)), "unknown_action")
        .when(said == "", "invalid_actor").when(privacy.is_sensitive(said), "sensitive_actor").when(F.length(said) > 240, "invalid_actor")
        .when(~F.coalesce(F.trim(source).isin(*sources), F.lit(False)), "invalid_source").otherwise(rest)
    )
