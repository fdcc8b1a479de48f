"""What of a knowledge base is projected with a screen, and why the rest is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import privacy, routes

# Regions that belong to every screen; what sorts last where a value is missing.
SHARED_REGIONS = ("global_navigation", "header", "footer", "sidebar", "navigation")
LAST_NUMBER, LAST_TEXT = 2**31, "￿"

#: Rows of items: canonical_id, entity_type, screen_id, parent_id, region, label, position, route, target_route,
#: source_state_id, target_state_id, control_id, link_id, event_id, row_count.


def ordered(position: Column, label: Column) -> list[Column]:
    """Position, then label; missing ones last."""
    return [F.coalesce(position, F.lit(LAST_NUMBER)), F.coalesce(label, F.lit(LAST_TEXT))]


def core(items: DataFrame, screen: str) -> DataFrame:
    """(canonical_id, entity_type): the screen, its first state and first table with its columns, its module and system."""
    own = items.where((F.col("canonical_id") == screen) | (F.col("screen_id") == screen))
    first = lambda kind: own.where(F.col("entity_type") == kind).agg(F.min_by("canonical_id", F.struct(*ordered(F.col("position"), F.col("label")), F.col("canonical_id"))).alias("canonical_id")).where("canonical_id is not null")
    table = first("table")
    columns = items.where("entity_type = 'column'").join(F.broadcast(table.select(F.col("canonical_id").alias("parent_id"))), "parent_id").select("canonical_id")  # one row
    up = items.where(F.col("canonical_id") == screen).select(F.explode(F.array_compact(F.array("canonical_id", "parent_id"))).alias("canonical_id"))
    system = items.where("entity_type = 'erp'").select("canonical_id")
    ids = up.union(system).union(first("state")).union(table).union(columns).distinct()
    return ids.join(items.select("canonical_id", "entity_type"), "canonical_id")


def complete(items: DataFrame, screen: str) -> DataFrame:
    """Every candidate of the screen with `reason`: null if it is selected, else why it is left out.

    Elements are judged by themselves, then events by the elements and states they come from, then transitions by their
    states and events: three joins on ids.
    """
    states = items.where((F.col("entity_type") == "state") & (F.col("screen_id") == screen)).select(F.col("canonical_id").alias("id"))
    i = items.alias("i")
    at = F.lit(screen)
    in_states = lambda df, column, name: df.join(states.select(F.col("id").alias(column), F.lit(True).alias(name)), column, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    shared = F.coalesce(F.lower("region").isin(*SHARED_REGIONS), F.lit(False))
    other = F.coalesce(F.col("screen_id") != at, F.lit(False))
    claimed = in_states(i.select("i.*"), "parent_id", "_p")
    claimed = claimed.withColumn("_claimed", F.coalesce(F.col("screen_id") == at, F.lit(False)) | F.coalesce(F.col("parent_id") == at, F.lit(False)) | F.col("_p"))
    lost_parent = F.col("parent_id").isNotNull() & (F.col("parent_id") != at) & ~F.col("_p")
    blank = F.trim(F.coalesce("label", F.lit(""))).isin("", "unlabeled control")
    elements = claimed.where(F.col("entity_type").isin("field", "control", "link") & F.col("_claimed")).withColumn("reason", (
        F.when(shared, "global_scope_entity").when((F.col("entity_type") == "control") & blank, "placeholder_control_label").when(other, "screen_mismatch")
        .when((F.col("entity_type") == "link") & (F.col("target_route") == "/"), "root_navigation_link").when((F.col("entity_type") == "link") & ~routes.is_local_target(F.col("target_route")), "unsafe_link_target")
        .when((F.col("entity_type") != "link") & lost_parent, "parent_not_selected")
    ))
    chosen = elements.where("reason is null").select(F.col("canonical_id").alias("id"))
    events = claimed.where("entity_type = 'event'")
    for column, name in (("control_id", "_c"), ("link_id", "_l")):
        events = events.join(chosen.select(F.col("id").alias(column), F.lit(True).alias(name)), column, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    events = in_states(events, "source_state_id", "_s")
    touches = F.col("_claimed") | F.col("_c") | F.col("_l") | F.col("_s")
    lost = lambda column, there: F.col(column).isNotNull() & ~F.col(there)
    events = events.where(touches).withColumn("reason", (
        F.when(shared, "global_scope_entity").when(lost("source_state_id", "_s") | lost("control_id", "_c") | lost("link_id", "_l"), "event_source_not_selected").when(other, "screen_mismatch")
        .when(~(F.col("_c") | F.col("_l") | F.col("_s") | F.coalesce(F.col("screen_id") == at, F.lit(False))), "orphan_event")
    ))
    fired = events.where("reason is null").select(F.col("canonical_id").alias("event_id"), F.lit(True).alias("_e"))
    steps = in_states(in_states(items.where("entity_type = 'transition'"), "source_state_id", "_s"), "target_state_id", "_t").where("_s or _t").join(fired, "event_id", "left")
    steps = steps.withColumn("reason", F.when(~(F.col("_s") & F.col("_t")), "cross_screen_transition").when(F.col("event_id").isNotNull() & F.col("_e").isNull(), "transition_event_not_selected"))
    out = lambda df: df.select("canonical_id", "entity_type", "reason")
    return out(elements).unionByName(out(events)).unionByName(out(steps)).unionByName(out(items.where((F.col("entity_type") == "state") & (F.col("screen_id") == screen)).withColumn("reason", F.lit(None).cast("string"))))


def readiness(selected: DataFrame, items: DataFrame) -> DataFrame:
    """(canonical_id, ready): whether a planned row has a label without sensitive values."""
    return selected.join(items.select("canonical_id", "label"), "canonical_id").select("canonical_id", (~privacy.is_sensitive(F.col("label"))).alias("ready"))


def neighbourhood(items: DataFrame, corrections: DataFrame, screen: str) -> DataFrame:
    """Items that belong to a screen by what is in force: a corrected parent decides, not the source's. Its tables'
    columns and its states' transitions come with them."""
    eff = items.join(corrections.select("canonical_id", F.col("screen_id").alias("_s"), F.col("parent_id").alias("_p")), "canonical_id", "left").withColumns({"screen_id": F.coalesce("_s", "screen_id"), "parent_id": F.coalesce("_p", "parent_id")}).drop("_s", "_p")
    own = eff.where(F.col("screen_id") == screen)
    tables = own.where("entity_type = 'table'").select(F.col("canonical_id").alias("parent_id"))
    states = own.where("entity_type = 'state'").select(F.col("canonical_id").alias("k"))
    columns = eff.where("entity_type = 'column'").join(tables, "parent_id", "left_semi")
    steps = eff.where("entity_type = 'transition'")
    touching = steps.join(states, F.col("source_state_id") == F.col("k"), "left_semi").union(steps.join(states, F.col("target_state_id") == F.col("k"), "left_semi"))
    ids = own.select("canonical_id").union(columns.select("canonical_id")).union(touching.select("canonical_id")).distinct()
    return eff.join(ids, "canonical_id", "left_semi")
