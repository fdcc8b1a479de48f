"""Roll-ups of what an exploration found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome(explicit: Column, error: Column, succeeded: Column, changed: Column) -> Column:
    """What came of an event, the first that fits."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    failed = F.coalesce(error, F.lit("")) != ""
    return (
        F.when(F.coalesce(explicit, F.lit("")) != "", explicit).when(error == "state_restore_failed", "restore_failed").when(failed & ~yes(succeeded), "interaction_failed")
        .when(failed, "execution_error").when(yes(changed), "changed").otherwise("unchanged")
    )


def histograms(df: DataFrame, group: str | None, *dimensions: str) -> DataFrame:
    """(group, dimension, value, n): counts of each value of each dimension, per group and, with a null group, over all.

    One pass: a row becomes one (dimension, value) pair for each dimension, counted before the shuffle.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    key = [F.col(group).alias("group")] if group else []
    each = df.select(*key, pairs.alias("p")).groupBy(*(["group"] if group else []), "p.dimension", "p.value").agg(F.count("*").alias("n"))
    if not group:
        return each
    return each.unionByName(each.groupBy("dimension", "value").agg(F.sum("n").alias("n")).withColumn("group", F.lit(None).cast(each.schema["group"].dataType)))


def flow_profile(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """One row: states, roots among them (no transition leads there), depths, transitions that change the route."""
    roots = states.join(transitions.select(F.col("target").alias("state_id")), "state_id", "left_anti").agg(F.count("*").alias("roots"))
    s = states.agg(F.count("*").alias("states"), F.max("depth").alias("deepest"))
    t = transitions.agg(F.count("*").alias("transitions"), F.count_if("changed_route").alias("route_changes"))
    return s.join(roots).join(t)  # one row each


def common_prefix(routes: Column) -> Column:
    """The longest common start of an array of routes, whole segments; null if they share none."""
    split = lambda r: F.filter(F.split(r, "/"), lambda x: x != "")

    def meet(a: Column, b: Column) -> Column:
        n = F.least(F.size(a), F.size(b))
        differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i > n) | (F.try_element_at(a, i) != F.try_element_at(b, i)))
        return F.slice(a, F.lit(1), F.when(F.size(differ) > 0, F.element_at(differ, 1) - 1).otherwise(n))

    parts = F.transform(routes, split)
    same = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, 1), meet)
    return F.when(F.size(same) > 0, F.concat(F.lit("/"), F.array_join(same, "/")))


def most_common(df: DataFrame, value: str, seq: str, k: int = 5) -> DataFrame:
    """The k most frequent values; among equals the one seen first."""
    return df.groupBy(value).agg(F.count("*").alias("n"), F.min(seq).alias("first")).orderBy(F.desc("n"), "first").limit(k)


def shortest_paths(states: DataFrame) -> DataFrame:
    """One row a state: the shortest path to it, the first among equals; other columns take their first filled value.

    states (state_id, seq, path array, title)."""
    return states.groupBy("state_id").agg(
        F.min_by("path", F.struct(F.size("path"), F.col("seq"))).alias("path"), F.min_by("title", F.when(F.col("title") != "", F.col("seq"))).alias("title"), F.count("*").alias("seen"),
    )


def merged_nodes(sightings: DataFrame) -> DataFrame:
    """One node a route from sightings (route, seq, title, confidence, module, status).

    A later title replaces one that is missing or was no surer; every sighting that states a confidence, even a lower one,
    sets what the next is measured by. Module: the first; status: the last but discovered. The title's fold takes a
    route's sightings in order, which bounds it by the sightings of one route.
    """
    row = F.struct("seq", "title", F.col("confidence").cast("double").alias("confidence"))
    start = F.struct(F.lit("").alias("title"), F.lit(0.0).alias("confidence"))

    def fold(s: Column, x: Column) -> Column:
        new = F.coalesce(x["confidence"], F.lit(0.0))
        take = (F.coalesce(x["title"], F.lit("")) != "") & ((s["title"] == "") | (new >= s["confidence"]))
        return F.struct(F.when(take, x["title"]).otherwise(s["title"]).alias("title"), F.coalesce(x["confidence"], s["confidence"]).alias("confidence"))

    out = sightings.groupBy("route").agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.min_by("module", F.when(F.coalesce("module", F.lit("")) != "", F.col("seq"))).alias("module"),
        F.coalesce(F.max_by("status", F.when(F.col("status") != "discovered", F.col("seq"))), F.lit("discovered")).alias("status"),
    )
    return out.select("route", F.aggregate("rows", start, fold)["title"].alias("title"), "module", "status")


def result_audit(results: DataFrame) -> DataFrame:
    """(dimension, value, n): what came of events, over all results, in one pass: outcomes, categories, categories of events
    that changed something, strategies of restoring a state, how interactions went, and errors.

    results (outcome, error, interaction_succeeded, changed, category, restore_strategy): interaction_succeeded is null where
    it was not recorded; then an outcome of changed or unchanged tells that it went well.
    """
    came = outcome(F.col("outcome"), F.col("error"), F.col("interaction_succeeded"), F.col("changed"))
    filled = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    rows = results.withColumns({"_outcome": came, "_category": filled("category", "unknown"), "_restore": filled("restore_strategy", "none")})
    went = F.when(F.col("interaction_succeeded"), "succeeded").when(~F.col("interaction_succeeded"), "not_succeeded").when(F.col("_outcome").isin("changed", "unchanged"), "inferred_succeeded").otherwise("unknown")
    wide = rows.select(
        F.col("_outcome").alias("outcomes"), F.col("_category").alias("categories"), F.when(F.coalesce("changed", F.lit(False)), F.col("_category")).alias("changed_categories"),
        F.col("_restore").alias("restore_strategies"), went.alias("interactions"), F.nullif("error", F.lit("")).alias("errors"),
    )
    return histograms(wide, None, *wide.columns).where("value is not null")


def flow_audit(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """(dimension, value, n) of a state flow: states by depth, roots (of depth 0) and dynamic ones; transitions by event type
    and strategy of restoring, and those that change the route. states (depth), transitions (event_type, restore_strategy,
    changed_route)."""
    depth = F.coalesce("depth", F.lit(0))
    s = histograms(states.select(depth.cast("string").alias("depths"), F.when(depth == 0, "root").otherwise("dynamic").alias("states")), None, "depths", "states")
    t = transitions.select(
        F.coalesce("event_type", F.lit("unknown")).alias("categories"), F.coalesce("restore_strategy", F.lit("not_recorded")).alias("restoration"),
        F.when(F.coalesce("changed_route", F.lit(False)), "changed").otherwise("same").alias("routes"))
    return s.unionByName(histograms(t, None, *t.columns))
