"""What a crawl leaves behind, folded: links registered, states reached, menus, modules and how a crawl went."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import hashing, routes, text
from tessella.sources.shared import dropped, written_once

# Menu texts that are no menu entries, and the starts of texts of whole menus.
IGNORED_MENUS = ("menu de navegación", "menu de navegacion")


def menus(items: DataFrame, folding_tags: tuple[str, ...], plain_tags: tuple[str, ...], ignored: tuple[str, ...] = ()) -> DataFrame:
    """Menu entries of each screen, the first of each text: items (screen, seq, text, tag, selector)."""
    label = text.squeeze(F.coalesce("text", F.lit("")))
    tag = F.lower(F.trim(F.coalesce("tag", F.lit(""))))
    kind = F.when(tag.isin(*folding_tags), "collapsable_menu").when(tag.isin(*plain_tags), "basic_menu_item")
    rows = items.withColumns({"label": label, "kind": kind}).withColumn("key", F.lower("label"))
    whole = reduce(lambda a, b: a | b, [F.col("key").startswith(w) for w in IGNORED_MENUS])
    good = rows.where((F.col("label") != "") & (F.length("label") <= 80) & F.col("kind").isNotNull() & ~whole & ~F.col("key").isin(*ignored, ""))
    first = good.groupBy("screen", "key").agg(F.min_by(F.struct("seq", "label", "kind", "selector"), "seq").alias("f"))
    return first.select("screen", "f.*")


def registered_links(links: DataFrame, home: str, known: DataFrame, only_new: bool = False, allow: tuple[str, ...] = (), block: tuple[str, ...] = ()) -> DataFrame:
    """Links that make edges: not to their own screen, allowed, and of the global menu only from home or to what is new.

    links (seq, source, target, region, label); known (route) before them. A target is known from the first link on that
    registers it, so later global links to it don't count: one aggregation finds that link.
    """
    rows = links.where((F.col("source") != F.col("target")) & routes.is_allowed(F.col("target"), allow, block))
    before = known.select(F.col("route").alias("target"), F.lit(True).alias("_k")).distinct()
    first = rows.groupBy("target").agg(F.min("seq").alias("_first"))
    rows = rows.join(before, "target", "left").join(first, "target")
    there = F.col("_k").isNotNull() | (F.col("seq") > F.col("_first"))
    repeated = (F.coalesce("region", F.lit("main_content")) == "global_navigation") & (F.col("source") != home) & there
    return rows.where(~repeated & ~(F.lit(only_new) & there)).select(*links.columns)


def dynamic_nodes(steps: DataFrame) -> DataFrame:
    """(node, source, label) of states reached by events: a state is its route and the first 12 digits of its signature."""
    node = F.concat("route", F.lit("#state:"), F.substring("signature", 1, 12))
    return steps.select(node.alias("node"), F.col("source"), F.col("label"))


def reached_states(events: DataFrame, known: DataFrame, most_depth: int) -> DataFrame:
    """New states that events lead to: (signature, path, depth, enqueue), the shortest way to each, the first of equals.

    events (seq, signature, source_path, label, changed); known (signature). Only changes reach states; one of the greatest
    depth is kept but not gone on from.
    """
    rows = events.where("changed").join(known.select("signature"), "signature", "left_anti").withColumn("path", F.concat("source_path", F.array("label")))
    best = rows.groupBy("signature").agg(F.min_by("path", F.struct(F.size("path"), F.col("seq"))).alias("path"))
    return best.withColumn("depth", F.size("path")).withColumn("enqueue", F.col("depth") < most_depth)


def changes(observations: DataFrame) -> DataFrame:
    """observations (event_id, before, after, before_exact, after_exact, stable) with `outcome`: an unstable one is an error,
    not a change; structure decides, and where it is the same the exact form tells of changed data."""
    outcome = F.when(~F.col("stable"), "unstable_observation").when(F.col("before") != F.col("after"), "changed").when(F.col("before_exact") != F.col("after_exact"), "data_changed").otherwise("unchanged")
    return observations.withColumn("outcome", outcome)


def discovered_modules(entries: DataFrame, home: str) -> DataFrame:
    """(module, name, screens, discriminator): menus opened at home become modules, with the screens of links found inside.

    entries (selector, label, state_route, target): the first menu on the way and a link behind it. Menus without a screen
    are no modules; menus of one name get their selector as discriminator.
    """
    inside = entries.where((F.col("state_route") == home) & F.col("target").isNotNull() & (F.col("target") != home))
    per = inside.groupBy("selector").agg(F.min("label").alias("name"), F.count_distinct("target").alias("screens"))
    names = per.groupBy(text.label_key(F.col("name")).alias("k")).agg(F.count("*").alias("n"))
    out = per.withColumn("k", text.label_key(F.col("name"))).join(names, "k")
    return out.select(F.col("selector").alias("module"), "name", "screens", F.when(F.col("n") > 1, F.col("selector")).alias("discriminator"))


def fixed_point(start: DataFrame, step, done, most_rounds: int = 100) -> tuple[DataFrame, int]:
    """Applies step to a table until done(old, new) says that nothing is new; each round is written out, so a lost executor
    repeats one round and plans stay short, and the round before it is deleted. Returns the last table and the rounds that
    were needed; a table that has not settled after most_rounds is an error."""
    now = start
    for n in range(1, most_rounds + 1):
        new = written_once(step(now), "round")
        if done(now, new):
            return new, n
        if n > 1:
            dropped(now)
        now = new
    raise RuntimeError(f"not settled after {most_rounds} rounds")


def summary(pages: DataFrame, edges: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: pages, those with a title, edges, kinds of edges, failures."""
    p = pages.agg(F.count("*").alias("pages"), F.count_if(F.coalesce("title", F.lit("")) != "").alias("titled"))
    e = edges.agg(F.count("*").alias("edges"), F.count_distinct("kind").alias("kinds"))
    return p.crossJoin(e).crossJoin(failures.agg(F.count("*").alias("failures")))  # one row each


def planner_order(kind: str) -> list[Column]:
    """How a plan orders its rows of a kind: missing numbers last, missing words after all others, ids in the end. Rows have
    the columns that the kind's key names."""
    last, none = F.lit(2**31), F.lit("￿")
    word = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], none)
    c = F.col
    depth, place = F.coalesce(c("depth"), last), F.coalesce(c("position"), last)
    keys = {
        "ui_state": lambda: [(depth != 0).cast("int"), depth], "complete_state": lambda: [(depth != 0).cast("int"), depth, (~F.coalesce(c("is_route_root"), F.lit(False))).cast("int")],
        "table": lambda: [place, F.coalesce("normalized_name", F.lit(""))], "table_column": lambda: [place, F.coalesce("normalized_name", F.lit(""))],
        "field": lambda: [place, word(c("normalized_label")), word(c("normalized_name"))], "control": lambda: [place, word(c("control_type")), word(c("normalized_label"))],
        "link": lambda: [place, word(c("normalized_label")), word(c("route"), c("target_route"))],
        "event": lambda: [word(c("event_type"), c("category")), word(c("source_state_id"), c("control_id"), c("link_id"), c("screen_id"))],
        "transition": lambda: [word(c("source_state_id")), word(c("target_state_id")), word(c("event_id"))],
    }
    return [*keys[kind](), c("canonical_id")]


def captured(screens: DataFrame, visited: DataFrame, allow: tuple[str, ...] = (), block: tuple[str, ...] = ()) -> DataFrame:
    """screens with `capture`, what a crawl does with each screen as it comes: not_allowed by the route's prefix; visited, if
    the route was (visited: route) or an earlier screen of it is captured or found unavailable; unavailable; or captured.

    screens (seq, route, available). Routes are compared without query and fragment. A route's first allowed screen is one
    aggregation, joined back, so routes with very many screens are no groups.
    """
    key = routes.route_key(F.col("route"))
    rows = screens.withColumns({"_route": key, "_allowed": routes.is_allowed(key, allow, block)})
    first = rows.where("_allowed").groupBy("_route").agg(F.min("seq").alias("_first"))
    known = visited.select(routes.route_key(F.col("route")).alias("_route"), F.lit(True).alias("_known")).distinct()
    rows = rows.join(first, "_route", "left").join(known, "_route", "left")
    gate = F.when(~F.col("_allowed"), "not_allowed").when(F.col("_known") | (F.col("seq") > F.col("_first")), "visited").when(~F.coalesce("available", F.lit(True)), "unavailable")
    return rows.withColumn("capture", F.coalesce(gate, F.lit("captured"))).select(*screens.columns, "capture")


def event_results(results: DataFrame) -> DataFrame:
    """(state_id, results, outcomes, links, buttons, inputs): what the events of each state led to. outcomes is a map of outcome
    to number, and the counts are of the elements on the screens after them. results (state_id, outcome, links, buttons,
    inputs: arrays, null for none)."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    of = results.groupBy("state_id", F.coalesce("outcome", F.lit("unknown")).alias("outcome")).agg(
        F.count("*").alias("n"), *(F.sum(F.when(F.col(c).isNotNull(), size(c)).otherwise(0)).alias(c) for c in ("links", "buttons", "inputs")))
    # a state has few outcomes
    return of.groupBy("state_id").agg(
        F.sum("n").alias("results"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"), *(F.sum(c).alias(c) for c in ("links", "buttons", "inputs")))
