"""Modules of a system from the paths that a crawl stored: which menu opened first, and which routes lay behind it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import hashing, routes, text

WARNING = "code string, subject string, module_id string"


class Modules(NamedTuple):
    """modules (module_id, name, normalized_name, origin, route_prefix, n_routes), routes (route, module_id), and warnings."""

    modules: DataFrame
    routes: DataFrame
    warnings: DataFrame


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))


def module_id(erp: str, name: Column, origin: Column, same_key: Column, same_name: Column) -> Column:
    """A module's id is one of its normalised name. Names that become equal are told apart by a digest of the name, and equal
    names by one of name and origin."""
    e, key, exact = F.lit(" ".join(erp.lower().split())), text.id_key(name), text.squeeze(name)
    by_name = F.substring(F.sha2(F.regexp_replace(F.to_json(F.array(exact)), r"^\[|\]$", ""), 256), 1, 12)
    by_both = F.substring(hashing.content_hash(name=exact, origin=origin), 1, 16)
    return (
        F.when(same_name > 1, hashing.stable_id("module", F.lit("module"), e, key, by_both)).when(same_key > 1, hashing.stable_id("module", F.lit("module"), e, key, by_name))
        .otherwise(hashing.stable_id("module", F.lit("module"), e, key))
    )


def common_prefix(route: Column) -> Column:
    """Aggregate: the steps that all routes begin with, or null. They are those of the least and the greatest route."""
    steps = F.split(F.regexp_replace(route, "^/+|/+$", ""), "/")
    pairs = F.arrays_zip(F.min(steps).alias("a"), F.max(steps).alias("b"))
    stop = F.aggregate(pairs, F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("on")), lambda s, p: F.when(
        s["on"] & p["a"].eqNullSafe(p["b"]), F.struct(F.array_append(s["kept"], p["a"]).alias("kept"), F.lit(True).alias("on"))
    ).otherwise(F.struct(s["kept"].alias("kept"), F.lit(False).alias("on"))))
    return F.when(F.size(stop["kept"]) > 0, F.concat(F.lit("/"), F.array_join(stop["kept"], "/")))


def discovered(erp: str, nodes: DataFrame, edges: DataFrame, functional: DataFrame, home: str = "/", legacy: DataFrame | None = None) -> Modules:
    """Menus that were opened first on the way from home become modules, with the routes of all links found behind them.

    nodes (seq, id, route, kind, base_route, depth, steps: array of structs with a selector); edges (seq, source, target,
    label, category, selector); functional (route): screens that count. An edge that expands a menu and leads to a state of
    depth 1 at home names a module; its origin is the menu's selector, or that of the state's first step, or the state. Links
    of states at home belong to the module whose origin is the selector of their first step: the last one of an origin. If
    functional holds routes, modules without one of them are left out with a warning. legacy (name, route) is used where
    paths name no module. A route of several modules belongs to the first by normalised name, name and origin, each other
    one is a warning. Empty tables give none of it.
    """
    at_home = routes.route_key(F.lit(home))
    one = F.struct("id", "kind", "base_route", "depth", "first")
    keyed = nodes.withColumn("first", F.get("steps", F.lit(0)).getField("selector")).select("seq", F.explode(F.array_distinct(F.array_compact(F.array("id", "route")))).alias("key"), one.alias("n")).where("key <> ''")
    keyed = keyed.groupBy("key").agg(F.max_by("n", "seq").alias("n")).select("key", "n.*")
    menus = edges.where((F.col("category") == "expand_menu") & _filled(F.col("label")).isNotNull()).select("seq", F.trim("label").alias("name"), "source", "target", F.col("selector").alias("own"))
    menus = menus.join(keyed.withColumnRenamed("key", "target"), "target")
    base = routes.route_key(F.coalesce(F.nullif("base_route", F.lit("")), "source"))
    origin = F.coalesce(_filled(F.coalesce(F.nullif("own", F.lit("")), "first")), "target")
    found = menus.where((base == at_home) & (F.col("depth") == 1)).select("seq", "name", origin.alias("origin"))
    if legacy is not None and found.isEmpty():
        found = legacy.groupBy("name").agg(F.min(F.lit(0)).cast("long").alias("seq")).select("seq", "name", F.concat(F.lit("legacy:"), "name").alias("origin"))
        behind = legacy.where("route is not null").select(F.concat(F.lit("legacy:"), "name").alias("origin"), routes.route_key(F.col("route")).alias("route")).distinct()
    else:
        inside = keyed.where((F.col("kind") == "ui_state") & (routes.route_key(F.coalesce("base_route", F.lit("/"))) == at_home) & (F.col("depth") >= 1))
        inside = inside.select("key", _filled(F.col("first")).alias("origin")).where("origin is not null")
        out = edges.where(F.col("target").startswith("/") & ~F.contains("target", F.lit("#state:"))).select(F.col("source").alias("key"), routes.route_key(F.col("target")).alias("route"))
        behind = inside.join(out, "key").select("origin", "route").distinct()
    last = found.groupBy("origin").agg(F.max("seq").alias("seq"))
    held = behind.join(last, "origin").select("seq", "origin", "route")
    wanted = functional.select(routes.route_key(F.col("route")).alias("route")).distinct()
    if not functional.isEmpty():
        useful = held.join(wanted, "route", "left_semi").select("seq", "origin").distinct()
        omitted = found.join(useful, ["seq", "origin"], "left_anti")
        found = found.join(useful, ["seq", "origin"])
    else:
        omitted = found.where(F.lit(False))
    same = lambda k: F.count("*").over(Window.partitionBy(k))
    named = found.withColumns({"normalized_name": text.id_key(F.col("name")), "exact": text.squeeze(F.col("name"))})
    named = named.withColumns({"_same_key": same("normalized_name"), "_same_name": same("exact")})
    named = named.withColumn("module_id", module_id(erp, F.col("name"), F.col("origin"), F.col("_same_key"), F.col("_same_name")))
    led = held.join(named.select("seq", "origin", "name", "normalized_name", "module_id"), ["seq", "origin"])
    order = F.struct("normalized_name", "name", "origin", "seq")
    owned = led.groupBy("route").agg(F.min_by("module_id", order).alias("module_id"))
    doubtful = led.join(owned.withColumnRenamed("module_id", "owner"), "route").where("module_id <> owner")
    prefixes = led.groupBy("seq", "origin").agg(common_prefix(F.col("route")).alias("route_prefix"), F.count("*").alias("n_routes"))
    modules = named.join(prefixes, ["seq", "origin"], "left").select("module_id", "name", "normalized_name", "origin", "route_prefix", F.coalesce("n_routes", F.lit(0)).alias("n_routes"))
    none = F.lit(None).cast("string")
    warnings = omitted.select(F.lit("module_without_functional_screen").alias("code"), F.col("name").alias("subject"), none.alias("module_id")).union(
        doubtful.select(F.lit("ambiguous_module_route"), "route", "module_id"))
    return Modules(modules, owned, warnings)

