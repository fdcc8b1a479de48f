"""From screen records to typed entities with stable ids, and the checks that they must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import hashing, privacy, routes, text
from tessella.operators.policy import is_local
from tessella.operators.relations import dangling, duplicates
from tessella.sources.shared import counted, written_once


def _kept(region: Column) -> Column:
    return ~F.coalesce(F.lower(region).isin(*privacy.SENSITIVE_REGIONS), F.lit(False))


def _ident(kind: str, *parts: Column) -> Column:
    return hashing.stable_id(kind, *[F.coalesce(p, F.lit("")) for p in parts])


def build(erp: str, screens: DataFrame, states: DataFrame, transitions: DataFrame, modules: DataFrame) -> dict[str, DataFrame]:
    """Entities of one system: erp, module, screen, field, control, table, column, link, state, transition and warning.

    screens are those of sources.documents; states (state_id, route, title, signature); transitions (source_state_id,
    target_state_id, event_type, label, selector); modules (prefix, name). Elements of sensitive regions are dropped, the
    first of equals stays, ids are hashes of names, so the same input gives the same ids.
    """
    spark = screens.sparkSession
    e = F.lit(erp)
    out = {"erp": spark.range(1).select(_ident("erp", e).alias("erp_id"), e.alias("name"))}
    erp_id = _ident("erp", e)
    out["module"] = modules.select(_ident("module", e, text.id_key(F.col("name"))).alias("module_id"), erp_id.alias("erp_id"), "name", "prefix")
    # screens get their keys once, and are written with them, as every kind of child reads them
    s = written_once(screens.withColumn("route", routes.route_key(F.col("route"))).withColumn("screen_id", _ident("screen", e, F.col("route"))), "screens")
    up = s.select("screen_id", F.explode(routes.ancestors(F.col("route"))).alias("prefix"))
    home = up.join(out["module"].select("prefix", "module_id"), "prefix").groupBy("screen_id").agg(F.max_by("module_id", F.length("prefix")).alias("module_id"))
    labels = F.concat(*[F.coalesce(F.transform(F.filter(F.col(c), lambda x: is_local(x["region"]) & _kept(x["region"])), lambda x: x[f]), F.array().cast("array<string>")) for c, f in (("inputs", "label"), ("buttons", "text"), ("tables", "name"), ("local_links", "text"))])
    out["screen"] = s.join(home, "screen_id", "left").select("screen_id", erp_id.alias("erp_id"), "module_id", "route", "title", text.id_key(F.col("title")).alias("normalized_title"), privacy.safe_text(F.col("title"), labels)["text"].alias("main_content_text"))

    out["screen"] = written_once(out["screen"], "screen")

    def children(column: str, kind: str, label: Column, *more: str) -> DataFrame:
        rows = s.select("screen_id", F.posexplode(column).alias("pos", "x")).where(_kept(F.col("x.region")))
        rows = rows.withColumn(f"{kind}_id", _ident(kind, F.col("screen_id"), text.id_key(label), F.coalesce(F.col("x.region"), F.lit(""))))
        first = F.min_by(F.struct("pos", label.alias("label"), *[F.col(f"x.{m}").alias(m) for m in more]), "pos")
        return rows.groupBy("screen_id", f"{kind}_id").agg(first.alias("f")).select(f"{kind}_id", "screen_id", "f.*")

    out["field"] = children("inputs", "field", text.first_filled(F.col("x.label"), F.col("x.placeholder"), F.col("x.name")), "type", "region")
    out["control"] = children("buttons", "control", text.first_filled(F.col("x.text")), "type", "region").withColumn("label", F.coalesce("label", F.lit("unlabeled control")))
    out["table"] = children("tables", "table", text.first_filled(F.col("x.name"), F.array_join("x.headers", " ")), "headers", "row_count")
    out["table"] = written_once(out["table"], "table")
    out["column"] = out["table"].select("table_id", "screen_id", F.posexplode("headers").alias("position", "name")).where("trim(name) <> ''").withColumn("column_id", _ident("column", F.col("table_id"), F.col("position").cast("string"), text.id_key(F.col("name"))))
    out["table"] = out["table"].drop("headers")
    links = s.select("screen_id", F.posexplode(F.concat(F.coalesce("local_links", F.array()), F.coalesce("links", F.array()))).alias("pos", "x")).where(_kept(F.col("x.region")))
    links = links.select("screen_id", "pos", F.trim("x.text").alias("label"), routes.safe_relative(F.col("x.href")).alias("target_route"), "x.region").where("target_route is not null").withColumn("target_route", routes.route_key(F.col("target_route")))
    links = links.groupBy("screen_id", text.id_key(F.col("label")).alias("k"), "target_route").agg(F.min_by(F.struct("label", "region"), "pos").alias("f"))
    target = out["screen"].select(F.col("route").alias("target_route"), F.col("screen_id").alias("target_screen_id"))
    out["link"] = links.join(target, "target_route", "left").select(_ident("link", F.col("screen_id"), F.col("k"), F.col("target_route")).alias("link_id"), "screen_id", "f.label", "f.region", "target_route", "target_screen_id")
    st = states.withColumn("route", routes.route_key(F.col("route")))
    matched = st.join(out["screen"].select("route", "screen_id"), "route")
    out["state"] = matched.select(_ident("state", F.col("screen_id"), F.col("signature")).alias("state_key"), "state_id", "screen_id", "title", "signature")
    end = lambda k: out["state"].select(F.col("state_id").alias(f"{k}_state_id"), F.col("state_key").alias(k))
    found = transitions.join(end("source"), "source_state_id").join(end("target"), "target_state_id")
    out["transition"] = found.select(_ident("transition", F.col("source"), F.col("target"), F.col("event_type"), F.col("selector")).alias("transition_id"), "source", "target", "event_type", "label").groupBy("transition_id", "source", "target", "event_type").agg(F.min("label").alias("label"))
    lost = st.join(out["screen"].select("route"), "route", "left_anti").select(F.lit("state_without_screen").alias("code"), F.col("state_id").alias("subject"))
    known = out["state"].select("state_id")
    half = transitions.select(F.explode(F.array("source_state_id", "target_state_id")).alias("state_id")).join(known, "state_id", "left_anti").distinct().select(F.lit("incomplete_transition").alias("code"), F.col("state_id").alias("subject"))
    out["warning"] = lost.union(half)
    return out


OMITTED = ("inputs", "buttons", "tables", "local_links", "links")


def written_without_sensitive(screens: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(screens without elements of sensitive regions, written; what was left out): the number of screens as `n`, and for each
    kind of element how many were omitted, counted while the screens are written. Null arrays stay null."""
    kinds = [k for k in OMITTED if k in screens.columns]
    gone = lambda k: F.coalesce(F.size(F.filter(k, lambda x: ~_kept(x["region"]))), F.lit(0))
    marked = screens.withColumns({f"_{k}": F.when(F.col(k).isNotNull(), gone(k)).otherwise(0) for k in kinds})
    kept = marked.withColumns({k: F.filter(k, lambda x: _kept(x["region"])) for k in kinds})
    table, said = counted(kept, "screens", **{k: F.coalesce(F.sum(f"_{k}"), F.lit(0)) for k in kinds})
    return table.drop(*(f"_{k}" for k in kinds)), said


def issues(entities: dict[str, DataFrame]) -> DataFrame:
    """(severity, code, subject): ids that repeat, and references to entities that are not there."""
    ids = {"module": "module_id", "screen": "screen_id", "field": "field_id", "control": "control_id", "table": "table_id", "column": "column_id", "link": "link_id", "state": "state_key", "transition": "transition_id"}
    parents = (("screen", "module_id", "module", "module_id"), ("field", "screen_id", "screen", "screen_id"), ("control", "screen_id", "screen", "screen_id"), ("table", "screen_id", "screen", "screen_id"), ("column", "table_id", "table", "table_id"),
               ("link", "screen_id", "screen", "screen_id"), ("link", "target_screen_id", "screen", "screen_id"), ("state", "screen_id", "screen", "screen_id"), ("transition", "source", "state", "state_key"), ("transition", "target", "state", "state_key"))
    rows = [duplicates(entities[k], c).select(F.lit("error").alias("severity"), F.lit(f"duplicate_{k}").alias("code"), F.col(c).alias("subject")) for k, c in ids.items()]
    rows += [dangling(entities[k], c, entities[p], pc).select(F.lit("error").alias("severity"), F.lit(f"{k}.{c}").alias("code"), F.col(c).alias("subject")) for k, c, p, pc in parents]
    rows += [entities["warning"].select(F.lit("warning").alias("severity"), "code", "subject")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def statistics(entities: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in entities.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity_type"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def flattened(entities: dict[str, DataFrame]) -> DataFrame:
    """(entity_type, canonical_id, parent_id, content_hash, payload): one row an entity, fields in order of name."""
    ids = {"erp": "erp_id", "module": "module_id", "screen": "screen_id", "field": "field_id", "control": "control_id", "table": "table_id", "column": "column_id", "link": "link_id", "state": "state_key", "transition": "transition_id"}
    out = None
    for name, key in ids.items():
        df = entities[name]
        up = [F.col(c) for c in ("table_id", "screen_id", "module_id", "source", "erp_id") if c in df.columns and c != key]
        payload = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        one = df.select(F.lit(name).alias("entity_type"), F.col(key).alias("canonical_id"), (F.coalesce(*up) if up else F.lit(None).cast("string")).alias("parent_id"), F.sha2(payload, 256).alias("content_hash"), payload.alias("payload"))
        out = one if out is None else out.unionByName(one)
    return out
