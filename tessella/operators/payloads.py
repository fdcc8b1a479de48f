"""Stored JSON payloads as typed rows. A payload is parsed once, to a VARIANT; what does not fit its type is kept as a
diagnostic, so that one bad row costs itself and not its screen."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.shared import written_once

#: What VARIANT calls the values of a type.
_KINDS = {"string": r"^STRING$", "int": r"^(BIGINT|INT|SMALLINT|TINYINT)$", "boolean": r"^BOOLEAN$", "strings": r"^ARRAY<(STRING|VOID)?>$|^ARRAY<>$"}
_SQL = {"string": "string", "int": "int", "boolean": "boolean", "strings": "array<string>"}


class Field(NamedTuple):
    """A field of a payload: without a default it must be there; a default None lets it be null or absent."""

    name: str
    kind: str = "string"
    default: object = ...


# The fields of each kind of entity that a screen's structure shows.
STRUCTURE = {
    "field": (Field("label"), Field("input_type", default=None), Field("required", "boolean", False), Field("readonly", "boolean", False)),
    "control": (Field("label"), Field("control_type", default=None), Field("mutative", "boolean", False), Field("safety_decision", default=None)),
    "table": (Field("name", default=None),),
    "table_column": (Field("name"), Field("table_id")),
    "ui_state": (Field("title"), Field("depth", "int", None)),
    "event": (Field("label"), Field("category"), Field("policy_decision"), Field("mutative", "boolean", False)),
    "transition": (Field("category"), Field("source_state_id", default=None), Field("target_state_id", default=None), Field("trigger_control_id", default=None)),
}
SCREEN = (Field("title"), Field("route"), Field("module_id", default=None), Field("normalized_title", default=None))
OMITTED = "Elemento estructural omitido: "


class Typed(NamedTuple):
    rows: DataFrame
    invalid: DataFrame


def opened(items: DataFrame, payload: str = "payload") -> DataFrame:
    """items with `doc`, the payload as a VARIANT, null unless it is a JSON object. Text that is no JSON is null too."""
    doc = F.try_parse_json(F.col(payload))
    return items.withColumn("doc", doc).withColumn("doc", F.when(F.schema_of_variant("doc").startswith("OBJECT"), F.col("doc")))


def value(doc: str | Column, name: str, kind: str = "string") -> Column:
    """A field of a VARIANT, null where it is absent or of another type: numbers are no strings."""
    inner = F.try_variant_get(F.col(doc) if isinstance(doc, str) else doc, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(inner).rlike(_KINDS[kind]), F.try_variant_get(F.col(doc) if isinstance(doc, str) else doc, f"$.{name}", _SQL[kind]))


def problem(doc: str, fields: tuple[Field, ...]) -> Column:
    """The first field that is missing or of another type, as `name: missing` or `name: type`; `payload` if there is none."""

    def one(f: Field) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(F.col(doc), f"$.{f.name}", "variant"))
        absent = kind.isNull() | (kind == "VOID")
        missing = F.when(absent, f"{f.name}: missing") if f.default is ... else F.when(kind == "VOID", f"{f.name}: type") if f.default is not None else F.lit(None).cast("string")
        return F.coalesce(missing, F.when(~absent & ~kind.rlike(_KINDS[f.kind]), f"{f.name}: type"))

    return F.when(F.col(doc).isNull(), "payload").otherwise(F.coalesce(*map(one, fields), F.lit(None).cast("string")))


def typed(items: DataFrame, fields: tuple[Field, ...]) -> Typed:
    """Opened items with the fields as columns, and those that don't fit, with `reason`. Clashing columns are replaced."""
    checked = items.withColumn("reason", problem("doc", fields))

    def column(f: Field) -> Column:
        found = value("doc", f.name, f.kind)
        return (found if f.default in (..., None) else F.coalesce(found, F.lit(f.default))).alias(f.name)

    kept = [c for c in items.columns if c not in {f.name for f in fields}]
    return Typed(checked.where("reason is null").select(*kept, *map(column, fields)), checked.where("reason is not null"))


class Structures(NamedTuple):
    """children (screen_id, kind, id, parent_id, label, body: JSON of the fields), warnings (screen_id or null, kind, id,
    reason), evidence (screen_id, evidence_id)."""

    children: DataFrame
    warnings: DataFrame
    evidence: DataFrame


def structures(items: DataFrame) -> Structures:
    """What the screens of one version consist of, from items (canonical_id, entity_type, payload).

    A child belongs to the screen that its payload names, a column to its table and so to its table's screen, a transition to
    the screens of its states: it needs one state that is sound and, if it names a control, one that is sound. Items that
    don't fit are warnings. Parsed payloads are written once, as each type reads them. Tables without a name are called Tabla. Null and broken payloads are warnings, other types are
    not looked at, an empty table gives nothing. All that is joined here grows with the items, and Spark, which goes by the
    size of compressed files, would send it through the driver: joins are merges.
    """
    rows = written_once(opened(items.select("canonical_id", "entity_type", "payload")).withColumn("screen_id", value("doc", "screen_id")), "payloads")
    fits = {k: typed(rows.where(F.col("entity_type") == k), fields) for k, fields in STRUCTURE.items()}
    body = lambda k: F.to_json(F.struct(*(f.name for f in STRUCTURE[k])), {"ignoreNullFields": "false"})
    none = F.lit(None).cast("string")

    def child(df: DataFrame, kind: str, label: Column, parent: Column = none) -> DataFrame:
        return df.where("screen_id is not null").select("screen_id", F.lit(kind).alias("kind"), F.col("canonical_id").alias("id"), parent.alias("parent_id"), label.alias("label"), body(kind).alias("body"), "doc")

    parts = [child(fits[k].rows, k, F.col(c)) for k, c in (("field", "label"), ("control", "label"), ("ui_state", "title"), ("event", "label"))]
    tables = fits["table"].rows.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.lit("Tabla")))
    parts.append(child(tables, "table", F.col("name")))
    # a column's screen is its table's, also of one whose name does not fit
    homes = rows.where("entity_type = 'table' and screen_id is not null").select(F.col("canonical_id").alias("table_id"), F.col("screen_id").alias("home")).hint("merge")
    columns = fits["table_column"].rows.join(homes, "table_id").withColumn("screen_id", F.col("home"))
    parts.append(child(columns, "table_column", F.col("name"), F.col("table_id")))
    states = rows.where("entity_type = 'ui_state' and screen_id is not null").select(F.col("canonical_id").alias("state"), F.col("screen_id").alias("home")).hint("merge")
    sound = fits["ui_state"].rows.select(F.col("canonical_id").alias("state"), F.lit(True).alias("sound")).hint("merge")
    controls = fits["control"].rows.select(F.col("canonical_id").alias("trigger_control_id"), F.col("screen_id").alias("home"), F.lit(True).alias("known")).hint("merge")
    raw = rows.where("entity_type = 'transition'").withColumns({c: value("doc", c) for c in ("source_state_id", "target_state_id")})
    ends = raw.select("canonical_id", F.explode(F.array_distinct(F.array_compact(F.array("source_state_id", "target_state_id")))).alias("state"))
    near = ends.join(states, "state").join(sound, "state", "left").groupBy("canonical_id", "home").agg(F.max(F.coalesce("sound", F.lit(False))).alias("sound")).hint("merge")
    moves = fits["transition"].rows.drop("screen_id").join(near, "canonical_id").join(controls, ["trigger_control_id", "home"], "left")
    ok = F.col("sound") & (F.col("trigger_control_id").isNull() | F.coalesce("known", F.lit(False)))
    parts.append(child(moves.where(ok).withColumn("screen_id", F.col("home")), "transition", F.col("category")))
    children = reduce(DataFrame.unionByName, parts)
    bad = lambda df, screen: df.select(screen.alias("screen_id"), F.col("entity_type").alias("kind"), F.col("canonical_id").alias("id"), "reason")
    wrong = [bad(fits[k].invalid, F.col("screen_id")) for k in ("field", "control", "table", "ui_state", "event")]
    broken = fits["table_column"].invalid.withColumn("table_id", value("doc", "table_id")).join(homes, "table_id", "left")
    wrong.append(bad(broken, F.col("home")))
    lost = near.join(fits["transition"].invalid.select("canonical_id", "entity_type", "reason"), "canonical_id")
    wrong.append(bad(lost, F.col("home")))
    reason = F.when(~F.col("sound"), "source_state_id: unknown").otherwise("trigger_control_id: unknown")
    wrong.append(bad(moves.where(~ok).withColumn("reason", reason), F.col("home")))
    evidence = children.select("screen_id", F.explode(value("doc", "evidence_ids", "strings")).alias("evidence_id")).where("trim(evidence_id) <> ''").distinct()
    return Structures(children.drop("doc"), reduce(DataFrame.union, wrong), evidence)


def structure_hashes(children: DataFrame, buckets: int = 64) -> DataFrame:
    """(screen_id, n, structure_hash): digests of each screen's sorted children, in buckets of them, so that no row holds a
    whole screen's children."""
    line = F.to_json(F.struct("kind", "id", "parent_id", "label", "body"), {"ignoreNullFields": "false"})
    each = children.select("screen_id", F.sha2(line, 256).alias("h")).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)).cast("int"))
    parts = each.groupBy("screen_id", "bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("d"), F.count("*").alias("n"))
    return parts.groupBy("screen_id").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]), ","), 256).alias("structure_hash"))


def effective(items: DataFrame, corrections: DataFrame, *names: str) -> DataFrame:
    """items (canonical_id, status, and the names) with the names as they are in force: those of the latest correction's JSON
    (corrections: canonical_id, seq, payload) where the item is corrected and the field is a string there, else the item's."""
    last = corrections.groupBy("canonical_id").agg(F.max_by("payload", "seq").alias("payload"))
    doc = opened(last).select("canonical_id", "doc")
    joined = items.join(doc, "canonical_id", "left")
    use = lambda n: F.when(F.col("status") == "corrected", value("doc", n))
    return joined.select(*(c for c in items.columns if c not in names), *(F.coalesce(use(n), F.col(n)).alias(n) for n in names))

