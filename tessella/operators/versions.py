"""Versions of knowledge, reviews as append-only logs, and what may follow what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.relations import carried_forward, set_or_reset

# The status that each review action leads to, for structural items and for proposals.
STRUCTURAL = {"approve": "approved", "reject": "rejected", "correct": "corrected", "reset": "pending"}
SEMANTIC = (("pending", "approve", "approved"), ("pending", "reject", "rejected"), ("pending", "correct", "corrected"), ("approved", "reset", "pending"), ("rejected", "reset", "pending"), ("corrected", "reset", "pending"))


def effective(items: DataFrame, log: DataFrame, key: str = "item_id") -> DataFrame:
    """items with `effective`: the payload of the correction in force, or the source where there is none or it is empty.

    log has key, created_at, action_id, action and corrected_payload.
    """
    order = F.struct("created_at", "action_id")
    told = set_or_reset(log, key, order, F.when(F.col("action") == "correct", F.col("corrected_payload")), F.col("action") == "reset")
    kept = F.when(~F.col("payload").isin("", "{}"), F.col("payload"))
    return items.join(told, key, "left").withColumn("effective", F.coalesce(kept, F.col("source_payload"))).drop("payload")


def publication_errors(items: DataFrame, log: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, error): items that are corrected although no correction of them is in force. They can't be published."""
    order = F.struct("created_at", "action_id")
    told = set_or_reset(log, key, order, F.when(F.col("action") == "correct", F.col("corrected_payload")), F.col("action") == "reset")
    lost = items.where("status = 'corrected'").join(told.where("payload is not null").select(key), key, "left_anti")
    return lost.select(key, F.lit("corrected_without_correction").alias("error"))


def publishable(effective_items: DataFrame) -> DataFrame:
    return effective_items.where(F.col("status").isin("approved", "corrected"))


def checked_actions(actions: DataFrame, transitions: DataFrame) -> DataFrame:
    """actions with `error`: null for those that may be done. transitions (previous, action, next) lists what may follow.

    Actions have status, revision, action, expected_status, expected_revision, notes and changed. The first fault tells.
    """
    rules = transitions.select(F.col("previous").alias("status"), "action", "next")
    known = actions.join(F.broadcast(rules), ["status", "action"], "left")  # a rule for each pair of status and action
    fault = (
        F.when(F.col("expected_status") != F.col("status"), "status_conflict").when(F.col("expected_revision") != F.col("revision"), "revision_conflict")
        .when(F.col("next").isNull(), "transition_not_allowed")
        .when(F.col("action").isin("reject", "correct") & (F.trim(F.coalesce("notes", F.lit(""))) == ""), "notes_required")
        .when((F.col("action") == "correct") & ~F.coalesce("changed", F.lit(False)), "correction_changes_nothing")
    )
    return known.withColumn("error", fault).withColumn("revision", F.when(fault.isNull(), F.col("revision") + 1).otherwise(F.col("revision")))


def semantic_state(proposals: DataFrame, screens: DataFrame, key: str = "screen_id") -> DataFrame:
    """Each screen's state: that of its newest proposals, mixed if they differ, unavailable if none is valid, no_proposal
    without any. proposals have key, created_at, status, valid."""
    at = proposals.groupBy(key, "created_at").agg(F.count_distinct("status").alias("kinds"), F.min("status").alias("status"), F.bool_and("valid").alias("valid"))
    newest = at.groupBy(key).agg(F.max_by(F.struct("kinds", "status", "valid"), "created_at").alias("l"))
    state = F.when(F.col("l").isNull(), "no_proposal").when(F.col("l.kinds") > 1, "mixed").when(~F.col("l.valid"), "unavailable").otherwise(F.col("l.status"))
    return screens.join(newest, key, "left").select(key, state.alias("state"))


def drifted(proposals: DataFrame, current: DataFrame, key: str = "screen_id") -> DataFrame:
    """Proposals with `drift`: whether the structure they were made from is no longer the same; null if the screen is gone."""
    now = current.select(key, F.col("evidence_hash").alias("_now"))
    return proposals.join(now, key, "left").withColumn("drift", F.col("evidence_hash") != F.col("_now")).drop("_now")


def created_once(new: DataFrame, stored: DataFrame, identity: list[str]) -> DataFrame:
    """new with `outcome`: created, reused (same identity and content) or collision (same identity, other content)."""
    old = stored.select(*identity, F.col("content_hash").alias("_old"))
    outcome = F.when(F.col("_old").isNull(), "created").when(F.col("_old") == F.col("content_hash"), "reused").otherwise("collision")
    return new.join(old, identity, "left").withColumn("outcome", outcome).drop("_old")


def resolved_version(versions: DataFrame, erp: str | None = None, version: str | None = None) -> DataFrame:
    """The one version asked for, or a row that tells why there is none: versions (erp_id, version, status)."""
    asked = versions
    if erp is not None:
        asked = asked.where(F.col("erp_id") == erp)
    asked = asked.where(F.col("version") == version) if version is not None else asked.where("status = 'active'")
    found = asked.agg(F.count("*").alias("n"), F.min("erp_id").alias("erp_id"), F.min("version").alias("version"))
    error = F.when(F.col("n") == 0, "no_version").when(F.col("n") > 1, "ambiguous_version")
    return found.select(F.when(error.isNull(), F.col("erp_id")).alias("erp_id"), F.when(error.isNull(), F.col("version")).alias("version"), error.alias("error"))


def imported(new: DataFrame, versions: DataFrame, items: DataFrame, erp: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(items, versions) after an import: nothing if the version exists; else its rows with the reviews that unchanged rows
    had in the active version, which is archived."""
    there = versions.where((F.col("erp_id") == erp) & (F.col("version") == version)).limit(1)
    active = versions.where((F.col("erp_id") == erp) & (F.col("status") == "active")).select("version")
    old = items.join(active, "version", "left_semi")
    fresh = new.join(there.select(F.lit(True).alias("_there")), F.expr("true"), "left_anti")  # one row at most
    rows = carried_forward(fresh, old, ["entity_type", "canonical_id"]).withColumn("version", F.lit(version))
    is_new = there.agg((F.count("*") == 0).alias("is_new"))
    kept = versions.join(is_new, F.expr("true")).withColumn("status", F.when(F.col("is_new") & (F.col("erp_id") == erp) & (F.col("status") == "active"), "archived").otherwise(F.col("status"))).drop("is_new")
    added = is_new.where("is_new").select(F.lit(erp).alias("erp_id"), F.lit(version).alias("version"), F.lit("active").alias("status"))
    return items.unionByName(rows, allowMissingColumns=True), kept.unionByName(added)


# What a new version is synchronised to.
TARGETS = ("neo4j", "chroma")


def pending_jobs(versions_before: DataFrame, erp: str, version: str, requested_at: Column | None = None) -> DataFrame:
    """(job_id, version, target, status, requested_at): the jobs that the import of a version makes, none if it exists."""
    spark = versions_before.sparkSession
    at = F.current_timestamp() if requested_at is None else requested_at
    rows = spark.range(1).select(F.lit(version).alias("version"), F.explode(F.array(*map(F.lit, TARGETS))).alias("target"))
    there = versions_before.where((F.col("erp_id") == erp) & (F.col("version") == version)).select(F.lit(version).alias("version")).limit(1)
    new = rows.join(there, "version", "left_anti")
    return new.select(F.concat_ws(":", F.lit(erp), "version", "target").alias("job_id"), "version", "target", F.lit("pending").alias("status"), at.alias("requested_at"))


def dry_run(new: DataFrame, warnings: DataFrame, version: str) -> DataFrame:
    """(result, version, items, warnings): what an import would read; nothing is written. The system itself is an item."""
    n = new.agg((F.count("*") + 1).alias("items"))
    return n.join(warnings.agg(F.count("*").alias("warnings"))).select(F.lit("dry_run").alias("result"), F.lit(version).alias("version"), "items", "warnings")  # one row each


def import_errors(items: DataFrame, manifest_version: str, manifest_hash: str, version: str, n_errors: int) -> list[str]:
    """Why a build may not be imported: it has errors, or its manifest is of another version or content."""
    told = [(n_errors > 0, "invalid_knowledge"), (manifest_version != version, "manifest_version"), (manifest_hash != content_digest(items), "manifest_hash")]
    return [name for wrong, name in told if wrong]


def content_digest(items: DataFrame) -> str:
    """A digest of a version's rows (entity_type, canonical_id, content_hash) that no order changes: the sum of the rows'
    digests, so nothing is gathered."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct("entity_type", "canonical_id", "content_hash")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    total, n = items.agg(F.coalesce(F.sum(row), F.lit(0)), F.count("*")).head()
    return f"{int(total):x}-{n}"
