"""Jobs, stable states and what builds leave out, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import audits, integrity, versions
from tessella.plans import canonical
from tessella.plans.base import ENTITIES, entities
from tessella.plans.registry import query
from tessella.session import load
from tessella.sources import jobs
from tessella.sources.shared import written_once
from tessella.streaming import stability

_EVENT = "CASE event_type WHEN 'click' THEN 'started' WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END"


@query(f"""
WITH e AS (SELECT user_id AS job_id, event_id AS seq, {_EVENT} AS event FROM events),
b AS (SELECT *, event = 'started' AS s, coalesce(lag(event = 'started') OVER (PARTITION BY job_id ORDER BY seq, event), false) AS runs FROM e),
o AS (SELECT *, CASE WHEN s THEN NOT runs ELSE runs END AS ok FROM b)
SELECT job_id::VARCHAR AS job_id, CASE arg_max(event, seq) FILTER (ok) WHEN 'started' THEN 'running' ELSE coalesce(arg_max(event, seq) FILTER (ok), 'pending') END AS status,
  count(*) FILTER (ok AND s) AS attempt_count, count(*) FILTER (NOT ok) AS refused FROM o GROUP BY 1
""")
def sync_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Users as jobs, what they do as what happens to them."""
    log = load(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.lit("v").alias("version"), F.lit("t").alias("target"), F.col("event_id").alias("seq"), F.expr(_EVENT).alias("event"),
        F.current_timestamp().alias("at"), F.lit(None).cast("string").alias("detail"))
    return jobs.folded(log).select("job_id", "status", "attempt_count", "refused")


@query(f"""
WITH e AS (SELECT user_id AS job_id, event_id AS seq, {_EVENT} AS event FROM events),
b AS (SELECT *, event = 'started' AS s, coalesce(lag(event = 'started') OVER (PARTITION BY job_id ORDER BY seq, event), false) AS runs FROM e)
SELECT job_id::VARCHAR AS job_id FROM b GROUP BY 1 HAVING arg_max(event, seq) FILTER (CASE WHEN s THEN NOT runs ELSE runs END) = 'failed' AND job_id::INT % 2 = 0
""")
def failed_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs of one version that failed, the last requested first."""
    log = load(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.lit("v").alias("version"), F.lit("t").alias("target"), F.col("event_id").alias("seq"), F.expr(_EVENT).alias("event"),
        F.current_timestamp().alias("at"), F.lit(None).cast("string").alias("detail"))
    states = jobs.folded(log).withColumn("version", F.when(F.col("job_id").cast("int") % 2 == 0, "v1").otherwise("v2")).withColumn("requested_at", F.col("job_id"))
    return jobs.listed(states, "v1", "failed").select("job_id")


@query("""
WITH e AS (SELECT user_id AS key, event_id AS seq, event_type AS f, ts AS t FROM events),
c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR f IS DISTINCT FROM lag(f) OVER w THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY key ORDER BY t, seq)),
r AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY t, seq) AS run FROM c),
n AS (SELECT *, row_number() OVER w AS n, first_value(t) OVER w AS since FROM r WINDOW w AS (PARTITION BY key, run ORDER BY t, seq)),
g AS (SELECT * FROM n WHERE n >= 2 AND epoch_us(t) // 1000 - epoch_us(since) // 1000 >= 3600000 QUALIFY row_number() OVER (PARTITION BY key, run ORDER BY n) = 1)
SELECT key::VARCHAR AS key, f AS fingerprint, n, epoch_us(since) // 1000 AS since, epoch_us(t) // 1000 AS "at" FROM g
""")
def stable_states(spark: SparkSession, sf: str) -> DataFrame:
    """When a user has done one thing at least twice running and for an hour."""
    seen = load(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("fingerprint"), F.col("ts").alias("at"))
    return stability.stable_runs_of_batch(seen, 2, 3_600_000).select("key", "fingerprint", "n", F.unix_millis(F.col("since").cast("timestamp")).alias("since"), F.unix_millis(F.col("at").cast("timestamp")).alias("at"))


@query("""
WITH x AS (SELECT o_custkey % 100 AS screen, ['Header', 'main_content', 'session', NULL, 'volatile', 'footer'][(o_orderkey % 6 + 1)::INT] AS region, o_orderkey % 2 = 0 AS is_link FROM orders)
SELECT 'screens' AS what, count(DISTINCT screen) AS n FROM x UNION ALL SELECT 'buttons', count(*) FROM x WHERE NOT is_link AND lower(region) IN ('header', 'session', 'volatile')
UNION ALL SELECT 'links', count(*) FROM x WHERE is_link AND lower(region) IN ('header', 'session', 'volatile')
""")
def build_omissions(spark: SparkSession, sf: str) -> DataFrame:
    """How many elements of sensitive regions a build leaves out, counted as it writes."""
    regions = F.array(*map(F.lit, ("Header", "main_content", "session", None, "volatile", "footer")))
    item = F.struct(F.col("o_orderpriority").alias("text"), F.element_at(regions, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("region"))
    link = F.col("o_orderkey") % 2 == 0
    screens = load(spark, sf, "orders").groupBy((F.col("o_custkey") % 100).alias("screen")).agg(F.collect_list(F.when(~link, item)).alias("buttons"), F.collect_list(F.when(link, item)).alias("links"))
    _, said = canonical.written_without_sensitive(screens)
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("what"), F.lit(said[v]).cast("long").alias("n")) for k, v in (("screens", "n"), ("buttons", "buttons"), ("links", "links"))))))


_RESULTS = """r AS (SELECT event_id, event_type AS category, CASE WHEN event_type = 'error' THEN CASE WHEN value < 30 THEN 'state_restore_failed' ELSE 'timeout' END END AS error,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE value > 20 END AS went, value > 50 AS changed, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'replay' ELSE 'reload' END AS strategy FROM events)"""


@query(f"""
WITH {_RESULTS}, o AS (SELECT *, CASE WHEN error = 'state_restore_failed' THEN 'restore_failed' WHEN error IS NOT NULL AND NOT coalesce(went, false) THEN 'interaction_failed' WHEN error IS NOT NULL THEN 'execution_error'
  WHEN coalesce(changed, false) THEN 'changed' ELSE 'unchanged' END AS outcome FROM r),
x AS (
  SELECT 'outcomes' AS dimension, outcome AS value FROM o UNION ALL SELECT 'categories', category FROM o UNION ALL SELECT 'changed_categories', category FROM o WHERE changed UNION ALL SELECT 'restore_strategies', coalesce(strategy, 'none') FROM o
  UNION ALL SELECT 'errors', error FROM o WHERE error IS NOT NULL
  UNION ALL SELECT 'interactions', CASE WHEN went THEN 'succeeded' WHEN NOT went THEN 'not_succeeded' WHEN outcome IN ('changed', 'unchanged') THEN 'inferred_succeeded' ELSE 'unknown' END FROM o
)
SELECT dimension, value, count(*) AS n FROM x GROUP BY ALL
""")
def result_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What came of all events, in six histograms."""
    events = load(spark, sf, "events")
    results = events.selectExpr(
        "cast(null as string) AS outcome", "CASE WHEN event_type = 'error' THEN CASE WHEN value < 30 THEN 'state_restore_failed' ELSE 'timeout' END END AS error", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value > 20 END AS interaction_succeeded",
        "value > 50 AS changed", "event_type AS category", "CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'replay' ELSE 'reload' END AS restore_strategy")
    return audits.result_audit(results)


@query("""
WITH x AS (
  SELECT 'depths' AS dimension, (o_orderkey % 4)::VARCHAR AS value FROM orders UNION ALL SELECT 'states', CASE WHEN o_orderkey % 4 = 0 THEN 'root' ELSE 'dynamic' END FROM orders
  UNION ALL SELECT 'categories', coalesce(l_shipmode, 'unknown') FROM (SELECT CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END AS l_shipmode FROM lineitem)
  UNION ALL SELECT 'restoration', CASE WHEN l_linenumber = 3 THEN 'not_recorded' ELSE l_linestatus END FROM lineitem UNION ALL SELECT 'routes', CASE WHEN l_linenumber = 1 THEN 'changed' ELSE 'same' END FROM lineitem
)
SELECT dimension, value, count(*) AS n FROM x GROUP BY ALL
""")
def flow_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as states and their lines as transitions, in five histograms."""
    n = F.col("l_linenumber")
    moves = load(spark, sf, "lineitem").select(F.when(n != 2, F.col("l_returnflag")).alias("event_type"), F.when(n != 3, F.col("l_linestatus")).alias("restore_strategy"), (n == 1).alias("changed_route"))
    return audits.flow_audit(load(spark, sf, "orders").select((F.col("o_orderkey") % 4).alias("depth")), moves)


_PATHS = " UNION ALL ".join(
    f"SELECT '{kind}.{column}' AS path, canonical_id AS subject, '{to}' AS kind, {column} AS target FROM ent WHERE entity_type = '{kind}'" + (f" AND coalesce({column}, '') <> ''" if (kind, column) in integrity.OPTIONAL else "")
    for kind, column, to in integrity.PATHS)


@query(f"""
WITH {ENTITIES}, r AS ({_PATHS} UNION ALL SELECT entity_type || '.evidence_ids', canonical_id, 'evidence', unnest(['evidence:' || (seq % 13), 'evidence:' || (seq % 5000)]) FROM ent WHERE seq % 3 = 0)
SELECT path, subject, target FROM r WHERE NOT EXISTS (SELECT 1 FROM ent WHERE entity_type = r.kind AND canonical_id = r.target)
""")
def dangling_references(spark: SparkSession, sf: str) -> DataFrame:
    """References of all fourteen paths to what is not there."""
    own = F.expr("CASE WHEN seq % 3 = 0 THEN array(concat('evidence:', seq % 13), concat('evidence:', seq % 5000)) END")
    return integrity.dangling(written_once(entities(spark, sf).withColumn("evidence_ids", own), "entities"))


@query("""
WITH v AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1)
SELECT 'erp:1:v2:' || t AS job_id, 'v2' AS version, t AS target, 'pending' AS status FROM (VALUES ('neo4j'), ('chroma')) AS x(t) WHERE (SELECT count(*) FROM v) > 0
""")
def import_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The jobs that the import of a second version makes; one that is there already makes none."""
    there = load(spark, sf, "orders").select(F.lit("erp:1").alias("erp_id"), F.concat(F.lit("v"), F.substring("o_orderpriority", 1, 1)).alias("version")).where("version <> 'v2'").distinct()
    again = versions.pending_jobs(there, "erp:1", "v1")
    return versions.pending_jobs(there, "erp:1", "v2").union(again).select("job_id", "version", "target", "status")


@query("SELECT 'dry_run' AS result, 'v2' AS version, (SELECT count(*) + 1 FROM part) AS items, (SELECT count(*) FROM supplier WHERE s_suppkey % 4 = 0) AS warnings")
def import_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    return versions.dry_run(load(spark, sf, "part"), load(spark, sf, "supplier").where("s_suppkey % 4 = 0"), "v2")
