"""Latest rows, logs, quotas, pages, audits and checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import hashing
from tessella.operators import audits, ranking, relations
from tessella.plans.registry import query
from tessella.session import load


@query("""
SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O'
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""")
def latest_active_version(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").where("o_orderstatus = 'O'")
    newest = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return orders.groupBy("o_custkey").agg(newest.alias("o_orderkey"))


@query("""
SELECT e.user_id, max_by(e.event_id, e.event_id) AS event_id, max_by(e.event_type, e.event_id) AS event_type FROM events e GROUP BY e.user_id
""")
def latest_action(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.latest(load(spark, sf, "events"), ["user_id"], [F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""
WITH c AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase' AND value IS NOT NULL)
SELECT u.user_id, (SELECT c.event_id FROM c WHERE c.user_id = u.user_id
   AND NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = c.user_id AND r.event_type = 'error' AND (r.ts, r.event_id) > (c.ts, c.event_id))
   ORDER BY c.ts DESC, c.event_id DESC LIMIT 1) AS correction
FROM (SELECT DISTINCT user_id FROM events) u
""")
def log_fold_effective(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases set a value, errors clear it, other events keep it."""
    log = load(spark, sf, "events")
    payload = F.when((F.col("event_type") == "purchase") & F.col("value").isNotNull(), F.col("event_id"))
    told = relations.set_or_reset(log, "user_id", F.struct("ts", "event_id"), payload, F.col("event_type") == "error")
    return log.select("user_id").distinct().join(told, "user_id", "left").select("user_id", F.col("payload").alias("correction"))


@query("""
WITH m AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN count(DISTINCT event_type) > 1 THEN 'MIXED' ELSE min(event_type) END AS state FROM events JOIN m USING (user_id, ts) GROUP BY user_id
""")
def latest_with_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.latest_or_mixed(load(spark, sf, "events"), "user_id", "ts", F.col("event_type"))


@query("""
WITH n AS (SELECT o_orderkey AS id, sha256(concat_ws('|', o_custkey, o_orderpriority)) AS h FROM orders),
o AS (SELECT o_orderkey AS id, sha256(concat_ws('|', o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderpriority END)) AS h,
  CASE o_orderstatus WHEN 'O' THEN 'approved' WHEN 'F' THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'fixed' END AS correction FROM orders WHERE o_orderkey % 2 = 0),
j AS (SELECT n.id, o.*, coalesce(n.h = o.h AND (o.status <> 'pending' OR o.correction IS NOT NULL), false) AS c FROM n LEFT JOIN o ON n.id = o.id)
SELECT id, CASE WHEN c THEN status ELSE 'pending' END AS status, CASE WHEN c THEN correction END AS correction,
  CASE WHEN c THEN CASE WHEN correction IS NOT NULL THEN 'correct' WHEN status = 'approved' THEN 'approve' ELSE 'reject' END END AS action, CASE WHEN c THEN 1 ELSE 0 END AS revision FROM j
""")
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of the orders: every second one has a predecessor, every third predecessor differs."""
    orders = load(spark, sf, "orders").withColumn("id", F.col("o_orderkey"))
    digest = lambda p: F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), p), 256)
    new = orders.select("id", digest(F.col("o_orderpriority")).alias("content_hash"))
    status = F.when(F.col("o_orderstatus") == "O", "approved").when(F.col("o_orderstatus") == "F", "rejected").otherwise("pending")
    old = orders.where("id % 2 = 0").select("id", digest(F.when(F.col("id") % 3 == 0, "changed").otherwise(F.col("o_orderpriority"))).alias("content_hash"), status.alias("status"), F.when(F.col("id") % 5 == 0, "fixed").alias("correction"))
    return relations.carried_forward(new, old, ["id"]).drop("content_hash")


@query("""
SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS turn FROM orders ORDER BY turn, o_orderdate, o_orderkey LIMIT 50 OFFSET 20
""")
def pending_first_page(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = load(spark, sf, "orders").withColumn("turn", turn)
    return ranking.page(rows, [F.col("turn"), F.col("o_orderdate"), F.col("o_orderkey")], 20, 50).select("o_orderkey", "o_orderstatus", "turn")


@query("""
SELECT p_partkey, p_name, count(*) OVER () AS total FROM part WHERE lower(p_name) LIKE '%1%' OR lower(p_brand) LIKE '%1%' OR lower(p_type) LIKE '%1%' ORDER BY p_name, p_partkey LIMIT 200
""")
def effective_search_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of what a pattern matches in any of three columns, with the whole count."""
    like = lambda c: F.lower(c).like("%1%")
    found = load(spark, sf, "part").where(like("p_name") | like("p_brand") | like("p_type"))
    return ranking.page(found, [F.col("p_name"), F.col("p_partkey")], 0, 200).select("p_partkey", "p_name").crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))  # one row


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def group_counts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""
SELECT count(*) FILTER (l_returnflag = 'A') AS approved, count(*) FILTER (l_returnflag = 'R') AS rejected, count(*) FILTER (l_returnflag = 'N') AS pending,
  count(*) FILTER (l_linestatus = 'O') + count(*) FILTER (l_returnflag = 'X') AS unavailable, coalesce(sum(l_linenumber) FILTER (l_returnflag = 'X'), 0)::BIGINT AS warnings FROM lineitem
""")
def conditional_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters by state, 0 where a state is missing; unavailable also counts the mixed ones."""
    state = lambda v: F.count_if(F.col("l_returnflag") == v)
    return load(spark, sf, "lineitem").agg(
        state("A").alias("approved"), state("R").alias("rejected"), state("N").alias("pending"),
        (F.count_if(F.col("l_linestatus") == "O") + state("X")).alias("unavailable"), F.coalesce(F.sum(F.when(F.col("l_returnflag") == "X", F.col("l_linenumber"))), F.lit(0)).cast("long").alias("warnings"),
    )


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def preagg_left_join(spark: SparkSession, sf: str) -> DataFrame:
    counts = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("orders"))
    return load(spark, sf, "customer").select("c_custkey").join(counts, "c_custkey", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))


@query("""
SELECT user_id, event_type, count(*) AS n FROM events GROUP BY GROUPING SETS ((user_id, event_type), (event_type))
""")
def audit_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Counts for each screen and over all, as in audits of policy: a null user is the whole."""
    events = load(spark, sf, "events")
    each = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    # the whole is summed from the parts
    return each.unionByName(each.groupBy("event_type").agg(F.sum("n").alias("n")).withColumn("user_id", F.lit(None).cast("long")))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, min(p_partkey) LIMIT 5")
def top_n_common(spark: SparkSession, sf: str) -> DataFrame:
    """The five most frequent brands, among equals the one seen first."""
    return audits.most_common(load(spark, sf, "part"), "p_brand", "p_partkey").select("p_brand", "n")


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return relations.duplicates(load(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_refs(spark: SparkSession, sf: str) -> DataFrame:
    return relations.dangling(load(spark, sf, "documents").select("doc_id"), "doc_id", load(spark, sf, "labels"), "doc_id")


@query("""
WITH r AS (SELECT 'orders.o_custkey' AS path, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer)) AS missing, count(*) AS rows FROM orders
UNION ALL SELECT 'lineitem.l_orderkey', count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders)), count(*) FROM lineitem
UNION ALL SELECT 'lineitem.l_partkey', count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part)), count(*) FROM lineitem
UNION ALL SELECT 'labels.doc_id', count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM documents)), count(*) FROM labels) SELECT * FROM r
""")
def referential_report(spark: SparkSession, sf: str) -> DataFrame:
    """Missing parents for each foreign key."""
    out = None
    for child, key, parent, parent_key in (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("labels", "doc_id", "documents", "doc_id")):
        rows = load(spark, sf, child).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
        known = load(spark, sf, parent).select(F.col(parent_key).alias("k"), F.lit(True).alias("there")).distinct()
        one = rows.join(known, "k", "left").agg(F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.sum("n").alias("rows")).select(F.lit(f"{child}.{key}").alias("path"), "missing", "rows")
        out = one if out is None else out.unionByName(one)
    return out


_QUOTA = """
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS i FROM events),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY i) AS c FROM e),
g AS (SELECT *, count(*) FILTER (c <= 2) OVER (PARTITION BY user_id ORDER BY i) AS g FROM c),
s AS (SELECT *, c <= 2 AND g <= 5 AS selected FROM g),
t AS (SELECT *, count(*) FILTER (selected) OVER (PARTITION BY user_id, event_type) AS taken FROM s)
SELECT event_id, selected, CASE WHEN NOT selected THEN CASE WHEN least(c - 1, taken) >= 2 THEN 'category_quota' ELSE 'total_quota' END END AS excluded_by FROM t
"""


@query(_QUOTA)
def quota_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Five events a user, two of a type, by value."""
    order = [F.col("value").desc_nulls_last(), F.col("event_id")]
    return ranking.quota_selection(load(spark, sf, "events"), "user_id", "event_type", order, 2, 5).select("event_id", "selected", "excluded_by")


@query("""
WITH d AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'deny' WHEN 'signup' THEN 'review' ELSE 'allow' END AS decision FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, decision ORDER BY event_id) AS r,
  least(count(*) FILTER (decision = 'deny') OVER (PARTITION BY user_id), 10) AS nd, least(count(*) FILTER (decision = 'review') OVER (PARTITION BY user_id), 10) AS nr FROM d)
SELECT event_id, decision FROM r WHERE r <= CASE WHEN decision IN ('deny', 'review') THEN 10 ELSE greatest(0, 20 - nd - nr) END
""")
def reserved_quota(spark: SparkSession, sf: str) -> DataFrame:
    decision = F.when(F.col("event_type") == "error", "deny").when(F.col("event_type") == "signup", "review").otherwise("allow")
    rows = load(spark, sf, "events").select("event_id", "user_id", decision.alias("decision"))
    return ranking.reserved_quota(rows, "user_id", "decision", [F.col("event_id")], 20).select("event_id", "decision")


@query("""
WITH c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, event_type, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM c)
SELECT user_id, run, event_type, count(*) AS n FROM r GROUP BY ALL
""")
def run_length_stability(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.runs(load(spark, sf, "events"), "user_id", [F.col("ts"), F.col("event_id")], "event_type")


@query("""
SELECT p_partkey, p_brand, row_number() OVER w AS place, lag(p_partkey) OVER w AS previous, lead(p_partkey) OVER w AS next FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_name, p_partkey)
""")
def neighbour_nav(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.neighbours(load(spark, sf, "part"), "p_brand", [F.col("p_name"), F.col("p_partkey")], "p_partkey")


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY lower(n_name)) - 1 AS position FROM nation")
def module_order(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.order_index(load(spark, sf, "nation").select("n_nationkey", "n_name"), [F.lower("n_name")])


@query("""
SELECT l_orderkey, string_agg(k, ',' ORDER BY k) FILTER (i <= 3) AS kept, count(*) > 3 AS overflow
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k) AS i FROM (SELECT DISTINCT l_orderkey, l_partkey::VARCHAR AS k FROM lineitem)) GROUP BY l_orderkey
""")
def bounded_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three parts of each order, sorted as text, and whether there were more."""
    parts = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(relations.bounded(F.collect_set(F.col("l_partkey").cast("string")), 3).alias("b"))
    return parts.select("l_orderkey", F.array_join("b.kept", ",").alias("kept"), F.col("b.overflow").alias("overflow"))


@query("""
SELECT vec_id FROM embeddings WHERE label = 3 AND vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3 AND vec_id % 2 = 0)
""")
def stale_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Of a scope's stored ids, those that the new set lacks."""
    scope = load(spark, sf, "embeddings").where("label = 3").select("vec_id")
    return relations.stale(scope, scope.where("vec_id % 2 = 0"), "vec_id")


@query("""
WITH i AS (SELECT unnest([44, 7, 12, 999999999, 7, 3]) AS doc_id, unnest([0, 1, 2, 3, 4, 5]) AS pos)
SELECT min(pos)::INT AS pos, doc_id, lang FROM i JOIN documents USING (doc_id) GROUP BY doc_id, lang
""")
def ordered_union_semijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Requested ids, first request first, that exist."""
    wanted = relations.ordered_union(F.array(*map(F.lit, (44, 7, 12))), F.array(*map(F.lit, (999999999, 7, 3))))
    ids = spark.range(1).select(F.posexplode(wanted).alias("place", "doc_id"))
    asked = F.array(*map(F.lit, (44, 7, 12, 999999999, 7, 3)))
    found = relations.in_given_order(ids, load(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return found.select((F.array_position(asked, F.col("doc_id")) - 1).cast("int").alias("pos"), F.col("doc_id").cast("int"), "lang")


@query("""
SELECT 'nation:' || substr(sha256('["nation",' || n_nationkey || ']'), 1, 24) AS id, sha256('nation' || chr(0) || n_name) AS key FROM nation
""")
def stable_hash_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids from JSON arrays and keys from NUL-joined parts. A number is written as a number."""
    raw = F.concat(F.lit('["nation",'), F.col("n_nationkey").cast("string"), F.lit("]"))
    return load(spark, sf, "nation").select(F.concat(F.lit("nation:"), F.substring(F.sha2(raw, 256), 1, 24)).alias("id"), hashing.joined_hash(F.lit("nation"), F.col("n_name")).alias("key"))


@query("""
SELECT doc_id, 'document:' || substr(sha256('["' || source || '","' || lang || '"]'), 1, 24) AS id,
  sha256('{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS content_hash FROM documents
""")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    return docs.select("doc_id", hashing.stable_id("document", F.col("source"), F.col("lang")).alias("id"), hashing.content_hash(lang=F.col("lang"), source=F.col("source"), n_chars=F.col("n_chars")).alias("content_hash"))


@query("""
SELECT n_regionkey, sha256('["' || string_agg(n_name, '","' ORDER BY n_name) || '"]') AS digest FROM nation GROUP BY n_regionkey
""")
def projection_digest(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "nation").groupBy("n_regionkey").agg(hashing.set_hash(F.col("n_name")).alias("digest"))


@query("""
WITH f AS (SELECT count(*) AS raw, count(DISTINCT (user_id, event_type)) AS deduplicated, count(DISTINCT (user_id, event_type)) FILTER (value > 50) AS eligible,
  count(DISTINCT (user_id, event_type)) FILTER (value > 50 AND event_type <> 'error') AS allowed FROM events) SELECT * FROM f
""")
def pipeline_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """How many candidates each stage leaves."""
    keys = load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("v"))
    eligible = F.col("v") > 50
    return keys.agg(F.sum("n").alias("raw"), F.count("*").alias("deduplicated"), F.count_if(eligible).alias("eligible"), F.count_if(eligible & (F.col("event_type") != "error")).alias("allowed"))


@query("""
WITH o AS (SELECT event_id, CASE WHEN event_type = 'error' AND value < 10 THEN 'interaction_failed' WHEN event_type = 'error' THEN 'execution_error' WHEN value > 50 THEN 'changed' ELSE 'unchanged' END AS outcome FROM events)
SELECT outcome, count(*) AS n FROM o GROUP BY outcome
""")
def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:

    said = audits.outcome(F.lit(None).cast("string"), F.when(F.col("event_type") == "error", "e"), F.col("value") >= 10, F.col("value") > 50)
    return load(spark, sf, "events").groupBy(said.alias("outcome")).agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT user_id, 'event_type' AS dimension, event_type AS value FROM events UNION ALL SELECT user_id, 'large', CASE WHEN events.value > 50 THEN 'true' ELSE 'false' END FROM events)
SELECT user_id AS "group", dimension, value, count(*) AS n FROM p GROUP BY GROUPING SETS ((user_id, dimension, value), (dimension, value))
""")
def audit_histograms(spark: SparkSession, sf: str) -> DataFrame:

    rows = load(spark, sf, "events").select("user_id", "event_type", (F.coalesce(F.col("value"), F.lit(0.0)) > 50).alias("large"))
    return audits.histograms(rows, "user_id", "event_type", "large")


@query("""
SELECT c_custkey AS state_id, min_by(o_orderkey, (length(o_orderpriority), o_orderkey)) AS shortest, count(*) AS seen FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey
""")
def shortest_path_per_state(spark: SparkSession, sf: str) -> DataFrame:
    """An order's priority, split in letters, stands for a path."""

    rows = load(spark, sf, "orders").select(F.col("o_custkey").alias("state_id"), F.col("o_orderkey").alias("seq"), F.split("o_orderpriority", "").alias("path"), F.col("o_orderkey").cast("string").alias("title"))
    best = audits.shortest_paths(rows)
    first = rows.select("state_id", F.col("path").alias("path"), "seq").join(best, ["state_id", "path"]).groupBy("state_id").agg(F.min("seq").alias("shortest"), F.first("seen").alias("seen"))
    return first.join(load(spark, sf, "customer").select(F.col("c_custkey").alias("state_id")), "state_id", "left_semi")
