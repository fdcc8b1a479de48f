"""Explorations of graphs made of the given tables, and modules from the paths of such a crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import frontier, modules
from tessella.plans.registry import query
from tessella.session import load

#: Routes: home, nations, their customers, and orders; a customer also links to the customer after it.
_ROUTES = """
SELECT '/' AS source, n_nationkey::BIGINT AS seq, '/n/' || n_nationkey AS target FROM nation
UNION ALL SELECT '/n/' || c_nationkey, (c_custkey * 7919) % 10007, '/c/' || c_custkey FROM customer
UNION ALL SELECT '/c/' || o_custkey, o_orderkey, '/o/' || o_orderkey FROM orders
UNION ALL SELECT '/c/' || c_custkey, 0, '/c/' || (c_custkey + 1) FROM customer
"""


def _routes(spark: SparkSession, sf: str) -> DataFrame:
    say = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    rows = lambda df, source, seq, target: df.select(source.alias("source"), seq.cast("long").alias("seq"), target.alias("target"))
    customer = load(spark, sf, "customer")
    return (
        rows(load(spark, sf, "nation"), F.lit("/"), F.col("n_nationkey"), say("/n/", "n_nationkey"))
        .union(rows(customer, say("/n/", "c_nationkey"), F.col("c_custkey") * 7919 % 10007, say("/c/", "c_custkey")))
        .union(rows(load(spark, sf, "orders"), say("/c/", "o_custkey"), F.col("o_orderkey"), say("/o/", "o_orderkey")))
        .union(rows(customer, say("/c/", "c_custkey"), F.lit(0), F.concat(F.lit("/c/"), (F.col("c_custkey") + 1).cast("string"))))
    )


def _start(spark: SparkSession, route: str) -> DataFrame:
    return spark.range(1).select(F.lit(route).alias("id"), F.lit(0).alias("seq"))


_QUEUE = f"""l AS ({_ROUTES}), r(route, depth, key) AS (
  SELECT '/', 0, []::BIGINT[] UNION ALL SELECT target, depth + 1, list_append(key, seq) FROM r JOIN l ON r.route = l.source WHERE depth < 3
), f AS (
  SELECT route, min({{'depth': depth, 'key': key}}) AS k FROM r GROUP BY route
), q AS (
  SELECT route, k.depth AS depth, row_number() OVER (ORDER BY k.depth, k.key, route) AS n, k.key AS key FROM f
)"""


@query(f"WITH RECURSIVE {_QUEUE} SELECT route, depth FROM q WHERE n <= 300")
def crawl_first_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The first 300 pages of a crawl of depth 3, in the order of its queue."""
    found = frontier.explored(_start(spark, "/"), _routes(spark, sf), most_pages=300, most_depth=3).found
    return found.where("status = 'visited'").select(F.col("id").alias("route"), "depth")


@query(f"WITH RECURSIVE {_QUEUE} SELECT route, depth, (rank() OVER (PARTITION BY depth ORDER BY key))::BIGINT AS turn FROM q")
def crawl_order(spark: SparkSession, sf: str) -> DataFrame:
    """Every page of that crawl with its turn within its depth; pages that the queue's keys do not tell apart share one."""
    from pyspark.sql import Window

    found = frontier.explored(_start(spark, "/"), _routes(spark, sf), most_depth=3).found
    return found.select(F.col("id").alias("route"), "depth", F.rank().over(Window.partitionBy("depth").orderBy("wave", "rank")).cast("long").alias("turn"))


@query("""
WITH RECURSIVE l(kind, source, target, to_kind) AS (
  SELECT 'route', c_custkey, (c_custkey * 7 + unnest([1, 2, 3])) % (SELECT count(*) FROM customer), 'route' FROM customer WHERE c_acctbal > 2000
  UNION ALL SELECT 'route', o_custkey, o_orderkey, 'state' FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT 'state', o_orderkey, o_orderkey // 3, 'state' FROM orders WHERE o_orderpriority <> '5-LOW'
  UNION ALL SELECT 'state', o_orderkey, (o_orderkey * 3 + 1) % (SELECT count(*) FROM customer), 'route' FROM orders
), r(kind, id) AS (
  SELECT 'route', 0::BIGINT UNION SELECT l.to_kind, l.target FROM r JOIN l ON r.kind = l.kind AND r.id = l.source
)
SELECT kind, id::VARCHAR AS id FROM r
""")
def exploration_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as routes and orders as states that feed each other until nothing is new."""
    customer, orders = load(spark, sf, "customer"), load(spark, sf, "orders")
    edge = lambda df, source, seq, target: df.select(F.expr(source).alias("source"), F.expr(seq).alias("seq"), F.expr(target).alias("target"))
    found = frontier.explored(
        _start(spark, "0"), edge(customer.where("c_acctbal > 2000").withColumn("k", F.explode(F.expr("sequence(1, 3)"))), "c_custkey", "k", f"(c_custkey * 7 + k) % {customer.count()}"),
        edge(orders.where("o_orderstatus = 'O'"), "o_custkey", "o_orderkey", "o_orderkey"),
        edge(orders.where("o_orderpriority <> '5-LOW'"), "o_orderkey", "0", "o_orderkey div 3"),
        edge(orders, "o_orderkey", "0", f"(o_orderkey * 3 + 1) % {customer.count()}"),
    ).found
    return found.select("kind", "id")


_MENUS = """
m AS (SELECT n_nationkey AS k, '#menu-' || (n_nationkey // 2) AS origin, CASE n_nationkey % 6 WHEN 0 THEN 'Ventas' WHEN 1 THEN ' ventas ' WHEN 2 THEN 'VENTAS' ELSE n_name END AS label, n_nationkey % 11 <> 7 AS first FROM nation),
c AS (SELECT k, trim(label) AS name, origin FROM m WHERE first),
h AS (SELECT origin, max(k) AS k FROM c GROUP BY 1),
b AS (SELECT DISTINCT '#menu-' || (c_nationkey // 2) AS origin, '/' || CASE WHEN c_custkey % 50 = 3 THEN 'shared/' || (c_custkey % 7) ELSE 'n' || (c_nationkey // 2) || '/c/' || c_custkey END AS route FROM customer WHERE c_custkey % 3 <> 0),
d AS (SELECT k, origin, route FROM b JOIN h USING (origin)),
u AS (SELECT k, origin FROM d GROUP BY ALL HAVING bool_or(route NOT LIKE '/n3/%' AND route NOT LIKE '/shared/%')),
n AS (SELECT k, origin, name, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS normalized_name FROM c JOIN u USING (k, origin)),
x AS (SELECT *, count(*) OVER (PARTITION BY normalized_name) AS same_key, count(*) OVER (PARTITION BY name) AS same_name FROM n),
i AS (SELECT *, 'module:' || substring(sha256('["module","erp:1","' || normalized_name || '"' || CASE WHEN same_name > 1 THEN ',"' || substring(sha256('{"name":"' || name || '","origin":"' || origin || '"}'), 1, 16) || '"'
  WHEN same_key > 1 THEN ',"' || substring(sha256('"' || name || '"'), 1, 12) || '"' ELSE '' END || ']'), 1, 24) AS module_id FROM x),
e AS (SELECT d.route, i.* FROM d JOIN i USING (k, origin))
"""


def _crawled(spark: SparkSession, sf: str) -> modules.Modules:
    """Nations are menus, each two with one selector; customers are links of the states behind them."""
    n = load(spark, sf, "nation").withColumn("origin", F.expr("concat('#menu-', n_nationkey div 2)"))
    state = n.select("n_nationkey", "origin", F.expr("concat('s', n_nationkey)").alias("id"), F.expr("n_nationkey % 11 <> 7").alias("is_first"))
    step = F.array(F.struct(F.col("origin").alias("selector")))
    node = lambda df, seq, key, depth: df.select(seq.alias("seq"), key.alias("id"), F.lit(None).cast("string").alias("route"), F.lit("ui_state").alias("kind"), F.lit("/").alias("base_route"), depth.cast("int").alias("depth"), step.alias("steps"))
    nested = state.withColumn("id", F.concat("id", F.lit("-in")))
    nodes = node(state, F.col("n_nationkey"), F.col("id"), F.when(F.col("is_first"), 1).otherwise(2)).union(node(nested, F.col("n_nationkey") + 1000, F.col("id"), F.lit(2)))
    label = F.expr("CASE n_nationkey % 6 WHEN 0 THEN 'Ventas' WHEN 1 THEN ' ventas ' WHEN 2 THEN 'VENTAS' ELSE n_name END")
    null = F.lit(None).cast("string")
    menus = n.select(F.col("n_nationkey").alias("seq"), F.lit("/").alias("source"), F.expr("concat('s', n_nationkey)").alias("target"), label.alias("label"), F.lit("expand_menu").alias("category"), F.when(F.col("n_nationkey") % 2 == 0, F.col("origin")).alias("selector"))
    target = F.expr("concat('/', CASE WHEN c_custkey % 50 = 3 THEN concat('shared/', c_custkey % 7) ELSE concat('n', c_nationkey div 2, '/c/', c_custkey) END, '/?x=1')")
    links = load(spark, sf, "customer").where("c_custkey % 3 <> 0").select((F.col("c_custkey") + 10000).alias("seq"), F.expr("concat('s', c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN '-in' ELSE '' END)").alias("source"), target.alias("target"), null.alias("label"), null.alias("category"), null.alias("selector"))
    functional = links.select(F.col("target").alias("route")).where("route NOT LIKE '/n3/%' AND route NOT LIKE '/shared/%'")
    return modules.discovered("erp:1", nodes, menus.union(links), functional)


@query(f"""
WITH {_MENUS}, s AS (SELECT k, origin, min(string_split(substring(route, 2), '/')) AS a, max(string_split(substring(route, 2), '/')) AS b, count(*) AS n_routes FROM e GROUP BY 1, 2)
SELECT module_id, name, normalized_name, origin, CASE WHEN a[1] = b[1] THEN '/' || a[1] || CASE WHEN len(a) > 1 AND a[2] = b[2] THEN '/' || a[2] || CASE WHEN len(a) > 2 AND a[3] = b[3] THEN '/' || a[3] ELSE '' END ELSE '' END END AS route_prefix, n_routes FROM i JOIN s USING (k, origin)
""")
def crawled_modules(spark: SparkSession, sf: str) -> DataFrame:
    return _crawled(spark, sf).modules


@query(f"""
WITH {_MENUS}, o AS (SELECT route, min_by(module_id, [normalized_name, name, origin]) AS module_id FROM e GROUP BY 1)
SELECT 'route' AS what, route AS subject, module_id FROM o
UNION ALL SELECT 'ambiguous_module_route', route, e.module_id FROM e JOIN o USING (route) WHERE e.module_id <> o.module_id
UNION ALL SELECT 'module_without_functional_screen', name, NULL FROM c WHERE (k, origin) NOT IN (SELECT (k, origin) FROM u)
""")
def crawled_module_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Which module each route belongs to, and what a build warns of."""
    found = _crawled(spark, sf)
    return found.routes.select(F.lit("route").alias("what"), F.col("route").alias("subject"), "module_id").union(found.warnings)
