"""Graph queries over trade between nations, and over small fixed graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import references as R
from ..operators.components import connected_components
from ..session import table
from .base import query
from .metrics import _references

TRADE = """WITH RECURSIVE r AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rn FROM r), e AS (SELECT src, dst FROM k WHERE rn <= {top}) """


def _trade(spark, sf_dir, top):
    counts = _references(spark, sf_dir).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    w = Window.partitionBy("src").orderBy(F.desc("n"), "dst")
    return counts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).select("src", "dst")


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))


@query(TRADE.format(top=2) + """SELECT CAST(n_nationkey AS VARCHAR) AS module, coalesce((SELECT string_agg(CAST(dst AS VARCHAR), ',' ORDER BY CAST(dst AS VARCHAR)) FROM e WHERE src = n_nationkey), '') AS dependencies,
coalesce((SELECT string_agg(CAST(src AS VARCHAR), ',' ORDER BY CAST(src AS VARCHAR)) FROM e WHERE dst = n_nationkey), '') AS dependents FROM nation""")
def g08_module_graph(spark, sf_dir):
    text = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    found = G.module_graph(text(_nations(spark, sf_dir)).withColumnRenamed("node", "module"), text(_trade(spark, sf_dir, 2)))
    return found.select("module", F.array_join("dependencies", ",").alias("dependencies"), F.array_join("dependents", ",").alias("dependents"))


SCC = """, t AS (SELECT src, dst FROM e UNION SELECT t.src, e.dst FROM t JOIN e ON t.dst = e.src),
c AS (SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM t a JOIN t b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src) """


@query(TRADE.format(top=1) + SCC + "SELECT node, component FROM c")
def g01_strong_components(spark, sf_dir):
    return G.strong_components(_trade(spark, sf_dir, 1))


@query(TRADE.format(top=1) + SCC + ", s AS (SELECT component, count(*) AS n FROM c GROUP BY 1 HAVING count(*) > 1) SELECT 'HL101' AS rule, CAST(component AS INTEGER) AS module, CAST(n + 1 AS BIGINT) AS length FROM s")
def hl101_dependency_cycles(spark, sf_dir):
    edges = _trade(spark, sf_dir, 1)
    found = G.cycle_witnesses(edges, G.strong_components(edges))
    return found.where(F.size("witness") > 2).select(F.lit("HL101").alias("rule"), F.col("component").alias("module"), F.size("witness").cast("long").alias("length"))


REACH = TRADE.format(top=2) + ", f AS (SELECT 0 AS node UNION SELECT e.dst FROM f JOIN e ON f.node = e.src) "


@query(REACH + "SELECT CAST(node AS INTEGER) AS node FROM f")
def g05_reachable(spark, sf_dir):
    return G.reachable(_nations(spark, sf_dir).where("node = 0"), _trade(spark, sf_dir, 2))


@query(REACH + "SELECT n_nationkey AS node FROM nation WHERE n_nationkey NOT IN (SELECT node FROM f)")
def j12_unreached(spark, sf_dir):
    nations = _nations(spark, sf_dir)
    return G.dead(nations, nations.where("node = 0"), _trade(spark, sf_dir, 2))


#: All customers in a ring, each to the one before: as deep as there are customers.
def _ring(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"))
    ends = keys.agg(F.min("src").alias("low"), F.max("src").alias("high")).first()
    return keys.withColumn("dst", F.when(F.col("src") == ends["low"], F.lit(ends["high"])).otherwise(F.col("src") - 1).cast("long")).withColumn("src", F.col("src").cast("long"))


@query("SELECT CAST(c_custkey AS BIGINT) AS node, CAST((SELECT min(c_custkey) FROM customer) AS BIGINT) AS component FROM customer")
def g01_long_ring(spark, sf_dir):
    return G.strong_components(_ring(spark, sf_dir))


@query("SELECT CAST(min(c_custkey) AS BIGINT) AS component, CAST(count(*) + 1 AS BIGINT) AS length, CAST(max(c_custkey) AS BIGINT) AS second FROM customer")
def g02_long_ring(spark, sf_dir):
    edges = _ring(spark, sf_dir)
    rows = G.cycle_rows(edges, G.strong_components(edges)).groupBy("component").agg((F.count("*") + 1).alias("length"), F.max(F.when(F.col("at") == 1, F.col("node"))).alias("second"))
    return rows.select("component", "length", F.coalesce("second", "component").alias("second"))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS node, CAST(row_number() OVER w - 1 AS BIGINT) AS depth, CAST(coalesce(lag(o_orderkey) OVER w, -1) AS BIGINT) AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def g03_order_chains(spark, sf_dir):
    """Every order calls the customer's order before it."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("src"), before.cast("long").alias("dst"))
    return G.generations(orders.select(F.col("src").alias("node")), orders.where("dst is not null")).select("node", "depth", F.coalesce("next", F.lit(-1)).alias("next"))


@query("SELECT CAST(c_custkey AS BIGINT) AS node FROM customer WHERE c_custkey <= (SELECT max(c_custkey) FROM customer WHERE c_nationkey = 3)")
def g05_long_chain(spark, sf_dir):
    """What the customers of one nation reach in the ring, cut before its last edge."""
    ring = _ring(spark, sf_dir).where("dst < src")
    return G.reachable(table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").cast("long").alias("node")), ring)


@query(TRADE.format(top=2) + ", d AS (SELECT src, dst FROM e WHERE src < dst), p AS (SELECT n_nationkey AS node, 0 AS depth FROM nation UNION SELECT d.src, p.depth + 1 FROM d JOIN p ON d.dst = p.node) SELECT node, CAST(max(depth) AS BIGINT) AS depth FROM p GROUP BY 1")
def g03_generations(spark, sf_dir):
    return G.generations(_nations(spark, sf_dir), _trade(spark, sf_dir, 2).where("src < dst")).select("node", "depth")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id AS a, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'error' AND json_extract(props, '$.k') IS NOT NULL AND user_id IS NOT NULL),
p AS (SELECT DISTINCT x.k AS src, y.k AS dst FROM e x JOIN e y ON x.a = y.a),
t AS (SELECT src, dst FROM p UNION SELECT t.src, p.dst FROM t JOIN p ON t.dst = p.src),
m AS (SELECT k, min(a) AS a, count(*) AS n FROM e GROUP BY k), c AS (SELECT t.src AS k, min(m.a) AS component, sum(m.n) AS n FROM t JOIN m ON t.dst = m.k GROUP BY t.src)
SELECT e.a AS node, min(c.component) AS component FROM e JOIN c ON e.k = c.k GROUP BY e.a HAVING max(c.n) > (SELECT count(*) FROM e f WHERE f.a = e.a)""")
def g06_components(spark, sf_dir):
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("u"), F.get_json_object("props", "$.k").cast("long").alias("k")).distinct()
    first = errors.groupBy("k").agg(F.min("u").alias("dst"))
    return connected_components(errors.join(first, "k").select(F.col("u").alias("src"), "dst"))


#: Orders as exports of their customer: urgent and high ones come together behind their priorities, the others at their own.
COHORTS = """WITH o AS (SELECT 'c' || o_custkey AS module, 'o' || o_orderkey AS export, o_orderstatus AS consumer, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'fast' ELSE o_orderpriority[1] END AS kind FROM orders),
g AS (SELECT module, kind, min(export) AS cohort, count(*) AS size, list_distinct(list(consumer)) AS used FROM o GROUP BY 1, 2) """
COHESION = COHORTS + """, p AS (SELECT a.module, avg(CAST(len(list_intersect(a.used, b.used)) AS DOUBLE) / len(list_distinct(list_concat(a.used, b.used)))) AS overlap, sum(a.size * b.size) AS apart
 FROM g a JOIN g b ON a.module = b.module AND a.cohort < b.cohort GROUP BY 1), w AS (SELECT module, sum(size) AS n, count(*) AS cohorts, min(size) AS smallest FROM g GROUP BY 1),
c AS (SELECT w.module, CAST(n AS BIGINT) AS exports, cohorts, smallest, round(CAST(coalesce(2 * apart / CAST(nullif(n * (n - 1), 0) AS DOUBLE), 0) AS DOUBLE), 9) AS separated_ratio,
 round(CAST(CASE WHEN cohorts = 1 THEN 1 ELSE overlap END AS DOUBLE), 9) AS consumer_overlap FROM w LEFT JOIN p USING (module)) """


def _order_groups(spark, sf_dir):
    """The cohorts, and who uses each export: the order's status."""
    orders = table(spark, sf_dir, "orders")
    module, export = F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey")
    first = F.substring("o_orderpriority", 1, 1)
    reached = orders.select(export.alias("src"), F.concat_ws(":", module, first).alias("dst"))
    both = orders.where(first.isin("1", "2")).select(F.concat_ws(":", module, first).alias("src"), F.concat_ws(":", module, F.lit("fast")).alias("dst")).distinct()
    groups = G.separate_groups(orders.select(module.alias("module"), export.alias("export")), reached.unionByName(both))
    return groups, orders.select(module.alias("module"), export.alias("export"), F.col("o_orderstatus").alias("consumer"))


@query(COHORTS + "SELECT o.module, o.export, g.cohort FROM o JOIN g ON o.module = g.module AND o.kind = g.kind")
def g07_separate_groups(spark, sf_dir):
    return _order_groups(spark, sf_dir)[0]


@query(COHESION + "SELECT * FROM c")
def a15_cohesion(spark, sf_dir):
    found = G.cohesion(*_order_groups(spark, sf_dir))
    return found.withColumn("separated_ratio", F.round("separated_ratio", 9)).withColumn("consumer_overlap", F.round(F.col("consumer_overlap").cast("double"), 9))


@query(COHESION + "SELECT 'HL115' AS rule, module FROM c WHERE cohorts >= 2 AND smallest >= 2 AND exports >= 4 AND separated_ratio >= 0.5 AND consumer_overlap <= 0.2")
def hl115_low_cohesion(spark, sf_dir):
    found = a15_cohesion(spark, sf_dir).where("cohorts >= 2 and smallest >= 2 and exports >= 4 and separated_ratio >= 0.5 and consumer_overlap <= 0.2")
    return found.select(F.lit("HL115").alias("rule"), "module")


#: A scope per region, per nation with an overdrawn supplier, and per overdrawn customer.
SCOPES = """WITH n AS (SELECT n_nationkey, 'r' || n_regionkey AS region, 'r' || n_regionkey || '/n' || n_nationkey AS scope, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) AS open FROM nation),
c AS (SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal < 0 AS open, n.region, n.scope, n.open AS near FROM customer JOIN n ON c_nationkey = n_nationkey) """


def _scopes(spark, sf_dir):
    """Nations with their scopes, customers with theirs, and all scopes there are."""
    overdrawn = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(True).alias("open")).distinct()
    region = F.concat(F.lit("r"), "n_regionkey")
    nations = table(spark, sf_dir, "nation").join(overdrawn, "n_nationkey", "left").select("n_nationkey", region.alias("region"), F.concat(region, F.lit("/n"), "n_nationkey").alias("scope"), "open")
    customers = table(spark, sf_dir, "customer").join(nations.select(F.col("n_nationkey").alias("c_nationkey"), "region", "scope"), "c_nationkey")
    own = F.concat("scope", F.lit("/c"), "c_custkey")
    scopes = nations.select(F.col("region").alias("scope")).distinct().unionByName(nations.where("open").select("scope")).unionByName(customers.where("c_acctbal < 0").select(own.alias("scope")))
    return nations, customers, scopes


@query(SCOPES + """, h AS (SELECT id, CASE segment WHEN 'BUILDING' THEN '' WHEN 'MACHINERY' THEN scope WHEN 'HOUSEHOLD' THEN region WHEN 'FURNITURE' THEN CASE WHEN open THEN scope || '/c' || id END ELSE CASE WHEN near THEN region ELSE 'std' END END AS target,
 CASE segment WHEN 'BUILDING' THEN 'crate' WHEN 'MACHINERY' THEN 'self' WHEN 'HOUSEHOLD' THEN 'super' WHEN 'FURNITURE' THEN 'child' ELSE CASE WHEN near THEN 'alias' ELSE 'library' END END AS how FROM c) SELECT * FROM h WHERE target IS NOT NULL""")
def j10_path_resolution(spark, sf_dir):
    """A path per customer from its nation's scope, beginning as its segment says."""
    nations, customers, scopes = _scopes(spark, sf_dir)
    begins = {"BUILDING": F.lit("crate"), "MACHINERY": F.lit("self"), "HOUSEHOLD": F.lit("super"), "FURNITURE": F.concat(F.lit("c"), "c_custkey")}
    head = F.concat(F.lit("lib"), "c_nationkey")
    for segment, begin in begins.items():
        head = F.when(F.col("c_mktsegment") == segment, begin).otherwise(head)
    name = F.concat(F.lit("lib"), "n_nationkey").alias("name")
    aliases, libraries = nations.where("open").select("scope", name, F.col("region").alias("target")), nations.select(name, F.lit("std").alias("target"))
    return R.resolve_paths(customers.select(F.col("c_custkey").alias("id"), "scope", head.alias("head")), scopes, aliases, libraries)


@query(SCOPES + "SELECT id, region AS scope, 1 AS depth FROM c UNION ALL SELECT id, scope, 2 FROM c WHERE near UNION ALL SELECT id, scope || '/c' || id, 3 FROM c WHERE open")
def j11_path_hops(spark, sf_dir):
    """A path of four segments per customer."""
    _, customers, scopes = _scopes(spark, sf_dir)
    segments = F.concat(F.split("scope", "/"), F.array(F.concat(F.lit("c"), "c_custkey"), F.lit("all")))
    return R.path_hops(customers.select(F.col("c_custkey").alias("id"), segments.alias("segments")), scopes)
