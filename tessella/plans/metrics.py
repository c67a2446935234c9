"""Metrics, scores, baselines and rollups over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Coupling
from ..functions.text import nonblank_lines, plural, rounded_percent
from ..operators import history as H
from ..operators import metrics as M
from ..scratch import staged
from ..session import table
from .base import query

SCORES = """SELECT CAST(user_id AS VARCHAR) AS module, CAST(sum(CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 END) AS BIGINT) AS score
FROM events WHERE event_type IN ('error', 'purchase', 'click') GROUP BY 1 HAVING score >= {}"""


def scores(spark, sf_dir, threshold):
    severity = F.when(F.col("event_type") == "purchase", "smell").when(F.col("event_type") == "click", "info").otherwise(F.col("event_type"))
    findings = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("module"), severity.alias("severity"))
    return M.weighted_scores(findings, threshold)


@query(SCORES.format(110))
def a07_score_rollup(spark, sf_dir):
    return scores(spark, sf_dir, 110)


CUST = "WITH s AS (SELECT s_suppkey, s_nationkey AS m FROM supplier), o AS (SELECT o_orderkey, c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey), r AS (SELECT s.m AS src, o.n AS dst, l_partkey AS contract FROM lineitem JOIN s ON l_suppkey = s_suppkey JOIN o ON l_orderkey = o_orderkey) "
METRICS = CUST + """, d AS (SELECT s_nationkey AS module, count(DISTINCT s_name) AS declarations, count(DISTINCT CASE WHEN s_acctbal > 5000 THEN s_name END) AS public_surface FROM supplier GROUP BY 1),
m AS (SELECT n_nationkey AS module,
 CAST(coalesce(declarations, 0) AS BIGINT) AS declarations, CAST(coalesce(public_surface, 0) AS BIGINT) AS public_surface,
 CAST((SELECT count(DISTINCT dst) FROM r WHERE src = n_nationkey AND src <> dst) AS BIGINT) AS dependencies,
 CAST((SELECT count(DISTINCT src) FROM r WHERE dst = n_nationkey AND src <> dst) AS BIGINT) AS dependents,
 CAST((SELECT count(*) FROM r WHERE src = n_nationkey AND src <> dst) AS BIGINT) AS cross_module_references,
 CAST((SELECT count(DISTINCT contract) FROM r WHERE src = n_nationkey AND src <> dst) AS BIGINT) AS referenced_contracts
 FROM nation LEFT JOIN d ON module = n_nationkey) """


def _references(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    owners = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("dst"))
    makers = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    return lines.join(makers, F.col("l_suppkey") == F.col("s_suppkey")).join(owners, F.col("l_orderkey") == F.col("o_orderkey")).select("src", "dst", F.col("l_partkey").alias("contract"))


def _metrics(spark, sf_dir):
    refs = _references(spark, sf_dir)
    modules = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("module"))
    declared = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("module"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 5000).alias("public"))
    return M.module_metrics(modules, declared, refs.select("src", "dst").distinct(), refs)


@query(METRICS + "SELECT *, CASE WHEN declarations = 0 THEN 0.0::DOUBLE ELSE public_surface / declarations END AS public_surface_ratio FROM m")
def a01_module_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


OUT = METRICS + """, z AS (SELECT module, referenced_contracts, cross_module_references, dependencies,
 CASE WHEN stddev_pop(referenced_contracts) OVER () > 0 THEN (referenced_contracts - avg(referenced_contracts) OVER ()) / stddev_pop(referenced_contracts) OVER () END AS zc,
 CASE WHEN stddev_pop(cross_module_references) OVER () > 0 THEN (cross_module_references - avg(cross_module_references) OVER ()) / stddev_pop(cross_module_references) OVER () END AS zr,
 CASE WHEN stddev_pop(dependencies) OVER () > 0 THEN (dependencies - avg(dependencies) OVER ()) / stddev_pop(dependencies) OVER () END AS zd FROM m) """


@query(OUT + """SELECT module, coalesce(zc >= 1 AND referenced_contracts >= 3, false) AS contracts_outlier, coalesce(zr >= 1, false) AS references_outlier,
 coalesce(zd >= 1, false) AS dependencies_outlier, round(zc, 6) AS contracts_z FROM z""")
def a06_coupling_outliers(spark, sf_dir):
    flags = M.outlier_flags(_metrics(spark, sf_dir), ["referenced_contracts", "cross_module_references", "dependencies"], {"referenced_contracts": 3}, 1.0)
    names = {"referenced_contracts_outlier": "contracts_outlier", "cross_module_references_outlier": "references_outlier", "dependencies_outlier": "dependencies_outlier"}
    return flags.select("module", *[F.col(a).alias(b) for a, b in names.items()], F.round("referenced_contracts_z", 6).alias("contracts_z"))


TRADERS = """WITH l AS (SELECT 'c' || o_custkey AS c, 's' || l_suppkey AS s, l_partkey, l_orderkey, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT c AS src, s AS dst, 'p' || l_partkey AS contract FROM l UNION ALL SELECT s, c, 'o' || l_orderkey FROM l WHERE l_returnflag = 'R'),
m AS (SELECT module, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) AS fan_in, coalesce(contracts, 0) AS contracts FROM (SELECT 'c' || c_custkey AS module FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier)
 LEFT JOIN (SELECT src, count(DISTINCT dst) AS fan_out, count(DISTINCT contract) AS contracts FROM r GROUP BY 1) o ON o.src = module LEFT JOIN (SELECT dst, count(DISTINCT src) AS fan_in FROM r GROUP BY 1) i ON i.dst = module),
z AS (SELECT *, fan_out >= 5 AND fan_out - avg(fan_out) OVER () >= 2 * stddev_pop(fan_out) OVER () AND stddev_pop(fan_out) OVER () > 0 AS wide, contracts >= 10 AND contracts - avg(contracts) OVER () >= 2 * stddev_pop(contracts) OVER () AND stddev_pop(contracts) OVER () > 0 AS deep,
 fan_in >= 5 AND fan_in - avg(fan_in) OVER () >= 2 * stddev_pop(fan_in) OVER () AND stddev_pop(fan_in) OVER () > 0 AS known FROM m) """


@query(TRADERS + """SELECT 'HL103' AS rule, module, CAST(contracts AS BIGINT) AS score, 'Outward coupling concentration: fan-out of ' || fan_out || ' and ' || contracts || ' referenced contracts are both repository outliers.' AS message FROM z WHERE wide AND deep
UNION ALL SELECT 'HL103', module, CAST(fan_in AS BIGINT), 'fan-in of ' || fan_in || ' is a repository outlier. Outward coupling is also concentrated in this module.' FROM z WHERE wide AND deep AND known""")
def hl103_coupling(spark, sf_dir):
    """Customers and suppliers as modules: an order line refers to its supplier, a returned one back to its customer."""
    t = lambda name: table(spark, sf_dir, name)
    name = lambda sort, key: F.concat(F.lit(sort), F.col(key).cast("string"))
    lines = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sent = lines.select(name("c", "o_custkey").alias("src"), name("s", "l_suppkey").alias("dst"), name("p", "l_partkey").alias("contract"))
    returned = lines.where("l_returnflag = 'R'").select(name("s", "l_suppkey").alias("src"), name("c", "o_custkey").alias("dst"), name("o", "l_orderkey").alias("contract"))
    references = sent.unionByName(returned)
    modules = t("customer").select(name("c", "c_custkey").alias("module")).unionByName(t("supplier").select(name("s", "s_suppkey").alias("module")))
    none = modules.select("module", F.col("module").alias("name"), F.lit(True).alias("public")).where(F.lit(False))
    metrics = M.module_metrics(modules, none, references.select("src", "dst").distinct(), references)
    limits = Coupling()
    minimum = {"dependencies": limits.minimum_fan_out, "dependents": limits.minimum_fan_in, "referenced_contracts": limits.minimum_contracts}
    return M.coupling_findings(metrics, minimum, limits.minimum_z).select(F.lit("HL103").alias("rule"), "module", "score", "message")


UNUSED = "SELECT module, CAST(count(*) AS BIGINT) AS unused, string_agg(name, ', ' ORDER BY name) AS names FROM (SELECT p_brand AS module, p_name || '#' || p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)) GROUP BY 1"


def _names(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "part").join(used, "p_partkey", "left").select(F.col("p_brand").alias("module"), F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("name"), F.coalesce("n", F.lit(0)).alias("external_references"))


@query(UNUSED)
def a08_unused_names(spark, sf_dir):
    return M.unused_names(_names(spark, sf_dir))


@query("SELECT module, unused || CASE WHEN unused = 1 THEN ' symbol' ELSE ' symbols' END AS message FROM (" + UNUSED + ")")
def hl102_unused_surface(spark, sf_dir):
    return M.unused_names(_names(spark, sf_dir)).select("module", plural(F.col("unused"), "symbol", "symbols").alias("message"))


@query("SELECT p_brand AS module, CAST(count(*) AS BIGINT) AS public_surface FROM part GROUP BY 1 HAVING count(*) > 40")
def hl107_surface_limit(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("module")).agg(F.count("*").alias("public_surface"))
    return M.limit_exceeded(sizes, "public_surface", 40)


@query("SELECT p_type AS module, CAST(count(*) AS BIGINT) AS files FROM part GROUP BY 1 HAVING count(*) > 12")
def hl117_file_limit(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("module")).agg(F.count("*").alias("files"))
    return M.limit_exceeded(sizes, "files", 12)


@query("""SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS modules, CAST(count(*) AS BIGINT) AS diagnostics,
 CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS smells FROM events""")
def a09_run_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "purchase", "smell").otherwise(F.col("event_type"))
    return M.run_summary(events.select(severity.alias("severity")), events.select(F.col("user_id").alias("module")))


@query("""WITH c AS (SELECT user_id AS module, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS prior, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS surface FROM events GROUP BY 1)
SELECT module, CAST(surface AS BIGINT) AS surface, CAST(prior AS BIGINT) AS prior FROM c WHERE prior > 0 AND surface > prior""")
def j04_baseline_growth(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("module"), (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("early"))
    count = lambda df: df.groupBy("module").agg(F.count("*").alias("surface"))
    return M.growth(count(events.where("not early")), count(events.where("early")), "module", "surface")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
a AS (SELECT user_id, event_type, count(*) AS allowed FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2)
SELECT e.event_id, e.user_id, e.event_type FROM e LEFT JOIN a ON e.user_id = a.user_id AND e.event_type = a.event_type WHERE rn > coalesce(allowed, 0)""")
def j05_multiset_antijoin(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    early = M.multiplicities(events.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")), ["user_id", "event_type"])
    return M.beyond_allowance(events, early, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS allowed FROM events GROUP BY 1, 2")
def a13_multiplicities(spark, sf_dir):
    return M.multiplicities(table(spark, sf_dir, "events"), ["user_id", "event_type"])


GAPS = "h AS (SELECT CAST(l_quantity AS BIGINT) AS gap, count(*) FILTER (WHERE l_returnflag <> 'R') AS source, count(*) FILTER (WHERE l_returnflag = 'R') AS test FROM lineitem GROUP BY 1)"


def _gaps(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("gap"), (F.col("l_returnflag") == "R").alias("is_test"))


@query("WITH " + GAPS + " SELECT gap, CAST(source AS BIGINT) AS source, CAST(test AS BIGINT) AS test FROM h")
def a10_gap_histogram(spark, sf_dir):
    return M.gap_histogram(_gaps(spark, sf_dir))


@query("WITH " + GAPS + """ SELECT CAST(l AS BIGINT) AS "limit", CAST(coalesce((SELECT sum(source) FROM h WHERE gap > l), 0) AS BIGINT) AS source, CAST(coalesce((SELECT sum(test) FROM h WHERE gap > l), 0) AS BIGINT) AS test
FROM range(0, (SELECT max(gap) + 1 FROM h)) AS t(l)""")
def a11_violations_by_limit(spark, sf_dir):
    return M.violations_by_limit(M.gap_histogram(_gaps(spark, sf_dir))).withColumn("limit", F.col("limit").cast("long"))


@query("SELECT l_orderkey AS caller, l_partkey AS callee, CAST(min(l_linenumber) AS INTEGER) AS line FROM lineitem GROUP BY 1, 2")
def a12_first_call_site(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("callee")).agg(F.min("l_linenumber").alias("line"))


@query("SELECT CAST(sum(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> ''))) AS BIGINT) AS lines, CAST(count(*) AS BIGINT) AS files FROM documents")
def a19_line_budget(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.sum(nonblank_lines(F.col("text"))).alias("lines"), F.count("*").alias("files"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS files, sum(CASE WHEN event_type = 'click' THEN 1 END) AS added, sum(CASE WHEN event_type = 'error' THEN 1 END) AS deleted FROM events GROUP BY 1, 2)
SELECT user_id, CAST(count(*) AS BIGINT) AS commits, CAST(coalesce(sum(added), 0) AS BIGINT) AS added, CAST(coalesce(sum(deleted), 0) AS BIGINT) AS deleted, CAST(median(files) AS DOUBLE) AS median_files FROM d GROUP BY 1""")
def a23_commit_summary(spark, sf_dir):
    one = lambda kind: F.sum(F.when(F.col("event_type") == kind, 1))
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("files"), one("click").alias("added"), one("error").alias("deleted"), F.lit("").alias("subject"))
    return M.commit_summary(days, "user_id").drop("fixes")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
e AS (SELECT o_custkey, min(rn) AS first FROM o WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_orderkey, o_custkey, CAST(rn - first AS BIGINT) AS step, CASE WHEN rn < first THEN 'before' WHEN rn > first AND rn <= first + 2 THEN 'after' ELSE 'post' END AS phase
FROM o JOIN e USING (o_custkey) WHERE rn >= first - 2""")
def w06_adoption_window(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return M.around(orders, "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F", 2, 2).select("o_orderkey", "o_custkey", "step", "phase")


@query("""SELECT o_custkey, CAST(count(*) AS BIGINT) AS runs, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS first_o_totalprice, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS last_o_totalprice FROM orders GROUP BY 1""")
def a28_endpoints(spark, sf_dir):
    return M.endpoints(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_totalprice"])


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def w04_last_runs(spark, sf_dir):
    return M.top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 20)


@query("SELECT l_partkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 12")
def w08_top_modules(spark, sf_dir):
    return M.top_k(table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), [F.desc("n"), F.asc("l_partkey")], 12)


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) AS g FROM part), o AS (SELECT * FROM p WHERE g = 1),
q AS (SELECT p_size, unnest([0, 0.1, 0.5, 0.9, 1]) AS quantile, unnest([quantile_cont(p_retailprice, 0), quantile_cont(p_retailprice, 0.1), quantile_cont(p_retailprice, 0.5), quantile_cont(p_retailprice, 0.9), quantile_cont(p_retailprice, 1)]) AS mark FROM o GROUP BY 1),
n AS (SELECT o.p_size, quantile, o.p_partkey, o.p_retailprice, row_number() OVER (PARTITION BY o.p_size, quantile ORDER BY abs(o.p_retailprice - mark), o.p_partkey) AS rn FROM o JOIN q ON o.p_size = q.p_size)
SELECT p_size, CAST(quantile AS DOUBLE) AS quantile, p_partkey, p_retailprice FROM n WHERE rn = 1""")
def w09_quantile_samples(spark, sf_dir):
    return M.quantile_samples(table(spark, sf_dir, "part"), "p_size", "p_retailprice", "p_brand", "p_partkey")


@query("""SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) THEN 'ambiguous'
 WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'project' WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) THEN 'engine' ELSE 'unresolved' END AS attribution FROM orders""")
def j17_attribution(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "revision")
    runs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("revision"))
    return M.attribute_runs(runs, customers.where("c_acctbal > 0"), customers.where("c_nationkey < 10")).select("o_orderkey", "attribution")


@query("""WITH once AS (SELECT DISTINCT l_orderkey AS k, p_brand AS item, substr(p_brand, 1, 7) AS module FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT k) AS n FROM once),
e AS (SELECT item, count(*) AS c FROM once GROUP BY 1), p AS (SELECT x.item AS a, y.item AS b, count(*) AS shared FROM once x JOIN once y ON x.k = y.k AND x.item < y.item AND x.module <> y.module GROUP BY 1, 2)
SELECT a, b, CAST(n AS BIGINT) AS n, CAST(ea.c AS BIGINT) AS edits_a, CAST(eb.c AS BIGINT) AS edits_b, CAST(shared AS BIGINT) AS shared, round(shared / ea.c, 9) AS rate_a, round(shared / eb.c, 9) AS rate_b, round(shared * n / (ea.c * eb.c), 9) AS lift
FROM p JOIN e ea ON a = ea.item JOIN e eb ON b = eb.item, n WHERE shared * n / (ea.c * eb.c) >= 1.0""")
def j06_cochange_baskets(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    rows = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").select(F.col("l_orderkey").alias("k"), F.col("p_brand").alias("item"), F.substring("p_brand", 1, 7).alias("module"))
    pairs = H.baskets(rows, "k", "item", "module").where("lift >= 1.0")
    return pairs.select("a", "b", "n", "edits_a", "edits_b", "shared", *[F.round(c, 9).alias(c) for c in ("rate_a", "rate_b", "lift")])


#: A history per nation: a day is a commit, a brand has two files. Each file was added in its oldest commit and renamed halfway.
HISTORY = """WITH d AS (SELECT c_nationkey, max(o_orderdate) AS last FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
l AS (SELECT 'n' || c_nationkey AS repo, CAST(date_diff('day', o_orderdate, last) AS INTEGER) AS seq, p_brand, l_quantity FROM orders JOIN customer ON o_custkey = c_custkey JOIN d USING (c_nationkey) JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
t AS (SELECT repo, seq, p_brand || '/main' AS file FROM l UNION SELECT repo, seq, p_brand || '/notes' FROM l WHERE l_quantity > 5), e AS (SELECT repo, seq FROM t GROUP BY 1, 2 HAVING count(*) <= 12), b AS (SELECT repo, file, max(seq) AS born FROM t GROUP BY 1, 2),
v AS (SELECT e.repo, e.seq, b.file, t.seq IS NOT NULL AS edited FROM e JOIN b ON e.repo = b.repo AND e.seq <= b.born LEFT JOIN t ON t.repo = e.repo AND t.seq = e.seq AND t.file = b.file) """


def _observed(spark, sf_dir):
    """The observations of commits of at most 12 files."""
    t = lambda name: table(spark, sf_dir, name)
    placed = t("orders").select("o_orderkey", "o_orderdate", F.col("o_custkey").alias("c_custkey")).join(t("customer").select("c_custkey", "c_nationkey"), "c_custkey")
    dated = placed.join(placed.groupBy("c_nationkey").agg(F.max("o_orderdate").alias("last")), "c_nationkey").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("n"), "c_nationkey").alias("repo"), F.datediff("last", "o_orderdate").alias("seq"))
    lines = dated.join(t("lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_quantity"), "l_orderkey").join(t("part").select("p_partkey", "p_brand"), "p_partkey")
    both = F.array(F.concat("p_brand", F.lit("/main")), F.when(F.col("l_quantity") > 5, F.concat("p_brand", F.lit("/notes"))))
    # The walk reads the history many times: it is written once, as a source would be.
    touched = staged(lines.select("repo", "seq", F.explode(both).alias("file")).where("file is not null").distinct(), "history-touched")
    born = staged(touched.groupBy("repo", "file").agg(F.max("seq").alias("born")), "history-born")
    moved = touched.join(born, ["repo", "file"]).where("2 * seq >= born and seq < born").groupBy("repo", "file").agg(F.min("seq").alias("moved"))
    known = touched.join(born.join(moved, ["repo", "file"], "left"), ["repo", "file"])
    kind = F.when(F.col("seq") == F.col("born"), "A").when(F.col("seq") == F.col("moved"), "R").otherwise("M")
    old = F.concat(F.lit("old/"), "file")
    path, before = F.when(F.col("seq") > F.col("moved"), old).otherwise(F.col("file")), F.when(kind == "R", old)
    changes = staged(known.select("repo", "seq", path.alias("path"), before.alias("previous_path"), kind.alias("kind"), F.lit(True).alias("content_changed")), "history-changes")
    return H.observations(touched.select("repo", "seq").distinct(), changes, born.select("repo", F.col("file").alias("path")), 12), born


@query(HISTORY + "SELECT * FROM v")
def j18_observations(spark, sf_dir):
    return _observed(spark, sf_dir)[0]


@query(HISTORY + """, x AS (SELECT repo, a.file AS a, b.file AS b, count(*) AS n, count(*) FILTER (a.edited) AS edits_a, count(*) FILTER (b.edited) AS edits_b, count(*) FILTER (a.edited AND b.edited) AS shared,
 array_to_string(list_slice(list_sort(list(seq) FILTER (a.edited AND b.edited)), 1, 5), ',') AS newest FROM v a JOIN v b USING (repo, seq) WHERE a.file < b.file GROUP BY 1, 2, 3),
y AS (SELECT *, shared / edits_a AS rate_a, shared / edits_b AS rate_b, shared * n / (edits_a * edits_b) AS lift FROM x WHERE shared > 0), z AS (SELECT p_brand, max(p_retailprice) > 999 AS ab, min(p_retailprice) < 902 AS ba FROM part GROUP BY 1)
SELECT repo, a, b, n, edits_a, edits_b, shared, round(rate_a, 9) AS rate_a, round(rate_b, 9) AS rate_b, round(lift, 9) AS lift, CASE WHEN NOT coalesce(replace(a, '/main', '') = replace(b, '/notes', ''), false) THEN 'none' WHEN ab AND ba THEN 'both' WHEN ab THEN 'left-to-right' WHEN ba THEN 'right-to-left' ELSE 'none' END AS dependency, newest, 'HL119' AS rule
FROM y LEFT JOIN z ON a = p_brand || '/main' WHERE n >= 30 AND shared >= 5 AND rate_a >= 0.8 AND rate_b >= 0.8 AND lift >= 2""")
def hl119_cochange(spark, sf_dir):
    """Files of one history that change together; the brand's dearest and cheapest part tell which of its files depends on which."""
    alive, files = _observed(spark, sf_dir)
    alive = staged(alive, "history-alive")
    pairs = H.qualifying(H.co_change(alive, files.select("repo", "file", F.col("file").alias("module"))))
    prices = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max("p_retailprice").alias("most"), F.min("p_retailprice").alias("least"))
    main, notes = F.concat("p_brand", F.lit("/main")), F.concat("p_brand", F.lit("/notes"))
    uses = prices.where("most > 999").select(main.alias("src"), notes.alias("dst")).unionByName(prices.where("least < 902").select(notes.alias("src"), main.alias("dst")))
    named = H.direction(pairs, uses)
    rounded = [F.round(c, 9).alias(c) for c in ("rate_a", "rate_b", "lift")]
    return named.select("repo", "a", "b", "n", "edits_a", "edits_b", "shared", *rounded, "dependency", F.array_join(F.col("commits").cast("array<string>"), ",").alias("newest"), F.lit("HL119").alias("rule"))


@query("""SELECT CAST(user_id AS VARCHAR) AS module, CAST(floor(count(*) FILTER (WHERE event_type = 'click') / count(*) * 100 + 0.5) AS BIGINT) AS percent FROM events GROUP BY 1""")
def p18_rounded_ratio(spark, sf_dir):
    grouped = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("module")).agg(F.count_if(F.col("event_type") == "click").alias("s"), F.count("*").alias("d"))
    return grouped.select("module", rounded_percent(M.surface_ratio(F.col("s"), F.col("d"))).alias("percent"))
