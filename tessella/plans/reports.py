"""Reports over events, documents and pages as findings, commands and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics as M
from ..operators import reports as R
from ..session import table
from . import metrics as _metrics  # noqa: F401
from .base import ORACLES, QUERIES, inline, query

#: Rules with findings over whole tables; their severities, and one that is off.
RULES = {"HL102": "hl102_unused_surface", "HL103": "hl103_coupling", "HL107": "hl107_surface_limit", "HL117": "hl117_file_limit"}
RATED = {"HL103": "smell", "HL117": "info"}
OFF = ("HL107",)


@query("SELECT severity, rule, CAST(count(*) AS BIGINT) AS findings FROM (" + " UNION ALL ".join(f"SELECT '{RATED.get(r, 'error')}' AS severity, '{r}' AS rule FROM ({ORACLES[q]}) q{i}" for i, (r, q) in enumerate(RULES.items()) if r not in OFF) + ") f GROUP BY 1, 2")
def u01_all_findings(spark, sf_dir):
    """Findings of all rules that aren't disabled, by severity."""
    found = R.all_findings({r: QUERIES[q](spark, sf_dir) for r, q in RULES.items() if r not in OFF}, RATED)
    return found.groupBy("severity", "rule").agg(F.count("*").alias("findings"))


@query("""SELECT event_id, upper(event_type) || ' HL' || CAST(user_id AS VARCHAR) || CASE WHEN event_type = 'error' THEN '' ELSE ' m' || CAST(user_id AS VARCHAR) END || CASE WHEN event_type = 'click' THEN '' ELSE ' f' || CAST(user_id AS VARCHAR)
 || CASE WHEN event_id % 10 = 0 THEN '' ELSE ':' || CAST(event_id % 10 AS VARCHAR) END END || ': ' || props AS text FROM events""")
def k03_finding_lines(spark, sf_dir):
    kind, user, line = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id") % 10
    module, file = F.when(kind != "error", F.concat(F.lit("m"), user)), F.when(kind != "click", F.concat(F.lit("f"), user)).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", R.finding_line(kind, F.concat(F.lit("HL"), user), module, file, line, F.col("props")).alias("text"))


NAMES = "SELECT user_id % 100 AS module, user_id AS file, CAST(json_extract(props, '$.k') AS BIGINT) AS name, event_type = 'purchase' AS exported FROM events"


def _names(spark, sf_dir):
    name = F.get_json_object("props", "$.k").cast("long").alias("name")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 100).alias("module"), F.col("user_id").alias("file"), name, (F.col("event_type") == "purchase").alias("exported"))


@query(f"SELECT module, file, count(DISTINCT name) AS declarations, count(DISTINCT name) FILTER (WHERE exported) AS exports FROM ({NAMES}) GROUP BY 1, 2")
def a05_file_metrics(spark, sf_dir):
    return R.file_metrics(_names(spark, sf_dir))[0]


@query(f"SELECT module, count(DISTINCT name) AS declarations, count(DISTINCT name) FILTER (WHERE exported) AS exports FROM ({NAMES}) GROUP BY 1")
def a05_module_metrics(spark, sf_dir):
    return R.file_metrics(_names(spark, sf_dir))[1]


@query("""WITH n AS (SELECT l_suppkey AS module, l_orderkey AS file, l_partkey AS name, l_returnflag = 'R' AS exported FROM lineitem),
f AS (SELECT module, file, count(DISTINCT name) AS declarations, count(DISTINCT name) FILTER (WHERE exported) AS exports FROM n GROUP BY 1, 2)
SELECT 'HL109' AS rule, f.module, f.file FROM f JOIN orders ON o_orderkey = f.file WHERE o_orderpriority = '1-URGENT' AND declarations = 1 AND exports = 1""")
def hl109_single_declaration(spark, sf_dir):
    """Line items as names: a supplier is a module, an order a file, an urgent order an entry file."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("module"), F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("name"), (F.col("l_returnflag") == "R").alias("exported"))
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("file"))
    entries = lines.select("module", "file").join(urgent, "file", "left_semi")
    return R.single_declarations(R.file_metrics(lines)[0], entries).select(F.lit("HL109").alias("rule"), "module", "file")


@query("""WITH f AS (SELECT CASE WHEN p_size <= 10 THEN 'node_modules/' WHEN p_size <= 20 THEN 'dist/' ELSE 'src/' END || p_brand || '/p' || p_partkey || CASE WHEN p_retailprice < 930 THEN '.css' WHEN p_retailprice < 960 THEN '.css.ts' ELSE '.ts' END AS file FROM part)
SELECT 'HL110' AS rule, file FROM f WHERE file LIKE 'src/%.css'""")
def hl110_css_files(spark, sf_dir):
    """A file per part: its size tells the folder, its price the ending."""
    from ..functions.paths import css_files

    folder = F.when(F.col("p_size") <= 10, "node_modules/").when(F.col("p_size") <= 20, "dist/").otherwise("src/")
    ending = F.when(F.col("p_retailprice") < 930, ".css").when(F.col("p_retailprice") < 960, ".css.ts").otherwise(".ts")
    files = table(spark, sf_dir, "part").select(F.concat(folder, "p_brand", F.lit("/p"), "p_partkey", ending).alias("file"))
    return css_files(files).select(F.lit("HL110").alias("rule"), "file")


STYLES = r"""WITH s AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, sha256(unnest(regexp_extract_all(html, '(?is)<style\b[^>]*>'))) AS signature, starts_with(url, 'https') AS known FROM pages),
a AS (SELECT host, signature, count(*) AS allowed FROM s WHERE known GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY host, signature ORDER BY page_id) AS rn FROM s) """


@query(STYLES + "SELECT 'HL111' AS rule, r.host, r.page_id AS line, r.signature FROM r LEFT JOIN a ON a.host = r.host AND a.signature = r.signature WHERE rn > coalesce(allowed, 0)")
def hl111_inline_styles(spark, sf_dir):
    """Style elements of a host's pages beyond as many equal ones as its https pages have, the baseline."""
    host = F.substring_index(F.substring_index("url", "://", -1), "/", 1)
    tags = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.col("url").startswith("https").alias("known"), F.explode(X.style_tags(F.col("html"))).alias("tag"))
    found = tags.select("page_id", "host", "known", F.sha2("tag", 256).alias("signature"))
    allowance = found.where("known").groupBy("host", "signature").agg(F.count("*").alias("allowed"))
    return M.beyond_allowance(found, allowance, ["host", "signature"], ["page_id"]).select(F.lit("HL111").alias("rule"), "host", F.col("page_id").alias("line"), "signature")


@query("""WITH c AS (SELECT user_id, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS prior, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS surface FROM events GROUP BY 1)
SELECT 'HL113' AS rule, user_id AS module, CAST(surface - prior AS BIGINT) AS score FROM c WHERE prior > 0 AND surface > prior""")
def hl113_surface_growth(spark, sf_dir):
    """Modules whose surface is above the baseline's."""
    return QUERIES["j04_baseline_growth"](spark, sf_dir).select(F.lit("HL113").alias("rule"), "module", (F.col("surface") - F.col("prior")).alias("score"))


METRICS = "SELECT user_id AS module, count(*) AS declarations, count(*) FILTER (WHERE event_type = 'purchase') AS public_surface, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS dependencies FROM events GROUP BY 1"


@query(f"""SELECT count(*) AS metric_modules, CAST(sum(declarations) AS BIGINT) AS declarations, CAST(sum(public_surface) AS BIGINT) AS public_surface, CAST(sum(dependencies) AS BIGINT) AS dependencies,
max(dependencies) AS max_dependencies, sum(public_surface)::DOUBLE / sum(declarations) AS public_ratio FROM ({METRICS}) WHERE module <> 7""")
def a16_metric_totals(spark, sf_dir):
    """Totals over all modules but one (P21)."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("module")).agg(F.count("*").alias("declarations"), F.count_if(F.col("event_type") == "purchase").alias("public_surface"), F.count_distinct(k).alias("dependencies"))
    return R.metric_totals(rows, without="7")


@query("""WITH p AS (SELECT o_orderpriority AS step, o_orderstatus AS status, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2)
SELECT step, CAST(sum(n) AS BIGINT) AS count, round(sum(s), 2) AS wall_seconds, string_agg(status || '=' || CAST(n AS VARCHAR), ',' ORDER BY status) AS statuses FROM p GROUP BY 1""")
def a25_step_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("step"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("duration_seconds"))
    shown = F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return R.step_rollup(rows).select("step", "count", F.round("wall_seconds", 2).alias("wall_seconds"), shown.alias("statuses"))


@query("""WITH f AS (SELECT source || '/' || CASE WHEN doc_id % 50 = 0 THEN 'index.ts' ELSE CAST(doc_id AS VARCHAR) || '.ts' END AS path, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS lines, lang = 'en' AS test FROM documents)
SELECT count(*) AS files, CAST(sum(lines) AS BIGINT) AS nonempty_lines, CAST(count(*) FILTER (WHERE test) AS BIGINT) AS test_files, CAST(count(*) FILTER (WHERE NOT test) AS BIGINT) AS production_files, median(lines) FILTER (WHERE NOT test) AS median_lines,
CAST(count(*) FILTER (WHERE NOT test AND lines <= 20) AS BIGINT) AS tiny_files, CAST(count(*) FILTER (WHERE NOT test AND path LIKE '%/index.ts') AS BIGINT) AS index_files, count(DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1)) FILTER (WHERE NOT test) AS directories FROM f""")
def a24_inventory(spark, sf_dir):
    """Documents as files; English ones stand for tests."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 50 == 0, "index.ts").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".ts")))
    return R.inventory(docs.select(F.concat_ws("/", "source", name).alias("path"), X.nonblank_lines(F.col("text")).alias("lines"), (F.col("lang") == "en").alias("test")))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT o_custkey, CAST(count(*) AS VARCHAR) || ' functions [' || string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY o_orderkey) FILTER (WHERE rn <= 8) || CASE WHEN count(*) > 8 THEN ', …' ELSE '' END || ']' AS text FROM r GROUP BY 1""")
def w10_first_members(spark, sf_dir):
    return R.described(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], F.col("o_orderkey").cast("string"))


@query("""WITH m AS (SELECT o_custkey, count(*) >= 5 AS eligible, count(*) FILTER (WHERE o_orderstatus = 'F') AS large, max(CASE WHEN o_totalprice > 300000 THEN o_orderkey END) AS separated FROM orders GROUP BY 1)
SELECT count(*) AS modules, CAST(count(*) FILTER (WHERE eligible) AS BIGINT) AS eligible, CAST(count(*) FILTER (WHERE eligible AND large >= 2) AS BIGINT) AS candidates, CAST(count(*) FILTER (WHERE eligible AND large >= 2 AND separated IS NOT NULL) AS BIGINT) AS separated FROM m""")
def a21_semantic_funnel(spark, sf_dir):
    """Customers as modules, their orders as clusters."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.count("*") >= 5).alias("eligible"), F.count_if(F.col("o_orderstatus") == "F").alias("large"), F.max(F.when(F.col("o_totalprice") > 300000, F.col("o_orderkey"))).alias("separated"))
    return R.funnel(rows)


@query("SELECT o_orderkey, o_orderkey - (SELECT min(o_orderkey) FROM orders) AS seq, CASE WHEN (SELECT max(o_orderkey) - min(o_orderkey) FROM orders) >= 500 THEN 'window' ELSE 'root' END AS coverage FROM orders WHERE o_orderkey - (SELECT min(o_orderkey) FROM orders) < 500")
def w05_history_window(spark, sf_dir):
    """Orders as commits; the smallest key is the newest."""
    orders = table(spark, sf_dir, "orders")
    first = orders.agg(F.min("o_orderkey")).first()[0]
    return R.window_coverage(orders.select("o_orderkey", (F.col("o_orderkey") - first).alias("seq")), 500)
