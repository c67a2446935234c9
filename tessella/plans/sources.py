"""What is read from manifests, over trees of crates that Spark writes from customers and their orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import toml_string
from ..session import table
from ..sources import files as S
from .base import query
from .rendered import text

#: A customer's name and library: workspaces have neither, BUILDING ones tell the library's file.
CRATES = """WITH m AS (SELECT 'c' || c_custkey AS directory, CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'crate' || c_custkey END AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'src/core.rs' END AS lib, c_acctbal >= 0 AS runs, c_custkey FROM customer) """


def _manifests(spark, sf_dir):
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    package = (
        F.when(segment == "HOUSEHOLD", "[workspace]\nmembers = []\n")
        .when(segment == "BUILDING", text('[package]\nname = "crate', key, '"\n\n[lib]\npath = "src/core.rs"\n'))
        .otherwise(text("[lib]\nname = 'none'\n\n[package]\nedition = '2021'\nname = 'crate", key, "'\n"))
    )
    return table(spark, sf_dir, "customer").select(text("c", key).alias("directory"), package.alias("text"))


@query(CRATES + "SELECT directory, name, lib FROM m")
def s06_manifest_strings(spark, sf_dir):
    body = F.col("text")
    return _manifests(spark, sf_dir).select("directory", toml_string(body, "package", "name").alias("name"), toml_string(body, "lib", "path").alias("lib"))


@query(CRATES + """SELECT name AS crate, 'lib' AS kind, directory || '/' || coalesce(lib, 'src/lib.rs') AS root FROM m WHERE name IS NOT NULL UNION ALL SELECT name, 'bin', directory || '/src/main.rs' FROM m WHERE name IS NOT NULL AND runs
UNION ALL SELECT name, CASE o_orderstatus WHEN 'O' THEN 'test' WHEN 'F' THEN 'bench' ELSE 'bin' END, directory || CASE o_orderstatus WHEN 'O' THEN '/tests/o' WHEN 'F' THEN '/benches/o' ELSE '/src/bin/o' END || o_orderkey || '.rs' FROM m JOIN orders ON o_custkey = c_custkey WHERE name IS NOT NULL""")
def s05_crates(spark, sf_dir):
    """Crate roots that exist: two libraries in each folder, a main file where the balance isn't negative, a file per order in the folder its status tells."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    at = text("c", F.col("c_custkey"))
    own = customers.select(F.explode(F.array(text(at, "/src/lib.rs"), text(at, "/src/core.rs"), text(at, "/src/util.rs"), F.when(F.col("c_acctbal") >= 0, text(at, "/src/main.rs")))).alias("file")).where("file is not null")
    folder = F.when(F.col("o_orderstatus") == "O", "/tests/o").when(F.col("o_orderstatus") == "F", "/benches/o").otherwise("/src/bin/o")
    more = orders.select(F.concat(text("c", F.col("o_custkey")), folder, text(F.col("o_orderkey"), ".rs")).alias("file"))
    return S.crates(_manifests(spark, sf_dir), own.unionByName(more)).select("crate", "kind", "root")
