"""Rust sources in pieces: what is found in them is what is found in the whole."""

import pytest
from pyspark.sql import functions as F

from tessella.functions.rust import item_pieces, scope_facts
from tessella.functions.syntax import token_lines
from tessella.operators import rust as U
from tessella.plans.rendered import trade_crates

from .test_rust import LIB


@pytest.mark.parametrize("text", [LIB, LIB * 3, LIB.replace("a . b]", "a . b"), "} fn a() {}\n) use x::y;\n" + LIB, 'fn a() { "}\n;" }\nfn b() { \'}\'; r#"}\n"#; x::y() }\npub use c::{d}\n;\nfn e() {}\n', "", "/* fn a() {}\nfn b() {}\n"])
def test_pieces_hold_whole_items(text):
    pieces = list(item_pieces(text, 1))
    assert "".join(pieces) == text
    whole, parts = scope_facts(text), [x for p in pieces for x in scope_facts(p)]
    for key in ("items", "modules", "uses", "paths"):
        told = lambda rows: sorted(repr((x["scope"], y)) for x in rows for y in x[key])
        assert told(parts) == told(whole)
    assert sum(token_lines(p, True) for p in pieces) == token_lines(text, True)


def test_no_row_holds_a_whole_nation(spark, tmp_path):
    """Sources grow by rows, not by their length: a row with all functions of a nation took an executor's memory."""
    n = 20_000
    tables = {
        "nation": spark.createDataFrame([(0, 0), (1, 0)], "n_nationkey int, n_regionkey int"),
        "supplier": spark.range(2).select(F.col("id").alias("s_suppkey"), F.col("id").cast("int").alias("s_nationkey"), F.lit(1.0).alias("s_acctbal")),
        "customer": spark.range(n).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey")),
        "orders": spark.range(n).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")),
        "lineitem": spark.range(n).select(F.col("id").alias("l_orderkey"), (F.col("id") % 2).alias("l_suppkey")),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    crates = trade_crates(spark, str(tmp_path))
    assert crates.agg(F.max(F.length("text"))).first()[0] < 700_000
    found = U.rust_scopes(crates).groupBy("file").agg(F.sum(F.size("items")).alias("items"), F.sum(F.size("paths")).alias("paths"), F.sum(F.size("uses")).alias("uses"))
    assert {r["file"]: tuple(r)[1:] for r in found.collect()} == {"r0/src/lib.rs": (2, 0, 0), "r0/src/n0.rs": (1, 0, 0), "r0/src/n1.rs": (n + 1, n // 2, 1)}


def test_a_row_holds_one_item(spark):
    """A batch of 4,096 rows is read at once: rows of 5,000 keys made it grow with the table. What is found in the items is what is found in the whole text."""
    rows = [r["text"] for r in trade_crates(spark, "/root/testdata/sf0.001").where("file like '%/n%.rs'").select("text").collect()]
    assert max(t.count("fn supply") + t.count("fn customer") for t in rows) == 1
    whole, parts = scope_facts("".join(rows)), [x for t in rows for x in scope_facts(t)]
    for key in ("items", "modules", "uses", "paths"):
        assert sorted(repr(y) for x in parts for y in x[key]) == sorted(repr(y) for x in whole for y in x[key])


def test_few_scopes_gather_no_table(spark):
    """Chains met the few crates, places and files in sort-merge joins: all rows of a table were gathered under a handful of keys."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = spark.createDataFrame([("a.rs", "r", "r"), ("b.rs", "r", "r/n")], "file string, crate string, place string")
        scopes = U.rust_scopes(spark.createDataFrame([("a.rs", "pub mod n;\nfn f() { crate::n::g(); n::g(); }\n"), ("b.rs", "use super::*;\npub fn g() { r::f() }\n")], "file string, text string"))
        table = U.scope_table(scopes, files.distinct())
        module_of = table.select("place", F.col("place").alias("module")).distinct()
        references = U.rust_references(table)
        counts = U.reference_counts(references, module_of)
        for rows in (table, counts):
            assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in counts.collect()} == {("r", 2, 1), ("r/n", 2, 2)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
