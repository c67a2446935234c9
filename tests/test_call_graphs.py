"""Cycles, generations, gaps, dead symbols and entry points on small fixed graphs."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import graph as G
from tessella.operators import references as R

CALLS = [("first", "second"), ("second", "first"), ("self", "self"), ("caller", "first"), ("p", "loop"), ("p", "leaf"), ("g", "p"), ("g", "leaf"), ("loop", "loop"), ("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x3", "x2")]
MODULES = [("top", "a"), ("middle", "a"), ("leaf", "a"), ("api", "b"), ("deep", "b"), ("loop", "a"), ("over", "a")]
EDGES = [("top", "middle"), ("top", "leaf"), ("top", "api"), ("middle", "api"), ("api", "deep"), ("loop", "loop"), ("over", "loop")]
FILES = [("a/index.ts", "a"), ("a/util.ts", "a"), ("b/index.ts", "b"), ("b/deep/x.tsx", "b/deep"), ("c/one.ts", "c")]
IMPORTS = [("a/index.ts", "./util"), ("a/index.ts", "../b"), ("a/util.ts", "../b/deep/x"), ("b/index.ts", "./deep/x.js"), ("c/one.ts", "react"), ("c/one.ts", "../a/util")]


def test_cycles(spark):
    edges = spark.createDataFrame(CALLS, "src string, dst string")
    found = G.strong_components(edges)
    assert {tuple(r) for r in found.select("node", "component").collect()} == {("first", "first"), ("second", "first"), ("self", "self"), ("loop", "loop"), ("x1", "x1"), ("x2", "x1"), ("x3", "x1")}
    shown = {tuple(r["witness"]) for r in G.cycle_witnesses(edges, found).collect()}
    assert shown == {("first", "second", "first"), ("self", "self"), ("loop", "loop"), ("x1", "x2", "x3", "x1")}


@pytest.mark.parametrize("most", [0, 1000])
def test_generations(spark, most):
    nodes, edges = spark.createDataFrame(MODULES, "node string, module string"), spark.createDataFrame(EDGES, "src string, dst string")
    assert {tuple(r) for r in G.generations(nodes, edges, "module", most).collect()} == {("top", 2, "middle"), ("middle", 1, "api"), ("leaf", 0, None), ("api", 1, "deep"), ("deep", 0, None)}
    assert {tuple(r) for r in G.generation_gaps(nodes, edges).collect()} == {("top", "middle", 1), ("top", "leaf", 2), ("top", "api", 2), ("middle", "api", 1), ("api", "deep", 1)}


def test_dead_symbols(spark):
    edges = spark.createDataFrame([("main", "used"), ("used", "helper"), ("deadChain", "deadLeaf"), ("recA", "recB"), ("recB", "recA"), ("exported", "inner")], "src string, dst string")
    node = lambda names: spark.createDataFrame([(x,) for x in names.split()], "node string")
    found = G.dead(node("used helper deadChain deadLeaf recA recB unusedArrow exported inner"), node("main exported"), edges)
    assert {r["node"] for r in found.collect()} == {"deadChain", "deadLeaf", "recA", "recB", "unusedArrow"}


def test_imports_and_entry_points(spark):
    files = spark.createDataFrame(FILES, "file string, module string")
    edges = R.import_edges(spark.createDataFrame(IMPORTS, "file string, specifier string"), files)
    assert {tuple(r) for r in edges.collect()} == {("a/index.ts", "a", "b/index.ts", "b"), ("a/util.ts", "a", "b/deep/x.tsx", "b/deep"), ("b/index.ts", "b", "b/deep/x.tsx", "b/deep"), ("c/one.ts", "c", "a/util.ts", "a")}
    entries = R.entry_points(files.unionByName(spark.createDataFrame([("a/index.tsx", "a")], "file string, module string")))
    assert {tuple(r) for r in entries.collect()} == {("a", 2, None), ("b", 1, "b/index.ts"), ("b/deep", 0, None), ("c", 0, None)}
    found = R.entry_point_findings(R.entry_points(files), edges)
    assert {(r["module"], r["file"]) for r in found.collect()} == {("b/deep", None), ("c", None), ("a", "a/util.ts"), ("b", "b/index.ts"), ("c", "c/one.ts")}
    assert found.where(F.col("message") == "Module must have exactly one public index entrypoint; found 0.").count() == 2
