"""The library's own operators: registered queries on the smallest tables against their SQL, and cases that need no table."""

import duckdb
import pytest

from tessella import catalog, config
from tessella.operators.components import connected_components
from tessella.sources import git

#: Over source trees and the like that Spark writes from the smallest tables.
WRITTEN = (
    "s18_instruction_lines hl112_instruction_limit t04_meaningful_lines p01_file_kinds s08_rust_facts t05_use_leaves s01_script_facts hl104_exact_clones hl105_near_clones m05_tree_similarity t01_inline_styles "
    "t06_path_chains a03_rust_references x02_private_exports hl103_coupling hl108_bypassing_imports t07_semantic_functions "
    "t03_css_colors hl118_color_files hl110_css_files s06_manifest_strings s05_crates g07_separate_groups a15_cohesion hl115_low_cohesion j10_path_resolution j11_path_hops"
).split()
TABLES = "region nation customer supplier part orders lineitem documents pages".split()
SMALLEST = "/root/testdata/sf0.001"


def same(got, want):
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, got.select(*columns).toPandas().itertuples(index=False, name=None))) == sorted(map(repr, want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()))


@pytest.mark.parametrize("name", WRITTEN)
def test_written_sources(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALLEST}/{t}.parquet'")
    same(catalog.queries()[name](spark, SMALLEST), con.sql(catalog.oracle_sql()[name]))


def test_every_query_has_a_name_of_its_own():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 7), (9, 9)], "src long, dst long")
    assert {(r["node"], r["component"]) for r in connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}


def test_settings():
    assert config.settings({"file_limit": False}).file_limit is None
    for bad in ({"file_limit": 0}, {"file_limit": 1.5}, {"unknown": 1}, {"color_roots": ["../x"]}):
        with pytest.raises(ValueError):
            config.settings(bad)


def test_raw_changes():
    raw = b":100644 100644 aa bb M\0a.ts\0:100644 100644 aa aa R100\0old.ts\0new.ts\0"
    assert git.parse_changes(raw) == [("a.ts", None, "M", True), ("new.ts", "old.ts", "R", False)]
    with pytest.raises(ValueError):
        git.parse_changes(b":100644 100644 aa bb X\0a\0")
