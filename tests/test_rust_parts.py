"""Rust facts of which only some are asked for: only those leave the workers, and long rows don't make batches long."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions.rust import scope_facts
from tessella.operators import rust as U
from tessella.plans import rust as P

from .test_rust import LIB

ODD = "fn f() -> impl T { m!{ use } } pub fn g() { pub use a::b; }\nmod x { fn h() { ( } mod y { pub use c::d; } } pub(crate) struct S { a: [u8; 2 } pub use e::{f, g}; fn i( { mod z { fn j() {} }"


@pytest.mark.parametrize("text", [LIB, LIB * 2, LIB.replace("a . b]", "a . b"), ODD, "} " + ODD, "", None])
def test_items_and_modules_need_no_bodies(text):
    told = lambda bodies: [(x["scope"], x["items"], x["modules"]) for x in scope_facts(text, bodies)]
    assert told(False) == told(True)


def test_a_use_ends_with_its_brackets():
    """One without an end, in a macro, took the items after the macro with it."""
    (file,) = scope_facts("m!{ use } fn a() {} const B: u8 = 1; fn c() {}")
    assert [x["name"] for x in file["items"]] == ["a", "B", "c"]


def test_only_what_is_asked_for_leaves_the_workers(spark):
    texts = spark.createDataFrame([("a.rs", LIB), ("b.rs", None)], "file string, text string")
    whole, some = U.rust_scopes(texts), U.rust_scopes(texts, ("items", "modules"))
    assert some.columns == ["file", "scope", "items", "modules"]
    rows = lambda df: sorted(map(repr, df.select("file", "scope", "items", "modules").collect()))
    assert rows(some) == rows(whole)
    plan = P.s08_rust_facts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "paths" not in plan and "uses" not in plan


def test_long_items_make_no_long_batches(spark):
    """Batches of 10,000 rows or 64 MB were held by the executor and each of its workers."""
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    rows = spark.range(0, 24, 1, 1).select(F.lit("a.rs").alias("file"), F.concat(F.lit("fn f() { "), F.repeat(F.lit("a::b(); "), 30_000), F.lit("}\n")).alias("text"))
    scopes = U.rust_scopes(rows)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    assert rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 6_000_000
    assert scopes.agg(F.sum(F.size("paths"))).first()[0] == 24 * 30_000
