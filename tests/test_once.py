"""Work that is done once, and spread over tasks, however often its result is used."""

import re

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import graph as G
from tessella.operators import metrics as M
from tessella.plans.rendered import customer_views


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_colours_are_looked_for_once(spark):
    """The count of files, the filter and the result each looked for the colours anew."""
    rows = spark.createDataFrame([("a.css", "a { color: red }"), ("b.css", "b { color: #FFF }"), ("c.css", "c { }")], "file string, text string")
    found = M.color_files(rows.select("file", X.css_colors(F.col("text")).alias("colors")), ["."], 1)
    assert "regexp_extract_all" not in _plan(found)
    assert {(r["file"], tuple(r["colors"]), r["score"]) for r in found.collect()} == {("a.css", ("red",), 2), ("b.css", ("#fff",), 2)}


def test_words_are_colours_as_name_by_name(spark):
    """Words that are looked up are the colours that trying each name finds; before, each name was tried at each character."""
    text = "a.red #red $red -red red-box red2 2red red_ red(1) RED; éred redé darkred lightred color(red) x-rgb(1, 2) rgb (3) xrgb(4) #ab #abc #abcd-x #12345678 tan\nblue,red\ttan{teal} hsl(\n5) 'plum' \"peru\" url(pink) red.pink/gold"
    plain = re.sub(r"""url\([^)]*\)|"[^"]*"|'[^']*'""", " ", text.lower())
    pattern = rf"(?:#(?:[0-9a-f]{{8}}|[0-9a-f]{{6}}|[0-9a-f]{{3,4}})(?![0-9a-z_-]))|(?:\b(?:{X.COLOR_FUNCTIONS})\([^()]*\))|(?:(?<![\w.#$-])(?:{'|'.join(X.COLOR_NAMES)})(?![\w(-]))"
    column = X.css_colors(F.col("text"))
    assert spark.createDataFrame([(text,)], "text string").select(column).first()[0] == sorted(set(re.findall(pattern, plain, re.ASCII)))
    assert "darkgoldenrod|" not in str(column)


def test_views_are_spread(spark):
    """One small file of customers was one task's, and so were all the texts that are written of it."""
    assert customer_views(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_what_symbols_reach_is_followed_once(spark, monkeypatch):
    """Every round carried all exports along with what they reach."""
    written, real = [], G.staged

    def staged(df, name):
        out = real(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(G, "staged", staged)
    exports = spark.range(300).select(F.lit("m").alias("module"), F.format_string("e%03d", "id").alias("export"))
    chain = [f"s{i}" for i in range(6)]
    # One export is reached by a chain's end, and itself reaches nothing.
    edges = exports.where("export <> 'e299' and export <> 'e298'").select(F.col("export").alias("src"), F.lit("s0").alias("dst")).unionByName(spark.createDataFrame([*zip(chain, chain[1:]), ("s5", "e299")], "src string, dst string"))
    groups = G.separate_groups(exports, edges)
    assert {(r["cohort"], r["n"]) for r in groups.groupBy("cohort").agg(F.count("*").alias("n")).collect()} == {("e000", 299), ("e298", 1)}
    assert sum(n > 1 for n in written) == 3


def test_groups_are_made_once(spark):
    """Four mentions of the groups in the plan of their cohesion made them four times."""
    groups = spark.createDataFrame([("m", "a", "a"), ("m", "b", "a"), ("m", "c", "c")], "module string, export string, cohort string")
    found = G.cohesion(groups, spark.createDataFrame([("m", "a", "x"), ("m", "a", "x"), ("m", "a", "y"), ("m", "c", "x")], "module string, export string, consumer string"))
    assert "LogicalRDD" not in _plan(found) and "LocalRelation" not in _plan(found)
    assert [tuple(r) for r in found.select("module", "exports", "cohorts", "smallest", F.round("separated_ratio", 6), "consumer_overlap").collect()] == [("m", 3, 2, 1, 0.666667, 0.5)]
