"""Readers of repositories and run records, settings, rankings and clustering, on small inputs."""

import json
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import config
from tessella.functions import paths as P
from tessella.operators import history as H
from tessella.operators import reports as R
from tessella.operators.similarity import linkage_of
from tessella.sources import files, git, ledger


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repository")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (root / "src").mkdir()
    (root / "dist").mkdir()
    (root / "dist/x.ts").write_text("generated")
    (root / "src/a.ts").write_text("one\ntwo\n" * 10)
    run("add", "src/a.ts")
    run("commit", "-qm", "first")
    run("mv", "src/a.ts", "src/b.ts")
    (root / "src/c.rs").write_text("mod d;\n")
    run("add", ".")
    run("commit", "-qm", "second")
    run("commit", "-q", "--allow-empty", "-m", "third")
    return str(root)


def test_history(spark, repository):
    rows = [tuple(r) for r in git.history(spark, [repository]).orderBy("seq", "path").select("seq", "path", "previous_path", "kind", "content_changed", "added", "coverage").collect()]
    assert rows == [
        (0, None, None, None, None, None, "root"), (1, "dist/x.ts", None, "A", True, 1, "root"), (1, "src/b.ts", "src/a.ts", "R", False, 20, "root"),
        (1, "src/c.rs", None, "A", True, 1, "root"), (2, "src/a.ts", None, "A", True, 20, "root"),
    ]
    short = git.history(spark, [repository], window=2)
    assert short.select("seq").distinct().count() == 2 and {r["coverage"] for r in short.collect()} == {"window"}
    assert git.commits(short).count() == 2
    assert {r["path"] for r in git.tracked_files(spark, repository).collect()} == {"dist/x.ts", "src/b.ts", "src/c.rs"}


def test_source_texts(spark, repository):
    found = {r["file"]: r["text"] for r in files.source_texts(spark, repository, [".ts", ".rs"]).collect()}
    assert set(found) == {"src/b.ts", "src/c.rs"} and found["src/c.rs"] == "mod d;\n"


def test_ledger(spark, tmp_path):
    at = str(tmp_path / "ledger")
    assert ledger.read(spark, at, "runs").count() == 0
    findings = spark.createDataFrame([("HL101", "error", "m"), ("HL101", "error", "n"), ("HL107", "smell", "m")], "rule string, severity string, module string")
    metrics = spark.createDataFrame([("m", 4, 2, 3), ("n", 6, 1, 5)], "module string, declarations long, public_surface long, dependencies long")
    first = ledger.append(spark, at, {"started_at": 1, "modules": 2}, findings, metrics, evidence="{}")
    second = ledger.append(spark, at, {"started_at": 2}, findings.limit(0), metrics.limit(0))
    assert (first, second) == (1, 2) and [r["id"] for r in ledger.last_runs(ledger.read(spark, at, "runs"), 1).collect()] == [2]
    assert ledger.chronology(spark, at, 1).count() == 1 and ledger.chronology(spark, at, 2).count() == 0
    (totals,) = ledger.run_totals(ledger.read(spark, at, "runs"), ledger.read(spark, at, "module_metrics"), ledger.read(spark, at, "diagnostics")).collect()
    assert (totals["run_id"], totals["declarations"], totals["public_surface"], totals["ratio"], totals["largest_fan_out"], totals["by_rule"]) == (1, 10, 3, 0.3, 5, {"HL101": 2, "HL107": 1})
    # Rows of a run that was never finished aren't read.
    spark.createDataFrame([(9, "HL1")], "run_id long, rule string").select("run_id", "rule", *[F.lit(None).cast(t).alias(c) for c, t in [x.strip().split() for x in ledger.DIAGNOSTICS.split(",")][2:]]).write.mode("append").parquet(f"{at}/diagnostics")
    assert ledger.read(spark, at, "diagnostics").count() == 3
    ledger.write_baseline(metrics, spark.createDataFrame([("f", "s", 1)], "file string, signature string, allowed long"), at)
    assert ledger.read_baseline(spark, at, "modules").count() == 2 and ledger.read_baseline(spark, str(tmp_path / "none"), "modules") is None
    report = R.json_report(ledger.read(spark, at, "runs").withColumnRenamed("id", "run_id"), ledger.read(spark, at, "diagnostics"), ledger.read(spark, at, "module_metrics")).collect()
    told = {r["run_id"]: json.loads(r["report"]) for r in report}
    assert [x["rule"] for x in told[1]["diagnostics"]] == ["HL101", "HL101", "HL107"] and told[2]["diagnostics"] == [] and told[2]["metrics"] == []


def test_vectors_are_cached(spark):
    functions = spark.createDataFrame([("f", "h1", "x"), ("g", "h1", "x"), ("h", "h2", "yy")], "fn string, hash string, input string")
    cache = spark.createDataFrame([("m", "h1", [1.0, 0.0]), ("m", "old", [1.0, 1.0]), ("other", "h2", [1.0, 1.0])], "model string, hash string, vector array<double>")
    kept = ledger.refresh_cache(functions, cache, "m", 2, lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert {r["hash"]: r["vector"] for r in kept.collect()} == {"h1": [1.0, 0.0], "h2": [2.0, 1.0]}
    with pytest.raises(Exception, match="isn't valid"):
        ledger.refresh_cache(functions, cache, "m", 2, lambda texts: [[0.0, 0.0] for _ in texts]).collect()


def test_settings_of_a_file(tmp_path):
    assert config.load_settings(None) == config.load_settings(str(tmp_path / "none.json")) == config.Settings()
    (tmp_path / "s.json").write_text('{"disabled": ["HL107"], "weights": {"info": 0}}')
    told = config.load_settings(str(tmp_path / "s.json"))
    assert told.disabled == ("HL107",) and told.weights == {"error": 4, "smell": 2, "info": 0}


def test_names_of_rust(spark):
    rows = spark.createDataFrame([("src/lib.rs", "pub"), ("src/net/mod.rs", "pub(self)"), ("src/net/http.rs", None), ("a.rs", "pub(crate)")], "f string, v string")
    assert [tuple(r) for r in rows.select(P.rust_module(F.col("f")), P.is_public(F.col("v"))).collect()] == [("src", True), ("src/net", False), ("src/net/http", False), ("a", True)]


def test_ranks(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9, 0.8, 5, 2.0), ("a", "c", 0.9, 0.9, 5, 2.0), ("b", "c", 0.9, 0.9, 6, 1.0), ("a", "d", 0.9, 0.9, 5, 2.0)], "a string, b string, rate_a double, rate_b double, shared long, lift double")
    assert [(r["a"], r["b"]) for r in H.ranked(pairs).orderBy("rank").collect()] == [("b", "c"), ("a", "c"), ("a", "d"), ("a", "b")]
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("b", "c")], "src string, dst string")
    assert {(r["a"], r["b"]): r["dependency"] for r in H.direction(pairs, edges).collect()} == {("a", "b"): "both", ("a", "c"): "right-to-left", ("b", "c"): "left-to-right", ("a", "d"): "none"}


def test_reports(spark):
    found = {"A": spark.createDataFrame([("m", 1)], "module string, score int"), "B": spark.createDataFrame([("f",)], "file string")}
    rows = {r["rule"]: r for r in R.all_findings(found, {"B": "info"}).collect()}
    assert (rows["A"]["severity"], rows["A"]["file"], rows["B"]["severity"], rows["B"]["score"]) == ("error", None, "info", None)
    assert R.all_findings(found, {}, ["A"]).count() == 1
    for bad in (lambda: R.all_findings(found, {}, ["C"]), lambda: R.all_findings(found, {"A": "loud"}), lambda: R.all_findings(found, {}, ["A", "B"]), lambda: R.models({"x": None})):
        with pytest.raises(ValueError):
            bad()
    assert R.table_text(["Module", "#Ratio"], [["a", 1], ["b", "20%"]]) == "Module | Ratio\n--- | ---:\na | 1\nb | 20%\n"
    assert [r["model"] for r in R.models({"x": found["A"], "y": None, "z": found["B"]}).collect()] == ["x", "z"]
    names = spark.createDataFrame([("b",), ("B",), ("a",), ("\u00e4",)], "n string")
    assert [r["n"] for r in R.in_text_order(names, "n").collect()] == ["a", "\u00e4", "b", "B"]


def _plain_linkage(d, cut):
    clusters = {i: [i] for i in range(len(d))}
    merges, groups = [], None
    while len(clusters) > 1:
        gap, i, j = min((np.mean([d[x][y] for x in clusters[i] for y in clusters[j]]).round(9), i, j) for i in clusters for j in clusters if i < j)
        if groups is None and gap > cut:
            groups = list(clusters.values())
        new = clusters.pop(i) + clusters.pop(j)
        merges.append((i, j, gap, len(new)))
        clusters[len(d) + len(merges) - 1] = new
    label = {x: min(g) for g in groups or clusters.values() for x in g}
    return merges, [label[i] for i in range(len(d))]


@pytest.mark.parametrize("seed", range(6))
def test_linkage(seed):
    d = np.random.default_rng(seed).random((14, 14)).round(6)
    d = np.triu(d, 1) + np.triu(d, 1).T
    merges, label = linkage_of(d, 0.45)
    want, groups = _plain_linkage(d, 0.45)
    assert label == groups
    assert [(i, j, s) for i, j, _, s in merges] == [(i, j, s) for i, j, _, s in want] and np.allclose([m[2] for m in merges], [m[2] for m in want])


def test_linkage_ties():
    assert linkage_of(1.0 - np.eye(4), 1.0) == ([(0, 1, 1.0, 2), (2, 3, 1.0, 2), (4, 5, 1.0, 4)], [0, 0, 0, 0])
    assert linkage_of(1.0 - np.eye(4), 0.9)[1] == [0, 1, 2, 3]


def test_linkage_refuses():
    for d, cut in (([[0, np.inf], [np.inf, 0]], 1), ([[0, -1.0], [-1.0, 0]], 1), ([[0, 1.0], [1.0, 0]], -1), ([[0, np.nan], [np.nan, 0]], 1)):
        with pytest.raises(ValueError):
            linkage_of(np.array(d), cut)
    assert linkage_of(np.zeros((0, 0)), 1) == ([], []) and linkage_of(np.zeros((1, 1)), 1) == ([], [0])
