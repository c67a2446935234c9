"""The line budget: checks, checkpoints, and two writers."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import similarity as S
from tessella.sources.budget import Budget, BudgetError, BudgetLedger, budget_lines, run_budget

START = Budget(("src",), (".ts", ".rs"), 10, 4, ((20, "c0", "t0"),))


@pytest.fixture
def ledger(spark, tmp_path):
    ledger = BudgetLedger(spark, f"file://{tmp_path}/budget")
    ledger.write(0, START)
    return ledger


def texts(spark, lines):
    rows = [("src/a.ts", "x;\n" * lines + "// no\n\n"), ("src/b.rs", "/* a /* b */ */\nfn f() {}\n"), ("src/c.md", "x\n" * 99), ("other/d.ts", "x\n" * 99), ("srcs/e.ts", "x\n")]
    return spark.createDataFrame(rows, "file string, text string")


def test_check_and_advance(spark, ledger):
    assert budget_lines(texts(spark, 5), START) == 6
    told = run_budget(ledger, "check", texts(spark, 28))
    assert (told["total"], told["threshold"], told["refactor_target"]) == (29, 30, 26)
    with pytest.raises(BudgetError, match="reach the checkpoint of 30"):
        run_budget(ledger, "check", texts(spark, 29))
    assert run_budget(ledger, "advance-if-pending", texts(spark, 0))["pending"] is False
    with pytest.raises(BudgetError, match="26 lines or fewer"):
        run_budget(ledger, "advance", texts(spark, 26), lambda: ("c1", "t1"))
    with pytest.raises(BudgetError, match="clean"):
        run_budget(ledger, "advance", texts(spark, 25))
    assert run_budget(ledger, "advance", texts(spark, 25), lambda: ("c1", "t1"))["total"] == 26
    version, now = ledger.read()
    assert version == 2 and now.checkpoints[-1] == (30, "c1", "t1") and now.threshold == 40
    ledger.write(2, Budget(now.directories, now.extensions, 10, 4, now.checkpoints, override=33))
    assert run_budget(ledger, "advance-if-pending", texts(spark, 1), lambda: ("c2", "t2"))["threshold"] == 33
    assert ledger.read()[1].override is None and ledger.read()[1].checkpoints[-1][0] == 33
    with pytest.raises(BudgetError, match="use check"):
        run_budget(ledger, "grow", texts(spark, 1))


def test_the_second_of_two_writers_is_told(spark, ledger):
    version, now = ledger.read()
    assert ledger.write(version, now) == version + 1
    with pytest.raises(BudgetError, match="first"):
        ledger.write(version, Budget(("lib",), (".ts",), 1, 1, ((0, "", ""),)))
    assert ledger.read() == (version + 1, now)
    for bad in ({"growth": 0}, {"checkpoints": ()}, {"override": -1}, {"extensions": (1,)}):
        with pytest.raises(BudgetError):
            Budget(**({"directories": (), "extensions": (), "growth": 1, "reduction": 1, "checkpoints": ((0, "", ""),)} | bad))


def test_axes_and_what_they_leave(spark):
    """Principal axes against numpy, coordinates that stay as rows are added, and residuals without any part on the axes."""
    import numpy as np

    x = np.random.default_rng(3).normal(size=(200, 5)) * [5, 3, 1, 0.5, 0.1] + 7
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    basis = S.principal_axes(rows, "v")
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(np.abs(basis["axes"] @ vectors[:, ::-1][:, :2]), np.eye(2), atol=1e-6) and np.allclose(basis["share"], values[::-1][:2] / values.sum())
    before = {r["id"]: r["coords"] for r in S.project(rows, "v", basis).collect()}
    assert np.allclose([before[i] for i in range(200)], (x - x.mean(0)) @ basis["axes"].T)
    after = S.project(rows.unionByName(spark.createDataFrame([(999, [1.0] * 5)], "id long, v array<double>")), "v", basis).where("id < 999")
    assert {r["id"]: r["coords"] for r in after.collect()} == before
    left = np.array([r["residual"] for r in S.deflate(rows, "v", basis).orderBy(F.col("id")).collect()])
    assert np.abs(left @ basis["axes"].T).max() < 1e-8 and np.allclose(left.var(0).sum(), values[:3].sum())
