"""Axes that are kept: the same ones for later rows, refused for other models, and named only for what they were looked at."""

import numpy as np
import pytest

from tessella.operators.similarity import deflate, project
from tessella.sources.bases import annotated, axis_variance, read_basis, reference_basis


def test_a_kept_basis(spark, tmp_path):
    path = f"file://{tmp_path}/basis"
    x = np.random.default_rng(5).normal(size=(150, 4)) * [4, 2, 1, 0.5]
    frame = lambda a: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, v array<double>")
    rows = frame(x)
    assert read_basis(spark, path) is None
    first = reference_basis(rows, "v", path, "model-1")
    later = reference_basis(frame(x[:50] * 3 + 1), "v", path, "model-1")
    assert later["id"] == first["id"] and (later["axes"] == first["axes"]).all() and (later["mean"] == first["mean"]).all()
    told = axis_variance(rows, "v", first)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(told["axes"], values[:2] / values.sum()) and np.isclose(told["removed"] + told["retained"], 1)
    left = np.array([r["residual"] for r in deflate(rows, "v", first).collect()])
    assert np.isclose(left.var(0).sum() / x.var(0).sum(), told["retained"])
    for model, other in (("model-2", rows), ("model-1", frame(x[:, :3]))):
        with pytest.raises(ValueError, match="changed"):
            reference_basis(other, "v", path, model)
    spark.createDataFrame([("bad", "m", [0.0] * 4, [[1.0, 1.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]])], "id string, model string, mean array<double>, axes array<array<double>>").write.parquet(path + "-bad")
    with pytest.raises(ValueError, match="valid"):
        reference_basis(rows, "v", path + "-bad", "m")


def test_names_of_axes(spark, tmp_path):
    rows = spark.createDataFrame([(1, [3.0, 1.0]), (2, [1.0, 5.0]), (3, [0.0, 0.5])], "id long, v array<double>")
    basis = reference_basis(rows, "v", f"file://{tmp_path}/basis", "m")
    placed = project(rows, "v", basis)
    plain = {r["id"]: r["coords"] for r in placed.collect()}
    same, labels = annotated(placed, "coords", basis, None, ("first", "second"))
    assert labels == ["first", "second"] and {r["id"]: r["coords"] for r in same.collect()} == plain
    turned, labels = annotated(placed, "coords", basis, {"basis": basis["id"], "axes": [{"label": "size"}, {"label": "age", "direction": -1}]}, ("a", "b"))
    assert labels == ["size", "age"] and {r["id"]: r["coords"] for r in turned.collect()} == {k: [x, -y] for k, (x, y) in plain.items()}
    for bad in ({"basis": "other", "axes": []}, {"basis": basis["id"], "axes": [{"label": "one"}]}, {"basis": basis["id"], "axes": [{"label": " "}, {"label": "b"}]}, {"basis": basis["id"], "axes": [{"label": "a", "direction": True}, {"label": "b"}]}):
        with pytest.raises(ValueError):
            annotated(placed, "coords", basis, bad, ("a", "b"))
