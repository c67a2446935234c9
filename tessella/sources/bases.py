"""Axes that were fitted once and are kept: coordinates of later rows stay comparable, and what people call the axes is bound to them."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.similarity import principal_axes, second_moments

SCHEMA = "id string, model string, mean array<double>, axes array<array<double>>"


def basis_id(model: str, mean: np.ndarray, axes: np.ndarray) -> str:
    return hashlib.sha256(model.encode() + np.ascontiguousarray(mean, float).tobytes() + np.ascontiguousarray(axes, float).tobytes()).hexdigest()


def read_basis(spark: SparkSession, path: str) -> dict | None:
    """The basis kept at a path, or None."""
    try:
        row = spark.read.schema(SCHEMA).parquet(path).first()
    except AnalysisException:
        return None
    return row and {"id": row["id"], "model": row["model"], "mean": np.array(row["mean"]), "axes": np.array(row["axes"])}


def reference_basis(rows: DataFrame, vector: str, path: str, model: str, k: int = 2) -> dict:
    """The basis kept at `path`; fitted to `rows` and kept if there is none. Of two that fit at once, the first to write is kept and both get that one.

    A basis of another model, of another width, or whose axes aren't at right angles is an error: archive it and look at new axes."""
    spark = rows.sparkSession
    kept = read_basis(spark, path)
    if kept is None:
        found = principal_axes(rows, vector, k)
        row = (basis_id(model, found["mean"], found["axes"]), model, found["mean"].tolist(), found["axes"].tolist())
        try:
            spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("error").parquet(path)
        except AnalysisException:
            pass
        kept = read_basis(spark, path)
    width = len((rows.select(vector).first() or {vector: kept["mean"]})[vector])
    axes = kept["axes"]
    if kept["model"] != model or kept["mean"].shape != (width,):
        raise ValueError("the model or the width of its vectors has changed: archive the basis and look at new axes")
    if axes.shape[1:] != (width,) or not np.isfinite(axes).all() or not np.isfinite(kept["mean"]).all() or not np.allclose(axes @ axes.T, np.eye(len(axes)), atol=1e-5) or basis_id(model, kept["mean"], axes) != kept["id"]:
        raise ValueError("the kept basis isn't valid")
    return kept


def axis_variance(rows: DataFrame, vector: str, basis: Mapping) -> dict:
    """axes: the share of the rows' variance along each axis, about the rows' own mean; removed and retained: what taking the axes away takes and leaves."""
    _, _, cov = second_moments(rows, vector)
    total = max(float(np.trace(cov)), 1e-20)
    shares = [float(a @ cov @ a) / total for a in basis["axes"]]
    return {"axes": shares, "removed": sum(shares), "retained": 1 - sum(shares)}


def annotated(rows: DataFrame, coords: str, basis: Mapping, annotation: Mapping | None, labels: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """Rows with their coordinates turned as people read the axes, and the axes' labels; without an annotation both stay.

    annotation: {"basis": id, "axes": [{"label": text, "direction": 1 or -1}, ...]}; one that was made for another basis is refused."""
    if annotation is None:
        return rows, list(labels)
    if not isinstance(annotation, Mapping) or annotation.get("basis") != basis["id"]:
        raise ValueError("the annotation is of another basis: look at samples before naming its axes")
    axes = annotation.get("axes")
    fine = isinstance(axes, list) and len(axes) == len(basis["axes"]) and all(isinstance(a, Mapping) and isinstance(a.get("label"), str) and a["label"].strip() and type(a.get("direction", 1)) is int and a.get("direction", 1) in (1, -1) for a in axes)
    if not fine:
        raise ValueError("an annotation has a label and a direction of 1 or -1 for each axis")
    turned = F.zip_with(F.col(coords), F.array(*[F.lit(float(a.get("direction", 1))) for a in axes]), lambda x, d: x * d)
    return rows.withColumn(coords, turned), [a["label"] for a in axes]
