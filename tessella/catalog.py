"""Registered queries of the library's own operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import calls, clones, fixes, graph, metrics, reports, rust, similarity, sources, text  # noqa: F401
from .plans.base import ORACLES, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules by weighted score."""
    return metrics.scores(spark, sf_dir, 90)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
