"""Append-only record of runs, baselines, and the cache of embedding vectors, as Parquet and JSON tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.similarity import valid_vector

RUNS = "id long, started_at long, duration_ms long, revision string, modules long, diagnostics long, errors long, smells long"
DIAGNOSTICS = "run_id long, rule string, severity string, module string, file string, line int, message string, score double"
METRICS = "run_id long, module string, declarations long, public_surface long, public_surface_ratio double, dependencies long, dependents long, cross_module_references long, referenced_contracts long"
CHRONOLOGY = "run_id long, evidence_json string"
TABLES = {"diagnostics": DIAGNOSTICS, "module_metrics": METRICS, "chronology": CHRONOLOGY, "runs": RUNS}


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the ledger; empty before the first run. Columns that older rows don't have are null: unknown, not zero."""
    schema = T._parse_datatype_string(TABLES[name])
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{path}/{name}")
    return rows if name == "runs" else rows.join(read(spark, path, "runs").select(F.col("id").alias("run_id")), "run_id", "left_semi")


def append(spark: SparkSession, path: str, run: dict, diagnostics: DataFrame, metrics: DataFrame, evidence: str | None = None) -> int:
    """Add one run. Its own row is written last: rows of a run without it are never read, so a run is there whole or not at all."""
    last = read(spark, path, "runs").agg(F.max("id")).first()[0] or 0
    run_id = max(last + 1, run.get("id", 0))

    def put(df: DataFrame, name: str) -> None:
        fields = T._parse_datatype_string(TABLES[name]).fields
        have = set(df.columns)
        row = [F.lit(run_id).alias("run_id") if f.name == "run_id" else (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
        df.select(*row).write.mode("append").parquet(f"{path}/{name}")

    put(diagnostics, "diagnostics")
    put(metrics, "module_metrics")
    if evidence is not None:
        put(spark.createDataFrame([(evidence,)], "evidence_json string"), "chronology")
    put(spark.createDataFrame([{**{f.name: None for f in T._parse_datatype_string(RUNS).fields}, **run, "id": run_id}], RUNS), "runs")
    return run_id


def last_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(n)


def chronology(spark: SparkSession, path: str, run_id: int) -> DataFrame:
    return read(spark, path, "chronology").where(F.col("run_id") == run_id)


def run_totals(runs: DataFrame, metrics: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Per run that has metrics: totals, the overall ratio (null without declarations), the largest fan-out, diagnostics by rule."""
    sums = metrics.groupBy("run_id").agg(
        F.sum("declarations").alias("declarations"), F.sum("public_surface").alias("public_surface"),
        F.try_divide(F.sum("public_surface").cast("double"), F.nullif(F.sum("declarations"), F.lit(0))).alias("ratio"), F.coalesce(F.max("dependencies"), F.lit(0)).alias("largest_fan_out"),
    )
    counted = diagnostics.groupBy("run_id", "rule").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule", "n")))).alias("by_rule"))
    return runs.select(F.col("id").alias("run_id"), "started_at").join(sums, "run_id").join(counted, "run_id", "left")


def write_baseline(metrics: DataFrame, styles: DataFrame, path: str) -> None:
    """Public surface per module and allowed inline styles, each written whole."""
    metrics.select("module", "public_surface").write.mode("overwrite").json(f"{path}/modules")
    styles.select("file", "signature", "allowed").write.mode("overwrite").json(f"{path}/inline_styles")


def read_baseline(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    schema = {"modules": "module string, public_surface long", "inline_styles": "file string, signature string, allowed long"}[name]
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).json(f"{path}/{name}") if there else None


def cached_vectors(functions: DataFrame, cache: DataFrame, model: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Functions with their valid cached vectors, and the distinct contents (hash, input) that the cache lacks."""
    fine = cache.where((F.col("model") == model) & valid_vector(F.col("vector"), size)).select("hash", "vector")
    hits = functions.join(fine, "hash")
    misses = functions.join(fine.select("hash"), "hash", "left_anti").select("hash", "input").dropDuplicates(["hash"])
    return hits, misses


def refresh_cache(functions: DataFrame, cache: DataFrame, model: str, size: int, embed: Callable[[list[str]], list[list[float]]], batch: int = 16) -> DataFrame:
    """The cache that serves these functions: kept vectors of contents still in use, and new ones by `embed`, in batches within tasks."""
    hits, misses = cached_vectors(functions, cache, model, size)

    def run(frames):
        import pandas as pd

        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = embed(list(part["input"]))
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} inputs")
                yield pd.DataFrame({"hash": part["hash"].to_numpy(), "vector": list(vectors)})

    new = misses.mapInPandas(run, "hash string, vector array<double>").where(valid_vector(F.col("vector"), size) | F.raise_error(F.lit("a vector that isn't valid")).isNull())
    kept = hits.select("hash", "vector").dropDuplicates(["hash"])
    return kept.unionByName(new).select(F.lit(model).alias("model"), "hash", "vector")
