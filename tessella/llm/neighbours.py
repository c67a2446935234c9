"""Approximate nearest neighbours by cross-polytope hashing, with exact reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, with_parameters

#: Hash tables, each with its own rotation.
TABLES = 8
SEED = 11
#: Vectors of a bucket that one task compares; larger buckets are split and their queries sent to every part.
BLOCK = 4096
#: The number of probes is fitted on about so many vectors, with so many of them as queries, for this recall in the sample.
SAMPLE, SAMPLE_QUERIES, GOAL = 4096, 256, 0.95


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows; their length is a power of two."""
    n = x.shape[1]
    h = 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(unit: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Pseudo-rotation: three rounds of random signs and a Hadamard transform."""
    width = 1 << max(0, unit.shape[1] - 1).bit_length()
    x = np.zeros((len(unit), width))
    x[:, : unit.shape[1]] = unit
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = _hadamard(x * s)
    return x


def _scores(vectors: np.ndarray, tables: int) -> np.ndarray:
    """How far each row reaches along the signed axes of all tables: 2 * axis, + 1 for the negative direction, table after table."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = [rotated(unit, t) for t in range(tables)]
    return np.concatenate([np.stack([x, -x], 2).reshape(len(x), -1) for x in turned], 1)


def buckets(vectors: np.ndarray, tables: int) -> np.ndarray:
    """The nearest signed axis of each row in each table, as numbers that run through all tables."""
    x = _scores(vectors, tables)
    width = x.shape[1] // tables
    return x.reshape(len(x), tables, width).argmax(2) + np.arange(tables) * width


def probes_of(vectors: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """The `probes` signed axes of any tables that each row is nearest to, nearest first."""
    return np.argsort(-_scores(vectors, tables), axis=1, kind="stable")[:, :probes]


def fitted_probes(vectors: np.ndarray, tables: int, k: int, goal: float = GOAL, queries: int = SAMPLE_QUERIES) -> int:
    """The fewest probes with which the first of `vectors`, as queries, find the share `goal` of their `k` nearest among all of them."""
    if len(vectors) < 2:
        return 1
    asked = vectors[:queries]
    far = (vectors * vectors).sum(1)[None] - 2 * asked @ vectors.T
    far[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    k = min(k, len(vectors) - 1)
    near = np.argpartition(far, k - 1, axis=1)[:, :k]
    order = probes_of(asked, tables, tables * 2 * (1 << max(0, vectors.shape[1] - 1).bit_length()))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], 1)
    # A neighbour is found with the first probe that is a bucket of it.
    first = np.take_along_axis(place, buckets(vectors, tables)[near].reshape(len(asked), -1), 1).reshape(len(asked), k, tables).min(2)
    return int(np.sort(first.ravel())[int(np.ceil(goal * first.size)) - 1]) + 1


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _bucketed(rows: DataFrame, names: list[str], choose: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """One row per chosen bucket: size, bucket, the columns `names`, vector."""
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, some in batch.groupby(batch["vector"].str.len()):
                for at in range(0, len(some), 1024):
                    part = some.iloc[at : at + 1024]
                    found = choose(np.stack(part["vector"].to_numpy()))
                    of = np.repeat(np.arange(len(part)), found.shape[1])
                    yield pd.DataFrame({"size": np.int32(size), "bucket": found.ravel().astype(np.int32), **{n: part[n].to_numpy()[of] for n in names}, "vector": part["vector"].to_numpy()[of]})

    return rows.select(*names, "vector").mapInPandas(run, f"size int, bucket int, {kinds}, vector array<double>")


def fit_probes(unique: DataFrame, k: int, tables: int, sample: int = SAMPLE) -> int:
    """Probes for a table of distinct vectors (cid, vector): fitted on about `sample` vectors of each length, taken by hash, and the most of any length.

    A query's k nearest of all vectors correspond to fewer of the sample, so as many fewer are to be found there."""
    sizes = unique.groupBy(F.size("vector").alias("of")).agg(F.count("*").alias("n"))
    share = F.lit(float(sample)) / F.col("n")
    chosen = unique.withColumn("of", F.size("vector")).join(sizes, "of").where(F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) < share * (1 << 30)).select("of", "n", "vector")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["vector"].to_numpy())
        x = x[np.lexsort(x.T)]
        x = x[np.random.default_rng(SEED).permutation(len(x))]
        return pd.DataFrame({"probes": [fitted_probes(x, tables, max(1, round(k * len(x) / int(rows["n"].iloc[0]))))]})

    return chosen.groupBy("of").applyInPandas(fit, "probes int").agg(F.max("probes").alias("probes")).first()["probes"] or 1


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probes: int | None = None) -> DataFrame:
    """query_id, rank, <id_col>, score: the `k` nearest rows of `vectors` found for each row of `queries`, by Euclidean distance on the original
    vectors in double precision, ties to the smaller id; a row with the query's own id is left out.

    Equal vectors are one candidate with its k + 1 smallest ids. Unit vectors go to the nearest signed axis of each table's rotation;
    queries probe the nearest axes of any table, `probes` in all: if none are given, as many as a bounded sample needs (`fit_probes`). A bucket's queries meet
    its vectors in blocks, and only the best of each block go on.

    Cases: vectors that are null, empty, zero, or hold nulls or non-finite components take no part, on either side; vectors of
    different lengths have no distance and never meet; repeated ids are rows of their own; empty tables give an empty result.
    """
    def clean(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("vector")).where(_usable(F.col("vector")))

    valid, asked = clean(vectors), clean(queries).withColumnRenamed("id", "query")
    key = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")]
    same = Window.partitionBy("h1", "h2")
    first = valid.select("id", "vector", *key).withColumn("rn", F.row_number().over(same.orderBy("id"))).where(F.col("rn") <= k + 1)
    members = staged(first.withColumn("cid", F.min("id").over(same)).select("cid", "h2", "id", "rn", F.when(F.col("rn") == 1, F.col("vector")).alias("vector")), "ann-classes")
    unique = members.where("rn = 1").select("cid", "h2", "vector")
    chosen = fit_probes(unique, k, tables) if probes is None else probes
    index = staged(_bucketed(unique, ["cid", "h2"], lambda x: buckets(x, tables)), "ann-index")
    probing = _bucketed(asked, ["query"], lambda x: probes_of(x, tables, chosen))
    parts = index.groupBy("size", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).select(F.col("size").alias("ps"), F.col("bucket").alias("pb"), "parts")
    at = (F.col("size") == F.col("ps")) & (F.col("bucket") == F.col("pb"))
    dealt = with_parameters(index, parts, at, how="inner").select("size", "bucket", F.pmod(F.xxhash64("cid"), "parts").cast("int").alias("part"), "cid", "h2", "vector")
    sent = with_parameters(probing, parts, at, how="inner").select("size", "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query", "vector")
    id_type = vectors.schema[id_col].dataType.simpleString()

    def compare(block: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(asking):
            block = block.sort_values("cid", kind="stable")
            x, ids, keys = np.stack(block["vector"].to_numpy()), block["cid"].to_numpy(), block["h2"].to_numpy()
            norms = (x * x).sum(1)
            for start in range(0, len(asking), 256):
                some = asking.iloc[start : start + 256]
                q = np.stack(some["vector"].to_numpy())
                rough = norms[None] - 2 * q @ x.T
                top = np.argsort(rough, axis=1, kind="stable")[:, : 2 * (k + 1)]
                for i, query in enumerate(some["query"].to_numpy()):
                    exact = np.sqrt(((x[top[i]] - q[i]) ** 2).sum(1))
                    best = np.lexsort((ids[top[i]], exact))[: k + 1]
                    out.append(pd.DataFrame({"query": query, "cid": ids[top[i]][best], "h2": keys[top[i]][best], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "cid": [], "h2": [], "score": []})

    keys = ["size", "bucket", "part"]
    met = dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(compare, f"query {id_type}, cid {id_type}, h2 long, score double")
    rank = lambda by: F.row_number().over(Window.partitionBy("query").orderBy("score", by))
    # A class is known by its smallest id and a hash of its vector, as an id may repeat with other vectors.
    classes = met.distinct().withColumn("rn", rank("cid")).where(F.col("rn") <= k + 1).drop("rn")
    rows = classes.join(members.select("cid", "h2", "id"), ["cid", "h2"]).where(F.col("id") != F.col("query"))
    ranked = rows.withColumn("rank", rank("id")).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
