"""Connected components of undirected edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop_staged, staged


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """node, component (its smallest node) for every node of an edge.

    Alternates large-star and small-star steps, as joins with each node's smallest neighbour, so no neighbourhood is ever gathered
    in one place; the rounds grow with the logarithm of the longest path. Each round is a written table."""
    current = staged(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct(), "components")
    state = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        following = staged(small.where("u <> v").distinct(), "components")
        drop_staged(current)
        current = following
        seen = current.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    found = current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    return found.unionByName(roots)
