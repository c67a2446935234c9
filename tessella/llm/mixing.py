"""Mixing sources to target weights by hash thresholds, without sorting documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, drop_staged, staged, with_parameters

#: The hash key has LEVELS * BITS bits; each level refines the boundary bucket of the one before.
BITS = 12
LEVELS = 4


def hash_key(id_col: str, text_col: str) -> Column:
    """A uniform number from 0 to 2**48 - 1; rows that are equal in id and text stand or fall together."""
    return F.xxhash64(id_col, text_col).bitwiseAND(F.lit((1 << (BITS * LEVELS)) - 1))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of a table (source, size).

    Sources in code-point order, null last, get the weights in turn and share `share` times the total size. No target exceeds
    `most` times its source's size; what is over goes to the others by weight. Sorted by size over weight, the full
    sources come first, so running sums give the one level at which the rest is shared.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order, level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weigh).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    left = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The first source that isn't full has the level at which all others are filled.
    found = ranked.withColumn("left", left)
    found = found.withColumn("water", F.min(F.when(F.col("ratio") >= F.col("left"), F.struct("ratio", "left"))).over(whole)["left"])
    return found.select("source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight"))).cast("double").alias("target"))


def thresholds(keyed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, full, threshold: each document is taken `full` times, and once more where its key is below the threshold.

    `keyed` has source, size, key. Sizes are summed by source and bucket of the key's first bits; running sums find the bucket in
    which the budget ends; only that bucket's rows are summed again by their next bits. The last bucket goes in whole if that
    comes nearer to the target."""
    size, target = F.col("source_size"), F.col("target")
    full = F.when(size > 0, F.floor(target / size)).otherwise(F.lit(0)).cast("long")
    state = targets.withColumn("full", full).withColumn("rest", target - F.col("full") * size).withColumn("prefix", F.lit(0).cast("long"))
    for depth in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - depth)
        part = state.select(F.col("source").alias("of"), "prefix")
        rows = keyed
        if depth > 1:
            # Only the rows of the boundary buckets: a 4096th of what the level before has read.
            here = F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("key", shift + BITS) == F.col("prefix"))
            rows = with_parameters(keyed, part, here, how="inner")
        sums = rows.groupBy("source", F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").cast("double").alias("mass"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        ends = sums.withColumn("upto", F.sum("mass").over(running)).withColumnRenamed("source", "of")
        # The first bucket whose running sum passes the budget; none if the budget takes all.
        crossing = (
            ends.join(state.select(F.col("source").alias("s"), "rest"), F.col("of").eqNullSafe(F.col("s")))
            .where(F.col("upto") > F.col("rest"))
            .groupBy("of")
            .agg(F.min_by(F.struct("bucket", "mass", "upto"), "bucket").alias("cross"))
        )
        joined = state.join(crossing, F.col("source").eqNullSafe(F.col("of")), "left")
        cross = F.col("cross")
        last = depth == LEVELS
        nearer = (cross["upto"] - F.col("rest") < F.col("rest") - (cross["upto"] - cross["mass"])) & (F.col("rest") > 0)
        ending = F.when(cross.isNull(), F.shiftleft(F.col("prefix") + 1, BITS) if depth > 1 else F.lit(1 << BITS).cast("long")).otherwise(cross["bucket"] + (nearer.cast("long") if last else F.lit(0)))
        rest = F.when(cross.isNull(), F.lit(-1.0) if not last else F.col("rest")).otherwise(F.col("rest") - (cross["upto"] - cross["mass"]))
        # A source whose budget ends beyond its last bucket is done: no later level finds rows under that prefix.
        state = staged(joined.select("source", "source_size", "target", "full", rest.alias("rest"), ending.alias("prefix")), f"mix-level{depth}")
    more = F.col("target") > F.col("full") * F.col("source_size")
    return state.select("source", "source_size", "target", "full", F.when(more, F.col("prefix")).otherwise(F.lit(0)).alias("threshold"))


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes (id, source, size, key), and the plan (see `thresholds`)."""
    keyed = staged(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"), hash_key(id_col, text_col).alias("key")), "mix-sizes")
    return keyed, thresholds(keyed, staged(source_targets(keyed, weights, share, most), "mix-targets"))


def _copies() -> Column:
    return F.col("full") + (F.col("key") < F.col("threshold")).cast("long")


def mix_counts(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row of `docs`: id, size, source_size, target (its source's), copies, taken (words, repeats counted).

    Cases: null texts have size 0; a null source is a source of its own, last in order; sources without words have target 0 and
    no copies; rows equal in id and text get equal copies; an empty table gives an empty result. Other columns are ignored."""
    keyed, plan = plan_mix(docs, id_col, **options)
    joined = with_parameters(keyed, plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", _copies().alias("copies"), (_copies() * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it. Columns stay; names that start with `__mx_` are reserved."""
    keyed, plan = plan_mix(docs, id_col, text_col, source_col, **options)
    drop_staged(keyed)
    plan = plan.select(F.col("source").alias("__mx_of"), F.col("full").alias("__mx_full"), F.col("threshold").alias("__mx_upto"))
    joined = with_parameters(docs, plan, F.col(source_col).eqNullSafe(F.col("__mx_of")))
    copies = (F.col("__mx_full") + (hash_key(id_col, text_col) < F.col("__mx_upto")).cast("long")).cast("int")
    return joined.withColumn("__mx_copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*[F.col(f"`{c}`") for c in docs.columns])
