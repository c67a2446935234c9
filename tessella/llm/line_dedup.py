"""Lines that several documents share, kept only where they occur first. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, lower_ascii, staged

#: A line with more than this share of the rows of shared lines is dealt to so many parts.
HOT, PARTS = 1 / 2048, 256


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def _with_first(hashed: DataFrame, shared: DataFrame) -> DataFrame:
    """Join each line with the smallest document that holds it. Lines that hold more than HOT of all rows, of which there are fewer than
    1 / HOT, are known to all tasks and dealt to many of them."""
    bar = HOT * (shared.agg(F.sum("__ld_n").alias("n")).first()["n"] or 0)
    key = ["__ld_h1", "__ld_h2"]
    hot = shared.where(F.col("__ld_n") > bar).select(*key, F.lit(PARTS).alias("__ld_parts"))
    parts = F.coalesce("__ld_parts", F.lit(1))
    dealt = hashed.join(F.broadcast(hot), key, "left").withColumn("__ld_part", F.pmod(F.xxhash64("__ld_id", "__ld_pos"), parts).cast("int")).drop("__ld_parts")
    copied = shared.join(F.broadcast(hot), key, "left").select(*key, "__ld_first", F.explode(F.sequence(F.lit(0), parts - 1)).alias("__ld_part"))
    return dealt.join(copied, [*key, "__ld_part"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop lines whose key (`line_key`) has at least `min_chars` code points and is found in at least `min_docs`
    documents, except in the smallest document that holds it.

    Returns the columns of `docs`, the text without those lines, and n_lines (before), n_dropped. Lines are split at
    \\n; keys are compared by 128 hash bits.

    Cases: a null or empty text is one empty line and stays as it is; a text that loses all lines becomes empty. Rows
    of one id are one document, so a line repeated within it isn't shared; each of such rows is cleaned by itself. Rows with a
    null id count as no document and lose nothing. Input columns n_lines and n_dropped are replaced; names that start
    with `__ld_` are reserved.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row_key = F.xxhash64(F.col(text_col))
    lines = docs.select(F.col(id_col).alias("__ld_id"), row_key.alias("__ld_row"), F.posexplode(F.split(text, "\n", -1)).alias("__ld_pos", "__ld_line"))
    key = line_key(F.col("__ld_line"))
    # Long lines only: short ones can't be dropped and never leave the scan.
    hashed = lines.withColumn("__ld_key", key).where(F.length("__ld_key") >= min_chars).select(
        "__ld_id", "__ld_row", "__ld_pos", F.xxhash64("__ld_key").alias("__ld_h1"), F.xxhash64(F.lit(1), "__ld_key").alias("__ld_h2")
    )
    hashed = staged(hashed, "line-hashes")
    # Sums before the shuffle: a line found everywhere is one row per task here.
    last = F.max("__ld_id").alias("__ld_last") if min_docs == 2 else F.count_distinct("__ld_id").alias("__ld_last")
    enough = F.col("__ld_first") < F.col("__ld_last") if min_docs == 2 else F.col("__ld_last") >= min_docs
    shared = staged(hashed.groupBy("__ld_h1", "__ld_h2").agg(F.min("__ld_id").alias("__ld_first"), last, F.count("*").alias("__ld_n")).where(enough).select("__ld_h1", "__ld_h2", "__ld_first", "__ld_n"), "shared-lines")
    dropped = (
        _with_first(hashed, shared)
        .where("__ld_id > __ld_first")
        .groupBy("__ld_id", "__ld_row")
        .agg(F.collect_set("__ld_pos").alias("__ld_drop"))
    )
    joined = docs.join(dropped, F.col(id_col).eqNullSafe(F.col("__ld_id")) & row_key.eqNullSafe(F.col("__ld_row")), "left")
    split = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__ld_drop"))
    cleaned = F.when(F.col("__ld_drop").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n"))
    own = [F.col(f"`{c}`") if c != text_col else cleaned.alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*own, F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("__ld_drop"), F.lit(0)).cast("long").alias("n_dropped"))
