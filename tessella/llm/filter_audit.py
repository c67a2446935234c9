"""How filters of a corpus overlap, in whatever order they are applied. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged, words

#: Filters of one audit; the orders are the factorial of their number.
MAX_FILTERS = 7


def text_filters(min_words: int = 200, distinct_percent: int = 50, upper_percent: int = 3, symbols: str = "[#$%&*|]") -> dict[str, Column]:
    """Failure conditions A to D over a column `text` that isn't null and its `words`."""
    count = F.size("words")
    return {
        "A": count < min_words,
        "B": 100 * F.size(F.array_distinct("words")) < distinct_percent * count,
        "C": 100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > upper_percent * F.length("text"),
        "D": F.col("text").rlike(symbols),
    }


def _masks(docs: DataFrame, filters: dict[str, Column], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """id, part, mask of the text's own failures and a digest of the text: all that leaves the scan of the texts."""
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = [F.when(F.coalesce(fails, F.lit(False)), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    mask = reduce(lambda x, y: x.bitwiseOR(y), bits, F.lit(0))
    return plain.withColumn("words", words(F.col("text"))).select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def mask_histogram(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents of a part by the set of filters that they fail, at most 2 ** filters cells a part.

    Bit i of a mask is filter i of `filters`; the bit after them is that of copies, failed by rows whose text a smaller id has too.
    The smallest id of a text is found by grouping digests, and each row is joined with the smallest row of its text by digest and
    id together, so copies of one text meet in no join."""
    rows = staged(_masks(docs, filters, id_col, text_col, part_col), "audit-masks")
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    rated = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    found = rows.join(first, ["digest", "id"], "left").join(rated, "id", "left")
    copy = F.when(F.col("id").isNull() | F.col("first"), 0).otherwise(1 << len(filters))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    cells = staged(found.groupBy("part", F.col("mask").bitwiseOR(copy).alias("mask")).agg(F.count("*").alias("n"), count("good"), count("toxic")), "audit-cells")
    drop_staged(rows)
    return cells


def filter_orders(cells: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, from the cells alone.

    One row for each part, each order of `letters` (bit i of a mask is letter i) and each step of it. What a filter removes,
    summed over all orders, needs no orders: of a cell that fails k filters each of them is the first in 1/k of the orders."""
    if not 1 <= len(letters) <= MAX_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"from one to {MAX_FILTERS} different filters can be audited")
    orders = ["".join(p) for p in permutations(letters)]
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = parts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    place = [F.instr("filter_order", x) for x in letters]
    bits = lambda at: reduce(add, [F.when(at(p), 1 << i).otherwise(0) for i, p in enumerate(place)])
    steps = steps.select("part", "cells", "filter_order", "step", bits(lambda p: p == F.col("step")).alias("own"), bits(lambda p: p < F.col("step")).alias("before"))
    tally = lambda of, when: F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(when(c["mask"]), c[of]).otherwise(0))
    own, before = F.col("own"), F.col("before")
    fails, open_ = lambda m: m.bitwiseAND(own) != 0, lambda m: m.bitwiseAND(before) == 0
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(fails(c["mask"]), c["n"] * (len(orders) / F.bit_count(c["mask"])).cast("long")).otherwise(0))
    return steps.select(
        "part",
        "filter_order",
        "step",
        tally("n", lambda m: open_(m) & ~fails(m)).alias("kept"),
        tally("n", lambda m: open_(m) & fails(m)).alias("removed"),
        tally("n", lambda m: ~open_(m) & fails(m)).alias("redundant"),
        tally("n", lambda m: m == own).alias("unique_fails"),
        tally("good", lambda m: open_(m) & fails(m)).alias("good_lost"),
        tally("toxic", lambda m: open_(m) & fails(m)).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What each filter removes at each step of every order of the filters, per part, zeros included (`filter_orders`).

    `filters` are failure conditions over `text` and `words`; by default those of `text_filters`. `copies` names the filter of
    exact copies: rows whose text a smaller id has, in whatever part and whether or not another filter removes that row.

    Cases: a null text is empty, equal to an empty one; a null part is the empty string's; a condition that is null isn't failed.
    Repeated rows count one by one and aren't each other's copies, as their id isn't smaller; a row with a null id is nobody's copy
    and makes no copies. Where labels repeat an id, one label that says so is enough; ids without labels are neither good nor toxic. An empty
    table has no parts and gives no rows. Other columns are ignored.
    """
    filters = text_filters() if filters is None else filters
    if not 1 <= len(filters) < MAX_FILTERS:
        raise ValueError(f"from one to {MAX_FILTERS - 1} filters beside that of copies can be audited")
    return filter_orders(mask_histogram(docs, labels, filters, id_col, text_col, part_col), "".join(filters) + copies)
