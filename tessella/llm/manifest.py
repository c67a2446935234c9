"""A Merkle tree over a dataset: a root for each source, one for all, and a proof for each row. DataFrame functions only.

Rows are numbered within their source, dealt to blocks of a fixed number of consecutive leaves, and each block's levels are collapsed
within one row; the blocks' roots are the leaves of the next round. Proofs come down the same way: a leaf's path is that within its
block, then that of the block's root, then that of the source's root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged, with_parameters

#: Children of a node, and levels that a block collapses: FANOUT ** LEVELS leaves each.
FANOUT, LEVELS = 3, 6
#: Rows of (group, partition) starts that are broadcast at most.
START_ROWS = 100_000
_PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text, 256)


def leaf_digest(*columns: Column) -> Column:
    """Digest of a row: each value as its number of bytes, a colon and itself, or `-` if null."""
    texts = [c.cast("string") for c in columns]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """`rows` with pos (from 0, within the group, by `order`) and n (rows of the group).

    Ranges of (group, order) are sorted and written with each row's place in its range; a row's number is then that place plus
    the rows of its group in earlier ranges, of which there is one count for each range and group that meet: no group is in one task."""
    kept = staged(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__mm_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__mm_at", 33)
    starts = kept.groupBy(F.col(group).alias("__mm_group"), part.alias("__mm_part")).agg(F.min("__mm_at").alias("__mm_first"), F.count("*").alias("__mm_n"))
    # A row for each range that a group meets: a group's rows stay far below a task's memory.
    ahead = "OVER (PARTITION BY __mm_group ORDER BY __mm_part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    starts = staged(starts.selectExpr("__mm_group", "__mm_part", f"__mm_first - (sum(__mm_n) {ahead} - __mm_n) AS __mm_zero", "sum(__mm_n) OVER (PARTITION BY __mm_group) AS n"), f"{name}-starts")
    on = F.col(group).eqNullSafe(F.col("__mm_group")) & (part == F.col("__mm_part"))
    joined = with_parameters(kept, starts, on, START_ROWS).withColumn("pos", F.col("__mm_at") - F.col("__mm_zero"))
    numbered = staged(joined.select(*rows.columns, "pos", "n"), f"{name}-numbers")
    drop_staged(kept, starts)
    return numbered


def _blocks(nodes: DataFrame, payload: list[str], fanout: int, depth: int) -> DataFrame:
    """Blocks of consecutive nodes (grp, pos, n, hash): grp, block, n, node (structs in order), spans, levels, root.

    `spans` are the numbers of leaves below a node at each level that has more than one node in its group: a group that fits one block
    collapses to its root, a larger one by `depth` levels everywhere."""
    size = fanout**depth
    spans = F.filter(F.array(*[F.lit(fanout**i) for i in range(depth)]), lambda x: x < F.col("n"))
    one = F.struct("pos", "hash", *payload)
    grouped = nodes.groupBy("grp", F.floor(F.col("pos") / size).alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(one)).alias("node")).withColumn("spans", spans)

    def up(level: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / fanout).cast("int"))
        return F.transform(runs, lambda i: digest(F.array_join(F.slice(level, i * fanout + 1, fanout), "")))

    leaves = F.array(F.transform("node", lambda x: F.lower(F.hex(x["hash"]))))
    levels = F.aggregate("spans", leaves, lambda done, _: F.concat(done, F.array(up(F.element_at(done, -1)))))
    return grouped.withColumn("levels", levels).withColumn("root", F.element_at(F.element_at("levels", -1), 1))


def _path(at: Column, fanout: int) -> Column:
    """The siblings of leaf `at` of a block (from 0) on each level: their digests to the left and to the right, joined."""

    def step(span: Column, level: Column) -> Column:
        i = F.floor(at / span).cast("int")
        own = i % fanout
        row = F.get("levels", level)
        return F.struct(F.array_join(F.slice(row, i - own + 1, own), "").alias("left"), F.array_join(F.slice(row, i + 2, fanout - 1 - own), "").alias("right"))

    return F.transform("spans", step)


def _tree(nodes: DataFrame, most: int, payload: list[str], fanout: int, depth: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of a forest, each as its blocks, and the roots: grp, hash. `most` is the largest number of nodes in a group."""
    rounds, size = [], fanout**depth
    while True:
        blocks = staged(_blocks(nodes, payload if not rounds else [], fanout, depth), f"{name}-blocks")
        rounds.append(blocks)
        if most <= size:
            return rounds, blocks.select("grp", F.unhex("root").alias("hash"))
        most = -(-most // size)
        nodes = blocks.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.unhex("root").alias("hash"))


def _paths(rounds: list[DataFrame], fanout: int) -> DataFrame:
    """The blocks of the first round with `above`: the path of each one's root."""
    above = None
    for blocks in reversed(rounds):
        if above is None:
            known = blocks.withColumn("above", F.array().cast(_PATH))
        else:
            known = blocks.join(above, (blocks["grp"].eqNullSafe(above["a_grp"])) & (blocks["block"] == above["a_block"])).drop("a_grp", "a_block")
        if blocks is not rounds[0]:
            nodes = known.select("grp", "above", "spans", "levels", F.posexplode("node").alias("i", "x"))
            above = nodes.select(F.col("grp").alias("a_grp"), F.col("x.pos").alias("a_block"), F.concat(_path(F.col("i"), fanout), "above").alias("above"))
    return known


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source", fanout: int = FANOUT, depth: int = LEVELS) -> DataFrame:
    """id, leaf, subroot, root, proof, folded_root for each row of `docs`.

    A leaf is the digest of a row's `columns` (`leaf_digest`); per group, leaves ascend by id and every `fanout` consecutive nodes,
    the last run with what is left, become the digest of their joined digests, until one is left: the subroot. Subroots, by group, give the root in the
    same way. `proof` is the path: the siblings' joined digests to the left and right, from the leaf up. `tampered`, if given, is a
    row's text as found later; `folded_root` is what the path makes of the leaf that it gives, or of the row's own.

    Cases: a null group is a group before all others; a null id comes first in its group; rows of one id are in the order of
    their leaves, so repeated rows have equal leaves and neighbouring places; nulls are `-` and differ from empty texts. One row alone in one group is leaf, subroot and root with
    an empty path. An empty table gives an empty result. Other columns are ignored.
    """
    if fanout < 2 or depth < 1:
        raise ValueError("a run has two nodes at least and a block one level")
    text = columns[-1]
    value = lambda c, other=None: F.col(f"`{c}`") if other is None or c != text else other
    leaf = leaf_digest(*[value(c) for c in columns])
    found = F.lit(None).cast("string") if tampered is None else leaf_digest(*[value(c, tampered) for c in columns])
    hashed = docs.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("grp"), F.unhex(leaf).alias("hash"), F.unhex(found).alias("found"))
    hashed = hashed.withColumn("found", F.when(F.col("found") != F.col("hash"), F.col("found")))
    leaves = _numbered(hashed, "grp", ["id", "hash", "found"], "leaf")
    most = leaves.agg(F.max("n").alias("n")).first()["n"] or 0
    rounds, subroots = _tree(leaves, most, ["id", "found"], fanout, depth, "leaf")
    tops = _numbered(subroots.withColumnRenamed("grp", "source").withColumn("grp", F.lit(0)), "grp", ["source"], "source")
    top_rounds, top = _tree(tops, tops.count(), ["source"], fanout, depth, "source")
    root = (top.first() or {"hash": b""})["hash"]
    above = _paths(top_rounds, fanout).select("above", "spans", "levels", F.posexplode("node").alias("i", "x"))
    above = above.select(F.col("x.source").alias("t_grp"), F.lower(F.hex("x.hash")).alias("subroot"), F.concat(_path(F.col("i"), fanout), "above").alias("top"))
    blocks = with_parameters(_paths(rounds, fanout), staged(above, "source-paths"), F.col("grp").eqNullSafe(F.col("t_grp")))
    rows = blocks.select("spans", "levels", "above", "top", "subroot", F.posexplode("node").alias("i", "x"))
    rows = rows.select(F.col("x.id").alias("id"), F.lower(F.hex("x.hash")).alias("leaf"), "subroot", F.lower(F.hex("x.found")).alias("found"), F.concat(_path(F.col("i"), fanout), "above", "top").alias("proof"))
    folded = F.aggregate("proof", F.coalesce("found", "leaf"), lambda node, s: digest(F.concat(s["left"], node, s["right"])))
    drop_staged(leaves, tops)
    return rows.select(F.col("id").alias(id_col), "leaf", "subroot", F.lit(root.hex()).alias("root"), "proof", folded.alias("folded_root"))


def proof_text(proof: Column) -> Column:
    """A path's digests, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")
