"""Near copies by fingerprints that differ in a few bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import drop_staged, small_batches, staged

WIDTH, SEED = 3, 42
#: Bits of a half, and bits in which linked fingerprints differ at most.
HALF, RADIUS = 32, 3
#: Rows of halves that a task looks at together, and variants that it holds at once.
CHUNK_ROWS, CHUNK_VARIANTS = 20_000, 4_000_000
#: Hashes whose bits are counted at once.
PIECE = 1 << 15
#: A fingerprint with more than this share of all rows is known to every task; there are fewer than 1 / HOT of them.
HOT = 1 / 2048


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Per bit the majority of a text's shingle hashes; 0 without words. Shingles are joined by one space, repeats counted."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [words] if len(words) < width else zip(*[words[i:] for i in range(width)])
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(run), SEED) for run in runs), np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        votes += np.unpackbits(hashes[at : at + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the fingerprint's bits as a long) of every row."""
    small_batches(docs.sparkSession)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "fp"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(describe, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _halves(prints: DataFrame) -> DataFrame:
    """key, fp, own: each fingerprint under the variants of its two halves, within half the radius (one bit).

    A key is a half's 32 bits and the half's number. Two fingerprints within three bits agree in a half but for one bit at most, so one of them
    is found under the other's own half. Only one way is needed: where the numbers of ones are odd and even, the even one
    goes to the odd one; otherwise the one whose bit is 0 goes to the one whose bit is 1."""
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", HALF)
    even = F.bit_count("fp") % 2 == 0

    def keys(half: Column, side: int) -> Column:
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
        sent = F.filter(F.sequence(F.lit(0), F.lit(HALF - 1)), lambda i: even | (half.bitwiseAND(bit(i)) == 0))
        key = lambda h: F.shiftleft(h, 1).bitwiseOR(side)
        return F.concat(F.array(F.struct(key(half).alias("key"), F.lit(True).alias("own"))), F.transform(sent, lambda i: F.struct(key(half.bitwiseXOR(bit(i))).alias("key"), F.lit(False).alias("own"))))

    return prints.select("fp", F.explode(F.concat(keys(low, 0), keys(high, 1))).alias("x")).select("x.key", "fp", "x.own")


_ONE = np.uint64(1) << np.arange(HALF, dtype=np.uint64)
_I, _J = np.triu_indices(HALF, 1)
_TWO = _ONE[_I] | _ONE[_J]


def _variants(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The points around the rows of some keys: key number, other half, row, whether within one bit of the row's fingerprint.

    A row under its own half gives its other half, all at one bit from it and, if its ones are odd in number, all at two bits; a row
    under a variant has spent one bit and gives its other half alone."""
    rest = np.where(key & np.uint64(1), fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(HALF))
    mine = np.flatnonzero(own)
    odd = mine[(np.bitwise_count(fp[mine]) & 1).astype(bool)]
    row = np.concatenate([np.arange(len(fp)), np.repeat(mine, HALF), np.repeat(odd, len(_TWO))])
    point = np.concatenate([rest, (rest[mine][:, None] ^ _ONE).ravel(), (rest[odd][:, None] ^ _TWO).ravel()])
    near = np.ones(len(row), bool)
    near[len(row) - len(odd) * len(_TWO) :] = False
    return point, row, near


def _stars(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Linked pairs of fingerprints (2 columns), so many that every link between two of the rows under a key joins them directly or by others.

    Rows that meet in a point within one bit of one of them, and two of the others, all link with that one: a star, not
    all pairs. Points are taken in ranges of their first bits where there would be too many at once."""
    order = np.argsort(key, kind="stable")
    key, fp, own = key[order], fp[order], own[order]
    of = np.cumsum(np.r_[False, key[1:] != key[:-1]]).astype(np.uint64)
    found = []
    spread = len(fp) + int(own.sum()) * (HALF + len(_TWO) // 2)
    ranges = 1 << max(0, (spread // CHUNK_VARIANTS).bit_length())
    step = max(1, CHUNK_VARIANTS // (1 + HALF + len(_TWO)))
    for r in range(ranges):
        parts = []
        for at in range(0, len(fp), step):
            point, row, near = _variants(key[at : at + step], fp[at : at + step], own[at : at + step])
            if ranges > 1:
                held = (point >> np.uint64(HALF - ranges.bit_length() + 1)) == r
                point, row, near = point[held], row[held], near[held]
            parts.append((of[at : at + step][row] << np.uint64(HALF) | point, row + at, near))
        point, row, near = (np.concatenate(x) for x in zip(*parts))
        by = np.argsort(point, kind="stable")
        point, row, near = point[by], row[by], near[by]
        first = np.flatnonzero(np.r_[True, point[1:] != point[:-1]])
        sizes = np.diff(np.r_[first, len(point)])
        met = np.repeat(sizes > 1, sizes)
        if not met.any():
            continue
        sizes = sizes[sizes > 1]
        row, near = row[met], near[met]
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        # The centre of a point: its first row within one bit, if it has any.
        centre = np.minimum.reduceat(np.where(near, np.arange(len(row)), len(row)), starts)
        centre = np.repeat(centre, sizes)
        has = centre < len(row)
        pairs = np.stack([fp[row[centre[has]]], fp[row[has]]], axis=1)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= RADIUS]
        found.append(np.unique(np.sort(pairs, axis=1), axis=0))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.uint64)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (`fp`) that differ in at most three bits, enough of them to connect all that are linked.

    Rows of halves are shuffled by the variant; a task takes them key by key in order, whole keys at a time, and spreads the other half."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def links(columns: list[np.ndarray]) -> pa.RecordBatch:
            pairs = _stars(*columns)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], names=["a", "b"])

        size = 0
        for batch in batches:
            key, fp, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            held.append([key.view(np.uint64), fp.view(np.uint64), own])
            size += len(key)
            if size < CHUNK_ROWS:
                continue
            key, fp, own = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield links([key[:cut], fp[:cut], own[:cut]])
            held, size = [[key[cut:], fp[cut:], own[cut:]]], len(key) - cut if cut else 0
        if held:
            yield links([np.concatenate(x) for x in zip(*held)])

    dealt = _halves(prints.select("fp")).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the fingerprint's bits as a long) and component_id for each row: the smallest id reachable by links of at most three differing bits.

    Meet in the middle: fingerprints are spread over the variants within half the radius, shuffled by variant, and those that meet are
    verified and linked. Rows of one fingerprint are one class, and only classes are spread and linked.

    Cases: a null, empty or blank text has the fingerprint zero, which links like any other; fewer than three words are one shingle.
    Rows of one id are members of each of their classes; a row with a null id links others, and its component_id is null only if
    no row of its component has an id. An empty table gives an empty result. Other columns are ignored.
    """
    members = staged(fingerprints(docs, id_col, text_col), "simhash-prints")
    classes = staged(members.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    links = staged(fingerprint_links(classes), "simhash-links")
    linked = staged(connected_components(links, "a", "b"), "simhash-components")
    drop_staged(links)
    named = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = staged(named.join(heads, "component").select("fp", "n", "component_id"), "simhash-names")
    bar = HOT * (named.agg(F.sum("n").alias("n")).first()["n"] or 0)
    # Fewer than 1 / HOT rows; the other classes are small, so a shuffle by class is even.
    hot = F.broadcast(named.where(F.col("n") > bar).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot")))
    told = members.join(hot, "fp", "left")
    rare = told.where("hot is null").select("id", "fp").join(named.where(F.col("n") <= bar).select("fp", "component_id"), "fp")
    out = told.where("hot").select("id", "fp", F.col("hot_id").alias("component_id")).unionByName(rare.select("id", "fp", "component_id"))
    return out.select(F.col("id").alias(id_col), "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """Sixteen lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
