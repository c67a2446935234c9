"""The Merkle manifest against a plain tree."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm.manifest import merkle_manifest, proof_text

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
SMALL = [(1, "b", "en", 3, "a\nb"), (2, "b", None, None, None), (2, "b", None, None, None), (3, None, "de", 0, ""), (None, "b", "en", 1, "no id\n"), (7, "", "en", 4, "ß\n\nx"), (-5, "Ä", "en", 2, "é"), (2, "b", "en", 1, "other\n")]


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(row):
    return H("".join(map(value, row)))


def damaged(row):
    i, *rest, text = row
    even = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
    return (i, *rest, text.replace("\n", "") if even and text is not None else text)


def climb(level, fanout):
    """The root of a list of digests and each one's siblings, left and right, level by level."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, i in enumerate(at):
            start = i - i % fanout
            paths[k].append(("".join(level[start:i]), "".join(level[i + 1 : start + fanout])))
            at[k] = i // fanout
        level = [H("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], paths


def plain(rows, fanout=3):
    groups = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, roots = [], []
    for g in groups:
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = climb([leaf(r) for r in mine], fanout)
        trees.append((mine, paths))
        roots.append(root)
    root, tops = climb(roots, fanout)
    out = Counter()
    for (mine, paths), subroot, top in zip(trees, roots, tops):
        for r, path in zip(mine, paths):
            node = leaf(damaged(r))
            for left, right in path + top:
                node = H(left + node + right)
            out[r[0], leaf(r), subroot, root, "".join(a + b for a, b in path + top), node] += 1
    return out


def manifest(docs, **how):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle_manifest(docs, tampered, **how).withColumn("proof", proof_text(F.col("proof"))).collect()
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"], r["folded_root"]) for r in rows)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_awkward_rows(spark):
    docs = spark.createDataFrame(SMALL, SCHEMA).withColumns({"hash": F.lit("clash"), "pos": F.lit("clash"), "grp": F.lit(1), "found": F.lit("x")})
    assert manifest(docs) == plain(SMALL)
    assert merkle_manifest(docs.limit(0)).count() == 0
    alone = docs.where("doc_id = 3")
    got = merkle_manifest(alone).first()
    assert got["leaf"] == got["subroot"] == got["root"] == got["folded_root"] and got["proof"] == []


@pytest.mark.parametrize("fanout,depth", [(3, 1), (3, 2), (2, 3), (3, 6)])
def test_rounds_of_blocks(spark, fanout, depth):
    """A hot group of over a thousand rows and groups of every size around the runs, whatever the blocks."""
    rows = [(i, f"s{i % 11}" if i % 3 else "hot", "en", i, f"text {i}\n" * (i % 4)) for i in range(900)]
    rows += [(10_000 + i, f"of {n}", "en", i, "x\ny") for n in (1, 2, 3, 4, 8, 9, 10, 27, 28) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert manifest(docs, fanout=fanout, depth=depth) == plain(rows, fanout)


def test_one_source_per_row(spark):
    rows = [(i, f"s{i:05}", "en", 1, "a\nb") for i in range(100)]
    assert manifest(spark.createDataFrame(rows, SCHEMA), depth=2) == plain(rows)
