"""Fingerprints and links against a bit-by-bit version and a comparison of all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import simhash
from tessella.llm.registry import op12_simhash_dedup

WORDS = [f"word{i}" for i in range(300)]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64(" ".join(r).encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    """rows: (id, fingerprint); the smallest id reachable, per row, by comparing all pairs."""
    prints = sorted({f for _, f in rows})
    label = {f: f for f in prints}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                label[top(a)] = top(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[top(f)] = min(i, least.get(top(f), i))
    return Counter((i, f, least.get(top(f))) for i, f in rows)


def found(frame):
    return Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in frame.collect())


def texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(40):
        words = rng.choices(WORDS, k=rng.choice([1, 2, 3, 4, 60, 400]))
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 2, 8])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out.append("\t".join(copy).upper())
    return out


def test_awkward_rows_against_all_pairs(spark):
    rows = list(enumerate([*texts(1), None, "", " \x0b\n", "É È é", "x" * 40_000, "a b " * 30_000])) + [(5, "twice the id"), (5, "twice the id"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("clash"), "key": F.lit("clash"), "component": F.lit(1)})
    want = components([(i, plain_fingerprint(t)) for i, t in rows])
    assert found(simhash.near_copies(docs)) == want
    assert simhash.near_copies(docs.limit(0)).count() == 0
    assert spark.createDataFrame([(-1,), (255,)], "x long").select(simhash.hex_digits(F.col("x"))).collect() == [("f" * 16,), ("0" * 14 + "ff",)]


def linked_groups(spark, prints):
    frame = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in prints], "fp long").repartition(5)
    label = {x: x for x in prints}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in simhash.fingerprint_links(frame).collect():
        a, b = a % (1 << 64), b % (1 << 64)
        assert 1 <= (a ^ b).bit_count() <= 3
        label[top(a)] = top(b)
    return {x: top(x) for x in prints}


def test_every_way_to_differ(spark):
    """Pairs that differ in 0 to 4 bits, however these lie in the halves and whichever of the two has more ones."""
    rng = random.Random(3)
    prints, pairs = set(), []
    for n in (1, 2, 3, 4):
        for _ in range(150):
            a = rng.getrandbits(64)
            low = rng.randint(0, n)
            bits = rng.sample(range(32), low) + rng.sample(range(32, 64), n - low)
            b = a
            for i in bits:
                b ^= 1 << i
            prints |= {a, b}
            pairs.append((a, b, n))
    group = linked_groups(spark, sorted(prints))
    for a, b, n in pairs:
        assert (group[a] == group[b]) == (n <= 3)


@pytest.mark.parametrize("variants", [50_000, 4_000_000])
def test_dense_groups(spark, monkeypatch, variants):
    """Thousands of fingerprints around few centres, most of which share a half: as many links as points, and points in several ranges."""
    monkeypatch.setattr(simhash, "CHUNK_VARIANTS", variants)
    rng = random.Random(5)
    prints = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(350):
            x = centre
            for i in rng.sample(range(32, 42), rng.randint(0, 7)):
                x ^= 1 << i
            prints.add(x)
    prints = sorted(prints | {rng.getrandbits(64) for _ in range(200)})
    group = linked_groups(spark, prints)
    rows = simhash._halves(spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in prints], "fp long")).toPandas()
    here = simhash._stars(rows["key"].to_numpy().view(np.uint64), rows["fp"].to_numpy().view(np.uint64), rows["own"].to_numpy())
    assert len(here) < 700 * len(prints)
    want = components([(i, f) for i, f in enumerate(prints)])
    label = {f: c for _, f, c in want}
    assert len({(label[int(a)], label[int(b)]) for a, b in here}) == len({label[int(a)] for a, _ in here})
    # Where only some points are held at once, the same fingerprints are joined.
    monkeypatch.setattr(simhash, "CHUNK_VARIANTS", 4_000_000)
    again = simhash._stars(rows["key"].to_numpy().view(np.uint64), rows["fp"].to_numpy().view(np.uint64), rows["own"].to_numpy())
    assert {label[int(a)] for a, _ in here} == {label[int(a)] for a, _ in again} and set(here.ravel()) == set(again.ravel())
    assert len({(group[f], label[f]) for f in prints}) == len(set(group.values())) == len(set(label.values()))


def test_query_over_whole_table(spark):
    rows = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in op12_simhash_dedup(spark, "/root/testdata/sf0.001").collect()]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = components([(i, plain_fingerprint(t)) for i, t in docs])
    assert Counter((i, int(f, 16), c) for i, f, c in rows) == want and all(len(f) == 16 for _, f, _ in rows)
