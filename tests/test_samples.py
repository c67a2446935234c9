"""Samples of pairs: complete, of different members, and no more than asked for."""

from collections import Counter

from tessella.operators.similarity import pair_sample


def test_pair_sample(spark):
    sizes = {"a": 40, "b": 3, "c": 1, "d": 12}
    rows = [(f"{m}{i}", m) for m, n in sizes.items() for i in range(n)]
    found = [tuple(r) for r in pair_sample(spark.createDataFrame(rows, "k string, m string"), "k", "m", 50, 100).collect()]
    of = dict(rows)
    assert len({frozenset(r[1:]) for r in found}) == len(found)
    within = Counter(of[a] for kind, a, b in found if kind == "within")
    assert all(of[a] == of[b] for kind, a, b in found if kind == "within") and within == {"a": 50, "b": 3, "d": 50}
    across = [(a, b) for kind, a, b in found if kind == "across"]
    assert len(across) == 100 and all(of[a] != of[b] for a, b in across)
    every = pair_sample(spark.createDataFrame(rows, "k string, m string"), "k", "m", 1000, 10_000)
    assert every.where("kind = 'across'").count() == (56 * 55 - sum(n * (n - 1) for n in sizes.values())) // 2
    assert every.where("kind = 'within'").count() == sum(n * (n - 1) for n in sizes.values()) // 2
    assert pair_sample(spark.createDataFrame([], "k string, m string"), "k", "m", 5, 5).count() == 0
