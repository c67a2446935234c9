"""The language model beyond pairs, against plain counting."""

import math
from collections import Counter

import numpy as np
import pytest

from tessella.llm import language_model, registry


@pytest.mark.parametrize("order, hot, shard_bytes", [(3, 1 / 1024, 1 << 20), (3, 2.0, 7), (3, 0.1, 7), (4, 0.07, 3)], ids=["all hot", "none hot", "some hot", "four"])
def test_scores_of_an_order(spark, order, hot, shard_bytes):
    """In one shard or many, and whether n-grams are dealt by their contexts or one by one."""
    texts = ["a b a c", "b a a b c d", "d", "a b", "c c c a b e", "a b a c a b a c d", ""]
    model = language_model.train(spark.createDataFrame([(t,) for t in texts], "text string"), order=order, hot_share=hot, shard_bytes=shard_bytes)
    tables = {order: Counter()}
    marked = [["<s>", *t.split(), "</s>"] for t in texts]
    for w in marked:
        for i in range(len(w) - order + 1):
            tables[order][tuple(w[i : i + order])] += 1
    for k in range(order - 1, 0, -1):
        tables[k] = Counter()
        for longer in tables[k + 1]:
            tables[k][longer[1:]] += 1
        if k > 1:
            for w in marked:
                if len(w) >= k:
                    tables[k][tuple(w[:k])] += 1
    spare = lambda k, counts: sum(model.discounts[k][min(c, 3) - 1] for c in counts)
    kinds = tables[1]

    def chance(history, word):
        p = max(kinds[word,] - (0, *model.discounts[1])[min(kinds[word,], 3)], 0) / sum(kinds.values()) + spare(1, kinds.values()) / sum(kinds.values()) / (len(kinds) + 1)
        for k in range(2, min(order, len(history) + 1) + 1):
            context = tuple(history[len(history) - k + 1 :])
            after = [c for g, c in tables[k].items() if g[:-1] == context]
            if after:
                c = tables[k][*context, word]
                p = max(c - (0, *model.discounts[k])[min(c, 3)], 0) / sum(after) + spare(k, after) / sum(after) * p
        return p

    for history in (["<s>"], ["<s>", "a"], ["<s>", "a", "b"], ["<s>", "b", "a", "b"], ["<s>", "unseen", "a"]):
        assert sum(chance(history, w) for w in [*(k[0] for k in kinds), "unknown"]) == pytest.approx(1)
    probes = ["", "a", "a b a c", "unseen a b c", "c c a b unseen e"]
    for r in language_model.score(spark.createDataFrame([(t,) for t in probes], "text string"), model, keep=("text",)).collect():
        w = ["<s>", *r["text"].split(), "</s>"]
        assert r["score"] == pytest.approx(sum(math.log10(chance(w[:i], w[i])) for i in range(1, len(w))))


def test_query_learns_longer_contexts(spark, tmp_path):
    """After `x a` only `b` and after `y a` only `c` were seen: pairs can't tell them apart."""
    rows = [(i, f"x a b n{i}" if i % 2 else f"y a c n{i}") for i in range(60)]
    spark.createDataFrame([*rows, (1000, "x a b"), (1001, "x a c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.op2_lm_score(spark, str(tmp_path)).collect()
    assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in found)
    score = {r["doc_id"]: r["score"] for r in found}
    assert score[1000] > score[1001] + 1


def test_numbers_of_tokens_in_many_shards(spark, tmp_path):
    """2,500 shards in three blocks, some empty: every token gets its own number, those with more bits in their count first, then by shard."""
    pick = np.random.default_rng(2)
    per = pick.integers(0, 4, (2_500, 64)) * (pick.random((2_500, 64)) < 0.1)
    per[1_024:1_030] = 0
    rows = [(k // language_model.FIRSTS, k, [int(x.sum()), *map(int, x)]) for k, x in enumerate(per) if x.any()]
    totals = spark.createDataFrame(rows, "block int, shard int, sums array<long>")
    firsts, tokens, kinds = language_model._number(totals, f"{tmp_path}/firsts", 3)
    assert tokens == kinds == per.sum()
    at = 1
    for size in range(63, -1, -1):
        for k in range(2_500):
            if per[k, size]:
                assert firsts.shard(k // language_model.FIRSTS)["first"].reshape(-1, 64)[k % language_model.FIRSTS, size] == at
                at += per[k, size]
    empty, *sums = language_model._number(totals.limit(0), f"{tmp_path}/none", 1)
    assert sums == [0, 0] and empty.shard(0) == {}
