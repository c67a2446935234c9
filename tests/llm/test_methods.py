"""Methods of the corpus operators against plain versions: sources, grades, entropy, paths of pieces, and the pipeline's stages."""

import base64
import math
import random
import string
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import mixing, ordinal, pieces, secrets


def _targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Shares by weight; what is over a cap goes to the others, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, out = set(), {}
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        out = {s: most * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if out[s] > most * sizes[s]}
        if not over:
            return out
        full |= over


def test_mixing_against_sorting(spark):
    pick = random.Random(8)
    rows = [(i, " ".join(["w"] * pick.choice([0, 1, 3, 10, 40])), pick.choice(["a", "b", "b", "b", "c", None, "\u00e9"])) for i in range(400)] + [(7, None, "z"), (8, "x y", "b"), (8, "x y", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target = _targets(sizes)
    keys = {(r["doc_id"], r["text"]): r["k"] for r in docs.withColumn("k", mixing.hash_key("doc_id", "text")).collect()}
    got = mixing.mix_counts(docs).collect()
    texts = Counter((i, t, s) for i, t, s in rows)
    assert len(got) == len(rows)
    by_source = {s: [(keys[i, t], len((t or "").split())) for (i, t, x), n in texts.items() if x == s for _ in range(n)] for s in sizes}
    assert sum(r["taken"] for r in got if r["source_size"] == sizes["z"] == 0) == 0
    for s, members in by_source.items():
        full = int(target[s] // sizes[s]) if sizes[s] else 0
        budget = target[s] - full * sizes[s]
        # The documents with the smallest keys, as many as come nearest to the budget.
        best, total = budget, 0
        for k in sorted({k for k, _ in members}):
            total += sum(n for x, n in members if x == k)
            best = min(best, abs(budget - total))
        taken = sum(r["taken"] for r in got if math.isclose(r["target"], target[s]) and r["source_size"] == sizes[s])
        assert abs(abs(taken - target[s]) - best) < 1e-6
    whole = Counter({(r["doc_id"], r["copies"]): 1 for r in got})
    again = mixing.mix_documents(docs)
    assert again.columns == docs.columns and again.count() == sum(r["copies"] for r in got) and len(whole) > 100


def test_slopes_of_grades():
    theta = np.array([-0.7, 0.4, 1.9])
    loss = lambda f, y, t: -math.log(ordinal.slopes(f, y, t)[0])
    for f, y in product((-1.3, 0.2, 2.5), range(4)):
        _, g, along = ordinal.slopes(f, y, theta)
        assert g == pytest.approx((loss(f + 1e-6, y, theta) - loss(f - 1e-6, y, theta)) / 2e-6, abs=1e-5)
        for k in range(3):
            step = np.eye(3)[k] * 1e-6
            assert along[k] == pytest.approx((loss(f, y, theta + step) - loss(f, y, theta - step)) / 2e-6, abs=1e-5)
    assert sum(ordinal.slopes(0.3, y, theta)[0] for y in range(4)) == pytest.approx(1)


def test_grades_of_awkward_rows(spark):
    rows = [(i, "good words here " * (1 + i % 3) if i % 2 else "bad stuff there " * (1 + i % 3)) for i in range(120)]
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (502, "long " * 30_000), (1, rows[1][1])], "doc_id long, text string").withColumn("grade", F.lit("clash"))
    ratings = spark.createDataFrame([*((i, 2 * (i % 2)) for i in range(90)), (3, None), (4, 9), (None, 1), (5, 2), (999, 1)], "doc_id long, grade int")
    told = ordinal.predict(docs, ordinal.fit(docs, ratings, levels=3)).collect()
    assert len(told) == 124 and all(0 <= r["tail"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in told)
    assert min(r["tail"] for r in told if 90 <= r["doc_id"] < 120 and r["doc_id"] % 2) > max(r["tail"] for r in told if 90 <= r["doc_id"] < 120 and r["doc_id"] % 2 == 0)
    empty = ordinal.fit(docs.limit(0), ratings.limit(0), levels=3)
    assert ordinal.predict(docs.limit(0), empty).count() == 0 and {round(r["tail"], 6) for r in ordinal.predict(docs, empty).collect()} == {0.5}


def test_window_entropy(spark):
    pick = random.Random(1)
    rows = [("".join(pick.choices(string.ascii_letters + string.digits, k=pick.randint(20, 60))),) for _ in range(40)] + [("a" * 30,), ("ab" * 15,)]

    def plain(text):
        best = 0.0
        for i in range(len(text) - secrets.WINDOW + 1):
            n = Counter(text[i : i + secrets.WINDOW])
            best = max(best, -sum(c / secrets.WINDOW * math.log2(c / secrets.WINDOW) for c in n.values()))
        return best

    codes = F.transform(F.split("t", ""), lambda c: F.call_function("locate", c, F.lit(secrets.SYMBOLS)) - 1)
    for r in spark.createDataFrame(rows, "t string").select("t", secrets.window_entropy(codes).alias("e")).collect():
        assert r["e"] == pytest.approx(plain(r["t"]), abs=1e-9)


def test_entropy_of_planted_secrets(spark):
    pick = random.Random(6)
    any_of = lambda letters: lambda: "".join(pick.choices(letters, k=pick.randint(28, 40)))
    planted = {"letters and digits": any_of(string.ascii_letters + string.digits), "letters": any_of(string.ascii_letters), "base64": lambda: base64.b64encode(pick.randbytes(33)).decode(), "hex": lambda: pick.randbytes(13).hex().upper(), "path": lambda: "docs/example/" + any_of(string.ascii_letters + string.digits)()}
    clean = {
        "dashes": lambda: "-".join(pick.choices("the quick brown foxes jumped over lazy dogs internationalization".split(), k=5)), "long": lambda: pick.choice(["internationalizationofthings", "Donaudampfschifffahrtsgesellschaft", "getUserAuthenticationTokenFromRequestHeader"]),
        "folders": lambda: "/".join(pick.choices("usr local share python site packages numpy core tests data".split(), k=6)), "uuid": lambda: "123e4567-e89b-12d3-a456-426614174000", "numbers": lambda: "2024-01-02-10-20-30-40-50-60", "names": lambda: "_".join(pick.choices("max min value of the array index count total".split(), k=6)),
        "placeholder": lambda: "sk_live_your_" + any_of(string.ascii_letters)(),
    }
    rows = [(k, f"\u00e9 before {make()} after") for group in (planted, clean) for k, make in group.items() for _ in range(40)]
    found = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    told = Counter(r["doc_id"] for r in found if any(s["kind"] == "entropy" for s in r["spans"]))
    right = sum(told[k] for k in planted)
    assert right >= 0.97 * 40 * len(planted)
    assert right / sum(told.values()) >= 0.98
    long = secrets.scan_secrets(spark.createDataFrame([(1, "word " * 40_000 + any_of(string.ascii_letters + string.digits)()), (1, "x" * 100_000), (2, "x" * 100_000)], "doc_id int, text string")).collect()
    assert [len(r["spans"]) for r in long] == [1, 0, 0] and long[0]["spans"][0]["start"] == 200_000


def test_best_paths_of_pieces(spark):
    """A unigram model: the fold's path has the best sum among all ways to cut a word."""
    pick = random.Random(4)
    alphabet = "abc"
    table = {c: -3.0 - i for i, c in enumerate(alphabet + pieces.SPACE)}
    table |= {"".join(pick.choices(alphabet, k=pick.randint(2, 4))): round(-pick.uniform(2, 9), 3) for _ in range(25)} | {pieces.SPACE + "ab": -2.5}
    names = list(table)
    model = pieces.Model({p: (s, i) for i, (p, s) in enumerate(table.items())}, (), len(names), False, tuple(p.encode() for p in names) + (b"?",))
    words = sorted({pieces.SPACE + "".join(pick.choices(alphabet, k=pick.randint(1, 8))) for _ in range(40)} | {"abz", "z"})

    def best(word):
        out = {0: 0.0}
        for j in range(1, len(word) + 1):
            out[j] = max(out[i] + table.get(word[i:j], -1e6 if j == i + 1 else -1e18) for i in range(j))
        return out[len(word)]

    frame = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "key long, word string")
    for r in pieces.encode_words(frame, model).collect():
        cut = [names[i] if i < len(names) else None for i in r["ids"]]
        assert sum(table[p] if p else -1e6 for p in cut) == pytest.approx(best(r["word"]))
        if None not in cut:
            assert "".join(cut) == r["word"]


GOOD = "one two three four five six seven eight nine ten eleven twelve".split()


def _document(pick, n=90):
    return " ".join(f"{pick.choice(GOOD)}{pick.randrange(1000)}" for _ in range(n)).capitalize() + "."


def test_stages(spark, tmp_path):
    """Every stage keeps the columns, survives nulls and clashing names, and does what it is named for."""
    pick = random.Random(9)
    texts = {i: _document(pick) for i in range(40)}
    texts |= {40: texts[0], 41: texts[1] + " more", 42: "short one", 43: "same same same " * 40, 44: None, 45: "", 46: _document(pick) + "\nA line that two documents share", 47: _document(pick) + "\na line that two documents share "}
    rows = [(i, t, "en", "web" if i % 3 else None, len(t or "")) for i, t in texts.items()] + [(None, _document(pick), None, "book", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("clash") for c in ("size", "kept", "n_lines", "ids", "component_id", "word", "group")})
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    (_, rules), (_, lines), (_, near), (_, mix), (_, encode) = corpus_pipeline.STAGES
    good = rules(spark, docs, "")
    assert good.columns == docs.columns and ids(good) == Counter(i for i, *_ in rows) - Counter([42, 43, 44, 45])
    cleaned = lines(spark, good, "")
    assert cleaned.columns == docs.columns and ids(cleaned) == ids(good)
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cleaned.collect()}
    assert found[46][0] == texts[46] and found[47][0] == texts[47].split("\n")[0] and found[47][1] == len(found[47][0]) and found[0][0] == texts[0] and found[40][0] == ""
    single = near(spark, good, "")
    assert single.columns == docs.columns and ids(single) == ids(good) - Counter([40, 41])
    mixed = mix(spark, single, "")
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(ids(single)) and max(ids(mixed).values()) <= 2
    coded = encode(spark, mixed.unionByName(docs.where("doc_id = 44")), "")
    assert coded.count() == mixed.count() + 1 and all(r["n_pieces"] == len(r["ids"]) for r in coded.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_run(spark, tmp_path):
    pick = random.Random(2)
    spark.createDataFrame([(i, _document(pick), "en", "web", 9) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(range(30)) and len(rows) > 30
