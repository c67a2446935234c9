"""The filter audit against plain counting, order by order."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tessella.llm.filter_audit import audit_filters, text_filters

LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (1, LONG, "en"), (2, LONG, "de"), (3, LONG, "en"), (4, "short text", "en"), (5, None, None), (6, "", "en"), (7, "", ""), (8, "a " * 300, "en"), (9, "a " * 300 + "#", "de"), (10, LONG.upper(), "en"),
    (11, "SHOUT " * 10 + "$", "fr"), (11, "SHOUT " * 10 + "$", "fr"), (12, LONG + " |", "en"), (None, LONG, "en"), (None, "odd one", "en"), (13, "odd one", "en"), (14, "\x0b \n", "en"), (15, LONG + "É" * 20 + "ABC", "fr"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 1, 0), (8, 0, 1), (9, 1, None), (12, 1, 0), (99, 1, 1), (None, 1, 1), (11, 1, 0)]
COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumns({"part": F.lit("clash"), "mask": F.lit(-1), "words": F.lit("clash"), "id": F.lit("clash")})
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("good", F.lit(7))


def brute_force(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    fails = []
    for i, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails.append("".join(x for x, failed in {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": re.search(r"[#$%&*|]", text),
            "E": i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in rows),
        }.items() if failed))
    out, shapley = {}, Counter()
    for part in {lang or "" for *_, lang in rows}:
        mine = [(i, f) for (i, _, lang), f in zip(rows, fails) if (lang or "") == part]
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, x in enumerate(order):
                gone = [(i, f) for i, f in left if x in f]
                redundant = sum(x in f for _, f in mine) - len(gone)
                left = [(i, f) for i, f in left if x not in f]
                shapley[part, x] += len(gone)
                out[part, "".join(order), step + 1] = [len(left), len(gone), redundant, sum(f == x for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_every_order(tables):
    got = audit_filters(*tables).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in got} == brute_force(ROWS, LABELS)
    assert len(got) == 4 * 120 * 5


def test_other_filters_and_empty_tables(tables):
    docs, labels = tables
    got = audit_filters(docs, labels, {"n": F.col("text").contains("odd"), "x": F.lit(None).cast("boolean")}, copies="c")
    assert got.count() == 4 * 6 * 3 and got.where("filter_order = 'xnc' and step = 1").agg(F.sum("removed")).first()[0] == 0
    assert audit_filters(docs.limit(0), labels).count() == 0
    assert audit_filters(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
    with pytest.raises(ValueError):
        audit_filters(docs, labels, text_filters() | {"E": F.lit(True)})
