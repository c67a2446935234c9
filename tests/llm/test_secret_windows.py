"""The whole secret scan against a plain version, and its time on texts that are full of candidates."""

import math
import random
import re
import string
import time
from collections import Counter

from pyspark.sql import functions as F

from tessella.llm import secrets

LETTERS = string.ascii_letters + string.digits
WORD = re.compile(r"[A-Z]?[a-z]{0,20}|[A-Z]{1,20}")


def _best(text, window=secrets.WINDOW):
    return max((-sum(c / window * math.log2(c / window) for c in Counter(text[i : i + window]).values()) for i in range(len(text) - window + 1)), default=0.0)


def _allowed(part):
    names = re.split("[_+-]+", part)
    return (
        not part.strip(string.digits + "_+-") or len(names) > 1 and all(WORD.fullmatch(n) for n in names) or re.fullmatch(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", part) is not None
        or any(x in part.lower() for x in ("example", "placeholder", "your_", "xxxx", "0000000"))
    )


def _random(part):
    kind = "hex" if re.fullmatch("[0-9a-fA-F]+", part) else "letters" if re.fullmatch("[a-z]+|[A-Z]+", part) else "cases" if re.fullmatch("[A-Za-z]+", part) else "mixed"
    return _best(part) >= secrets.BITS[kind] - 1e-10


def plain(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    more = []
    for m in re.finditer(secrets.CANDIDATE, text):
        parts = [p for p in m[0].split("/") if p]
        told = any(len(p) >= 20 and not _allowed(p) and _random(p) for p in parts) or len(parts) > 1 and not any(map(_allowed, parts)) and _random(m[0])
        if told and not any(s < m.end() and m.start() < e for s, _, e, _ in spans):
            more.append((m.start(), 3, m.end(), "entropy"))
    return sorted(spans + more)


def _texts(pick):
    token = lambda n=None: "".join(pick.choices(LETTERS, k=n or pick.randint(18, 60)))
    make = [
        token, lambda: "api_key='" + token() + "'", lambda: "Token: " + token(7), lambda: "AKIA" + "".join(pick.choices(string.ascii_uppercase, k=pick.randint(8, 20))), lambda: pick.randbytes(pick.randint(10, 24)).hex(),
        lambda: "/".join(token(pick.randint(2, 30)) for _ in range(4)), lambda: token(12) + "/password=" + token(20), lambda: "-" * 30 + token(1), lambda: "the_quick-brown_Foxes+jumped-OVER", lambda: "--a_b--ab9c--d-e-f_g_h_i",
        lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: "2024-01-02-10-20-30-40-50", lambda: "é\U0001f600", lambda: "word", lambda: "\n", lambda: "x/" * 15, lambda: token(15) + "example" + token(15),
    ]
    return [pick.choice(["", " ", "\n"]).join(pick.choice(make)() for _ in range(pick.randint(0, 40))) for _ in range(300)]


def test_scan_against_plain_version(spark):
    rows = [*enumerate(_texts(random.Random(11))), (300, None), (301, ""), (None, "token = abcdefgh1"), (5, "token = abcdefgh1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("base", F.lit(1)).withColumn("candidate", F.lit(2))
    got = Counter((r["doc_id"], tuple(tuple(s) for s in r["spans"])) for r in secrets.scan_secrets(docs).collect())
    want = Counter((i, tuple(plain(t))) for i, t in rows)
    assert got == want
    assert Counter(s[3] for _, t in rows for s in plain(t)).keys() == {"assign", "access", "hex", "entropy"}
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_ten_thousand_tokens_in_one_text(spark):
    pick = random.Random(3)
    text = " ".join("".join(pick.choices(pick.choice([LETTERS, "abcdef0123456789", "aabbccdde", string.ascii_lowercase]), k=pick.randint(20, 31))) for _ in range(10_000))
    began = time.time()
    (row,) = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert time.time() - began < 60
    assert [tuple(s) for s in row["spans"]] == plain(text)


def test_time_follows_length(spark):
    pick = random.Random(4)
    token = lambda: "".join(pick.choices(LETTERS, k=24))
    texts = ["-" * 50_000 + "x1", "a-" * 50_000 + "x1B", "".join(token() for _ in range(20_000)), " ".join(f"token={token()} {token()}" for _ in range(10_000))]
    began = time.time()
    found = secrets.scan_secrets(spark.createDataFrame([*enumerate(texts)], "doc_id int, text string")).collect()
    assert time.time() - began < 90 and len(found) == 4
    assert sum(s["kind"] == "assign" for s in found[3]["spans"]) == 10_000
