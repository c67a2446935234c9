"""Observations of change histories against a walk from new to old."""

import random

from tessella.operators import history


def _walk(changes, files, most):
    out = set()
    for repo in {r for r, _ in files}:
        at = {p: p for r, p in files if r == repo}
        for seq in sorted({c[1] for c in changes if c[0] == repo}):
            part = [c for c in changes if c[:2] == (repo, seq)]
            edited = {at[p] for _, _, p, _, kind, content in part if content and kind != "D" and p in at}
            if len(part) <= most and edited:
                out |= {(repo, seq, f, f in edited) for f in at.values()}
            moved = {}
            for _, _, p, old, kind, _ in part:
                if p in at and kind == "A":
                    del at[p]
                elif p in at and kind == "R":
                    moved[old] = at.pop(p)
            at |= moved
    return out


def test_observations(spark):
    pick = random.Random(5)
    files = [(r, f"p{i}") for r in ("big", "small") for i in range(8)]
    changes = []
    for repo, commits in (("big", 120), ("small", 15)):
        for seq in range(commits):
            olds = pick.sample(range(12), 12)
            for i in pick.sample(range(12), pick.randint(0, 5)):
                kind = pick.choice("MMMMMMRRDA" if pick.random() < 0.5 else "MMMM")
                changes.append((repo, seq, f"p{i}", f"p{olds.pop()}" if kind == "R" else None, kind, pick.random() < 0.7))
    schema = "repo string, seq int, path string, previous_path string, kind string, content_changed boolean"
    commits = spark.createDataFrame(sorted({c[:2] for c in changes}), "repo string, seq int")
    found = history.observations(commits, spark.createDataFrame(changes, schema), spark.createDataFrame(files, "repo string, path string"), 4)
    assert "InPandas" not in found._jdf.queryExecution().toString()
    rows = [tuple(r) for r in found.select("repo", "seq", "file", "edited").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _walk(changes, files, 4)
    assert len({r[2] for r in rows}) > 4 and len(rows) > 100


def test_fixed_history(spark):
    """Five commits of a and b together, then 25 of c; a later history with a rename, an addition, a mode change and a large commit."""
    plain = lambda repo, seq, path: (repo, seq, path, None, "M", True)
    changes = [plain("r1", i, f) for i in range(5) for f in "ab"] + [plain("r1", i, "c") for i in range(5, 30)]
    changes += [("r2", 0, "a", "old", "R", True), plain("r2", 0, "b"), plain("r2", 1, "old"), plain("r2", 1, "b"), ("r2", 2, "c", None, "M", False), ("r2", 3, "b", None, "A", True), plain("r2", 4, "b"), plain("r2", 4, "old")]
    changes += [plain("r2", 5, f"x{i}") for i in range(4)] + [plain("r2", 5, "old"), ("r2", 6, "c", None, "D", True), plain("r2", 7, "c")]
    commits = spark.createDataFrame([("r1", i) for i in range(30)] + [("r2", i) for i in range(8)], "repo string, seq int")
    files = spark.createDataFrame([(r, f) for r in ("r1", "r2") for f in "abc"], "repo string, path string")
    found = history.observations(commits, spark.createDataFrame(changes, "repo string, seq int, path string, previous_path string, kind string, content_changed boolean"), files, 4).cache()
    want = {("r1", s, f, (s < 5) == (f != "c")) for s in range(30) for f in "abc"}
    want |= {("r2", s, f, e) for s, told in {0: "a+b+c-", 1: "a+b+c-", 3: "a-b+c-", 4: "a+c-", 7: "a-c+"}.items() for f, e in zip(told[::2], (x == "+" for x in told[1::2]))}
    assert {tuple(r) for r in found.select("repo", "seq", "file", "edited").collect()} == want
    pairs = history.qualifying(history.co_change(found, files.select("repo", files.path.alias("file"), files.path.alias("module"))))
    (row,) = history.direction(pairs, spark.createDataFrame([("a", "b")], "src string, dst string")).collect()
    assert (row["repo"], row["a"], row["b"], row["n"], row["edits_a"], row["edits_b"], row["shared"], row["rate_a"], row["lift"], row["dependency"], row["commits"]) == ("r1", "a", "b", 30, 5, 5, 5, 1.0, 6.0, "left-to-right", [0, 1, 2, 3, 4])
