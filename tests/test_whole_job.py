"""Queries over all of their rows, against brute force on small tables."""

import json

from tessella import catalog
from tessella.operators import references as R

from .test_call_graphs import FILES, IMPORTS


def _groups(pairs):
    """Node to the smallest node of its component, by union-find over links of different nodes."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {x: find(x) for x in root}


def test_components_of_all_error_events(spark, tmp_path):
    rows = [(u, "error", k) for u, k in [(1, 3), (2, 3), (2, 4), (5, 4), (6, 97), (7, 97), (8, 194), (9, 11), (9, 11), (10, 12), (11, 12), (12, None), (13, None)]]
    rows += [(9, "click", 3), (8, "view", 97)]
    events = [(u, kind, json.dumps({} if k is None else {"k": k})) for u, kind, k in rows]
    spark.createDataFrame(events, "user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    users = {}
    for u, kind, k in rows:
        if kind == "error" and k is not None:
            users.setdefault(k, set()).add(u)
    want = _groups((a, b) for us in users.values() for a in us for b in us)
    assert len(want) == 7
    assert {r["node"]: r["component"] for r in catalog.queries()["g06_components"](spark, str(tmp_path)).collect()} == want


def test_near_duplicates_are_confirmed(spark, tmp_path):
    own = lambda i, n: [f"line {j} that only text {i} has" for j in range(n)]
    common = [f"a licence line that many share, {i}" for i in range(20)]
    texts = {i: "\n".join(common[:3] + own(i, 5)) for i in range(1, 6)}  # three shared lines, nothing more
    texts |= {10: "\n".join(common), 11: "\n".join([*common, *own(11, 1)]), 12: "\n".join([*common, *own(12, 1)]), 13: "\n".join(own(13, 5))}
    texts |= {20 + i: "\n".join(own(20, 6)) for i in range(3)}  # one text thrice
    texts |= {30 + i: "\n".join([*own(30, 6), f"short {i}"]) for i in range(3)}  # equal anchors, different texts
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    anchors = {i: {x.strip().lower() for x in t.split("\n") if len(x.strip()) > 20} for i, t in texts.items()}
    near = [(a, b) for a in texts for b in texts if a < b and texts[a] != texts[b] and len(anchors[a] & anchors[b]) >= 3 and len(anchors[a] & anchors[b]) >= 0.9 * len(anchors[a] | anchors[b])]
    groups = _groups(near)
    sizes = {c: sum(x == c for x in groups.values()) for c in groups.values()}
    want = {c: n for c, n in sizes.items() if n >= 3}
    assert want == {10: 3, 30: 3}
    assert {r["component"]: r["members"] for r in catalog.queries()["hl105_near_duplicates"](spark, str(tmp_path)).collect()} == want


def test_import_written_as_js(spark):
    """A .js specifier that stands for a .tsx file is an edge, and bypasses a module without an entry point."""
    files = spark.createDataFrame(FILES, "file string, module string")
    found = R.import_edges(spark.createDataFrame(IMPORTS, "file string, specifier string"), files)
    edges = {("a/index.ts", "a", "b/index.ts", "b"), ("a/util.ts", "a", "b/deep/x.tsx", "b/deep"), ("b/index.ts", "b", "b/deep/x.tsx", "b/deep"), ("c/one.ts", "c", "a/util.ts", "a")}
    assert {tuple(r) for r in found.collect()} == edges
    past = R.bypassing_imports(found, R.entry_points(files)).select("src", "file", "dst", "target_file")
    assert {tuple(r) for r in past.collect()} == {(src, file, dst, target) for file, src, target, dst in edges if target != "b/index.ts"}
