"""Distances by blocks, and densities of points that are counted first, against brute force."""

import numpy as np

from tessella.operators import similarity as S


def test_smallest_distances_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    pick = np.random.default_rng(4)
    rows = [(int(i % 2), "xyz"[i % 3], pick.normal(size=5).tolist()) for i in range(90)]
    # Copies change nothing, and a vector without a length is near to none.
    found = S.cross_distances(spark.createDataFrame(rows + rows[:20] + [(0, "x", [0.0] * 5)], "module int, label string, v array<double>"), "module", "label", "v")
    want = {}
    for m, a, v in rows:
        for n, b, w in rows:
            if m == n and a < b:
                want[m, a, b] = min(want.get((m, a, b), 2), 1 - np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))
    got = {(r["module"], r["a"], r["b"]): r["distance"] for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_density_of_counted_points(spark):
    pick = np.random.default_rng(5)
    points = [tuple(map(float, p)) for p in pick.integers(-3, 4, size=(300, 2)) / 2]
    grid = [(0.0, 0.0), (1.25, -2.0), (1.25, -2.0), (50.0, 50.0)]
    found = S.density(spark.createDataFrame(points, "x double, y double"), "x", "y", spark.createDataFrame(grid, "gx double, gy double"), 0.5)
    got = {(r["gx"], r["gy"]): r["density"] for r in found.collect()}
    assert len(got) == 3 and got[50.0, 50.0] == 0
    for (gx, gy), d in got.items():
        near = [(x, y) for x, y in points if abs(np.floor(x / 2) - np.floor(gx / 2)) <= 1 and abs(np.floor(y / 2) - np.floor(gy / 2)) <= 1]
        assert abs(d - sum(np.exp(-((x - gx) ** 2 + (y - gy) ** 2) / 0.5) for x, y in near) / (2 * np.pi * 0.25 * 300)) < 1e-9
