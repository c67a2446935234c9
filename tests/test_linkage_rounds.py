"""Average linkage of modules that no task holds: the clusters are those of the matrix."""

import numpy as np
import pytest

from tessella.operators import similarity as S


@pytest.mark.parametrize("last", [20, 2000])
def test_rounds_are_the_matrix(spark, monkeypatch, last):
    """More than `most` members of a module were refused."""
    monkeypatch.setattr(S, "LINKED", 25)
    monkeypatch.setattr(S, "LAST", last)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    rows = [(m, f"k{m}{i:03d}", [float(x) for x in centres[i % 6] * (i % 3 > 0) * 0.9 + rng.normal(size=8)]) for m in (1, 2) for i in range(90 if m == 1 else 30)]
    rows += [(1, f"z{i}", [2 * x for x in rows[i][2]]) for i in range(12)] + [(1, f"y{i}", rows[3][2]) for i in range(5)]
    table = spark.createDataFrame(rows, "module int, key string, v array<double>")
    told = lambda most, cut: {tuple(r) for r in S.average_linkage(table, "module", "key", "v", cut, most).collect()}
    for cut in (0.2, 0.6):
        whole = told(1000, cut)
        assert len(whole) == len(rows) and told(50, cut) == whole


def test_rounds_refuse_what_the_matrix_refuses(spark):
    table = spark.createDataFrame([(1, 1, [0.0, 0.0]), (1, 2, [1.0, 0.0]), (1, 3, [0.0, 1.0])], "module int, key int, v array<double>")
    with pytest.raises(ValueError):
        S.average_linkage(table, "module", "key", "v", 0.5, 2).collect()
