"""The verdict of the quality rules against the same estimate in numpy."""

import random

import numpy as np
import pytest

from tessella.llm import quality


def _covariance(x, scale):
    return np.cov(x.T, bias=True) * scale + np.diag([s * s for _, s in quality.DIMENSIONS])


def _distances(x, mean, covariance):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(covariance), x - mean)


def _estimate(x):
    """Mean and covariance: two starts, rounds of concentration, the smaller determinant, reweighting."""
    p = x.shape[1]
    factor = quality.CORE / quality._chi2_below(quality._chi2_quantile(quality.CORE, p), p + 2)
    q1, mid, q3 = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    robust = np.diag(((q3 - q1) / 1.349) ** 2 + [s * s for _, s in quality.DIMENSIONS])
    found = []
    for mean, covariance in ((mid, robust), (x.mean(0), _covariance(x, 1.0))):
        for _ in range(quality.ROUNDS):
            d = _distances(x, mean, covariance)
            core = x[d <= np.quantile(d, quality.CORE, method="inverted_cdf")]
            mean, covariance = core.mean(0), _covariance(core, factor)
        found.append((np.linalg.slogdet(covariance)[1], mean, covariance))
    _, mean, covariance = min(found, key=lambda f: f[0])
    near = x[_distances(x, mean, covariance) <= quality._chi2_quantile(0.975, p)]
    return near.mean(0), _covariance(near, 1.0)


def test_verdict(spark):
    pick = random.Random(3)
    words = ["".join(pick.choices("abcdefghij", k=pick.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(pick.choices(words, k=n)).capitalize() + "."
    rows = [(i, text(pick.randint(60, 200)), "en", "web") for i in range(150)] + [(200 + i, text(pick.randint(300, 900)), "en", "book") for i in range(110)]
    rows += [(400 + i, " ".join(w * 6 for w in pick.choices(words, k=120)), "en", "web") for i in range(4)] + [(450 + i, "# | & " * 20 + text(80), "en", "web") for i in range(4)]
    rows += [(500 + i, text(70), "fr", f"few{i % 3}") for i in range(9)] + [(600, None, None, None), (601, "", "en", "web"), (602, "one two", "xx", None)]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows)
    for source in ("web", "book"):
        some = [r for r in got.values() if r["source"] == source]
        x = np.array([[r[n] for n in quality.NAMES] for r in some])
        told = np.array([not r["base_failed"] for r in some])
        d = _distances(x, *_estimate(x[told]))
        assert [r["distance"] for r in some] == pytest.approx(d.tolist())
        assert [r["kept"] for r in some] == [bool(t and y <= quality.CUTOFF) for t, y in zip(told, d)]
    assert not any(got[i]["kept"] for i in [*range(400, 404), *range(450, 454), 600, 601, 602])
    assert np.mean([got[i]["kept"] for i in [*range(150), *range(200, 310)]]) > 0.97
    # Too few even together: nothing is an outlier.
    assert all(got[500 + i]["kept"] for i in range(9))
