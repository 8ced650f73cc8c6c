import itertools
import math

import numpy as np
import pytest

from ringlet.functions import statistics as S
from ringlet.operators import scaling
from ringlet.sources import synthetic


def test_tails():
    assert S.normal_tail(1.959964) == pytest.approx(0.025, abs=1e-6) and S.normal_tail(-1.0) == pytest.approx(0.8413447)
    assert S.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and S.t_two_sided(12.7062, 1) == pytest.approx(0.05, abs=1e-5)
    assert S.chi2_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6) and S.chi2_tail(18.307, 10) == pytest.approx(0.05, abs=1e-5) and S.chi2_tail(0.0, 3) == 1


def test_ranks_and_correlations():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, 60).astype(float), rng.integers(0, 5, 60).astype(float)
    plain = [sum(v < u for v in x) + (sum(v == u for v in x) + 1) / 2 for u in x]
    assert S.midranks(x).tolist() == plain and S.pearson(x, y) == pytest.approx(np.corrcoef(x, y)[0, 1])
    up = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i, j in itertools.combinations(range(60), 2))
    free = [sum(a[i] != a[j] for i, j in itertools.combinations(range(60), 2)) for a in (x, y)]
    assert S.kendall(x, y) == pytest.approx(up / math.sqrt(free[0] * free[1]))
    assert math.isnan(S.pearson(x, x * 0)) and S.concordance(x, x) == pytest.approx(1) and S.concordance(x * 0, x * 0) == 1 and S.concordance(x * 0, x * 0 + 1) == 0
    assert S.effect_size(x[:1], y) == 0 and S.effect_size(x * 0, x * 0) == 0
    d = (x.mean() - y.mean()) / math.sqrt((59 * x.var(ddof=1) + 59 * y.var(ddof=1)) / 118)
    assert S.effect_size(x, y) == pytest.approx(d)


def test_lines():
    x = np.arange(1, 30, dtype=float)
    got = S.line(x, 2 * x + 1)
    assert (got.slope, got.intercept, got.r2) == pytest.approx((2, 1, 1)) and got.slope_error == pytest.approx(0, abs=1e-6)
    assert S.exponent(x, 3 * x**2).slope == pytest.approx(2) and S.growth(x, np.exp(x))[0] == "exponential" and S.growth(x, x**3)[0] == "polynomial"


def test_adjusted_and_rank_tests():
    assert S.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06]) and S.holm([]) == [] and S.holm([0.9, 0.9]) == [1.0, 1.0]
    same = S.signed_rank(np.ones(4), np.ones(4))
    assert (same.p, same.n_used, same.n_zero) == (1.0, 0, 4)
    got = S.signed_rank(np.array([125, 115, 130, 140, 140, 115, 140, 125, 140, 135.0]), np.array([110, 122, 125, 120, 140, 124, 123, 137, 135, 145.0]))
    assert (got.statistic, got.n_used, got.n_zero) == (18.0, 9, 1) and got.rank_biserial == pytest.approx(9 / 45)
    chi2, p, ranks = S.friedman(np.array([[1.0, 2, 3]] * 6))
    assert chi2 == pytest.approx(12) and p == pytest.approx(math.exp(-6)) and ranks == [1, 2, 3]
    assert S.critical_difference(3, 6) == pytest.approx(2.343 * math.sqrt(12 / 36)) and math.isnan(S.critical_difference(11, 3))
    assert S.cliques([1.0, 1.5, 2.9, 3.0], 1.0) == [(0, 1), (2, 3)] and S.cliques([1.0, 5.0], 1.0) == []
    groups = [np.array([5.0, 6, 7]), np.array([3.0, 4, 5]), np.array([1.0, 2])]
    want = sum(sum((x > y) + (x == y) / 2 for x in a for y in b) for a, b in itertools.combinations(groups, 2))
    assert S.trend(groups)[0] == want and S.trend(groups)[2] < 0.05 < S.trend(groups, falling=False)[2]


def test_resampling(spark):
    rng = np.random.default_rng(2)
    pts = rng.normal(size=(12, 2))
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(axis=2))
    near = d + rng.normal(scale=0.01, size=d.shape)
    near = np.abs(near + near.T) / 2
    r, p = S.mantel(spark, d, near, permutations=99)
    assert r > 0.95 and p == 0.01 and S.mantel(spark, d, near, permutations=99) == (r, p)
    noise = rng.uniform(size=d.shape)
    assert S.mantel(spark, d, noise + noise.T, permutations=99)[1] > 0.02
    one, low, high = S.correlation_interval(spark, S.upper(d), S.upper(near), replicates=100)
    assert low <= one <= high
    low, high = S.cluster_interval(spark, d, near, replicates=100)
    assert 0.8 < low <= high <= 1
    low, high = S.slope_interval(spark, d, 3 * d, replicates=50)
    assert low == pytest.approx(3) == high
    picks = rng.integers(0, 12, 12)
    a, b = S.drawn_pairs(picks)
    assert d[a, b].sum() == pytest.approx(S.weighted_sums(np.bincount(picks, minlength=12).astype(float), d))


def test_scaling_of_points():
    pts = np.random.default_rng(3).normal(size=(15, 2))
    d = S.embedded(pts)
    s = S.spectrum(d)
    assert s.negative_share < 1e-9 and s.cumulative[1] == pytest.approx(1) and np.allclose(S.embedded(S.classical(d, 2)), d)
    x, left = S.smacof(d, 2)
    assert left < 1e-3 and S.stress(d, x) == left and S.procrustes(pts, x) < 1e-3 and S.shepard(d, x)[0] > 0.999
    hole = d.copy()
    hole[0, 1] = hole[1, 0] = hole[0, 2] = hole[2, 0] = np.nan
    assert S.finite_rows(hole).tolist() == list(range(1, 15))
    full, w = S.filled(hole)
    assert full[0, 1] == 2 * np.nanmax(hole) and w[0, 1] == 0 and S.smacof(full, 2, weights=w)[1] < 0.05
    e = S.embedded(pts * 2)
    assert S.stress(d, pts * 2) == pytest.approx(math.sqrt(((S.upper(d) - S.upper(e)) ** 2).sum() / (S.upper(e) ** 2).sum()))
    assert S.effective_rank(np.eye(4)) == pytest.approx(4)
    (a, b), ok = S.known_pairs(hole, d)
    assert len(a) == len(b) == ok.sum() == 15 * 14 // 2 - 2


def test_scaling_of_datasets(spark):
    pts = np.random.default_rng(4).normal(size=(8, 2))
    d = S.embedded(pts)
    rows = [(g, i, j, float(d[i, j]), float(d[i, j] * 2)) for g in (0, 1) for i in range(8) for j in range(i + 1, 8)]
    frame = spark.createDataFrame(rows, "dataset int, i long, j long, a double, b double")
    got = scaling.stress(frame, scaling.coordinates(frame, "a", method="classical"), "a").collect()
    assert [r.dataset for r in sorted(got)] == [0, 1] and all(r.stress < 1e-6 and r.r2 > 0.999 for r in got)
    assert scaling.spectra(frame, "a").where("place = 1").first().cumulative == pytest.approx(1)
    assert all(r.rest < 1e-9 and r.p <= 0.05 for r in scaling.agreement(frame, "a", "b", permutations=19).collect())


def test_centrality():
    star = scaling.centrality(5, synthetic.star(5))
    assert star[0] == (1.0, 1.0, 1.0) and star[1] == pytest.approx((0.25, 4 / 7, 0))
    rng = np.random.default_rng(5)
    for _ in range(10):
        n = 6
        e = [(u, v) for u in range(n) for v in range(u + 1, n) if rng.random() < 0.5]
        paths = {}
        for s, t in itertools.permutations(range(n), 2):
            ways = [p for k in range(n - 1) for m in itertools.permutations([x for x in range(n) if x not in (s, t)], k) for p in [(s, *m, t)] if all((min(a, b), max(a, b)) in e for a, b in itertools.pairwise(p))]
            least = min(map(len, ways), default=0)
            paths[s, t] = [p for p in ways if len(p) == least]
        want = [sum(sum(u in p[1:-1] for p in ps) / len(ps) for ps in paths.values() if ps) / ((n - 1) * (n - 2)) for u in range(n)]
        assert [c[2] for c in scaling.centrality(n, e)] == pytest.approx(want)


def test_correlation_report(spark):
    pts = np.random.default_rng(6).normal(size=(12, 2))
    d = S.embedded(pts)
    noise = np.random.default_rng(7).uniform(size=d.shape)
    rows = [(g, i, j, float(d[i, j]), float(d[i, j] * 2), float(noise[i, j]), 1.0) for g in (0, 1) for i in range(12) for j in range(i + 1, 12)]
    frame = spark.createDataFrame(rows, "dataset int, i long, j long, ref double, near double, far double, flat double")
    got = {(r.dataset, r.method): r for r in scaling.correlation_report(frame, ["near", "far", "flat"], "ref", 20, 19).collect()}
    assert len(got) == 6 and got[0, "flat"].p is None and got[0, "flat"].n == 66
    near = got[0, "near"]
    assert near.spearman == pytest.approx(1) and near.kendall == pytest.approx(1) and near.slope == pytest.approx(0.5) and near.p == 0.05 and near.low > 0.99
    known = sorted((r.p, r.dataset, r.method) for r in got.values() if r.p is not None)
    assert [got[k[1:]].p_holm for k in known] == pytest.approx([S.holm([k[0] for k in known])[n] for n in range(4)])


def test_timing():
    from ringlet.functions.timing import timed

    calls = []
    got = timed(lambda: calls.append(1), runs=5, warm_up=2)
    assert len(calls) == 7 and got.runs == 5 and 0 <= got.least <= got.median
