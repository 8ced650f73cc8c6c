"""Statistics on arrays, for what SQL does not say: tails of distributions, resampling, permutation tests, scaling.

Arrays are those of one collection's pairs or a matrix of distances, thus bounded by what a task holds; ``replicated`` spreads
replicates over tasks, each with its own seed, so that reruns and other partitionings give the same draws.
Unknown distances are nan here and null in tables; pairs with one are left out of both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Tails


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, freedom: float) -> float:
    return beta_share(freedom / 2, 0.5, freedom / (freedom + t * t)) if math.isfinite(t) else 0.0


def chi2_tail(x: float, freedom: float) -> float:
    """By the series of the lower part, or the continued fraction of the upper."""
    a, x = freedom / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        top = -i * (i - a)
        b += 2
        d = 1 / (top * d + b)
        c = b + top / c
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


# Ranks and correlations


def midranks(x: np.ndarray) -> np.ndarray:
    _, at, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[at.ravel()]


def dense_codes(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].ravel()


def pearson(x: np.ndarray, y: np.ndarray) -> float:
    a, b = x - x.mean(), y - y.mean()
    size = math.sqrt(float(a @ a) * float(b @ b))
    return float(a @ b) / size if size > 0 else math.nan


def spearman(x: np.ndarray, y: np.ndarray) -> float:
    return pearson(midranks(x), midranks(y))


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    """tau-b, from the table of distinct values: n pairs and d distinct ones take d^2 steps."""
    cells, counts = np.unique(np.stack([dense_codes(x), dense_codes(y)]), axis=1, return_counts=True)
    total = 0.0
    for k in range(len(counts)):
        total += counts[k] * float((np.sign(cells[0] - cells[0, k]) * np.sign(cells[1] - cells[1, k]) * counts).sum())
    n = len(x)
    ties = lambda v: float((np.unique(v, return_counts=True)[1] * (np.unique(v, return_counts=True)[1] - 1.0)).sum()) / 2
    whole = n * (n - 1) / 2
    size = math.sqrt((whole - ties(x)) * (whole - ties(y)))
    return total / 2 / size if size > 0 else math.nan


CORRELATIONS: dict[str, Callable[[np.ndarray, np.ndarray], float]] = {"pearson": pearson, "spearman": spearman, "kendall": kendall}


def correlation_p(r: float, n: int) -> float:
    """Two-sided, by t with n - 2 degrees of freedom (Pearson, Spearman)."""
    if n < 3 or not math.isfinite(r):
        return 1.0
    return t_two_sided(r * math.sqrt((n - 2) / max(1 - r * r, 1e-300)), n - 2) if abs(r) < 1 else 0.0


def concordance(x: np.ndarray, y: np.ndarray) -> float:
    """Lin's coefficient with sample variances; two constants agree if they are equal."""
    vx, vy, gap = x.var(ddof=1), y.var(ddof=1), (x.mean() - y.mean()) ** 2
    if vx == 0 and vy == 0:
        return float(gap == 0)
    return float(2 * np.cov(x, y)[0, 1] / (vx + vy + gap))


def effect_size(a: np.ndarray, b: np.ndarray) -> float:
    """Cohen's d with pooled variance; 0 for fewer than two rows in a group or no spread."""
    if min(len(a), len(b)) < 2:
        return 0.0
    pooled = ((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2)
    return float((a.mean() - b.mean()) / math.sqrt(pooled)) if pooled > 0 else 0.0


@dataclass(frozen=True)
class Line:
    slope: float
    intercept: float
    r2: float
    slope_error: float
    p: float


def line(x: np.ndarray, y: np.ndarray) -> Line:
    n, r = len(x), pearson(x, y)
    sxx, syy = float(((x - x.mean()) ** 2).sum()), float(((y - y.mean()) ** 2).sum())
    slope = float(((x - x.mean()) * (y - y.mean())).sum()) / sxx
    error = math.sqrt(max(syy - slope * slope * sxx, 0.0) / (n - 2) / sxx) if n > 2 else 0.0
    return Line(slope, float(y.mean() - slope * x.mean()), r * r, error, correlation_p(r, n))


def exponent(size: np.ndarray, cost: np.ndarray) -> Line:
    """The line through logarithms, where both are positive."""
    ok = (size > 0) & (cost > 0)
    return line(np.log(size[ok]), np.log(cost[ok]))


def growth(size: np.ndarray, cost: np.ndarray) -> tuple[str, float, float]:
    """polynomial or exponential, and both r2: exponential where its r2 is over the other's by more than 0.05."""
    ok = (size > 0) & (cost > 0)
    poly, expo = line(np.log(size[ok]), np.log(cost[ok])).r2, line(size[ok], np.log(cost[ok])).r2
    return ("exponential" if expo > poly + 0.05 else "polynomial"), poly, expo


# Tests


def holm(p: Sequence[float]) -> list[float]:
    order = np.argsort(np.asarray(p, float), kind="stable")
    steps = np.maximum.accumulate(np.asarray(p, float)[order] * np.arange(len(p), 0, -1)) if len(p) else np.empty(0)
    out = np.empty(len(p))
    out[order] = np.minimum(steps, 1.0)
    return out.tolist()


@dataclass(frozen=True)
class SignedRank:
    statistic: float
    p: float
    rank_biserial: float
    n_used: int
    n_zero: int
    z: float


def signed_rank(x: np.ndarray, y: np.ndarray) -> SignedRank:
    """Wilcoxon's test without the zero differences, with ties' correction; without any difference p is 1."""
    d = np.asarray(x, float) - np.asarray(y, float)
    used = d[d != 0]
    n, zero = len(used), len(d) - len(used)
    if not n:
        return SignedRank(0.0, 1.0, 0.0, 0, zero, 0.0)
    r = midranks(np.abs(used))
    plus, minus = float(r[used > 0].sum()), float(r[used < 0].sum())
    t = np.unique(r, return_counts=True)[1].astype(float)
    spread = n * (n + 1) * (2 * n + 1) / 24 - float((t**3 - t).sum()) / 48
    z = (plus - n * (n + 1) / 4) / math.sqrt(spread) if spread > 0 else 0.0
    return SignedRank(min(plus, minus), min(1.0, 2 * normal_tail(abs(z))), (plus - minus) / (plus + minus), n, zero, z)


#: Q of the studentised range at 0.05 over the root of 2, for 2 to 10 methods.
NEMENYI_Q = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}


def critical_difference(methods: int, datasets: int) -> float:
    return NEMENYI_Q[methods] * math.sqrt(methods * (methods + 1) / (6 * datasets)) if methods in NEMENYI_Q and datasets > 0 else math.nan


def friedman(scores: np.ndarray) -> tuple[float, float, list[float]]:
    """chi2, p and average ranks of methods (columns) over datasets (rows); lower scores rank first."""
    n, k = scores.shape
    ranks = np.stack([midranks(row) for row in scores])
    chi2 = 12 / (n * k * (k + 1)) * float((ranks.sum(axis=0) ** 2).sum()) - 3 * n * (k + 1)
    return chi2, chi2_tail(chi2, k - 1), ranks.mean(axis=0).tolist()


def cliques(ranks: Sequence[float], apart: float) -> list[tuple[int, ...]]:
    """Largest runs of methods whose ranks are less than ``apart`` from first to last, of two methods at least."""
    order = sorted(range(len(ranks)), key=lambda k: ranks[k])
    out: list[tuple[int, ...]] = []
    upto = 0
    for start in range(len(order)):
        end = start
        while end + 1 < len(order) and ranks[order[end + 1]] - ranks[order[start]] < apart:
            end += 1
        if end > start and end + 1 > upto:
            out.append(tuple(order[start : end + 1]))
            upto = end + 1
    return out


def trend(groups: Sequence[np.ndarray], falling: bool = True) -> tuple[float, float, float]:
    """Jonckheere and Terpstra's statistic, z and one-sided p: pairs of groups' rows in the direction asked for, ties by half."""
    total = 0.0
    for i, a in enumerate(groups):
        for b in groups[i + 1 :]:
            first, second = (a, b) if falling else (b, a)
            ordered = np.sort(second)
            total += float((np.searchsorted(ordered, first, "left") + np.searchsorted(ordered, first, "right")).sum()) / 2
    sizes = np.array([len(g) for g in groups], float)
    n = sizes.sum()
    spread = (n * n * (2 * n + 3) - (sizes**2 * (2 * sizes + 3)).sum()) / 72
    z = (total - (n * n - (sizes**2).sum()) / 4) / math.sqrt(spread) if spread > 0 else 0.0
    return total, z, normal_tail(z) if spread > 0 else 1.0


# Resampling


def replicated(spark: SparkSession, count: int, run: Callable[[np.random.Generator], float], seed: int = 42, tasks: int = 64) -> np.ndarray:
    """run(generator) for each replicate, spread over tasks; a replicate's generator is seeded by (seed, its number)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "value": [float(run(np.random.default_rng([seed, int(r)]))) for r in b["id"]]})

    rows = spark.range(0, count, 1, min(tasks, max(count, 1))).mapInPandas(each, "id long, value double").collect()
    return np.array([r.value for r in sorted(rows)])


def upper(matrix: np.ndarray) -> np.ndarray:
    return matrix[np.triu_indices(len(matrix), 1)]


def known_pairs(*matrices: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Upper triangles where every matrix has a finite distance of at least 0, and the mask."""
    rows = [upper(m).astype(float) for m in matrices]
    ok = np.logical_and.reduce([np.isfinite(v) & (v >= 0) for v in rows])
    return [v[ok] for v in rows], ok


def mantel(spark: SparkSession, one: np.ndarray, two: np.ndarray, method: str = "spearman", permutations: int = 999, seed: int = 42) -> tuple[float, float]:
    """r, and p: one more than the permutations of the first matrix that give as much, over one more than all.  The pairs used
    are those known at first."""
    (a, b), ok = known_pairs(one, two)
    if len(a) < 3:
        return math.nan, 1.0
    corr, n = CORRELATIONS[method], len(one)
    i, j = np.triu_indices(n, 1)

    def run(rng: np.random.Generator) -> float:
        to = rng.permutation(n)
        moved = one[to[i], to[j]][ok]
        fine = np.isfinite(moved)
        return corr(moved[fine], b[fine])

    seen, got = corr(a, b), replicated(spark, permutations, run, seed)
    return seen, (int((got >= seen).sum()) + 1) / (permutations + 1)


def correlation_interval(spark: SparkSession, x: np.ndarray, y: np.ndarray, method: str = "spearman", replicates: int = 1000, level: float = 0.95, seed: int = 42) -> tuple[float, float, float]:
    """r on all pairs and its percentile interval from pairs drawn with replacement."""
    corr = CORRELATIONS[method]

    def run(rng: np.random.Generator) -> float:
        at = rng.integers(0, len(x), len(x))
        return corr(x[at], y[at])

    low, high = np.nanpercentile(replicated(spark, replicates, run, seed), [50 * (1 - level), 50 * (1 + level)])
    return corr(x, y), float(low), float(high)


def drawn_pairs(picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of graphs drawn with replacement: all pairs of draws but those of a graph with itself; repeats count."""
    i, j = np.triu_indices(len(picks), 1)
    a, b = picks[i], picks[j]
    return a[a != b], b[a != b]


def cluster_interval(spark: SparkSession, one: np.ndarray, two: np.ndarray, method: str = "spearman", replicates: int = 500, seed: int = 42) -> tuple[float, float]:
    """Percentile interval of a correlation when graphs, not pairs, are drawn."""
    corr, n = CORRELATIONS[method], len(one)

    def run(rng: np.random.Generator) -> float:
        a, b = drawn_pairs(rng.integers(0, n, n))
        x, y = one[a, b], two[a, b]
        ok = np.isfinite(x) & np.isfinite(y)
        return corr(x[ok], y[ok]) if ok.sum() > 2 else math.nan

    low, high = np.nanpercentile(replicated(spark, replicates, run, seed), [2.5, 97.5])
    return float(low), float(high)


def weighted_sums(counts: np.ndarray, values: np.ndarray) -> float:
    """Sum of a symmetric matrix over the pairs of drawn graphs, from how often each was drawn: half of c'Fc less its diagonal."""
    return float(counts @ values @ counts - (counts * counts * np.diag(values)).sum()) / 2


def slope_interval(spark: SparkSession, x: np.ndarray, y: np.ndarray, replicates: int = 500, seed: int = 42) -> tuple[float, float]:
    """Percentile interval of the slope of y on x (symmetric matrices) when graphs are drawn, from weighted sums."""
    n, one = len(x), np.ones_like(x) - np.eye(len(x))
    x, y = x * one, y * one

    def run(rng: np.random.Generator) -> float:
        c = np.bincount(rng.integers(0, n, n), minlength=n).astype(float)
        w, sx, sy, sxx, sxy = (weighted_sums(c, f) for f in (one, x, y, x * x, x * y))
        below = w * sxx - sx * sx
        return (w * sxy - sx * sy) / below if below > 0 else math.nan

    low, high = np.nanpercentile(replicated(spark, replicates, run, seed), [2.5, 97.5])
    return float(low), float(high)


# Scaling


def finite_rows(d: np.ndarray) -> np.ndarray:
    """Rows that stay when the row of most unknown distances goes, again and again, the first of equals, until all are known."""
    keep = np.arange(len(d))
    while len(keep) and (bad := (~np.isfinite(d[np.ix_(keep, keep)])).sum(axis=1)).max() > 0:
        keep = np.delete(keep, int(np.argmax(bad)))
    return keep


def filled(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unknown distances become twice the largest, with weight 0."""
    ok = np.isfinite(d)
    return np.where(ok, d, 2 * d[ok].max(initial=0.0)), ok.astype(float)


def double_centred(d: np.ndarray) -> np.ndarray:
    s = d.astype(float) ** 2
    return -0.5 * (s - s.mean(axis=0) - s.mean(axis=1)[:, None] + s.mean())


@dataclass(frozen=True)
class Spectrum:
    """Eigenvalues from the largest on, the share of the negative ones, and the positive ones' cumulative share."""

    values: np.ndarray
    negative_share: float
    cumulative: np.ndarray


def spectrum(d: np.ndarray) -> Spectrum:
    values = np.linalg.eigvalsh(double_centred(d))[::-1]
    size, up = np.abs(values).sum(), np.maximum(values, 0)
    return Spectrum(values, float(-values[values < 0].sum() / size) if size > 0 else 0.0, np.cumsum(up) / up.sum() if up.sum() > 0 else up * 0)


def classical(d: np.ndarray, dims: int) -> np.ndarray:
    """Coordinates along the largest eigenvalues; zeros where they are not positive."""
    values, vectors = np.linalg.eigh(double_centred(d))
    values, vectors = values[::-1][:dims], vectors[:, ::-1][:, :dims]
    return vectors * np.sqrt(np.maximum(values, 0))


def embedded(coords: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((coords[:, None] - coords[None]) ** 2).sum(axis=2), 0))


def stress(d: np.ndarray, coords: np.ndarray, weights: np.ndarray | None = None) -> float:
    """Kruskal's stress-1: squared differences over the squares of the embedded distances."""
    e, w = upper(embedded(coords)), np.ones(len(d) * (len(d) - 1) // 2) if weights is None else upper(weights)
    below = float((w * e * e).sum())
    return math.sqrt(float((w * (upper(d) - e) ** 2).sum()) / below) if below > 0 else 0.0


def smacof(d: np.ndarray, dims: int = 2, turns: int = 300, least: float = 1e-6, starts: int = 4, seed: int = 42, weights: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Coordinates of least raw stress found by majorisation, from the classical ones and random starts; and stress-1."""
    n = len(d)
    w = (np.ones_like(d, float) if weights is None else weights.astype(float)) * (1 - np.eye(n))
    v = np.diag(w.sum(axis=1)) - w
    inverse = np.linalg.pinv(v)
    best: tuple[float, np.ndarray] | None = None
    for start in range(starts):
        x = classical(d, dims) if start == 0 else np.random.default_rng([seed, start]).normal(size=(n, dims)) * d.mean()
        before = math.inf
        for _ in range(turns):
            e = embedded(x)
            raw = float((w * (d - e) ** 2).sum()) / 2
            if before - raw < least * max(raw, 1e-12):
                break
            before = raw
            ratio = np.where(e > 1e-12, w * d / np.where(e > 1e-12, e, 1.0), 0.0)
            x = inverse @ ((np.diag(ratio.sum(axis=1)) - ratio) @ x)
        raw = float((w * (d - embedded(x)) ** 2).sum()) / 2
        if best is None or raw < best[0]:
            best = raw, x
    return best[1], stress(d, best[1], weights)


def procrustes(a: np.ndarray, b: np.ndarray) -> float:
    """What is left of the squared distance after moving, turning and scaling one set of points onto the other, in 0 to 1."""
    x, y = a - a.mean(axis=0), b - b.mean(axis=0)
    x, y = x / max(np.linalg.norm(x), 1e-300), y / max(np.linalg.norm(y), 1e-300)
    return float(1 - np.linalg.svd(x.T @ y, compute_uv=False).sum() ** 2)


def procrustes_test(spark: SparkSession, a: np.ndarray, b: np.ndarray, permutations: int = 999, seed: int = 42) -> tuple[float, float]:
    """The rest, and p: the share of permutations of the second set that leave as little."""
    seen = procrustes(a, b)
    got = replicated(spark, permutations, lambda rng: procrustes(a, b[rng.permutation(len(b))]), seed)
    return seen, (int((got <= seen).sum()) + 1) / (permutations + 1)


def shepard(d: np.ndarray, coords: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Squared Pearson and Spearman correlation of distances and embedded distances, where the weight is positive."""
    x, y = upper(d).astype(float), upper(embedded(coords))
    if weights is not None:
        x, y = x[upper(weights) > 0], y[upper(weights) > 0]
    return pearson(x, y) ** 2, spearman(x, y) ** 2


def effective_rank(kernel: np.ndarray) -> float:
    """The exponential of the entropy of the eigenvalues' shares."""
    values = np.maximum(np.linalg.eigvalsh(kernel), 0)
    share = values[values > 1e-12 * max(values.max(initial=0.0), 1e-300)] / max(values.sum(), 1e-300)
    return float(np.exp(-(share * np.log(share)).sum()))


def matrix(pairs: DataFrame, value: str, n: int) -> np.ndarray:
    """The symmetric matrix of a small collection's pairs (i, j, value), nan where unknown; for the functions above."""
    out = np.full((n, n), np.nan)
    np.fill_diagonal(out, 0.0)
    for r in pairs.select("i", "j", value).toLocalIterator():
        if r[2] is not None:
            out[r[0], r[1]] = out[r[1], r[0]] = r[2]
    return out
