"""Scaling and centralities of collections, one task for each dataset or stretch of graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringlet.functions import statistics
from ringlet.operators.encode import bits
from ringlet.operators.ged import adjacency


def _matrices(rows: pd.DataFrame, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Members of the dataset and their matrices; unknown distances are nan."""
    members = np.unique(np.concatenate([rows["i"], rows["j"]]))
    i, j = np.searchsorted(members, rows["i"]), np.searchsorted(members, rows["j"])
    out = []
    for name in names:
        m = np.full((len(members), len(members)), np.nan)
        np.fill_diagonal(m, 0.0)
        m[i, j] = m[j, i] = rows[name].astype(float)
        out.append(m)
    return members, out


def by_dataset(pairs: DataFrame, names: list[str], run: Callable[[np.ndarray, list[np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """run(members, matrices) of each dataset's pairs (dataset, i, j, and the distances named); its rows follow the dataset.  A dataset's
    matrices are held by one task, as its eigenvalues need them together."""
    columns = ["dataset", *(c.split()[0] for c in schema.split(", "))]

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(rows["dataset"].iloc[0], *x) for x in run(*_matrices(rows, names))], columns=columns)

    kind = pairs.schema["dataset"].dataType.simpleString()
    return pairs.select("dataset", "i", "j", *names).groupBy("dataset").applyInPandas(each, f"dataset {kind}, {schema}")


def spectra(pairs: DataFrame, name: str) -> DataFrame:
    """dataset, place, value, cumulative, negative_share: eigenvalues of the doubly centred squares, of the rows whose distances are known."""

    def run(_: np.ndarray, m: list[np.ndarray]) -> list[tuple]:
        keep = statistics.finite_rows(m[0])
        s = statistics.spectrum(m[0][np.ix_(keep, keep)])
        return [(k, float(v), float(c), s.negative_share) for k, (v, c) in enumerate(zip(s.values, s.cumulative, strict=True))]

    return by_dataset(pairs, [name], run, "place int, value double, cumulative double, negative_share double")


def coordinates(pairs: DataFrame, name: str, dims: int = 2, method: str = "smacof", starts: int = 2, turns: int = 100) -> DataFrame:
    """dataset, i, at (an array of ``dims``): unknown distances weigh nothing."""
    if method not in ("smacof", "classical"):
        raise ValueError(f"no method {method}")

    def run(members: np.ndarray, m: list[np.ndarray]) -> list[tuple]:
        d, w = statistics.filled(m[0])
        x = statistics.classical(d, dims) if method == "classical" else statistics.smacof(d, dims, turns, starts=starts, weights=w)[0]
        return [(int(i), row.tolist()) for i, row in zip(members, x, strict=True)]

    return by_dataset(pairs, [name], run, "i long, at array<double>")


def embedded_pairs(pairs: DataFrame, coords: DataFrame, name: str) -> DataFrame:
    """dataset, i, j, distance, embedded: the distances between coordinates, joined by pair."""
    a = coords.select("dataset", "i", F.col("at").alias("_a"))
    b = coords.select("dataset", F.col("i").alias("j"), F.col("at").alias("_b"))
    square = F.aggregate(F.zip_with("_a", "_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    met = pairs.select("dataset", "i", "j", F.col(name).cast("double").alias("distance")).join(a, ["dataset", "i"]).join(b, ["dataset", "j"])
    return met.select("dataset", "i", "j", "distance", F.sqrt(square).alias("embedded"))


def stress(pairs: DataFrame, coords: DataFrame, name: str) -> DataFrame:
    """dataset, stress (over the embedded squares), r2 of the distances on the embedded ones."""
    e = embedded_pairs(pairs, coords, name)
    gap, below = F.col("distance") - F.col("embedded"), F.sum(F.col("embedded") * F.col("embedded"))
    spread = F.stddev_samp("distance") * F.stddev_samp("embedded")
    r = F.covar_samp("distance", "embedded") / F.nullif(spread, F.lit(0.0))
    return e.groupBy("dataset").agg(F.sqrt(F.sum(gap * gap) / F.nullif(below, F.lit(0.0))).alias("stress"), (r * r).alias("r2"))


def agreement(pairs: DataFrame, one: str, two: str, dims: int = 2, permutations: int = 99, seed: int = 42) -> DataFrame:
    """dataset, rest, p, monotone_r2: how far the classical coordinates of two distances agree (Procrustes), against permutations."""

    def run(_: np.ndarray, m: list[np.ndarray]) -> list[tuple]:
        (a, _w), (b, _v) = statistics.filled(m[0]), statistics.filled(m[1])
        x, y = statistics.classical(a, dims), statistics.classical(b, dims)
        seen, rng = statistics.procrustes(x, y), np.random.default_rng(seed)
        less = sum(statistics.procrustes(x, y[rng.permutation(len(y))]) <= seen for _ in range(permutations))
        return [(seen, (less + 1) / (permutations + 1), statistics.shepard(a, x)[1])]

    return by_dataset(pairs, [one, two], run, "rest double, p double, monotone_r2 double")


def correlation_report(pairs: DataFrame, proxies: list[str], reference: str, replicates: int = 200, permutations: int = 99, seed: int = 42) -> DataFrame:
    """dataset, method, n, pearson, spearman, kendall, ccc, slope, low, high (graphs drawn anew), p (Mantel), p_holm over all rows:
    how well each proxy distance follows the reference, on the pairs that both know."""

    def run(_: np.ndarray, m: list[np.ndarray]) -> list[tuple]:
        ref, out = m[-1], []
        for name, d in zip(proxies, m, strict=False):
            (x, y), ok = statistics.known_pairs(d, ref)
            if len(x) < 3 or x.std() == 0 or y.std() == 0:
                out.append((name, len(x), *[None] * 9))
                continue
            rng, n, (i, j) = np.random.default_rng(seed), len(ref), np.triu_indices(len(ref), 1)
            rho, moved, drawn = statistics.spearman(x, y), 0, []
            for _turn in range(permutations):
                to = rng.permutation(n)
                other = d[to[i], to[j]][ok]
                fine = np.isfinite(other)
                moved += statistics.spearman(other[fine], y[fine]) >= rho
            for _turn in range(replicates):
                a, b = statistics.drawn_pairs(rng.integers(0, n, n))
                fine = np.isfinite(d[a, b]) & np.isfinite(ref[a, b])
                drawn.append(statistics.spearman(d[a, b][fine], ref[a, b][fine]))
            low, high = np.nanpercentile(drawn, [2.5, 97.5])
            out.append((name, len(x), statistics.pearson(x, y), rho, statistics.kendall(x, y), statistics.concordance(x, y), statistics.line(x, y).slope, float(low), float(high), (moved + 1) / (permutations + 1), None))
        return out

    fields = "method string, n long, pearson double, spearman double, kendall double, ccc double, slope double, low double, high double, p double, p_holm double"
    rows = by_dataset(pairs, [*proxies, reference], run, fields)
    # Holm over the report's rows, which are datasets times methods.
    every = Window.orderBy("p", "dataset", "method")
    known = rows.where("p IS NOT NULL").drop("p_holm").withColumn("_r", F.row_number().over(every)).withColumn("_m", F.count("*").over(Window.partitionBy()))
    step = F.max(F.col("p") * (F.col("_m") - F.col("_r") + 1)).over(every.rowsBetween(Window.unboundedPreceding, 0))
    return known.withColumn("p_holm", F.least(step, F.lit(1.0))).drop("_r", "_m").unionByName(rows.where("p IS NULL"))


def distances_from(adj: list[int], start: int) -> list[int]:
    """Steps from a node to each, -1 where there is no way."""
    out, seen, ring, step = [-1] * len(adj), 1 << start, 1 << start, 0
    while ring:
        near = 0
        for u in bits(ring):
            out[u] = step
            near |= adj[u]
        ring, step = near & ~seen, step + 1
        seen |= ring
    return out


def centrality(n: int, edges: list[tuple[int, int]]) -> list[tuple[float, float, float]]:
    """Degree, closeness and betweenness of each node, as shares of what is possible."""
    adj = adjacency(n, edges)
    between = [0.0] * n
    close = []
    for s in range(n):
        far = distances_from(adj, s)
        order = sorted((u for u in range(n) if far[u] >= 0), key=lambda u: far[u])
        ways = [0.0] * n
        ways[s] = 1.0
        for u in order[1:]:
            ways[u] = sum(ways[v] for v in bits(adj[u]) if far[v] == far[u] - 1)
        given = [0.0] * n
        for u in reversed(order[1:]):
            for v in bits(adj[u]):
                if far[v] == far[u] - 1:
                    given[v] += ways[v] / ways[u] * (1 + given[u])
            between[u] += given[u]
        steps, reached = sum(d for d in far if d > 0), len(order) - 1
        close.append(reached / steps * reached / (n - 1) if steps else 0.0)
    pairs = (n - 1) * (n - 2)
    return [(adj[u].bit_count() / (n - 1) if n > 1 else 0.0, close[u], between[u] / pairs if pairs > 0 else 0.0) for u in range(n)]


def centralities(graphs: DataFrame) -> DataFrame:
    """id, node, degree, closeness, betweenness."""
    kind = graphs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, u, *c) for i, n, e in zip(b["id"], b["n"], b["edges"], strict=True) for u, c in enumerate(centrality(n, [(x["u"], x["v"]) for x in e]))]
            yield pd.DataFrame(rows, columns=["id", "node", "degree", "closeness", "betweenness"])

    return graphs.select("id", "n", "edges").mapInPandas(run, f"id {kind}, node int, degree double, closeness double, betweenness double")
