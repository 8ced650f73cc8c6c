"""Made-up graphs and strings.  Random ones are drawn by hashes of (seed, instance, place), so that any partitioning draws the same."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlet.operators import decode

Edges = list[tuple[int, int]]
#: Families and the sizes they are made in.
FAMILIES = {
    "path": range(3, 21), "star": range(3, 21), "cycle": range(3, 21), "complete": range(3, 11), "binary_tree": range(3, 21), "ba_m1": range(3, 21),
    "ba_m2": range(4, 21), "gnp_03": range(3, 21), "gnp_05": range(3, 21), "grid": range(4, 21),
}


def chance(*key: object) -> float:
    """A number in [0, 1) that the key decides."""
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=7).digest(), "big") / 2**56


def path(n: int) -> Edges:
    return [(k, k + 1) for k in range(n - 1)]


def star(n: int) -> Edges:
    return [(0, k) for k in range(1, n)]


def cycle(n: int) -> Edges:
    return path(n) + ([(0, n - 1)] if n > 2 else [])


def complete(n: int) -> Edges:
    return [(u, v) for v in range(n) for u in range(v)]


def binary_tree(n: int) -> Edges:
    return [((k - 1) // 2, k) for k in range(1, n)]


def grid(n: int) -> Edges:
    """Nodes row by row on the widest grid not wider than the root of n."""
    width = max(math.isqrt(n), 1)
    return [(k - 1, k) for k in range(n) if k % width] + [(k - width, k) for k in range(width, n)]


def gnp(n: int, p: float, *key: object) -> Edges:
    return [(u, v) for u, v in complete(n) if chance("gnp", n, p, u, v, *key) < p]


def attached(n: int, m: int, *key: object) -> Edges:
    """Preferential attachment: each node joins m earlier ones, drawn by their number of edges."""
    edges: Edges = star(m + 1) if n > m else complete(n)
    ends = [x for e in edges for x in e]
    for v in range(m + 1, n):
        chosen: set[int] = set()
        turn = 0
        while len(chosen) < m:
            chosen.add(ends[int(chance("attach", v, turn, m, *key) * len(ends))])
            turn += 1
        edges += [(u, v) for u in sorted(chosen)]
        ends += [x for u in chosen for x in (u, v)]
    return sorted(edges)


def random_tree(n: int, *key: object) -> Edges:
    return [(int(chance("tree", v, *key) * v), v) for v in range(1, n)]


def small_world(n: int, k: int, p: float, *key: object) -> Edges:
    """A ring of k neighbours each, whose edges move their far end with chance p."""
    edges = {(min(u, (u + s) % n), max(u, (u + s) % n)) for u in range(n) for s in range(1, k // 2 + 1) if n > 1 and u != (u + s) % n}
    for u, v in sorted(edges):
        if chance("move", u, v, *key) < p:
            free = [w for w in range(n) if w != u and (min(u, w), max(u, w)) not in edges]
            if free:
                w = free[int(chance("to", u, v, *key) * len(free))]
                edges = (edges - {(u, v)}) | {(min(u, w), max(u, w))}
    return sorted(edges)


def joined(n: int, edges: Edges) -> Edges:
    """The edges, and one from each further component's first node to node 0."""
    top = list(range(n))

    def root(x: int) -> int:
        while top[x] != x:
            x = top[x]
        return x

    for u, v in edges:
        top[max(root(u), root(v))] = min(root(u), root(v))
    return sorted(set(edges) | {(0, v) for v in range(1, n) if root(v) == v})


def family(name: str, n: int, seed: int = 42, instance: int = 0) -> Edges:
    """A connected graph of one family; the seed of an instance is seed + 1000 instance + n."""
    key = seed + instance * 1000 + n
    made = {
        "path": lambda: path(n), "star": lambda: star(n), "cycle": lambda: cycle(n), "complete": lambda: complete(n), "binary_tree": lambda: binary_tree(n), "grid": lambda: grid(n),
        "ba_m1": lambda: attached(n, 1, key), "ba_m2": lambda: attached(n, 2, key), "gnp_03": lambda: gnp(n, 0.3, key), "gnp_05": lambda: gnp(n, 0.5, key),
    }
    if name not in made:
        raise ValueError(f"no family {name}")
    return joined(n, made[name]())


def edited(n: int, edges: Edges, k: int, *key: object) -> Edges:
    """The graph after k changes of different cells: an edge there goes, one not there comes."""
    cells = sorted(complete(n), key=lambda e: chance("edit", e, *key))[:k]
    return sorted(set(edges) ^ set(cells))


def with_loops(n: int, edges: Edges, p: float, *key: object) -> Edges:
    return sorted([*edges, *((u, u) for u in range(n) if chance("loop", u, *key) < p)])


def relabelled(n: int, edges: Edges, *key: object) -> Edges:
    """An isomorphic copy, nodes renamed in an order drawn by hash."""
    place = {u: k for k, u in enumerate(sorted(range(n), key=lambda u: chance("name", u, *key)))}
    return sorted((min(place[u], place[v]), max(place[u], place[v])) for u, v in edges)


_GRAPH = f"id string, family string, instance int, n int, edges array<{decode.EDGE}>"


def _made(spark: SparkSession, wanted: list[tuple[str, int, int]], seed: int) -> DataFrame:
    rows = spark.createDataFrame(wanted, "family string, n int, instance int")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(f"{f}_{n}_{i}", f, i, n, [{"u": u, "v": v} for u, v in family(f, n, seed, i)]) for f, n, i in zip(b["family"], b["n"], b["instance"], strict=True)]
            yield pd.DataFrame(out, columns=["id", "family", "instance", "n", "edges"])

    return rows.mapInPandas(run, _GRAPH)


def families(spark: SparkSession, names: list[str] | None = None, instances: int = 3, seed: int = 42, largest: int | None = None) -> DataFrame:
    """id, family, instance, n, edges of every family in all its sizes up to ``largest``."""
    wanted = [(f, n, i) for f in names or FAMILIES for n in FAMILIES[f] if largest is None or n <= largest for i in range(instances)]
    return _made(spark, wanted, seed)


def density_sweep(spark: SparkSession, n: int = 10, shares: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), instances: int = 10, seed: int = 42) -> DataFrame:
    rows = spark.createDataFrame([(float(p), i) for p in shares for i in range(instances)], "p double, instance int")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(f"sweep_{p}_{i}", f"gnp_{p}", i, n, [{"u": u, "v": v} for u, v in joined(n, gnp(n, p, seed, i))]) for p, i in zip(b["p"], b["instance"], strict=True)]
            yield pd.DataFrame(out, columns=["id", "family", "instance", "n", "edges"])

    return rows.mapInPandas(run, _GRAPH)


def random_strings(spark: SparkSession, count: int, longest: int = 40, seed: int = 42) -> DataFrame:
    """id, w: strings of 0 to ``longest`` letters, each letter by a hash of its place."""
    rows = spark.range(count).withColumn("l", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(longest + 1)).cast("int"))
    letter = lambda k: F.substring(F.lit(decode.ALPHABET), (F.pmod(F.xxhash64("id", k, F.lit(seed)), F.lit(9)) + 1).cast("int"), F.lit(1))
    letters = F.transform(F.filter(F.sequence(F.lit(0), F.col("l")), lambda k: k < F.col("l")), letter)
    return rows.select("id", F.array_join(letters, "").alias("w"))


def edit_pairs(spark: SparkSession, graphs: DataFrame, most: int = 4) -> DataFrame:
    """id, k, n, edges, edited: each graph with k edits, k from 1 to ``most``."""
    kind = graphs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for id_, n, edges in zip(b["id"], b["n"], b["edges"], strict=True):
                plain = sorted({(min(e["u"], e["v"]), max(e["u"], e["v"])) for e in edges if e["u"] != e["v"]})
                for k in range(1, min(most, n * (n - 1) // 2) + 1):
                    out.append((id_, k, n, [{"u": u, "v": v} for u, v in plain], [{"u": u, "v": v} for u, v in edited(n, plain, k, id_)]))
            yield pd.DataFrame(out, columns=["id", "k", "n", "edges", "edited"])

    return graphs.select("id", "n", "edges").mapInPandas(run, f"id {kind}, k int, n int, edges array<{decode.EDGE}>, edited array<{decode.EDGE}>")


#: Small graphs known by heart: name -> (n, edges).
FIXTURES: dict[str, tuple[int, Edges]] = {
    "triangle": (3, cycle(3)), "path_3": (3, path(3)), "square_and_triangle": (7, [*cycle(4), (3, 4), (4, 5), (5, 6), (4, 6)]),
    "k33": (6, [(u, v) for u in range(3) for v in range(3, 6)]), "prism": (6, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (0, 3), (1, 4), (2, 5)]),
    "two_parts": (7, [*cycle(4), (4, 5), (5, 6), (4, 6)]), "edge": (2, [(0, 1)]), "empty_3": (3, []),
}


def fixtures(spark: SparkSession) -> DataFrame:
    rows = [(name, n, edges) for name, (n, edges) in FIXTURES.items()]
    return spark.createDataFrame(rows, f"id string, n int, edges array<{decode.EDGE}>")
