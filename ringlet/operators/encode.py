"""Encoding of graphs as instruction strings: Arrow functions over rows of one graph and one start node.

The encoder looks at displacements of both pointers in order of total, then first, distance, and
takes the first that allows an operation: a new node at the first pointer, at the second,
an edge, or (directed) a reversed edge.  Greedy encoders take the smallest new neighbour; the exhaustive one
tries all, the pruned one those of the largest structural triplet, and both keep the
shortest, then first, string over all starts.  The searches have no budget unless one is given; beyond it the
string is null, never a best so far.

A search leaves a branch when the edges still to be made could not give a string as short as the best one (every edge
takes an instruction of its own), and tries only one of several new nodes that have the same neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlet.operators import decode

METHODS = ("single", "min", "pruned", "exhaustive")


@cache
def displacements(m: int) -> tuple[tuple[int, int], ...]:
    """All displacements of the two pointers up to m, in the order in which the encoder looks at them."""
    span = range(-m, m + 1)
    return tuple(sorted(((a, b) for a in span for b in span), key=lambda x: (abs(x[0]) + abs(x[1]), abs(x[0]), x)))


def bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


class Search:
    """All strings of one graph from one start that the choice of new neighbours allows.

    ``out[u]`` are the neighbours of u as bits; ``left[u]`` those edges of it not yet made."""

    def __init__(self, n: int, edges: list[tuple[int, int]], directed: bool, choose: Callable[[list[int]], list[int]], budget: int | None = None):
        self.n, self.directed, self.choose, self.steps = n, directed, choose, budget
        self.out, self.into = [0] * n, [0] * n
        for u, v in edges:
            self.out[u] |= 1 << v
            self.into[v] |= 1 << u
            if not directed:
                self.out[v] |= 1 << u
                self.into[u] |= 1 << v
        self.total = sum(x.bit_count() for x in self.out)
        if not directed:
            self.total = (self.total + sum(self.out[u] >> u & 1 for u in range(n))) // 2

    def reaches_all(self, start: int) -> bool:
        seen = new = 1 << start
        while new:
            near = 0
            for u in bits(new):
                near |= self.out[u]
            new = near & ~seen
            seen |= new
        return seen == (1 << self.n) - 1

    def best(self, start: int) -> str | None:
        """Shortest, then first, string; None where a node cannot be reached or the budget ends."""
        if not self.reaches_all(start):
            return None
        self.found: str | None = None
        self._grow([start], 0, 0, 1 << start, list(self.out), self.total, "")
        return None if self.spent else self.found

    @property
    def spent(self) -> bool:
        return self.steps is not None and self.steps < 0

    def _take(self, left: list[int], u: int, v: int) -> None:
        left[u] &= ~(1 << v)
        if not self.directed:
            left[v] &= ~(1 << u)

    def _hopeless(self, text: str, missing: int) -> bool:
        if self.found is None:
            return False
        least = len(text) + missing
        return least > len(self.found) or (least == len(self.found) and text > self.found[: len(text)])

    def _grow(self, ring: list[int], p: int, s: int, placed: int, left: list[int], missing: int, text: str) -> None:
        """``left``: edges to be made; ``missing``: their number."""
        while True:
            if self.steps is not None:
                self.steps -= 1
                if self.steps < 0:
                    return
            if self._hopeless(text, missing):
                return
            if not missing and len(ring) == self.n:
                if self.found is None or (len(text), text) < (len(self.found), self.found):
                    self.found = text
                return
            rank, a, b = self._nearest(ring, p, s, placed, left)
            m = len(ring)
            if rank != 1:
                text += "N" * a if a > 0 else "P" * -a
                p = (p + a) % m
            if rank != 0:
                text += "n" * b if b > 0 else "p" * -b
                s = (s + b) % m
            text += "VvCc"[rank]
            missing -= 1
            if rank >= 2:
                left = list(left)
                self._take(left, *((ring[p], ring[s]) if rank == 2 else (ring[s], ring[p])))
                continue
            at = p if rank == 0 else s
            options = self._distinct(self.choose(list(bits(self.out[ring[at]] & ~placed))))
            for x in options[1:]:
                self._grow(*self._inserted(ring, p, s, placed, left, rank, at, x), missing, text)
            ring, p, s, placed, left = self._inserted(ring, p, s, placed, left, rank, at, options[0])

    def _inserted(self, ring, p, s, placed, left, rank, at, x):
        left = list(left)
        self._take(left, ring[at], x)
        if rank == 0:
            s += s > p
        else:
            p += p > s
        return [*ring[: at + 1], x, *ring[at + 1 :]], p, s, placed | 1 << x, left

    def _distinct(self, options: list[int]) -> list[int]:
        """One of each set of new nodes that only their names tell apart: the same neighbours, but for one another."""
        if len(options) < 2:
            return options
        kept: list[int] = []
        for x in options:
            if not any(self._twins(x, y) for y in kept):
                kept.append(x)
        return kept

    def _twins(self, x: int, y: int) -> bool:
        both = 1 << x | 1 << y
        if self.out[x] & ~both != self.out[y] & ~both or self.into[x] & ~both != self.into[y] & ~both:
            return False
        return (self.out[x] >> y & 1) == (self.out[y] >> x & 1) and (self.out[x] >> x & 1) == (self.out[y] >> y & 1)

    def _nearest(self, ring: list[int], p: int, s: int, placed: int, left: list[int]) -> tuple[int, int, int]:
        """Kind (0 V, 1 v, 2 C, 3 c) and displacements of the first operation in the order of ``displacements``."""
        m, best = len(ring), None
        place = {u: i for i, u in enumerate(ring)}
        for i, u in enumerate(ring):
            if self.out[u] & ~placed:
                a, b = _short(i - p, m), _short(i - s, m)
                for key in ((abs(a), abs(a), a, 0, 0), (abs(b), 0, 0, b, 1)):
                    if best is None or key < best:
                        best = key
        for u in ring:
            for v in bits(left[u] & placed):
                a, b = _short(place[u] - p, m), _short(place[v] - s, m)
                key = (abs(a) + abs(b), abs(a), a, b, 2)
                if best is None or key < best:
                    best = key
                if self.directed:
                    a, b = _short(place[v] - p, m), _short(place[u] - s, m)
                    key = (abs(a) + abs(b), abs(a), a, b, 3)
                    if key < best:
                        best = key
        if best is None:
            raise ValueError("no operation left")
        return best[4], best[2], best[3]


def _short(d: int, m: int) -> int:
    """The displacement of least distance around a ring of m, backwards on a tie."""
    d %= m
    return d if 2 * d < m else d - m


def triplets(n: int, edges: list[tuple[int, int]], directed: bool) -> list[tuple[int, int, int]]:
    """Nodes at distance 1, 2 and 3 of each node."""
    out = Search(n, edges, directed, list).out
    result = []
    for x in range(n):
        seen = ring = 1 << x
        counts = []
        for _ in range(3):
            near = 0
            for y in bits(ring):
                near |= out[y]
            ring = near & ~seen
            seen |= ring
            counts.append(ring.bit_count())
        result.append(tuple(counts))
    return result


def _chooser(n: int, edges: list[tuple[int, int]], directed: bool, method: str) -> Callable[[list[int]], list[int]]:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if method in ("single", "min"):
        return lambda new: new[:1]
    if method == "exhaustive":
        return lambda new: new
    rank = triplets(n, edges, directed)

    def largest(new: list[int]) -> list[int]:
        top = max(rank[x] for x in new)
        return [x for x in new if rank[x] == top]

    return largest


def encode_from(n: int, edges: list[tuple[int, int]], directed: bool, method: str, start: int, budget: int | None = None) -> str | None:
    """The string from one start node."""
    if n <= 1 and not edges:
        return ""
    return Search(n, edges, directed, _chooser(n, edges, directed, method), budget).best(start)


def encode(n: int, edges: list[tuple[int, int]], directed: bool, method: str, start: int = 0, budget: int | None = None) -> str | None:
    """``single`` (from ``start``), ``min`` (greedy from all), ``pruned`` or ``exhaustive``; a budget holds for each start, and null
    from any start that spends it makes the whole null."""
    if n <= 1 and not edges:
        return ""
    found = []
    for first in [start] if method == "single" else range(n):
        search = Search(n, edges, directed, _chooser(n, edges, directed, method), budget)
        found.append(search.best(first))
        if search.spent:
            return None
    return min((w for w in found if w is not None), key=lambda w: (len(w), w), default=None)


def from_starts(graphs: DataFrame, method: str, directed: bool = False, budget: int | None = None, start: int | None = None) -> DataFrame:
    """id, start, w, spent for each graph (id, n, edges) and start node (only ``start`` if given): the rows of one graph are spread
    over tasks like those of different ones."""
    kind = graphs.schema["id"].dataType.simpleString()
    starts = F.array(F.lit(start)) if start is not None else F.sequence(F.lit(0), F.greatest(F.col("n"), F.lit(1)) - 1)
    rows = graphs.select("id", "n", "edges", F.explode(starts).alias("start"))
    spark = graphs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w, spent = [], []
            for n, edges, first in zip(b["n"], b["edges"], b["start"], strict=True):
                pairs = [(e["u"], e["v"]) for e in edges]
                search = Search(n, pairs, directed, _chooser(n, pairs, directed, method), budget)
                w.append(search.best(first) if n > 1 or pairs else "")
                spent.append(search.spent)
            yield pd.DataFrame({"id": b["id"], "start": b["start"], "w": pd.Series(w, dtype=object), "spent": spent})

    return rows.repartition(tasks, "id", "start").mapInPandas(run, f"id {kind}, start int, w string, spent boolean")


def encoded(graphs: DataFrame, method: str, directed: bool = False, budget: int | None = None, start: int = 0) -> DataFrame:
    """id, encoding of graphs (id, n, edges array<struct<u,v>>): null where no start reaches all nodes, or the budget ends."""
    rows = from_starts(graphs, method, directed, budget, start if method == "single" else None)
    least = F.min(F.when(F.col("w").isNotNull(), F.struct(F.length("w").alias("l"), "w")))["w"]
    return rows.groupBy("id").agg(F.when(~F.max("spent"), least).alias("encoding"))


def isomorphism_classes(graphs: DataFrame, directed: bool = False, budget: int | None = None) -> DataFrame:
    """Graphs grouped by exhaustive canonical string: encoding, n_graphs, first_id.  The row of a null
    encoding is no class; it counts the graphs without one."""
    return encoded(graphs, "exhaustive", directed, budget).groupBy("encoding").agg(F.count("*").alias("n_graphs"), F.min("id").alias("first_id"))


def graph_distances(graphs: DataFrame, pairs: DataFrame, method: str = "exhaustive") -> DataFrame:
    """Adds ``distance`` to pairs (id_i, id_j): Levenshtein between the graphs' encodings."""
    w = encoded(graphs, method)
    p = pairs.join(w.select(F.col("id").alias("id_i"), F.col("encoding").alias("_a")), "id_i")
    p = p.join(w.select(F.col("id").alias("id_j"), F.col("encoding").alias("_b")), "id_j")
    return p.withColumn("distance", F.levenshtein("_a", "_b")).drop("_a", "_b")


def same_graph(n: int, a: list[tuple[int, int]], m: int, b: list[tuple[int, int]], directed: bool = False) -> bool:
    """Whether two graphs are isomorphic: nodes of most neighbours first, each tried on those of the same degrees."""
    if n != m:
        return False
    one, two = Search(n, a, directed, list), Search(m, b, directed, list)
    shape = lambda g, u: (g.out[u].bit_count(), g.into[u].bit_count(), g.out[u] >> u & 1)
    if sorted(shape(one, u) for u in range(n)) != sorted(shape(two, u) for u in range(n)):
        return False
    order = sorted(range(n), key=lambda u: shape(one, u), reverse=True)
    image = [-1] * n

    def fits(u: int, x: int, upto: int) -> bool:
        return all((one.out[u] >> w & 1) == (two.out[x] >> image[w] & 1) and (one.out[w] >> u & 1) == (two.out[image[w]] >> x & 1) for w in order[:upto])

    def place(k: int, used: int) -> bool:
        if k == n:
            return True
        u = order[k]
        for x in range(n):
            if not used >> x & 1 and shape(one, u) == shape(two, x) and fits(u, x, k):
                image[u] = x
                if place(k + 1, used | 1 << x):
                    return True
        image[u] = -1
        return False

    return place(0, 0)


def search_tree(n: int, edges: list[tuple[int, int]], max_depth: int = 3, max_nodes: int = 400, directed: bool = False) -> list[tuple[int, int, int, str]]:
    """The first levels of the exhaustive search, breadth first: (node, its parent or -1, depth, string so far)."""
    search = Search(n, edges, directed, list)
    rows: list[tuple[int, int, int, str]] = []
    level = [(-1, [s], 0, 0, 1 << s, list(search.out), "") for s in range(n)]
    for depth in range(max_depth + 1):
        after = []
        for parent, ring, p, s, placed, left, text in level:
            if len(rows) == max_nodes:
                return rows
            rows.append((len(rows), parent, depth, text))
            if len(ring) == n and not any(left):
                continue
            rank, a, b = search._nearest(ring, p, s, placed, left)
            m, moves = len(ring), ""
            if rank != 1:
                moves, p = "N" * a if a > 0 else "P" * -a, (p + a) % m
            if rank != 0:
                moves, s = moves + ("n" * b if b > 0 else "p" * -b), (s + b) % m
            moves += "VvCc"[rank]
            if rank >= 2:
                left = list(left)
                search._take(left, *((ring[p], ring[s]) if rank == 2 else (ring[s], ring[p])))
                after.append((len(rows) - 1, ring, p, s, placed, left, text + moves))
                continue
            at = p if rank == 0 else s
            for x in bits(search.out[ring[at]] & ~placed):
                after.append((len(rows) - 1, *search._inserted(ring, p, s, placed, left, rank, at, x), text + moves))
        level = after
    return rows


def normalised(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, n, edges of graphs with labelled nodes (id, label) and edges (id, source, target): labels are sorted and numbered
    from 0; edges to unknown labels go."""
    from pyspark.sql import Window

    place = (F.row_number().over(Window.partitionBy("id").orderBy("label")) - 1).alias("_k")
    numbered = nodes.select("id", "label").distinct().select("id", "label", place)
    e = edges.join(numbered.withColumnsRenamed({"label": "source", "_k": "u"}), ["id", "source"]).join(numbered.withColumnsRenamed({"label": "target", "_k": "v"}), ["id", "target"])
    e = e.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("u", "v"))).alias("edges"))
    empty = F.expr(f"cast(array() as array<{decode.EDGE}>)")
    return numbered.groupBy("id").agg(F.count("*").cast("int").alias("n")).join(e, "id", "left").withColumn("edges", F.coalesce("edges", empty))


def edge_index(edges: str = "edges", directed: bool = False, loops: bool = False) -> Column:
    """Two arrays of ends, (source, target); an undirected edge appears both ways.  Loops go unless asked for."""
    flat = decode.distinct_edges(edges, directed)
    if not loops:
        flat = F.filter(flat, lambda e: e["u"] != e["v"])
    if not directed:
        flat = F.array_distinct(F.flatten(F.transform(flat, lambda e: F.array(e, F.struct(e["v"].alias("u"), e["u"].alias("v"))))))
    return F.struct(F.transform(flat, lambda e: e["u"]).alias("source"), F.transform(flat, lambda e: e["v"]).alias("target"))


def from_edge_index(source: Column, target: Column) -> Column:
    """The edges array of two arrays of ends."""
    return F.transform(F.arrays_zip(source.alias("source"), target.alias("target")), lambda e: F.struct(e["source"].cast("int").alias("u"), e["target"].cast("int").alias("v")))


def connected(n: str = "n", edges: str = "edges") -> Column:
    """Whether node 0 reaches all nodes of an undirected graph: as many rounds as nodes, on its arrays."""
    grown = f"""aggregate(sequence(1, {n}), array(0), (r, i) -> array_union(r, transform(filter(flatten(transform({edges},
      e -> array(e, named_struct('u', e.v, 'v', e.u)))), e -> array_contains(r, e.u)), e -> e.v)))"""
    return F.expr(f"size({grown}) >= {n}")


def engine(spark: SparkSession, asked: str | None = None) -> str:
    """Which engine runs an operator that has two: ``asked``, else the session's ``ringlet.engine``, else ``catalyst``."""
    name = asked or spark.conf.get("ringlet.engine", "catalyst")
    if name not in ("catalyst", "arrow"):
        raise ValueError(f"unknown engine {name}")
    return name
