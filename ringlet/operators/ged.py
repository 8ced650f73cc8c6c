"""Graph edit distance: bounds, exact search, brackets, and backends that measure rows of pairs.

Costs are those of inserting, deleting and substituting nodes and edges; by default one for each insertion and deletion, and
substitution is free, as graphs bear no labels.  The BRANCH lower bound assigns nodes (or their absence) to
nodes, half of the difference of degrees counting as edges; the bipartite upper bound is the cost of the edits that
such an assignment induces, the smaller of both orientations.  The exact search maps nodes one by one and leaves a branch
when a bound of the rest cannot beat the best map.  A distance that was not closed stays null; never a best so far.

Under unit costs the lower bound is also a Catalyst expression (``pairs.branch_bound``).
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds closer than this have met.
TOLERANCE = 1e-9
#: A search that took all but this share of its time is not taken for finished.
MARGIN, LEAST_MARGIN = 0.01, 1e-3

Edges = list[tuple[int, int]]


@dataclass(frozen=True)
class Costs:
    node_in: float = 1.0
    node_out: float = 1.0
    node_change: float = 0.0
    edge_in: float = 1.0
    edge_out: float = 1.0
    edge_change: float = 0.0

    def __post_init__(self) -> None:
        if min(self.node_in, self.node_out, self.node_change, self.edge_in, self.edge_out, self.edge_change) < 0:
            raise ValueError("costs must not be negative")


UNIT = Costs()


def adjacency(n: int, edges: Edges) -> list[int]:
    """Neighbours of each node as bits, without loops."""
    out = [0] * n
    for u, v in edges:
        if u != v:
            out[u] |= 1 << v
            out[v] |= 1 << u
    return out


def edge_assignment(a: int, b: int, costs: Costs) -> float:
    """Least cost to turn a incident edges into b."""
    change = min(costs.edge_change, costs.edge_in + costs.edge_out)
    return min(a, b) * change + max(a - b, 0) * costs.edge_out + max(b - a, 0) * costs.edge_in


def assignment_costs(n: int, a: Edges, m: int, b: Edges, costs: Costs, share: float) -> list[list[float]]:
    """The square matrix of n + m rows: nodes against nodes, and against absence; incident edges count by ``share``."""
    x, y = [z.bit_count() for z in adjacency(n, a)], [z.bit_count() for z in adjacency(m, b)]
    out = [[math.inf] * (n + m) for _ in range(n + m)]
    for i in range(n):
        for j in range(m):
            out[i][j] = costs.node_change + share * edge_assignment(x[i], y[j], costs)
        out[i][m + i] = costs.node_out + share * x[i] * costs.edge_out
    for j in range(m):
        out[n + j][j] = costs.node_in + share * y[j] * costs.edge_in
        for i in range(n):
            out[n + j][m + i] = 0.0
    return out


def assign(costs: list[list[float]]) -> tuple[float, list[int]]:
    """Least assignment of rows to columns (shortest augmenting paths with potentials): its cost, and each row's column."""
    n = len(costs)
    if not n:
        return 0.0, []
    rows, cols = [0.0] * (n + 1), [0.0] * (n + 1)
    match = [n] * (n + 1)  # the row of each column; column n stands for none
    for i in range(n):
        match[n] = i
        free, least, before, done = n, [math.inf] * (n + 1), [n] * (n + 1), [False] * (n + 1)
        while match[free] != n or free == n:
            done[free] = True
            r, step, at = match[free], math.inf, n
            for j in range(n):
                if done[j]:
                    continue
                gap = costs[r][j] - rows[r] - cols[j]
                if gap < least[j]:
                    least[j], before[j] = gap, free
                if least[j] < step:
                    step, at = least[j], j
            for j in range(n + 1):
                if done[j]:
                    rows[match[j]] += step
                    cols[j] -= step
                else:
                    least[j] -= step
            free = at
        while free != n:
            match[free] = match[before[free]]
            free = before[free]
        match[n] = n
    chosen = [0] * n
    for j in range(n):
        chosen[match[j]] = j
    return sum(costs[i][chosen[i]] for i in range(n)), chosen


def lower_bound(n: int, a: Edges, m: int, b: Edges, costs: Costs = UNIT) -> float:
    """BRANCH: the least assignment with half of the incident edges' cost."""
    return assign(assignment_costs(n, a, m, b, costs, 0.5))[0]


def induced_cost(n: int, a: Edges, m: int, b: Edges, image: list[int | None], costs: Costs = UNIT) -> float:
    """Cost of the edits that a map of nodes induces; None: the node goes.  Nodes that are no image come in."""
    x, y = adjacency(n, a), adjacency(m, b)
    kept = [i for i in range(n) if image[i] is not None]
    total = (n - len(kept)) * costs.node_out + (m - len(kept)) * costs.node_in + len(kept) * costs.node_change
    same = sum(1 for k, i in enumerate(kept) for j in kept[:k] if x[i] >> j & 1 and y[image[i]] >> image[j] & 1)
    one, two = sum(z.bit_count() for z in x) // 2, sum(z.bit_count() for z in y) // 2
    return total + same * costs.edge_change + (one - same) * costs.edge_out + (two - same) * costs.edge_in


def assigned_map(n: int, m: int, chosen: list[int]) -> list[int | None]:
    return [j if j < m else None for j in chosen[:n]]


def upper_bound(n: int, a: Edges, m: int, b: Edges, costs: Costs = UNIT, both_ways: bool = True) -> float:
    """Cost that the least bipartite assignment induces; the smaller of both orientations."""
    best = induced_cost(n, a, m, b, assigned_map(n, m, assign(assignment_costs(n, a, m, b, costs, 1.0))[1]), costs)
    if both_ways:
        back = Costs(costs.node_out, costs.node_in, costs.node_change, costs.edge_out, costs.edge_in, costs.edge_change)
        best = min(best, induced_cost(m, b, n, a, assigned_map(m, n, assign(assignment_costs(m, b, n, a, back, 1.0))[1]), back))
    return best


def bracket(n: int, a: Edges, m: int, b: Edges, costs: Costs = UNIT) -> tuple[float, float]:
    lower, upper = lower_bound(n, a, m, b, costs), upper_bound(n, a, m, b, costs)
    if lower > upper + TOLERANCE:
        raise ValueError(f"bounds cross: {lower} > {upper}")
    return lower, upper


def exact(n: int, a: Edges, m: int, b: Edges, costs: Costs = UNIT, seconds: float | None = None) -> float | None:
    """The edit distance; None where the search did not end in time."""
    if n > m:
        back = Costs(costs.node_out, costs.node_in, costs.node_change, costs.edge_out, costs.edge_in, costs.edge_change)
        return exact(m, b, n, a, back, seconds)
    x, y = adjacency(n, a), adjacency(m, b)
    order = sorted(range(n), key=lambda u: -x[u].bit_count())
    best = upper_bound(n, a, m, b, costs)
    floor = lower_bound(n, a, m, b, costs)
    began, ended = time.monotonic(), True
    change = min(costs.edge_change, costs.edge_in + costs.edge_out)
    image: list[int | None] = [None] * n
    total_y = sum(z.bit_count() for z in y) // 2

    total_x = sum(z.bit_count() for z in x) // 2

    def rest(k: int, used: int, gone: int, met: int) -> float:
        """A bound of what is still to pay: nodes and edges left on both sides, paired as far as they go."""
        left, free = n - k, m - used.bit_count()
        nodes = min(left, free) * min(costs.node_change, costs.node_in + costs.node_out) + max(left - free, 0) * costs.node_out + max(free - left, 0) * costs.node_in
        return nodes + edge_assignment(total_x - gone, total_y - met, costs)

    def place(k: int, used: int, gone: int, met: int, paid: float) -> None:
        """``gone``, ``met``: edges between nodes placed so far, and between their images."""
        nonlocal best, ended
        if seconds is not None and time.monotonic() - began > seconds:
            ended = False
            return
        if best <= floor + TOLERANCE or paid + rest(k, used, gone, met) >= best - TOLERANCE:
            return
        if k == n:
            best = paid + (m - used.bit_count()) * costs.node_in + (total_y - met) * costs.edge_in
            return
        u, tried = order[k], []
        back = [w for w in order[:k] if x[u] >> w & 1]
        for v in range(m):
            if used >> v & 1 or any(_alike(y, v, w) for w in tried):
                continue
            tried.append(v)
            two = (y[v] & used).bit_count()
            both = sum(1 for w in back if image[w] is not None and y[v] >> image[w] & 1)
            image[u] = v
            cost = costs.node_change + both * change + (len(back) - both) * costs.edge_out + (two - both) * costs.edge_in
            place(k + 1, used | 1 << v, gone + len(back), met + two, paid + cost)
        image[u] = None
        place(k + 1, used, gone + len(back), met, paid + costs.node_out + len(back) * costs.edge_out)

    place(0, 0, 0, 0, 0.0)
    return best if ended else None


def _alike(y: list[int], v: int, w: int) -> bool:
    """Free nodes with the same neighbours but for one another."""
    both = 1 << v | 1 << w
    return y[v] & ~both == y[w] & ~both


def finished(seconds: float, budget: float | None) -> bool:
    """Whether a search ended of itself: it left some of its time."""
    return budget is None or seconds < budget - max(LEAST_MARGIN, MARGIN * budget)


def zero_is_possible(n: int, a: Edges, m: int, b: Edges, costs: Costs = UNIT) -> bool:
    """Whether distance 0 can be: the graphs are isomorphic, or are so without isolated nodes where nodes cost nothing."""
    from ringlet.operators.encode import same_graph

    plain = lambda e: [(u, v) for u, v in e if u != v]
    if costs.node_in == 0 and costs.node_out == 0:
        def bare(e: Edges) -> tuple[int, Edges]:
            names = {u: k for k, u in enumerate(sorted({u for pair in plain(e) for u in pair}))}
            return len(names), [(names[u], names[v]) for u, v in plain(e)]

        (n, a), (m, b) = bare(a), bare(b)
    return same_graph(n, plain(a), m, plain(b))


@dataclass(frozen=True)
class Result:
    """lb <= distance <= ub; certified: the distance is known."""

    lb: float
    ub: float
    distance: float | None
    seconds: float
    timed_out: bool
    method: str

    @property
    def certified(self) -> bool:
        return self.distance is not None


class Backend(Protocol):
    name: str

    def measure(self, n: int, a: Edges, m: int, b: Edges) -> Result: ...


@dataclass
class Bounds:
    """Both bounds; the distance is known where they meet."""

    costs: Costs = UNIT
    name: str = "bounds"

    def measure(self, n: int, a: Edges, m: int, b: Edges) -> Result:
        began = time.monotonic()
        lower, upper = bracket(n, a, m, b, self.costs)
        return Result(lower, upper, upper if upper - lower <= TOLERANCE else None, time.monotonic() - began, False, self.name)


@dataclass
class Exact:
    """Bounds, then the search where they do not meet."""

    costs: Costs = UNIT
    seconds: float | None = None
    name: str = "exact"

    def measure(self, n: int, a: Edges, m: int, b: Edges) -> Result:
        began = time.monotonic()
        first = Bounds(self.costs).measure(n, a, m, b)
        if first.certified:
            return Result(first.lb, first.ub, first.distance, time.monotonic() - began, False, self.name)
        found = exact(n, a, m, b, self.costs, self.seconds)
        took = time.monotonic() - began
        if found is None:
            return Result(first.lb, first.ub, None, took, True, self.name)
        return Result(found, found, found, took, False, self.name)


@dataclass
class Stub:
    """A fixed function in place of a search, for tests: (n, a, m, b) -> distance or None."""

    answer: Callable[[int, Edges, int, Edges], float | None]
    name: str = "stub"

    def measure(self, n: int, a: Edges, m: int, b: Edges) -> Result:
        got = self.answer(n, a, m, b)
        return Result(0.0 if got is None else got, math.inf if got is None else got, got, 0.0, got is None, self.name)


def backend(kind: str, costs: Costs = UNIT, **options) -> Backend:
    """A backend by name; one that needs a library that is absent says so."""
    if kind == "bounds":
        return Bounds(costs)
    if kind == "exact":
        return Exact(costs, **options)
    if kind == "stub":
        return Stub(**options)
    raise ValueError(f"no backend {kind}: bounds, exact and stub are here, others need libraries that are not")


RESULT = "lb double, ub double, distance double, certified boolean, timed_out boolean, seconds double, method string"


def measured(pairs: DataFrame, by: Backend) -> DataFrame:
    """``pairs`` (k, n_i, edges_i, n_j, edges_j) with the backend's result."""
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, n, a, m, b in zip(batch["k"], batch["n_i"], batch["edges_i"], batch["n_j"], batch["edges_j"], strict=True):
                r = by.measure(n, [(e["u"], e["v"]) for e in a], m, [(e["u"], e["v"]) for e in b])
                rows.append((k, r.lb, r.ub, r.distance, r.certified, r.timed_out, r.seconds, r.method))
            yield pd.DataFrame(rows, columns=["k", *(c.split()[0] for c in RESULT.split(", "))])

    rows = pairs.select(F.col("k").cast("long").alias("k"), "n_i", "edges_i", "n_j", "edges_j")
    return rows.repartition(tasks, "k").mapInPandas(run, f"k long, {RESULT}")


def summary(results: DataFrame) -> DataFrame:
    """method, pairs measured, certified and timed out, and seconds in all and at most: what a backend has done."""
    count = lambda c: F.count_if(F.col(c))
    return results.groupBy("method").agg(F.count("*").alias("n"), count("certified").alias("n_certified"), count("timed_out").alias("n_timed_out"), F.sum("seconds").alias("seconds"), F.max("seconds").alias("slowest"))


def ladder(pairs: DataFrame, by: Backend, rungs: list[int], least: float = 0.5) -> tuple[list[tuple[int, int, float]], int | None]:
    """Measures the pairs whose larger graph has n nodes, for n in ``rungs``, until less than ``least`` of them are certified:
    (n, pairs, share certified) of each rung, and the last rung that held."""
    report, held = [], None
    for n in rungs:
        here = pairs.where(F.greatest("n_i", "n_j") == n)
        got = measured(here, by).agg(F.count("*").alias("c"), F.avg(F.col("certified").cast("double")).alias("s")).first()
        if not got.c:
            continue
        report.append((n, got.c, got.s))
        if got.s < least:
            break
        held = n
    return report, held
