"""Other ways to write a graph as a sequence of symbols, and what they cost in bits.

Adjacency bits and graph6 are Catalyst expressions over the sorted edge numbers of ``pairs.shaped``; the canonical codes,
sparse6 and the DFS code are searches, as Arrow functions.  All read simple graphs: loops are dropped.  A code that a
search could not prove least within its budget is null, with the reason; never the best so far.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringlet.operators.encode import bits, encode
from ringlet.operators.ged import adjacency
from ringlet.operators.pairs import CODE

Edges = list[tuple[int, int]]


class BudgetSpent(Exception):
    """A search ended without proof."""


# Expressions


def triangle(n: str = "n", x: str = "x") -> Column:
    """The strict upper triangle, column by column, as a string of 0 and 1."""
    cell = f"IF(array_contains({x}, cast(i AS bigint) * {CODE} + j), '1', '0')"
    return F.when(F.col(n) > 1, F.expr(f"array_join(flatten(transform(sequence(1, greatest({n}, 2) - 1), j -> transform(sequence(0, j - 1), i -> {cell}))), '')")).otherwise("")


def from_triangle(n: str, code: str) -> Column:
    """Edges (u, v) of a triangle's bits."""
    at = "cast(j * (j - 1) / 2 AS int) + i + 1"
    every = f"flatten(transform(sequence(1, greatest({n}, 2) - 1), j -> transform(sequence(0, j - 1), i -> struct(i AS u, j AS v, substring({code}, {at}, 1) = '1' AS there))))"
    return F.when(F.col(n) > 1, F.expr(f"transform(filter({every}, e -> e.there), e -> struct(e.u AS u, e.v AS v))")).otherwise(F.expr("cast(array() as array<struct<u:int,v:int>>)"))


def six_bits(code: Column) -> Column:
    """Bits in printable characters: filled up to sixes, each 63 more."""
    full = F.rpad(code, (F.ceil(F.length(code) / 6) * 6).cast("int"), "0")
    each = F.transform(F.sequence(F.lit(0), (F.length(full) / 6).cast("int")), lambda k: F.substring(full, k * 6 + 1, F.lit(6)))
    return F.array_join(F.transform(F.filter(each, lambda c: c != ""), lambda c: F.char(F.conv(c, 2, 10).cast("int") + 63)), "")


def size_header(n: Column) -> Column:
    """N(n): one character up to 62, four up to 258,047, eight beyond."""
    sixes = lambda k: F.array_join(F.array(*[F.char(F.shiftright(n.cast("long"), 6 * i).bitwiseAND(63) + 63) for i in range(k - 1, -1, -1)]), "")
    return F.when(n <= 62, F.char(n + 63)).when(n <= 258_047, F.concat(F.lit("~"), sixes(3))).otherwise(F.concat(F.lit("~~"), sixes(6)))


def graph6(n: str = "n", x: str = "x") -> Column:
    return F.concat(size_header(F.col(n)), six_bits(triangle(n, x)))


def unpacked(payload: Column) -> Column:
    """The bits of printable characters."""
    codes = F.transform(F.filter(F.split(payload, ""), lambda c: c != ""), lambda c: F.lpad(F.bin(F.ascii(c) - 63), 6, "0"))
    return F.array_join(codes, "")


def graph6_parts(text: str = "g6") -> Column:
    """struct(n, bits) of a graph6 text."""
    value = lambda part: F.conv(unpacked(part), 2, 10).cast("long")
    t = F.col(text)
    n = F.when(~t.startswith("~"), F.ascii(t).cast("long") - 63).when(~t.startswith("~~"), value(F.substring(t, 2, 3))).otherwise(value(F.substring(t, 3, 6)))
    rest = F.when(~t.startswith("~"), F.substr(t, F.lit(2))).when(~t.startswith("~~"), F.substr(t, F.lit(5))).otherwise(F.substr(t, F.lit(9)))
    return F.struct(n.cast("int").alias("n"), F.substring(unpacked(rest), F.lit(1), (n * (n - 1) / 2).cast("int")).alias("bits"))


# Searches


def code_of(adj: list[int], order: list[int]) -> str:
    return "".join("1" if adj[order[j]] >> order[i] & 1 else "0" for j in range(1, len(order)) for i in range(j))


def twins(adj: list[int]) -> list[int]:
    """For each node, as bits, those that may change places with it and leave the graph as it is: their other neighbours are the same."""
    n = len(adj)
    return [sum(1 << w for w in range(n) if w != v and adj[v] & ~(1 << v | 1 << w) == adj[w] & ~(1 << v | 1 << w)) for v in range(n)]


def apart(nodes: int, twin: list[int]) -> list[int]:
    """One node of each set of twins among ``nodes``, given as bits."""
    out, tried = [], 0
    for v in bits(nodes):
        if not tried & twin[v]:
            tried |= 1 << v
            out.append(v)
    return out


def least_code(n: int, edges: Edges, budget: int | None = None) -> str:
    """The least adjacency code over all orders of the nodes: a new node's row follows from the nodes before it, so that the orders
    that share the least rows so far go on together.  They are kept as cells: nodes whose order among each other no row has decided
    yet.  A row is least if it puts each cell's neighbours of the new node last, which cuts the cell there."""
    adj, spent = adjacency(n, edges), 0
    if n <= 1:
        return ""
    twin, code = twins(adj), []
    states: list[tuple[int, tuple[int, ...]]] = [((1 << n) - 1, ())]
    for k in range(n):
        best, after = None, []
        for free, cells in states:
            for v in apart(free, twin):
                spent += 1
                if budget is not None and spent > budget:
                    raise BudgetSpent(f"{budget} steps at node {k} of {n}")
                row = 0
                for c in cells:
                    row = row << c.bit_count() | (1 << (adj[v] & c).bit_count()) - 1
                if best is None or row < best:
                    best, after = row, []
                if row == best:
                    after.append((free & ~(1 << v), cells, v))
        code.append(format(best, f"0{k}b") if k else "")
        # Orders go on alike if the same nodes are free and each cell's nodes have the same free neighbours.
        level: dict[tuple, tuple[int, tuple[int, ...]]] = {}
        for free, cells, v in after:
            if len(cells) < 2 and not best:  # no row but zeros so far
                cells = (sum(cells) | 1 << v,)
            else:
                cells = (*(part for c in cells for part in (c & ~adj[v], c & adj[v]) if part), 1 << v)
            level.setdefault((free, tuple(tuple(sorted(adj[u] & free for u in bits(c))) for c in cells)), (free, cells))
        states = list(level.values())
    return "".join(code)


def canonical_order(n: int, edges: Edges) -> list[int]:
    """An order of the nodes that gives isomorphic graphs the same code: nodes are told apart by refinement, then one of
    each undecided cell in turn; the order of the largest code stays."""
    adj = adjacency(n, edges)

    def refined(cells: list[list[int]]) -> list[list[int]]:
        while True:
            masks = [sum(1 << v for v in c) for c in cells]
            out: list[list[int]] = []
            for c in cells:
                by: dict[tuple[int, ...], list[int]] = {}
                for v in c:
                    by.setdefault(tuple((adj[v] & m).bit_count() for m in masks), []).append(v)
                out += [by[key] for key in sorted(by)]
            if len(out) == len(cells):
                return out
            cells = out

    best: list[tuple[str, list[int]]] = []

    def settle(cells: list[list[int]]) -> None:
        cells = refined(cells)
        open_ = next((k for k, c in enumerate(cells) if len(c) > 1), None)
        if open_ is None:
            order = [c[0] for c in cells]
            code = code_of(adj, order)
            if not best or code > best[0][0]:
                best[:] = [(code, order)]
            return
        tried: list[int] = []
        for v in cells[open_]:
            if any(adj[v] & ~(1 << v | 1 << w) == adj[w] & ~(1 << v | 1 << w) for w in tried):
                continue
            tried.append(v)
            settle([*cells[:open_], [v], [w for w in cells[open_] if w != v], *cells[open_ + 1 :]])

    if n:
        settle([list(range(n))])
    return best[0][1] if best else []


def renamed(edges: Edges, order: list[int]) -> Edges:
    """Edges with nodes named by their place in the order."""
    place = {v: k for k, v in enumerate(order)}
    return sorted({(min(place[u], place[v]), max(place[u], place[v])) for u, v in edges if u != v})


def graph6_text(n: int, edges: Edges) -> str:
    """graph6 of a small graph on the driver; the expression ``graph6`` gives the same."""
    adj = adjacency(n, edges)
    payload = code_of(adj, list(range(n)))
    payload += "0" * (-len(payload) % 6)
    return _header(n) + "".join(chr(63 + int(payload[k : k + 6], 2)) for k in range(0, len(payload), 6))


def _header(n: int) -> str:
    if n <= 62:
        return chr(n + 63)
    width, mark = (3, "~") if n <= 258_047 else (6, "~~")
    return mark + "".join(chr((n >> 6 * k & 63) + 63) for k in range(width - 1, -1, -1))


def sparse6_text(n: int, edges: Edges) -> str:
    """sparse6: for each edge, by its larger end, one bit that steps to the next node and the smaller end in as many bits as n - 1 takes."""
    width = max(n - 1, 0).bit_length()
    stream: list[str] = []
    at = 0
    for v, u in sorted((max(e), min(e)) for e in {(min(p), max(p)) for p in edges if p[0] != p[1]}):
        if v == at:
            stream.append("0")
        elif v == at + 1:
            stream.append("1")
        else:
            stream += ["1", format(v, f"0{width}b"), "0"]
        at = v
        stream.append(format(u, f"0{width}b"))
    out = "".join(stream)
    fill = -len(out) % 6
    # Ones fill up, but for a zero first where ones would read as an edge of the last node.
    lone = width < 6 and n == 1 << width and fill >= width and at < n - 1
    out += ("0" + "1" * (fill - 1)) if lone and fill else "1" * fill
    return ":" + _header(n) + "".join(chr(63 + int(out[k : k + 6], 2)) for k in range(0, len(out), 6))


def from_sparse6(text: str) -> tuple[int, Edges]:
    body = text.removeprefix(":")
    if body.startswith("~~"):
        n, body = sum((ord(c) - 63) << 6 * k for k, c in enumerate(reversed(body[2:8]))), body[8:]
    elif body.startswith("~"):
        n, body = sum((ord(c) - 63) << 6 * k for k, c in enumerate(reversed(body[1:4]))), body[4:]
    else:
        n, body = ord(body[0]) - 63, body[1:]
    stream = "".join(format(ord(c) - 63, "06b") for c in body)
    width, at, v, edges = max(n - 1, 0).bit_length(), 0, 0, []
    while at + 1 + width <= len(stream):
        v += stream[at] == "1"
        u = int(stream[at + 1 : at + 1 + width] or "0", 2)
        at += 1 + width
        if u >= n or v >= n:
            break
        if u > v:
            v = u
        else:
            edges.append((u, v))
    return n, sorted(edges)


def dfs_code(n: int, edges: Edges, most: int | None = None) -> list[tuple[int, int]]:
    """The least depth-first code of a connected graph: (i, j) in order of discovery, backward edges before forward ones.  All
    embeddings of the least code so far are extended together, those that go on alike once; ``most`` bounds how many are in all."""
    adj = adjacency(n, edges)
    m = sum(z.bit_count() for z in adj) // 2
    if not m:
        raise ValueError("a graph without edges has no depth-first code")
    seen = near = 1
    while near:
        near = 0
        for u in bits(seen):
            near |= adj[u]
        near &= ~seen
        seen |= near
    if seen != (1 << n) - 1:
        raise ValueError("a graph that is not connected has no depth-first code")
    code = [(0, 1)]
    # An embedding: the nodes on the path, from the root to the last, and as bits all nodes and edges (u * n + v with u < v) used.
    # Those off the path matter no more but for being used, so that equal ones go on alike; so do those to twins that are free.
    edge = lambda u, v: 1 << (min(u, v) * n + max(u, v))
    twin, spent = twins(adj), 0
    live = {((u, v), 1 << u | 1 << v, edge(u, v)) for u in apart((1 << n) - 1, twin) for v in apart(adj[u], twin)}
    path, count = [0, 1], 2
    while len(code) < m:
        spent += len(live)
        if most is not None and spent > most:
            raise BudgetSpent(f"{spent} embeddings at edge {len(code)} of {m}")
        found: dict[tuple[int, int], set] = {}
        for nodes, taken, used in live:
            last = nodes[-1]
            back = next((k for k, v in enumerate(nodes[:-1]) if adj[last] >> v & 1 and not used & edge(last, v)), None)
            if back is not None:
                found.setdefault((0, path[back]), set()).add((nodes, taken, used | edge(last, nodes[back])))
                continue
            front = next((k for k in range(len(nodes) - 1, -1, -1) if adj[nodes[k]] & ~taken), None)
            if front is not None:
                for v in apart(adj[nodes[front]] & ~taken, twin):
                    found.setdefault((1, -path[front]), set()).add(((*nodes[: front + 1], v), taken | 1 << v, used | edge(nodes[front], v)))
        key = min(found)
        live = found[key]
        if key[0] == 0:
            code.append((path[-1], key[1]))
        else:
            front = -key[1]
            code.append((front, count))
            path, count = [*path[: path.index(front) + 1], count], count + 1
    return code


def from_dfs_code(code: list[tuple[int, int]]) -> tuple[int, Edges]:
    return max(max(e) for e in code) + 1, sorted((min(e), max(e)) for e in code)


def automorphisms(n: int, edges: Edges) -> tuple[int, list[int]]:
    """Number of automorphisms, and for each node the least node of its orbit."""
    adj = adjacency(n, edges)
    degree = [z.bit_count() for z in adj]
    orbit, count = list(range(n)), 0
    image: list[int] = []

    def place() -> None:
        nonlocal count
        u = len(image)
        if u == n:
            count += 1
            for a, b in enumerate(image):
                x, y = orbit[a], orbit[b]
                if x != y:
                    orbit[:] = [min(x, y) if o in (x, y) else o for o in orbit]
            return
        for v in range(n):
            if v not in image and degree[v] == degree[u] and all((adj[u] >> w & 1) == (adj[v] >> image[w] & 1) for w in range(u)):
                image.append(v)
                place()
                image.pop()

    place()
    return count, orbit


# The registry


@dataclass(frozen=True)
class Encoding:
    """symbols and their alphabet's size, a text, and bits: by entropy, as stored, and of the payload; inflated: the stored form is
    a rendering."""

    symbols: list[str]
    alphabet_size: int
    text: str
    entropy_bits: float | None
    stored_bits: int | None
    payload_bits: int | None
    inflated: bool = False


def _packed(bits_: int) -> int:
    return 8 * -(-bits_ // 8)


def _by_triangle(code: str, n: int) -> Encoding:
    cells = n * (n - 1) // 2
    return Encoding(list(code), 2, code, float(cells), _packed(cells), cells)


def _by_wire(wire: str, n: int, framing: int = 0) -> Encoding:
    return Encoding(list(wire[framing:]), 64, wire, 6.0 * (len(wire) - framing), 8 * len(wire), None if framing else n * (n - 1) // 2)


def _by_dfs(n: int, edges: Edges) -> Encoding:
    code = dfs_code(n, edges)
    symbols = [f"{i}-{j}" for i, j in code]
    return Encoding(symbols, n * n, " ".join(symbols), float(len(code) * 2 * max(n - 1, 1).bit_length()), 8 * len(" ".join(symbols)), None, True)


def _by_string(n: int, edges: Edges, method: str) -> Encoding:
    w = encode(n, [e for e in edges if e[0] != e[1]], False, method)
    if w is None:
        raise ValueError("no string: the graph is not connected")
    return Encoding(list(w), 9, w, len(w) * math.log2(9), 8 * len(w), None)


#: Name -> encoder of (n, edges).
ENCODERS: dict[str, Callable[[int, Edges], Encoding]] = {
    "adjacency": lambda n, e: _by_triangle(code_of(adjacency(n, e), list(range(n))), n),
    "least_code": lambda n, e: _by_triangle(least_code(n, e), n),
    "graph6": lambda n, e: _by_wire(graph6_text(n, e), n),
    "canonical_graph6": lambda n, e: _by_wire(graph6_text(n, renamed(e, canonical_order(n, e))), n),
    "sparse6": lambda n, e: _by_wire(sparse6_text(n, e), n, 1),
    "canonical_sparse6": lambda n, e: _by_wire(sparse6_text(n, renamed(e, canonical_order(n, e))), n, 1),
    "dfs_code": _by_dfs,
    "pruned_string": lambda n, e: _by_string(n, e, "pruned"),
    "canonical_string": lambda n, e: _by_string(n, e, "exhaustive"),
    "size_only": lambda n, e: Encoding([str(n)], 0, str(n), None, None, None),
}


def encoder(name: str) -> Callable[[int, Edges], Encoding]:
    if name not in ENCODERS:
        raise ValueError(f"no encoder {name}: {', '.join(sorted(ENCODERS))}")
    return ENCODERS[name]


def register(name: str, function: Callable[[int, Edges], Encoding]) -> None:
    if name in ENCODERS:
        raise ValueError(f"encoder {name} is there")
    ENCODERS[name] = function


FIELDS = "encoder string, symbols array<string>, alphabet_size int, text string, entropy_bits double, stored_bits long, payload_bits long, inflated boolean, problem string"


def encodings(graphs: DataFrame, names: list[str]) -> DataFrame:
    """id and the fields of ``Encoding`` for each graph (id, n, edges) and encoder; where there is none, symbols is null and problem
    says why."""
    kind = graphs.schema["id"].dataType.simpleString()
    for name in names:
        encoder(name)
    tasks = max(int(graphs.sparkSession.conf.get("spark.sql.shuffle.partitions")), graphs.sparkSession.sparkContext.defaultParallelism)
    rows = graphs.select("id", "n", "edges", F.explode(F.array(*map(F.lit, names))).alias("encoder")).repartition(tasks, "id", "encoder")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, n, edges, name in zip(batch["id"], batch["n"], batch["edges"], batch["encoder"], strict=True):
                try:
                    e = ENCODERS[name](n, [(x["u"], x["v"]) for x in edges])
                    out.append((id_, name, e.symbols, e.alphabet_size, e.text, e.entropy_bits, e.stored_bits, e.payload_bits, e.inflated, None))
                except (ValueError, BudgetSpent) as problem:
                    out.append((id_, name, None, None, None, None, None, None, None, str(problem)))
            frame = pd.DataFrame(out, columns=["id", *(c.split()[0] for c in FIELDS.split(", "))])
            yield frame.astype({"alphabet_size": "Int32", "stored_bits": "Int64", "payload_bits": "Int64", "inflated": "boolean"})

    return rows.mapInPandas(run, f"id {kind}, {FIELDS}")


def symbol_codes(a: Column, b: Column) -> tuple[Column, Column]:
    """Two sequences of symbols as strings of one character a symbol, the same for equal symbols of the pair."""
    known = F.array_distinct(F.concat(a, b))
    return tuple(F.array_join(F.transform(x, lambda s: F.char(F.array_position(known, s).cast("int") + 0x20)), "") for x in (a, b))


def symbol_levenshtein(a: Column, b: Column) -> Column:
    """Levenshtein over whole symbols; for at most 222 distinct symbols a pair, null beyond, where the characters run out."""
    x, y = symbol_codes(a, b)
    return F.when(F.size(F.array_distinct(F.concat(a, b))) <= 222, F.levenshtein(x, y))


def alignment(a: str, b: str) -> list[tuple[str, str | None, str | None]]:
    """Edits that turn a into b, few as can be: (match, substitute, delete or insert, letter, letter).  From the end on,
    a match is taken first, then a substitution, a deletion, an insertion."""
    far = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(far[-1][j - 1] + (x != y), far[-1][j] + 1, row[-1] + 1))
        far.append(row)
    i, j, out = len(a), len(b), []
    while i or j:
        here = far[i][j]
        if i and j and a[i - 1] == b[j - 1] and here == far[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append(("match", a[i], b[j]))
        elif i and j and here == far[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            out.append(("substitute", a[i], b[j]))
        elif i and here == far[i - 1][j] + 1:
            i -= 1
            out.append(("delete", a[i], None))
        else:
            j -= 1
            out.append(("insert", None, b[j]))
    return out[::-1]


def edit_path(a: str, b: str) -> list[str]:
    """The strings on the way from a to b, one edit apart, both ends among them."""
    path, done, rest = [a], "", a
    for kind, x, y in alignment(a, b):
        if kind != "insert":
            rest = rest[1:]
        if kind != "delete":
            done += y if y is not None else ""
        if kind != "match":
            path.append(done + rest)
    return path


def alignments(pairs: DataFrame) -> DataFrame:
    """k, step, op, a, b of pairs (k, w_i, w_j): one row for each step of the alignment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, step, *x) for k, a, b in zip(batch["k"], batch["w_i"], batch["w_j"], strict=True) for step, x in enumerate(alignment(a, b))]
            yield pd.DataFrame(rows, columns=["k", "step", "op", "a", "b"])

    return pairs.select(F.col("k").cast("long").alias("k"), "w_i", "w_j").mapInPandas(run, "k long, step int, op string, a string, b string")
