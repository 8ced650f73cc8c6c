"""Decoding of instruction strings, as one Catalyst fold over the characters.

State: the ring of nodes in list order, the positions of the two pointers, the number of nodes, and
the edges appended so far.  N/P and n/p move the first and second pointer; V and v insert a new node
after their pointer and join it; C and c join the nodes under the pointers; W does nothing.

Where strings come from texts, each Latin letter stands for an instruction (``FROM``, ``TO``) and all other
characters are dropped.  ``parts`` cuts the letters of a text into consecutive strings that cover all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "NnPpVvCcW"
EDGE = "struct<u:int,v:int>"
#: Letters from the commonest on, and the instructions they stand for in turn.
FROM = "etaoinshrdlcumwfgypbvkjxqz"
TO = "".join("NVnCpvPcW"[i % 9] for i in range(len(FROM)))
#: Parts of a text are numbered below this within it.
PARTS = 1 << 20


def _step(x: str) -> str:
    """SQL of the state after letter c of state x: one branch for each letter makes only what it changes."""

    def state(ring: str = f"{x}.ring", p: str = f"{x}.p", s: str = f"{x}.s", n: str = f"{x}.n", edges: str = f"{x}.edges") -> str:
        return f"named_struct('ring', {ring}, 'p', {p}, 's', {s}, 'n', {n}, 'edges', {edges})"

    def joined(u: str, v: str) -> str:
        return f"array_append({x}.edges, named_struct('u', {u}, 'v', {v}))"

    first, second, m = f"{x}.ring[{x}.p]", f"{x}.ring[{x}.s]", f"size({x}.ring)"
    after = {
        "N": state(p=f"({x}.p + 1) % {m}"), "P": state(p=f"({x}.p + {m} - 1) % {m}"), "n": state(s=f"({x}.s + 1) % {m}"), "p": state(s=f"({x}.s + {m} - 1) % {m}"),
        "V": state(f"array_insert({x}.ring, {x}.p + 2, {x}.n)", s=f"{x}.s + IF({x}.s > {x}.p, 1, 0)", n=f"{x}.n + 1", edges=joined(first, f"{x}.n")),
        "v": state(f"array_insert({x}.ring, {x}.s + 2, {x}.n)", p=f"{x}.p + IF({x}.p > {x}.s, 1, 0)", n=f"{x}.n + 1", edges=joined(second, f"{x}.n")),
        "C": state(edges=joined(first, second)), "c": state(edges=joined(second, first)),
    }
    return "CASE c " + " ".join(f"WHEN '{letter}' THEN {made}" for letter, made in after.items()) + f" ELSE {x} END"


_START = f"named_struct('ring', array(0), 'p', 0, 's', 0, 'n', 1, 'edges', cast(array() as array<{EDGE}>))"

#: One snapshot of the state after a step; the edge it made is null where it made none or one that was there.
_SNAPSHOT = """named_struct('instruction', c, 'ring', y.ring, 'p', y.p, 's', y.s, 'n', y.n, 'm', x.m + IF({made}, 1, 0),
  'created', IF({made}, y.edges[size(y.edges) - 1], cast(null as {edge})))"""
_MADE = "size(y.edges) > size(x.g.edges) AND NOT exists(x.g.edges, e -> {same})"
_SAME = {
    True: "e = y.edges[size(y.edges) - 1]",
    False: """least(e.u, e.v) = least(y.edges[size(y.edges) - 1].u, y.edges[size(y.edges) - 1].v)
      AND greatest(e.u, e.v) = greatest(y.edges[size(y.edges) - 1].u, y.edges[size(y.edges) - 1].v)""",
}


def letters(text: Column) -> Column:
    """The instructions that the letters of a text stand for: always a valid string."""
    lower = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""))
    return F.translate(lower, FROM, TO)


def parts(rows: DataFrame, key: str, text: str, length: int, *more: str) -> DataFrame:
    """id, part, w, and ``more``: the strings of ``length`` letters (the last may be shorter) that follow each other
    over each text; one empty string for a text without letters.  id is the key times ``PARTS``, plus part."""
    whole = rows.select(F.col(key).alias("_key"), letters(F.col(text)).alias("_w"), *more)
    last = F.greatest(F.ceil(F.length("_w") / length) - 1, F.lit(0)).cast("long")
    each = whole.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    w = F.substring(F.col("_w"), (F.col("part") * length + 1).cast("int"), F.lit(length))
    return each.select((F.col("_key") * PARTS + F.col("part")).alias("id"), "part", w.alias("w"), *more)


def valid(w: str = "w") -> Column:
    return F.col(w).rlike(f"^[{ALPHABET}]*$")


def checked(w: str, value: Column) -> Column:
    """``value``, or an error where the string is invalid."""
    return F.when(valid(w), value).otherwise(F.raise_error(F.concat(F.lit("invalid instruction string: "), F.col(w))))


def decoded(w: str = "w") -> Column:
    """struct(ring, p, s, n, edges) of a string column; invalid strings raise."""
    return checked(w, F.expr(f"aggregate(split({w}, ''), {_START}, (x, c) -> {_step('x')})"))


def graphs(strings: DataFrame) -> DataFrame:
    """The columns of ``strings`` (w among them), n, edges (as appended)."""
    made = strings.withColumn("_g", decoded())
    return made.select(*strings.columns, F.col("_g.n").alias("n"), F.col("_g.edges").alias("edges"))


def distinct_edges(edges: str = "edges", directed: bool = False) -> Column:
    """The distinct edges of an array, undirected ones with u <= v."""
    flat = F.col(edges) if directed else F.transform(edges, lambda e: F.struct(F.least(e["u"], e["v"]).alias("u"), F.greatest(e["u"], e["v"]).alias("v")))
    return F.array_distinct(flat)


def edge_rows(graphs: DataFrame, directed: bool = False) -> DataFrame:
    """Distinct edges (id, u, v); undirected ones with u <= v."""
    return graphs.select("id", F.inline(distinct_edges("edges", directed)))


def graph_json(n: str = "n", edges: str = "edges", directed: bool = False) -> Column:
    """A graph as JSON: directed, n, and its distinct edges in order."""
    pairs = F.transform(F.array_sort(distinct_edges(edges, directed)), lambda e: F.array(e["u"], e["v"]))
    return F.to_json(F.struct(F.lit(directed).alias("directed"), F.col(n).alias("n"), pairs.alias("edges")))


def graph_from_json(text: Column) -> Column:
    """struct(directed, n, edges) of ``graph_json``'s text."""
    got = F.from_json(text, "directed boolean, n int, edges array<array<int>>")
    edges = F.transform(got["edges"], lambda e: F.struct(e[0].alias("u"), e[1].alias("v")))
    return F.struct(got["directed"].alias("directed"), got["n"].alias("n"), edges.alias("edges"))


def traced(w: str = "w", directed: bool = False) -> Column:
    """The snapshots of all steps of a string, the start among them, from one fold."""
    made = _MADE.format(same=_SAME[directed])
    first = f"named_struct('instruction', '', 'ring', array(0), 'p', 0, 's', 0, 'n', 1, 'm', 0, 'created', cast(null as {EDGE}))"
    state = f"named_struct('g', {_START}, 'm', 0, 'log', array({first}))"
    # The new state is made once and named y, as the one element of an array.
    grown = f"""transform(array({_step("x.g")}), y -> named_struct('g', y, 'm', x.m + IF({made}, 1, 0),
      'log', array_append(x.log, {_SNAPSHOT.format(made=made, edge=EDGE)})))[0]"""
    return checked(w, F.expr(f"aggregate(filter(split({w}, ''), c -> c <> ''), {state}, (x, c) -> {grown}, x -> x.log)"))


def forward_order(ring: Column, at: Column) -> Column:
    """The ring's nodes from position ``at`` on, once around."""
    return F.concat(F.slice(ring, at + 1, F.size(ring)), F.slice(ring, F.lit(1), at))


def trace(strings: DataFrame, directed: bool = False) -> DataFrame:
    """One row for each prefix of a string: id, step, instruction, the ring from the first pointer on, nodes under the
    pointers, the edge made (created_u, created_v), nodes, edges, and the prefix."""
    rows = strings.select("id", "w", F.posexplode(traced("w", directed)).alias("step", "x"))
    return rows.select(
        "id", "step", "x.instruction", forward_order(F.col("x.ring"), F.col("x.p")).alias("ring"),
        F.expr("x.ring[x.p]").alias("primary_node"), F.expr("x.ring[x.s]").alias("secondary_node"),
        F.col("x.created.u").alias("created_u"), F.col("x.created.v").alias("created_v"),
        F.col("x.n").alias("n_nodes"), F.col("x.m").alias("n_edges"), F.expr("substring(w, 1, step)").alias("partial"),
    )


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of a text's UTF-8 bytes as 16 hexadecimal digits.

    The multiplication wraps at 64 bits, which plain arithmetic refuses; it is done on halves of 32 bits."""
    low = F.lit((1 << 32) - 1)

    def step(h: Column, byte: Column) -> Column:
        # Halves of h xor byte, times 2^40 + 0x1B3, the FNV prime.
        h0, h1 = h["lo"].bitwiseXOR(byte), h["hi"]
        a0 = h0 * 0x1B3
        a1 = h1 * 0x1B3 + F.shiftright(a0, 32) + F.shiftleft(h0.bitwiseAND((1 << 24) - 1), 8)
        return F.struct(a1.bitwiseAND(low).alias("hi"), a0.bitwiseAND(low).alias("lo"))

    raw = F.hex(F.encode(text, "UTF-8"))
    count = F.octet_length(text)
    codes = F.transform(F.filter(F.sequence(F.lit(0), count), lambda i: i < count), lambda i: F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    done = F.aggregate(codes, start, step)
    return F.lower(F.concat(F.lpad(F.hex(done["hi"]), 8, "0"), F.lpad(F.hex(done["lo"]), 8, "0")))


# Rings and graphs as arrays


def ring_inserted(ring: Column, at: Column, value: Column) -> Column:
    """The ring with a node after position ``at``."""
    return F.concat(F.slice(ring, F.lit(1), at + 1), F.array(value), F.slice(ring, at + 2, F.size(ring)))


def ring_removed(ring: Column, at: Column) -> Column:
    """The ring without the node at position ``at``."""
    return F.concat(F.slice(ring, F.lit(1), at), F.slice(ring, at + 2, F.size(ring)))


def ring_set(ring: Column, at: Column, value: Column) -> Column:
    return F.transform(ring, lambda x, k: F.when(k == at, value).otherwise(x))


def ring_next(ring: Column, at: Column, steps: int = 1) -> Column:
    """The position ``steps`` further on, or back if negative."""
    return F.pmod(at + steps, F.size(ring))


def neighbours(edges: Column, node: Column, directed: bool = False) -> Column:
    """The nodes that a node is joined to, in order."""
    out = F.transform(F.filter(edges, lambda e: e["u"] == node), lambda e: e["v"])
    if not directed:
        out = F.concat(out, F.transform(F.filter(edges, lambda e: e["v"] == node), lambda e: e["u"]))
    return F.array_sort(F.array_distinct(out))


def has_edge(edges: Column, u: Column, v: Column, directed: bool = False) -> Column:
    there = lambda e: (e["u"] == u) & (e["v"] == v)
    return F.exists(edges, there if directed else lambda e: there(e) | ((e["u"] == v) & (e["v"] == u)))


def with_edge(edges: Column, n: Column, u: Column, v: Column, directed: bool = False) -> Column:
    """The edges with one more, unless it is there; an end that is no node is an error."""
    grown = F.when(has_edge(edges, u, v, directed), edges).otherwise(F.concat(edges, F.array(F.struct(u.cast("int").alias("u"), v.cast("int").alias("v")))))
    return F.when((F.greatest(u, v) < n) & (F.least(u, v) >= 0), grown).otherwise(F.raise_error(F.lit("no such node")))
