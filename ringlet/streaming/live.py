"""Decoding of instruction streams: a graph grows as its letters come in.

Decoding is a fold from the left, so that the state between micro-batches is the fold's own: the ring, the pointers'
places, the number of nodes, the edges, and how far the stream was read.  Letters of a graph are numbered from 0; rows of a
micro-batch may come in any order, rows that were read already (a source that repeats itself) are skipped, and a
gap is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ringlet.operators.decode import ALPHABET

_STATE = "ring array<int>, p int, s int, n int, u array<int>, v array<int>, upto long"


def advanced(ring: list[int], p: int, s: int, n: int, edges: dict[tuple[int, int], None], letter: str) -> tuple[int, int, int]:
    """One letter: changes the ring and the edges in place, and returns the pointers' places and the number of nodes."""
    if letter not in ALPHABET or len(letter) != 1:
        raise ValueError(f"invalid instruction: {letter}")
    m = len(ring)
    if letter in "NP":
        p = (p + (1 if letter == "N" else -1)) % m
    elif letter in "np":
        s = (s + (1 if letter == "n" else -1)) % m
    elif letter in "Vv":
        at = p if letter == "V" else s
        edges[(ring[at], n)] = None
        ring.insert(at + 1, n)
        n += 1
        if letter == "V":
            s += s > at
        else:
            p += p > at
    elif letter in "Cc":
        u, v = ring[p], ring[s]
        edges[(min(u, v), max(u, v))] = None
    return p, s, n


def live_graphs(stream: DataFrame) -> DataFrame:
    """graph_id, n_letters, n_nodes, n_edges of each graph that a micro-batch of rows (graph_id, place, letter) changed; undirected."""
    kind = stream.schema["graph_id"].dataType.simpleString()

    def grow(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ring, p, s, n, u, v, upto = state.get if state.exists else ([0], 0, 0, 1, [], [], 0)
        ring, edges = list(ring), dict.fromkeys(zip(u, v, strict=True))
        rows = pd.concat(list(frames)).sort_values("place")
        for place, letter in zip(rows["place"], rows["letter"], strict=True):
            if place < upto:
                continue
            if place > upto:
                raise ValueError(f"graph {key[0]}: letter {upto} is missing before {place}")
            p, s, n = advanced(ring, p, s, n, edges, letter)
            upto += 1
        state.update((ring, p, s, n, [a for a, _ in edges], [b for _, b in edges], upto))
        yield pd.DataFrame({"graph_id": [key[0]], "n_letters": [upto], "n_nodes": [n], "n_edges": [len(edges)]})

    rows = stream.select("graph_id", "place", "letter")
    return rows.groupBy("graph_id").applyInPandasWithState(grow, f"graph_id {kind}, n_letters long, n_nodes int, n_edges int", _STATE, "update", "NoTimeout")
