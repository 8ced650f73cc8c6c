import random

import pytest
from pyspark.sql import functions as F

from ringlet.operators import decode, encode, pairs

PRESETS = [("VVPnC", 3, 3), ("Vpv", 3, 2), ("VVpvPpC", 4, 4), ("VVVV", 5, 4), ("VVpvpvPCnC", 5, 6), ("", 1, 0), ("W", 1, 0)]


def decoded(spark, strings):
    g = decode.graphs(spark.createDataFrame(list(enumerate(strings)), "id long, w string"))
    return {r.id: (r.n, sorted((e.u, e.v) for e in r.e)) for r in g.select("id", "n", decode.distinct_edges().alias("e")).collect()}


def test_presets(spark):
    got = decoded(spark, [w for w, _, _ in PRESETS])
    assert [(got[i][0], len(got[i][1])) for i in range(len(PRESETS))] == [(a, b) for _, a, b in PRESETS]


def test_invalid_string_raises(spark):
    with pytest.raises(Exception, match="invalid instruction string"):
        decoded(spark, ["VXV"])


def linked_list(w, directed=False):
    """The machine once more, with a linked list, step by step: nodes, edges, and a row for each step."""
    after, before, value = {0: 0}, {0: 0}, {0: 0}
    p = s = 0
    n, edges, rows = 1, [], []

    def insert(at):
        nonlocal n
        after[n], before[n], value[n] = after[at], at, n
        before[after[at]] = n
        after[at] = n
        n += 1

    def snapshot(c, made):
        ring, x = [value[p]], after[p]
        while x != p:
            ring.append(value[x])
            x = after[x]
        rows.append((c, ring, value[p], value[s], made, n, len(edges)))

    snapshot("", None)
    for c in w:
        new = None
        if c in "NP":
            p = after[p] if c == "N" else before[p]
        elif c in "np":
            s = after[s] if c == "n" else before[s]
        elif c in "Vv":
            at = p if c == "V" else s
            new = (value[at], n)
            insert(at)
        elif c in "Cc":
            new = (value[p], value[s]) if c == "C" else (value[s], value[p])
        made = None
        if new is not None:
            key = new if directed else (min(new), max(new))
            if key not in edges:
                edges.append(key)
                made = new
        snapshot(c, made)
    return n, sorted(edges), rows


def test_decoding_and_traces_equal_a_linked_list(spark):
    rng = random.Random(3)
    strings = ["", "VVCCcW", *("".join(rng.choice(decode.ALPHABET) for _ in range(rng.randrange(40))) for _ in range(60)), "".join(rng.choice("NnPpVvCc") for _ in range(600))]
    got = decoded(spark, strings)
    for directed in (False, True):
        steps = {}
        for r in decode.trace(spark.createDataFrame(list(enumerate(strings)), "id long, w string"), directed).orderBy("id", "step").collect():
            made = None if r.created_u is None else (r.created_u, r.created_v)
            steps.setdefault(r.id, []).append((r.instruction, r.ring, r.primary_node, r.secondary_node, made, r.n_nodes, r.n_edges))
            assert r.partial == strings[r.id][: r.step]
        for i, w in enumerate(strings):
            n, edges, rows = linked_list(w, directed)
            assert steps[i] == rows and (directed or got[i] == (n, edges))


def test_json_and_hash(spark):
    rows = spark.createDataFrame([(1, "VVPnC"), (2, "")], "id long, w string")
    g = decode.graphs(rows).withColumn("j", decode.graph_json())
    assert g.where("id = 1").first().j == '{"directed":false,"n":3,"edges":[[0,1],[0,2],[1,2]]}'
    back = g.select(decode.graph_from_json(g.j).alias("g")).collect()
    assert sorted((r.g.n, len(r.g.edges)) for r in back) == [(1, 0), (3, 3)]
    h = 0xCBF29CE484222325
    for b in "foobar é".encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    assert spark.createDataFrame([("foobar é",)], "t string").select(decode.fnv1a(F.col("t"))).first()[0] == f"{h:016x}"


def connected(rng, n, more=None):
    return sorted({(rng.randrange(v), v) for v in range(1, n)} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(n // 2 if more is None else more)})


def test_displacements_decide_the_first_operation():
    """The nearest operation equals a scan of all displacements in their order."""
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randrange(2, 8)
        directed = rng.random() < 0.5
        edges = [(u, v) for u in range(n) for v in range(n) if rng.random() < 0.4]
        search = encode.Search(n, edges, directed, list)
        ring = rng.sample(range(n), rng.randrange(1, n + 1))
        p, s, placed, m = rng.randrange(len(ring)), rng.randrange(len(ring)), sum(1 << u for u in ring), len(ring)
        left = [search.out[u] & rng.getrandbits(n) for u in range(n)]
        want = None
        for a, b in encode.displacements(m):
            u, v = ring[(p + a) % m], ring[(s + b) % m]
            kinds = (search.out[u] & ~placed, search.out[v] & ~placed, left[u] >> v & 1, directed and left[v] >> u & 1)
            if any(kinds):
                want = (next(k for k, x in enumerate(kinds) if x), a, b)
                break
        if want is None:
            continue
        got = search._nearest(ring, p, s, placed, left)
        used = lambda x: (x[0], x[1] if x[0] != 1 else 0, x[2] if x[0] != 0 else 0)
        assert used(got) == used(want)


@pytest.mark.parametrize("method", encode.METHODS)
@pytest.mark.parametrize("directed", [False, True])
def test_encoding_decodes_to_the_same_graph(method, directed):
    rng = random.Random(5)
    for n in (1, 2, 3, 4, 5, 6, 7):
        edges = connected(rng, n) if n > 1 else []
        w = encode.encode(n, edges, directed, method)
        if w is None:
            assert directed
            continue
        got, made, _ = linked_list(w, directed)
        assert encode.same_graph(n, edges, got, made, directed)


@pytest.mark.parametrize("method", ["pruned", "exhaustive"])
def test_canonical_ignores_labels(method):
    rng = random.Random(7)
    for n in (3, 4, 5, 6, 7, 8):
        edges, order = connected(rng, n), rng.sample(range(n), n)
        assert encode.encode(n, edges, False, method) == encode.encode(n, [(order[u], order[v]) for u, v in edges], False, method)


def test_exhaustive_is_the_least_of_all_strings():
    """Every string up to the canonical length that decodes to the graph is not before it."""
    from itertools import product

    for n, edges in ((3, [(0, 1), (1, 2)]), (3, [(0, 1), (1, 2), (0, 2)])):
        w = encode.encode(n, edges, False, "exhaustive")
        shorter = [x for length in range(len(w)) for x in map("".join, product("NnPpVvCc", repeat=length)) if encode.same_graph(n, edges, *linked_list(x)[:2])]
        assert not shorter


def test_disconnected_graphs_and_budgets_give_null(spark):
    assert encode.encode(3, [(0, 1)], False, "exhaustive") is None
    whole = [(i, j) for i in range(6) for j in range(i)]
    assert encode.encode(6, whole, False, "exhaustive", budget=5) is None and encode.encode(6, whole, False, "exhaustive") is not None
    frame = spark.createDataFrame([(1, 3, [(0, 1)]), (2, 13, [(0, k) for k in range(1, 13)]), (3, 1, [])], "id long, n int, edges array<struct<u:int,v:int>>")
    assert {r.id: r.encoding for r in encode.encoded(frame, "exhaustive").collect()} == {1: None, 2: "V" * 12, 3: ""}
    assert {r.id: r.encoding is None for r in encode.encoded(frame, "exhaustive", budget=3).collect()} == {1: True, 2: True, 3: False}


def test_search_tree():
    rows = encode.search_tree(3, [(0, 1), (1, 2)], max_depth=2)
    assert [r[:3] for r in rows[:3]] == [(0, -1, 0), (1, -1, 0), (2, -1, 0)] and {len(r[3]) for r in rows if r[2] == 1} == {1}
    assert len(encode.search_tree(5, [(0, k) for k in range(1, 5)], 3, max_nodes=7)) == 7


def test_connected_and_normalised(spark):
    edges = "id long, n int, edges array<struct<u:int,v:int>>"
    frame = spark.createDataFrame([(1, 3, [(0, 1)]), (2, 3, [(0, 1), (2, 1)]), (3, 1, [])], edges)
    assert {r.id: r.c for r in frame.select("id", encode.connected().alias("c")).collect()} == {1: False, 2: True, 3: True}
    nodes = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c"), (2, "x")], "id long, label string")
    ends = spark.createDataFrame([(1, "c", "a"), (1, "a", "gone")], "id long, source string, target string")
    got = {r.id: (r.n, [(e.u, e.v) for e in r.edges]) for r in encode.normalised(nodes, ends).collect()}
    assert got == {1: (3, [(2, 0)]), 2: (1, [])}


def test_pair_index(spark):
    for n in (2, 3, 10, 97):
        rows = pairs.pair_range(spark, n).collect()
        want = [(i, j) for i in range(n) for j in range(i + 1, n)]
        assert [(r.i, r.j) for r in sorted(rows)] == want
        k = spark.range(n * (n - 1) // 2).withColumnRenamed("id", "k")
        assert sorted((r.k, r.i, r.j) for r in pairs.found_in_rows(k, n).collect()) == [(k, *p) for k, p in enumerate(want)]
    assert [pairs.chunk(10, 4, c) for c in range(4)] == [(0, 3), (3, 6), (6, 8), (8, 10)]
    with pytest.raises(ValueError):
        pairs.chunk(10, 4, 4)


def test_numbers_in_order_of_id(spark):
    rows = spark.createDataFrame([(i * i * 7,) for i in range(50)], "id long")
    assert [r.idx for r in sorted(pairs.indexed(rows, 100).collect())] == list(range(50))


def test_rings_and_graphs_as_columns(spark):
    frame = spark.createDataFrame([([4, 5, 6], 3, [(0, 1), (2, 1), (2, 2)])], "ring array<int>, n int, edges array<struct<u:int,v:int>>")
    at = F.lit(1)
    ring, edges = F.col("ring"), F.col("edges")
    r = frame.select(
        decode.ring_inserted(ring, at, F.lit(9)).alias("a"), decode.ring_removed(ring, at).alias("b"), decode.ring_set(ring, at, F.lit(9)).alias("c"), decode.ring_next(ring, F.lit(2)).alias("d"), decode.ring_next(ring, F.lit(0), -1).alias("e"),
        decode.forward_order(ring, at).alias("f"), decode.neighbours(edges, F.lit(1)).alias("g"), decode.neighbours(edges, F.lit(2), directed=True).alias("h"), decode.has_edge(edges, F.lit(1), F.lit(2)).alias("i"),
        decode.has_edge(edges, F.lit(1), F.lit(2), directed=True).alias("j"), F.size(decode.with_edge(edges, F.col("n"), F.lit(1), F.lit(2))).alias("k"), F.size(decode.with_edge(edges, F.col("n"), F.lit(0), F.lit(2))).alias("l"),
    ).first()
    assert list(r) == [[4, 5, 9, 6], [4, 6], [4, 9, 6], 0, 2, [5, 6, 4], [0, 2], [1, 2], True, False, 3, 4]
    with pytest.raises(Exception, match="no such node"):
        frame.select(decode.with_edge(edges, F.col("n"), F.lit(0), F.lit(3))).collect()


def test_engine(spark):
    assert encode.engine(spark) == "catalyst" and encode.engine(spark, "arrow") == "arrow"
    with pytest.raises(ValueError):
        encode.engine(spark, "other")
