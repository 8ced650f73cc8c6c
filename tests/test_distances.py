import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from ringlet.operators import encode, encoders, ged, pairs
from ringlet.sources import synthetic


def graph(rng, n, more=3):
    return sorted({(rng.randrange(v), v) for v in range(1, n)} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(more if n > 1 else 0)})


def all_maps(n, m):
    for image in itertools.product([None, *range(m)], repeat=n):
        used = [x for x in image if x is not None]
        if len(set(used)) == len(used):
            yield list(image)


@pytest.mark.parametrize("costs", [ged.UNIT, ged.Costs(2, 3, 1, 1, 2, 0.5), ged.Costs(0, 0, 0, 1, 1, 0)])
def test_exact_distance_is_the_least_of_all_maps(costs):
    rng = random.Random(1)
    for _ in range(25):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        a, b = graph(rng, n, rng.randrange(3)), graph(rng, m, rng.randrange(3))
        want = min(ged.induced_cost(n, a, m, b, image, costs) for image in all_maps(n, m))
        lower, upper = ged.bracket(n, a, m, b, costs)
        assert ged.exact(n, a, m, b, costs) == pytest.approx(want) and lower <= want + 1e-9 <= upper + 2e-9


def test_assignment_is_least():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(0, 5)
        c = [[float(rng.randint(0, 9)) if i == j or rng.random() < 0.7 else math.inf for j in range(n)] for i in range(n)]
        cost, chosen = ged.assign(c)
        assert sorted(chosen) == list(range(n)) and cost == min(sum(c[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_bounds_of_the_pair_query_equal_the_assignment(spark):
    rng = random.Random(3)
    made = [(i, n, graph(rng, n, rng.randrange(5))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 6, 7])]
    frame = spark.createDataFrame([(i, "", n, e) for i, n, e in made], "id long, w string, n int, edges array<struct<u:int,v:int>>")
    for r in pairs.measured(pairs.indexed(pairs.shaped(frame))).collect():
        (_, n, a), (_, m, b) = made[r.i], made[r.j]
        want = ged.exact(n, a, m, b)
        assert r.lb == pytest.approx(ged.lower_bound(n, a, m, b)) and r.lb <= want <= r.ub
        assert r.ham == len({*a} ^ {*b})


def test_backends(spark):
    assert ged.zero_is_possible(3, [(0, 1)], 3, [(1, 2)]) and not ged.zero_is_possible(3, [(0, 1)], 2, [(0, 1)])
    assert ged.zero_is_possible(3, [(0, 1)], 2, [(0, 1)], ged.Costs(0, 0))
    assert ged.finished(0.5, None) and ged.finished(0.9, 1.0) and not ged.finished(0.995, 1.0)
    assert ged.exact(8, synthetic.complete(8), 8, synthetic.cycle(8), seconds=0.0) is None
    late = ged.Exact(seconds=0.0).measure(8, synthetic.cycle(8), 8, [*synthetic.path(7), (2, 7)])
    assert late.certified or (late.timed_out and late.distance is None and late.lb <= late.ub)
    with pytest.raises(ValueError):
        ged.backend("other")
    with pytest.raises(ValueError):
        ged.Costs(-1)
    frame = spark.createDataFrame([(0, 3, [(0, 1), (1, 2)], 3, synthetic.cycle(3)), (1, 2, [(0, 1)], 2, [(0, 1)])], "k long, n_i int, edges_i array<struct<u:int,v:int>>, n_j int, edges_j array<struct<u:int,v:int>>")
    assert {r.k: (r.distance, r.certified) for r in ged.measured(frame, ged.backend("exact")).collect()} == {0: (1.0, True), 1: (0.0, True)}
    stub = ged.backend("stub", answer=lambda n, a, m, b: None if n == 2 else 7.0)
    assert {r.k: (r.distance, r.timed_out) for r in ged.measured(frame, stub).collect()} == {0: (7.0, False), 1: (None, True)}
    report, held = ged.ladder(frame, stub, [2, 3, 4])
    assert [x[:2] for x in report] == [(2, 1)] and held is None
    assert ged.ladder(frame, ged.backend("exact"), [2, 3])[1] == 3


def test_least_code_canonical_order_and_automorphisms():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 6)
        e, perm = graph(rng, n, rng.randrange(4)), rng.sample(range(n), n)
        moved = [tuple(sorted((perm[u], perm[v]))) for u, v in e]
        adj = ged.adjacency(n, e)
        assert encoders.least_code(n, e) == min(encoders.code_of(adj, list(p)) for p in itertools.permutations(range(n))) == encoders.least_code(n, moved)
        one, two = (encoders.renamed(x, encoders.canonical_order(n, x)) for x in (e, moved))
        assert one == two and encode.same_graph(n, e, n, one)
        same = [p for p in itertools.permutations(range(n)) if {tuple(sorted((p[u], p[v]))) for u, v in e} == set(e)]
        count, orbits = encoders.automorphisms(n, e)
        assert count == len(same) and orbits == [min(p[u] for p in same) for u in range(n)]
    with pytest.raises(encoders.BudgetSpent):
        encoders.least_code(6, synthetic.cycle(6), 10)


def test_graph6_and_sparse6(spark):
    assert encoders.graph6_text(5, [(0, 2), (0, 4), (1, 3), (3, 4)]) == "DQc"
    assert encoders.sparse6_text(7, [(0, 1), (0, 2), (1, 2), (5, 6)]) == ":Fa@x^"
    rng = random.Random(5)
    made = [(i, n, graph(rng, n, n)) for i, n in enumerate([1, 2, 3, 8, 62, 63, 70])]
    frame = pairs.shaped(spark.createDataFrame(made, "id long, n int, edges array<struct<u:int,v:int>>"))
    rows = frame.withColumn("g6", encoders.graph6()).withColumn("p", encoders.graph6_parts()).withColumn("b", encoders.triangle()).withColumn("back", encoders.from_triangle("n", "b"))
    for r in rows.collect():
        _, n, e = made[r.id]
        assert r.g6 == encoders.graph6_text(n, e) and (r.p.n, r.p.bits) == (n, r.b) and sorted((x.u, x.v) for x in r.back) == e
        assert encoders.from_sparse6(encoders.sparse6_text(n, e)) == (n, e)
    header = spark.createDataFrame([(62,), (63,), (258_047,), (258_048,)], "n int").select("n", encoders.size_header(F.col("n")).alias("h")).collect()
    assert [r.h for r in header] == [encoders._header(r.n) for r in header] and [len(r.h) for r in header] == [1, 4, 4, 8]


def all_dfs_codes(n, e):
    """Every depth-first code by brute force, compared edge by edge: backward before forward, near targets, deep sources first."""
    adj = ged.adjacency(n, e)
    best = None

    def key(code):
        return [(0, j) if i > j else (1, -i) for i, j in code]

    def grow(nodes, path, used, code):
        nonlocal best
        if len(code) == len(e):
            if best is None or key(code) < key(best):
                best = list(code)
            return
        last = nodes[path[-1]]
        for back in path[:-1]:
            edge = frozenset((last, nodes[back]))
            if adj[last] >> nodes[back] & 1 and edge not in used:
                grow(nodes, path, used | {edge}, [*code, (path[-1], back)])
        for front in path:
            for v in range(n):
                edge = frozenset((nodes[front], v))
                if adj[nodes[front]] >> v & 1 and v not in nodes:
                    grow([*nodes, v], [*path[: path.index(front) + 1], len(nodes)], used | {edge}, [*code, (front, len(nodes))])

    for u, v in [*e, *((v, u) for u, v in e)]:
        grow([u, v], [0, 1], frozenset([frozenset((u, v))]), [(0, 1)])
    return best


def test_depth_first_codes():
    rng = random.Random(6)
    for _ in range(25):
        n = rng.randint(2, 5)
        e = graph(rng, n, rng.randrange(3))
        code = encoders.dfs_code(n, e)
        assert code == all_dfs_codes(n, e) and encode.same_graph(n, e, *encoders.from_dfs_code(code))
    for bad in ((1, []), (3, [(0, 1)])):
        with pytest.raises(ValueError):
            encoders.dfs_code(*bad)
    with pytest.raises(encoders.BudgetSpent):
        encoders.dfs_code(6, synthetic.complete(6), 10)


def test_encodings_say_why_there_is_none(spark):
    frame = synthetic.fixtures(spark)
    got = {(r.id, r.encoder): r for r in encoders.encodings(frame, list(encoders.ENCODERS)).collect()}
    assert got["empty_3", "dfs_code"].symbols is None and "no depth-first code" in got["empty_3", "dfs_code"].problem
    assert got["empty_3", "canonical_string"].problem and got["edge", "canonical_string"].text == "V"
    assert got["k33", "adjacency"].entropy_bits == 15 and got["k33", "adjacency"].stored_bits == 16
    assert got["prism", "sparse6"].entropy_bits == 6 * (len(got["prism", "sparse6"].text) - 1) and got["triangle", "size_only"].entropy_bits is None
    assert got["triangle", "dfs_code"].symbols == ["0-1", "1-2", "2-0"] and got["triangle", "dfs_code"].inflated
    with pytest.raises(ValueError):
        encoders.encoder("none")
    with pytest.raises(ValueError):
        encoders.register("graph6", encoders.ENCODERS["graph6"])


def test_alignments_and_symbols(spark):
    rng = random.Random(7)
    for _ in range(60):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(2))
        steps = encoders.alignment(a, b)
        path = encoders.edit_path(a, b)
        assert "".join(x or "" for _, x, _ in steps) == a and "".join(y or "" for *_, y in steps) == b
        assert path[0] == a and path[-1] == b and len(path) - 1 == sum(k != "match" for k, *_ in steps)
    assert sum(k != "match" for k, *_ in encoders.alignment("kitten", "sitting")) == 3
    frame = spark.createDataFrame([(["0-1", "1-2"], ["0-1", "2-0", "1-2"]), ([], ["x"])], "a array<string>, b array<string>")
    assert [r[0] for r in frame.select(encoders.symbol_levenshtein(F.col("a"), F.col("b"))).collect()] == [1, 1]


def leg(n, length):
    """A spider: node 0 and n legs of some nodes each."""
    return 1 + n * length, [(0 if k % length == 0 else k, k + 1) for k in range(n * length)]


@pytest.mark.parametrize("n, e", [leg(9, 1), leg(10, 1), leg(16, 1), leg(8, 2)])
def test_many_embeddings_have_a_depth_first_code(n, e):
    moved = [(n - 1 - u, n - 1 - v) for u, v in e]
    here, there = (encoders.ENCODERS["dfs_code"](n, x) for x in (e, moved))
    assert here.symbols == there.symbols and here.entropy_bits == len(e) * 2 * (n - 1).bit_length()
    assert encode.same_graph(n, e, *encoders.from_dfs_code([tuple(map(int, s.split("-"))) for s in here.symbols]))


@pytest.mark.parametrize("n, e", [leg(16, 1), leg(8, 2)])
def test_many_orders_have_a_least_code(n, e):
    moved = [(n - 1 - u, n - 1 - v) for u, v in e]
    here, there = (encoders.ENCODERS["least_code"](n, x).text for x in (e, moved))
    bits = iter(here)
    assert here == there and encode.same_graph(n, e, n, [(i, j) for j in range(1, n) for i in range(j) if next(bits) == "1"])
