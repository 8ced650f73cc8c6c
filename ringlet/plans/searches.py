"""Queries that need searches or numeric methods.  SQL checks what it can say of them: sizes kept, bounds met, invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlet.operators import decode, encode, encoders, ged, pairs, scaling
from ringlet.plans.relations import Query, bench, bench_pairs, bgraphs
from ringlet.sources import synthetic

METHODS = {"greedy_single": "single", "greedy_min": "min", "pruned_canonical": "pruned", "canonical": "exhaustive"}


def _simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bgraphs, indexed, with their proper edges as rows."""
    edges = F.expr(f"transform(x, c -> named_struct('u', cast(c div {pairs.CODE} AS int), 'v', cast(c % {pairs.CODE} AS int)))")
    return pairs.indexed(bgraphs(spark, sf_dir).select("id", "w", "n", "m", "x", "d", "cls")).withColumn("edges", edges)


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each graph and the next by idx, with _i and _j; k is the first's idx."""
    rows = _simple(spark, sf_dir).select("idx", "id", "w", "n", "edges", "x", "d")
    a = rows.select(*[F.col(c).alias("k" if c == "idx" else f"{c}_i") for c in rows.columns])
    b = rows.select(*[F.col(c).alias("_next" if c == "idx" else f"{c}_j") for c in rows.columns])
    return a.join(b, F.col("k") + 1 == F.col("_next")).drop("_next")


_NEXT = ", nx AS (SELECT a.idx AS k, a.id AS id_i, b.id AS id_j, a.w AS w_i, b.w AS w_j, a.n AS n_i, b.n AS n_j, a.d AS d_i, b.d AS d_j, a.x AS x_i, b.x AS x_j FROM b_i a JOIN b_i b ON b.idx = a.idx + 1)"


def encoding(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graphs = bgraphs(spark, sf_dir)
        return graphs.select("id", F.col("n").alias("n_nodes")).join(encode.encoded(graphs, METHODS[method]), "id").withColumn("len", F.length("encoding"))

    return run


def _code(graphs: DataFrame) -> DataFrame:
    """id, code: equal for isomorphic graphs, loops aside."""
    return encoders.encodings(graphs, ["canonical_graph6"]).select("id", F.col("text").alias("code"))


def g2s_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every graph by every method: sizes, and whether the graph is the same but for names."""
    graphs = bgraphs(spark, sf_dir)
    out = None
    for name, method in METHODS.items():
        back = decode.graphs(encode.encoded(graphs, method).where("encoding IS NOT NULL").select("id", F.col("encoding").alias("w")))
        rows = back.select("id", F.lit(name).alias("method"), F.col("n").alias("n_nodes"), F.size(decode.distinct_edges()).alias("n_edges")).join(_code(back), "id")
        out = rows if out is None else out.unionByName(rows)
    same = out.join(_code(graphs).withColumnRenamed("code", "_code"), "id").withColumn("isomorphic", (F.col("code") == F.col("_code")).cast("int"))
    return same.select("id", "method", "n_nodes", "n_edges", "isomorphic")


def canonical_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical strings of every graph and of a copy with other names."""
    graphs = bgraphs(spark, sf_dir)
    moved = graphs.withColumn("_p", F.expr("array_sort(transform(sequence(0, n - 1), k -> named_struct('h', md5(concat(id, ':', k)), 'k', k)))")).withColumn("_q", F.transform("_p", lambda s: s["k"]))
    to = lambda x: (F.array_position(F.col("_q"), x) - 1).cast("int")
    moved = moved.withColumn("edges", F.transform("edges", lambda e: F.struct(to(e["u"]).alias("u"), to(e["v"]).alias("v"))))
    out = graphs.select("id", F.col("n").cast("int").alias("n_nodes"))
    for method in ("pruned", "exhaustive"):
        a, b = encode.encoded(graphs, method), encode.encoded(moved, method).withColumnRenamed("encoding", "_other")
        out = out.join(a.join(b, "id").select("id", (F.col("encoding") == F.col("_other")).cast("int").alias(f"same_{method}")), "id")
    return out


def fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding a canonical string and encoding again gives it back."""
    graphs = bgraphs(spark, sf_dir)
    first = encode.encoded(graphs, "exhaustive")
    again = encode.encoded(decode.graphs(first.select("id", F.col("encoding").alias("w"))), "exhaustive").withColumnRenamed("encoding", "_again")
    return first.join(again, "id").select("id", (F.col("encoding") == F.col("_again")).cast("int").alias("stable"))


def graph_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levenshtein between the canonical strings of each graph and the next."""
    return encode.graph_distances(bgraphs(spark, sf_dir), _neighbours(spark, sf_dir).select("k", "id_i", "id_j"))


def start_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the greedy strings over the start nodes of each graph."""
    rows = encode.from_starts(bgraphs(spark, sf_dir), "min").where("w IS NOT NULL").withColumn("l", F.length("w"))
    spread, mean = F.stddev_pop("l"), F.avg("l")
    return rows.groupBy("id").agg(
        F.count("*").alias("n_starts"), F.min("l").alias("best"), F.max("l").alias("worst"), mean.alias("mean"), F.percentile("l", F.lit(0.5)).alias("median"), spread.alias("sd"),
        F.when(mean > 0, spread / F.nullif(mean, F.lit(0.0))).alias("cv"), (F.percentile("l", F.lit(0.75)) - F.percentile("l", F.lit(0.25))).alias("iqr"),
        F.min(F.struct("l", "start"))["start"].alias("best_start"), (-F.max(F.struct(F.col("l"), -F.col("start")))["col2"]).alias("worst_start"),
    )


def optimality_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy against canonical length: ratio and gap."""
    graphs = bgraphs(spark, sf_dir)
    a, b = encode.encoded(graphs, "min"), encode.encoded(graphs, "exhaustive").withColumnRenamed("encoding", "_best")
    rows = a.join(b, "id").select("id", F.length("encoding").alias("greedy"), F.length("_best").alias("canonical"))
    return rows.withColumn("gap", F.col("greedy") - F.col("canonical")).withColumn("ratio", F.when(F.col("canonical") > 0, F.col("greedy") / F.nullif(F.col("canonical"), F.lit(0))))


def ged_of_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distance between one graph of each isomorphism class and each other's; classes come from ``graph_classes``."""
    graphs = _simple(spark, sf_dir)
    classes = _code(graphs).groupBy("code").agg(F.min("id").alias("id"))
    heads = graphs.join(classes.select("id"), "id").select("id", "n", "edges")
    found = ged.measured(pairs.all_pairs(pairs.indexed(heads)), ged.backend("exact"))
    return found.drop("seconds")


def graph_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, class_id: the least id of an isomorphic graph (loops aside)."""
    code = _code(_simple(spark, sf_dir))
    return code.join(code.groupBy("code").agg(F.min("id").alias("class_id")), "code").select("id", "class_id")


def ged_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distance of each graph and the next, between its bounds."""
    rows = _neighbours(spark, sf_dir)
    got = ged.measured(rows, ged.backend("exact"))
    bounds = ged.measured(rows, ged.backend("bounds")).select("k", F.col("lb").alias("_lb"), F.col("ub").alias("_ub"))
    inside = (F.col("_lb") <= F.col("distance") + 1e-9) & (F.col("distance") <= F.col("_ub") + 1e-9)
    return got.join(bounds, "k").select("k", F.round("_lb", 1).alias("lb"), inside.cast("int").alias("inside"), F.col("certified").cast("int").alias("certified"))


def adjacency_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bgraphs(spark, sf_dir).withColumn("bits", encoders.triangle())
    back = rows.withColumn("_back", encoders.from_triangle("n", "bits"))
    return back.select("id", "bits", F.size("_back").alias("n_edges"))


def graph6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bgraphs(spark, sf_dir).withColumn("g6", encoders.graph6()).withColumn("_p", encoders.graph6_parts())
    return rows.select("id", "g6", F.col("_p.n").alias("n_back"), (F.col("_p.bits") == encoders.triangle()).cast("int").alias("same_bits"))


_TRIANGLE = "CASE WHEN n < 2 THEN '' ELSE array_to_string(flatten(list_transform(range(1, n), lambda j: list_transform(range(0, j), lambda i: CASE WHEN list_contains(x, i * 1048576 + j) THEN '1' ELSE '0' END))), '') END"


def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every graph by every encoder."""
    names = [n for n in encoders.ENCODERS if n not in ("canonical_string",)]
    rows = encoders.encodings(_simple(spark, sf_dir), names)
    return rows.withColumn("symbols", F.array_join("symbols", " "))


def bit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoders.encodings(_simple(spark, sf_dir), ["adjacency", "graph6", "dfs_code", "size_only"])
    return rows.select("id", "encoder", "entropy_bits", "payload_bits", F.col("symbols").isNotNull().cast("int").alias("defined"))


def symbol_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levenshtein over the symbols of adjacency codes, of each graph and the next."""
    symbols = lambda s: F.filter(F.split(encoders.triangle(f"n_{s}", f"x_{s}"), ""), lambda c: c != "")
    return _neighbours(spark, sf_dir).select("k", encoders.symbol_levenshtein(symbols("i"), symbols("j")).alias("d"))


def edit_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of each string and the next."""
    rows = encoders.alignments(_neighbours(spark, sf_dir))
    return rows.groupBy("k").agg(F.count_if(F.col("op") != "match").cast("int").alias("n_edits"), F.count("*").alias("n_steps"))


def automorphism_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for id_, n, edges in zip(b["id"], b["n"], b["edges"], strict=True):
                count, orbits = encoders.automorphisms(n, [(e["u"], e["v"]) for e in edges])
                rows.append((id_, count, len(set(orbits))))
            yield pd.DataFrame(rows, columns=["id", "group_size", "n_orbits"])

    return _simple(spark, sf_dir).select("id", "n", "edges").mapInPandas(run, "id long, group_size long, n_orbits int")


def synthetic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the families that nothing random enters."""
    rows = synthetic.families(spark, ["path", "star", "cycle", "complete", "binary_tree", "grid"], 1)
    return rows.select("family", "n", F.inline("edges")).select("family", "n", "u", "v")


def synthetic_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random families and the density sweep, encoded greedily."""
    rows = synthetic.families(spark, ["ba_m1", "ba_m2", "gnp_03", "gnp_05"], 2, largest=12).unionByName(synthetic.density_sweep(spark, instances=2))
    return rows.select("id", "family", "n", F.size("edges").alias("m")).join(encode.encoded(rows, "min"), "id")


def edit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs k edits apart: the edits are there, and bound the distance."""
    rows = synthetic.edit_pairs(spark, _simple(spark, sf_dir))
    changed = F.size(F.array_except("edges", "edited")) + F.size(F.array_except("edited", "edges"))
    return rows.select("id", "k", changed.alias("n_changed"))


def string_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random strings, their graphs, the best greedy and the canonical strings, and how far they are from the first."""
    rows = synthetic.random_strings(spark, 200, 12)
    graphs = decode.graphs(rows)
    a, b = encode.encoded(graphs, "min"), encode.encoded(graphs, "pruned").withColumnRenamed("encoding", "pruned")
    out = rows.join(a, "id").join(b, "id")
    return out.select("id", "w", "encoding", "pruned", F.levenshtein("w", "encoding").alias("to_greedy"), F.levenshtein("encoding", "pruned").alias("between"))


def _within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench_pairs(spark, sf_dir).where("cls_i = cls_j").select(F.col("cls_i").alias("dataset"), "i", "j", "lev", "ub")


def mds_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling.spectra(_within(spark, sf_dir), "lev").select("dataset", "place", *[F.round(c, 6).alias(c) for c in ("value", "cumulative", "negative_share")])


def mds_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stress of the coordinates found by majorisation, for each dataset and number of dimensions."""
    rows, out = _within(spark, sf_dir), None
    for dims in (2, 5):
        got = scaling.stress(rows, scaling.coordinates(rows, "lev", dims, starts=1, turns=30), "lev").withColumn("dims", F.lit(dims))
        out = got if out is None else out.unionByName(got)
    return out


def procrustes_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling.agreement(_within(spark, sf_dir), "lev", "ub")


def centralities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling.centralities(_simple(spark, sf_dir))


def lev1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs that one edit of the string gives, by class: of every string, its insertions, deletions and substitutions."""
    w = bench(spark, sf_dir).select("id", "w").where("length(w) > 0")
    letters = F.array(*map(F.lit, decode.ALPHABET))
    at = w.withColumn("p", F.explode(F.sequence(F.lit(1), F.length("w") + 1)))
    cut = at.where("p <= length(w)").select("id", F.expr("concat(substring(w, 1, p - 1), substring(w, p + 1))").alias("w"))
    put = at.withColumn("c", F.explode(letters))
    new = put.select("id", F.expr("concat(substring(w, 1, p - 1), c, substring(w, p))").alias("w"))
    other = put.where("p <= length(w)").select("id", F.expr("concat(substring(w, 1, p - 1), c, substring(w, p + 1))").alias("w"))
    every = cut.unionByName(new).unionByName(other).distinct()
    g = pairs.shaped(decode.graphs(every))
    return g.groupBy("id").agg(F.count("*").alias("n_strings"), F.countDistinct("n", "x").alias("n_graphs"), F.countDistinct("n", "d").alias("n_degree_sequences"))


def graph_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs as JSON and back."""
    rows = bgraphs(spark, sf_dir).withColumn("_g", decode.graph_from_json(decode.graph_json()))
    return rows.select("id", F.col("_g.n").alias("n_nodes"), F.size("_g.edges").alias("n_edges"))


def edge_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graphs as two arrays of ends, both ways, and back."""
    rows = bgraphs(spark, sf_dir).withColumn("_i", encode.edge_index())
    back = rows.withColumn("_b", encode.from_edge_index(F.col("_i.source"), F.col("_i.target"))).withColumn("_e", decode.distinct_edges("_b"))
    return back.select("id", F.size("_i.source").alias("n_entries"), F.size("_e").alias("n_edges"))


def graph_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One more node, and an edge from it to node 0; the neighbours of node 0 before and after, and the ring with a node less."""
    rows = _simple(spark, sf_dir).withColumn("_e", decode.with_edge(F.col("edges"), F.col("n") + 1, F.lit(0), F.col("n")))
    ring = decode.ring_removed(decode.ring_inserted(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0), F.col("n")), F.col("n"))
    return rows.select(
        "id", (F.col("n") + 1).alias("n_nodes"), F.size("_e").alias("n_edges"), F.size(decode.neighbours(F.col("edges"), F.lit(0))).alias("n_before"),
        F.size(decode.neighbours(F.col("_e"), F.lit(0))).alias("n_after"), decode.has_edge(F.col("_e"), F.col("n"), F.lit(0)).cast("int").alias("joined"), F.size(ring).alias("ring_size"),
    )


def encoder_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each canonical encoder, graphs it encodes and those whose text is the same under other names."""
    names = ["canonical_graph6", "canonical_sparse6", "least_code", "dfs_code"]
    graphs = _simple(spark, sf_dir)
    order = F.transform(F.array_sort(F.expr("transform(sequence(0, n - 1), k -> named_struct('h', md5(concat(id, ':', k)), 'k', k))")), lambda s: s["k"])
    to = lambda x: (F.array_position(F.col("_q"), x) - 1).cast("int")
    moved = graphs.withColumn("_q", order).withColumn("edges", F.transform("edges", lambda e: F.struct(to(e["u"]).alias("u"), to(e["v"]).alias("v"))))
    a = encoders.encodings(graphs, names).select("id", "encoder", "text")
    b = encoders.encodings(moved, names).select("id", "encoder", F.col("text").alias("_other"))
    met = a.join(b, ["id", "encoder"]).where("text IS NOT NULL")
    return met.groupBy("encoder").agg(F.count("*").alias("n"), F.count_if(F.col("text") == F.col("_other")).alias("n_same"))


def ged1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs one edge away from each graph, up to isomorphism."""
    cells = F.expr("flatten(transform(sequence(0, n - 1), a -> transform(filter(sequence(0, n - 1), b -> b > a), b -> named_struct('u', a, 'v', b))))")
    rows = _simple(spark, sf_dir).select("id", "n", "edges", F.explode(cells).alias("_c"))
    edges = F.when(F.array_contains("edges", F.col("_c")), F.array_except("edges", F.array("_c"))).otherwise(F.concat("edges", F.array("_c")))
    each = rows.select(F.struct("id", "_c").alias("_k"), "n", edges.alias("edges")).select(F.to_json("_k").alias("id"), "n", "edges")
    code = _code(each).select(F.from_json("id", "id long").getField("id").alias("id"), "code")
    return code.groupBy("id").agg(F.count("*").alias("n_edits"), F.countDistinct("code").alias("n_graphs"))


def ged_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the exact backend did on each graph and the next."""
    return ged.summary(ged.measured(_neighbours(spark, sf_dir), ged.backend("exact"))).drop("seconds", "slowest")


def dataset_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each proxy against the upper bound, within each dataset."""
    rows = bench_pairs(spark, sf_dir).where("cls_i = cls_j").select(F.col("cls_i").alias("dataset"), "i", "j", "lev", "ham", "lb", "ub")
    return scaling.correlation_report(rows, ["lev", "ham", "lb"], "ub", replicates=30, permutations=19)


#: name -> (query, SQL after the relations' prelude or None).
SEARCHES: dict[str, tuple[Query, str | None]] = {
    **{f"g2s_{name}": (encoding(name), None) for name in METHODS},
    "isomorphism_classes": (lambda s, d: encode.isomorphism_classes(bgraphs(s, d)), None),
    "g2s_roundtrip": (g2s_roundtrip, "SELECT id, method, n AS n_nodes, len(l)::INT AS n_edges, 1 AS isomorphic FROM b_g CROSS JOIN (VALUES ('greedy_single'), ('greedy_min'), ('pruned_canonical'), ('canonical')) AS m(method)"),
    "canonical_invariance": (canonical_invariance, "SELECT id, n AS n_nodes, 1 AS same_pruned, 1 AS same_exhaustive FROM b_g"),
    "fixed_point": (fixed_point, "SELECT id, 1 AS stable FROM b_g"),
    "graph_distance": (graph_distance, None),
    "start_nodes": (start_nodes, None),
    "greedy_optimality": (optimality_gap, None),
    "ged_of_classes": (ged_of_classes, None),
    "graph_classes": (graph_classes, None),
    "ged_neighbours": (ged_neighbours, _NEXT + """ SELECT k, round(abs(n_i - n_j) + list_sum(list_transform(range(1, greatest(n_i, n_j) + 1), lambda q: abs(coalesce(d_i[q], 0) - coalesce(d_j[q], 0)))) / 2, 1) AS lb, 1 AS inside, 1 AS certified FROM nx"""),
    "adjacency_bits": (adjacency_bits, f"SELECT id, {_TRIANGLE} AS bits, m AS n_edges FROM bgraphs"),
    "graph6": (graph6, f""", t AS (SELECT id, n, {_TRIANGLE} AS b FROM bgraphs), f AS (SELECT id, n, rpad(b, ((length(b) + 5) // 6 * 6)::INT, '0') AS b FROM t)
        SELECT id, concat(chr(n + 63), coalesce(array_to_string(list_transform(range(0, length(b) // 6), lambda q: chr((63 + 32 * substr(b, q * 6 + 1, 1)::INT + 16 * substr(b, q * 6 + 2, 1)::INT + 8 * substr(b, q * 6 + 3, 1)::INT
          + 4 * substr(b, q * 6 + 4, 1)::INT + 2 * substr(b, q * 6 + 5, 1)::INT + substr(b, q * 6 + 6, 1)::INT)::INT)), ''), '')) AS g6, n AS n_back, 1 AS same_bits FROM f"""),
    "encodings": (encodings, None),
    "bit_counts": (bit_counts, """SELECT id, encoder, CASE encoder WHEN 'adjacency' THEN (n * (n - 1) // 2)::DOUBLE WHEN 'graph6' THEN 6.0::DOUBLE * (1 + (n * (n - 1) // 2 + 5) // 6) WHEN 'dfs_code' THEN CASE WHEN m > 0 THEN (m * 2 * length(bin(greatest(n - 1, 1))))::DOUBLE END END AS entropy_bits,
        CASE WHEN encoder IN ('adjacency', 'graph6') THEN (n * (n - 1) // 2)::BIGINT END AS payload_bits, CASE WHEN encoder = 'dfs_code' AND m = 0 THEN 0 ELSE 1 END AS defined FROM bgraphs CROSS JOIN (VALUES ('adjacency'), ('graph6'), ('dfs_code'), ('size_only')) AS e(encoder)"""),
    "symbol_distance": (symbol_distance, _NEXT + f", t AS (SELECT id, {_TRIANGLE} AS b FROM bgraphs) SELECT k, levenshtein(a.b, b.b)::INT AS d FROM nx JOIN t a ON a.id = id_i JOIN t b ON b.id = id_j"),
    "edit_alignment": (edit_alignment, None),
    "edit_alignment_cost": (lambda s, d: edit_alignment(s, d).drop("n_steps"), _NEXT + " SELECT k, levenshtein(w_i, w_j)::INT AS n_edits FROM nx WHERE length(w_i) + length(w_j) > 0"),
    "automorphism_groups": (automorphism_groups, None),
    "synthetic_edges": (synthetic_edges, """, s AS (SELECT unnest(range(3, 21))::INT AS n) SELECT * FROM (
        SELECT 'path' AS family, n, unnest(range(0, n - 1))::INT AS u, unnest(range(1, n))::INT AS v FROM s UNION ALL SELECT 'star', n, 0, unnest(range(1, n))::INT FROM s
        UNION ALL SELECT 'cycle', n, unnest(range(0, n - 1))::INT, unnest(range(1, n))::INT FROM s UNION ALL SELECT 'cycle', n, 0, n - 1 FROM s
        UNION ALL SELECT 'binary_tree', n, ((q - 1) // 2)::INT, q::INT FROM (SELECT n, unnest(range(1, n)) AS q FROM s) UNION ALL SELECT 'complete', n, u::INT, v::INT FROM (SELECT n, unnest(range(0, n)) AS u FROM s WHERE n <= 10) JOIN (SELECT n, unnest(range(0, n)) AS v FROM s) USING (n) WHERE u < v
        UNION ALL SELECT 'grid', n, (q - 1)::INT, q::INT FROM (SELECT n, unnest(range(0, n)) AS q FROM s WHERE n >= 4) WHERE q % floor(sqrt(n))::INT <> 0 UNION ALL SELECT 'grid', n, (q - floor(sqrt(n)))::INT, q::INT FROM (SELECT n, unnest(range(0, n)) AS q FROM s WHERE n >= 4) WHERE q >= floor(sqrt(n)))"""),
    "synthetic_graphs": (synthetic_graphs, None),
    "edit_pairs": (edit_pairs, "SELECT id, k::INT AS k, k::INT AS n_changed FROM (SELECT id, unnest(range(1, least(4, n * (n - 1) // 2) + 1)) AS k FROM bgraphs)"),
    "string_pipeline": (string_pipeline, None),
    "mds_spectrum": (mds_spectrum, None),
    "mds_stress": (mds_stress, None),
    "procrustes_agreement": (procrustes_agreement, None),
    "centralities": (centralities, None),
    "lev1_neighbours": (lev1_neighbours, None),
    "graph_source": (graph_source, "SELECT id, n AS n_nodes, len(l)::INT AS n_edges FROM b_g"),
    "graph_edits": (graph_edits, "SELECT id, n + 1 AS n_nodes, m + 1 AS n_edges, len(list_filter(x, lambda c: c // 1048576 = 0))::INT AS n_before, (len(list_filter(x, lambda c: c // 1048576 = 0)) + 1)::INT AS n_after, 1 AS joined, n AS ring_size FROM bgraphs"),
    "encoder_invariance": (encoder_invariance, "SELECT encoder, count(*) AS n, count(*) AS n_same FROM bgraphs CROSS JOIN (VALUES ('canonical_graph6'), ('canonical_sparse6'), ('least_code'), ('dfs_code')) AS e(encoder) WHERE encoder <> 'dfs_code' OR m > 0 GROUP BY encoder"),
    "ged1_neighbours": (ged1_neighbours, None),
    "ged_summary": (ged_summary, "SELECT 'exact' AS method, count(*) - 1 AS n, count(*) - 1 AS n_certified, 0::BIGINT AS n_timed_out FROM bgraphs"),
    "dataset_analysis": (dataset_analysis, None),
    "edge_indexes": (edge_indexes, "SELECT id, (2 * len(x))::INT AS n_entries, len(x)::INT AS n_edges FROM bgraphs"),
}
