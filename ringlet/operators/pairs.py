"""Pairs of a collection by their linear index, and distances and bounds on them.

The index of i < j among N is k = i N - i (i + 1) / 2 + (j - i - 1).  Each row unfolds the places after its own and
meets them in one hash join, so that no pair is made twice and work can be resumed by k.

What a distance needs of a graph is an array in its row (edges as numbers, degrees in falling order), so that no
join on edges is made: every graph has the edge (0, 1), and such a join would send all pairs through one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: An edge u < v as one number: u times this, plus v.
CODE = 1 << 20


def indexed(rows: DataFrame, width: int = 64 * CODE) -> DataFrame:
    """Adds idx, 0 .. N-1 in order of id.  Places are counted within stretches of ``width`` ids; only the stretches'
    counts pass a window without a partition."""
    rows = rows.withColumn("_stretch", F.floor(F.col("id") / width))
    counts = rows.groupBy("_stretch").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_stretch").orderBy("id")) - 1
    return rows.withColumn("_place", place).join(starts, "_stretch").withColumn("idx", F.col("_start") + F.col("_place")).drop("_stretch", "_start", "_place")


def pair_index(i: Column, j: Column, n: Column) -> Column:
    """k of i < j among n."""
    return i * n - F.floor(i * (i + 1) / 2).cast("long") + j - i - 1


def unfolded(k: Column, n: Column) -> tuple[Column, Column]:
    """i and j of k among n: the square root's guess of i, corrected both ways by whole numbers."""
    guess = F.floor((2 * n - 1 - F.sqrt((2 * n - 1).cast("double") ** 2 - 8 * k)) / 2).cast("long")
    start = lambda i: i * n - F.floor(i * (i + 1) / 2).cast("long")
    i = F.when(start(guess) > k, guess - 1).when(start(guess + 1) <= k, guess + 1).otherwise(guess)
    return i, k - start(i) + i + 1


def pair_range(spark: SparkSession, n: int) -> DataFrame:
    """k, i, j of all pairs of n items, from the range of k."""
    total = F.lit(n).cast("long")
    p = spark.range(n * (n - 1) // 2).withColumnRenamed("id", "k")
    i, j = unfolded(F.col("k"), total)
    return p.select("k", i.alias("i"), j.alias("j"))


def found_in_rows(k: DataFrame, n: int) -> DataFrame:
    """The same by a search in the table of row starts: k (k, ...) meets the row whose stretch holds it.  A range join
    that both sides enter by stretches of n."""
    spark = k.sparkSession
    i = F.col("id")
    start = i * n - F.floor(i * (i + 1) / 2).cast("long")
    rows = spark.range(max(n - 1, 0)).select(i.alias("i"), start.alias("_from"), (start + n - i - 2).alias("_to"))
    rows = rows.withColumn("_s", F.explode(F.sequence(F.floor(F.col("_from") / n), F.floor(F.col("_to") / n))))
    met = k.withColumn("_s", F.floor(F.col("k") / n)).join(rows, "_s").where(F.col("k").between(F.col("_from"), F.col("_to")))
    return met.withColumn("j", F.col("k") - F.col("_from") + F.col("i") + 1).drop("_s", "_from", "_to")


def chunk(total: int, n_chunks: int, index: int) -> tuple[int, int]:
    """First and end of one of ``n_chunks`` even stretches of 0 .. total-1; the first ones take the rest."""
    if not 0 <= index < n_chunks:
        raise ValueError(f"chunk {index} of {n_chunks}")
    size, rest = divmod(total, n_chunks)
    first = index * size + min(index, rest)
    return first, first + size + (index < rest)


def shaped(graphs: DataFrame) -> DataFrame:
    """Adds what distances need of graphs (n, edges): m proper edges, x their numbers in order, degrees by node, d
    degrees in falling order, y the edges' numbers with nodes renamed by (falling degree, node)."""
    g = graphs.withColumn("x", F.expr(f"""array_sort(array_distinct(transform(filter(edges, e -> e.u <> e.v),
        e -> cast(least(e.u, e.v) AS bigint) * {CODE} + greatest(e.u, e.v))))"""))
    g = g.withColumn("degrees", F.expr(f"transform(sequence(0, n - 1), k -> size(filter(x, c -> c div {CODE} = k OR c % {CODE} = k)))"))
    g = g.withColumn("m", F.size("x")).withColumn("d", F.sort_array("degrees", asc=False))
    g = g.withColumn("_order", F.expr(f"array_sort(transform(sequence(0, n - 1), k -> cast(-degrees[k] AS bigint) * {CODE} + k))"))
    g = g.withColumn("_rank", F.expr(f"transform(sequence(0, n - 1), k -> array_position(_order, cast(-degrees[k] AS bigint) * {CODE} + k) - 1)"))
    ends = f"_rank[cast(c div {CODE} AS int)], _rank[cast(c % {CODE} AS int)]"
    return g.withColumn("y", F.expr(f"array_sort(transform(x, c -> least({ends}) * {CODE} + greatest({ends})))")).drop("_order", "_rank")


def branch_bound(n_i: Column, n_j: Column, d_i: Column, d_j: Column) -> Column:
    """The BRANCH lower bound of the edit distance under unit costs: nodes' difference, and half the difference of the
    degrees in falling order (the closed form of its assignment)."""
    at = lambda d, k: F.coalesce(F.get(d, k), F.lit(0))
    gaps = F.aggregate(F.sequence(F.lit(0), F.greatest(n_i, n_j) - 1), F.lit(0), lambda s, k: s + F.abs(at(d_i, k) - at(d_j, k)))
    return F.abs(n_i - n_j) + gaps / 2


def apart(a: Column, b: Column) -> Column:
    """Elements in one of two arrays without repeats but not in both."""
    return F.size(a) + F.size(b) - 2 * F.size(F.array_intersect(a, b))


def all_pairs(rows: DataFrame) -> DataFrame:
    """k, i, j of all pairs of ``rows`` (idx), each column twice, with _i and _j."""
    total = rows.agg(F.count("*")).scalar()
    side = lambda s: rows.select(*[F.col(c).alias("i" if c == "idx" and s == "i" else "j" if c == "idx" else f"{c}_{s}") for c in rows.columns])
    left = side("i").withColumn("_total", total).where("i < _total - 1")
    left = left.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("_total") - 1)))
    return left.join(side("j"), "j").withColumn("k", pair_index(F.col("i"), F.col("j"), F.col("_total"))).drop("_total")


def measured(rows: DataFrame) -> DataFrame:
    """Pairs of ``rows`` (id, idx, w, n, m, x, d, y) with lev, ham, and bounds of the edit distance: lb (BRANCH) and ub, the
    smaller of the costs that two node maps induce (equal names; equal places by degree)."""
    p = all_pairs(rows.select("id", "idx", "w", "n", "m", "x", "d", "y"))
    gap = F.abs(F.col("n_i") - F.col("n_j"))
    return p.select(
        "k", "i", "j", "id_i", "id_j", "n_i", "n_j", "m_i", "m_j", F.levenshtein("w_i", "w_j").alias("lev"), apart(F.col("x_i"), F.col("x_j")).alias("ham"),
        branch_bound(F.col("n_i"), F.col("n_j"), F.col("d_i"), F.col("d_j")).alias("lb"),
        (gap + F.least(apart(F.col("x_i"), F.col("x_j")), apart(F.col("y_i"), F.col("y_j")))).cast("double").alias("ub"),
    )
