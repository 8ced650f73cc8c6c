"""Registry of the graph-string queries and their oracle SQL.

Most queries are text that both engines read, over the relations of ``relations``; those that need operators of the package
are functions, with SQL of their own where SQL can express them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlet.operators import decode, pairs
from ringlet.plans import codec, distances, relations, reports, sampling, searches, statistics
from ringlet.plans.relations import PRELUDE, Query, bench, bgraphs, duck_sql, spark_query

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (codec, distances, statistics, sampling, reports):
    for _name, _sql in _part.SHARED.items():
        QUERIES[_name] = spark_query(_sql, {**_part.SPARK, **relations.SPARK})
        ORACLE_SQL[_name] = duck_sql(_sql, {**_part.DUCK, **relations.DUCK})


def register(name: str, query: Query, sql: str | None = None) -> None:
    """A query made by a function; ``sql`` follows the relations' prelude."""
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = f"{PRELUDE} {sql}"


def s2g_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode.trace(bench(spark, sf_dir))
    return rows.withColumns({"n_edges": F.col("n_edges").cast("long"), "ring": F.array_join("ring", ","), "step": F.col("step").cast("int")})


register("s2g_trace", s2g_trace, """SELECT id, i AS step, CASE WHEN i = 0 THEN '' ELSE substr(w, i, 1) END AS instruction, array_to_string(list_concat(ring[p + 1:], ring[:p]), ',') AS ring,
 ring[p + 1] AS primary_node, ring[s + 1] AS secondary_node, CASE WHEN made THEN e[len(e)].u END AS created_u, CASE WHEN made THEN e[len(e)].v END AS created_v, n AS n_nodes, m AS n_edges, substr(w, 1, i) AS partial
 FROM (SELECT *, i > 0 AND m > lag(m) OVER (PARTITION BY id ORDER BY i) AS made FROM (SELECT *, len(list_distinct(list_transform(e, lambda x: least(x.u, x.v) * 1000 + greatest(x.u, x.v))))::BIGINT AS m FROM b_t))""")  # fmt: skip


def fnv1a_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench(spark, sf_dir).select("id", decode.fnv1a(F.col("w")).alias("fnv1a_64"))


register("fnv1a_hashes", fnv1a_hashes, """, fnv AS (SELECT id, w, 0 AS i, 14695981039346656037::HUGEINT AS h FROM bench
 UNION ALL SELECT id, w, i + 1, xor(h, ascii(substr(w, i + 1, 1))::HUGEINT) * 1099511628211 % 18446744073709551616::HUGEINT FROM fnv WHERE i < length(w))
 SELECT id, lower(lpad(to_hex(h::UBIGINT), 16, '0')) AS fnv1a_64 FROM fnv WHERE i = length(w)""")  # fmt: skip


def structural_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes at distance 1, 2 and 3 of each node, from the arrays of its graph."""
    near = f"transform(filter(x, c -> c div {pairs.CODE} = {{a}} OR c % {pairs.CODE} = {{a}}), c -> if(c div {pairs.CODE} = {{a}}, c % {pairs.CODE}, c div {pairs.CODE}))"
    nodes = bgraphs(spark, sf_dir).select("id", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("node"))
    grown = lambda last: F.expr(f"array_distinct(flatten(transform({last}, a -> {near.replace('{a}', 'a')})))")
    rows = nodes.withColumn("_1", F.expr(near.replace("{a}", "node")))
    rows = rows.withColumn("_2", F.array_except(F.array_except(grown("_1"), F.col("_1")), F.array("node")))
    rows = rows.withColumn("_3", F.array_except(F.array_except(grown("_2"), F.col("_2")), F.array_union(F.col("_1"), F.array("node"))))
    return rows.select("id", F.col("node").cast("int").alias("node"), *[F.size(f"_{k}").cast("long").alias(f"n{k}") for k in (1, 2, 3)])


register("structural_triplets", structural_triplets, """, und AS (SELECT id, u, v FROM bedges WHERE u <> v UNION ALL SELECT id, v, u FROM bedges WHERE u <> v),
 d2 AS (SELECT DISTINCT a.id, a.u, b.v FROM und a JOIN und b ON a.id = b.id AND a.v = b.u WHERE a.u <> b.v EXCEPT SELECT id, u, v FROM und),
 d3 AS (SELECT DISTINCT a.id, a.u, b.v FROM d2 a JOIN und b ON a.id = b.id AND a.v = b.u WHERE a.u <> b.v EXCEPT SELECT id, u, v FROM und EXCEPT SELECT id, u, v FROM d2)
 SELECT g.id, g.u::INT AS node, count(CASE WHEN d = 1 THEN 1 END) AS n1, count(CASE WHEN d = 2 THEN 1 END) AS n2, count(CASE WHEN d = 3 THEN 1 END) AS n3
 FROM (SELECT id, unnest(range(0, n)) AS u FROM bgraphs) g LEFT JOIN (SELECT *, 1 AS d FROM und UNION ALL SELECT *, 2 FROM d2 UNION ALL SELECT *, 3 FROM d3) x ON g.id = x.id AND g.u = x.u GROUP BY g.id, g.u""")  # fmt: skip


def pair_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k unfolded to (i, j), and folded again."""
    n = bench(spark, sf_dir).count()
    return pairs.pair_range(spark, n).withColumn("back", pairs.pair_index(F.col("i"), F.col("j"), F.lit(n).cast("long")))


def pair_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = bench(spark, sf_dir).count()
    return pairs.found_in_rows(spark.range(n * (n - 1) // 2).withColumnRenamed("id", "k"), n).select("k", "i", "j")


_ALL_K = ", z AS (SELECT idx, count(*) OVER () AS total FROM bindexed) SELECT {} FROM (SELECT a.idx * a.total - a.idx * (a.idx + 1) // 2 + b.idx - a.idx - 1 AS k, a.idx AS i, b.idx AS j FROM z a JOIN z b ON a.idx < b.idx)"
register("pair_index_roundtrip", pair_index_roundtrip, _ALL_K.format("k, i, j, k AS back"))
register("pair_index_search", pair_index_search, _ALL_K.format("k, i, j"))

register(
    "displacement_pairs",
    lambda s, d: s.sql(
        "SELECT a, b, row_number() OVER (ORDER BY abs(a) + abs(b), abs(a), a, b) AS place FROM (SELECT explode(sequence(-4, 4)) AS a) x CROSS JOIN (SELECT explode(sequence(-4, 4)) AS b) y"
    ),
)
ORACLE_SQL["displacement_pairs"] = (
    "SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, row_number() OVER (ORDER BY abs(a) + abs(b), abs(a), a, b)::INT AS place FROM range(-4, 5) x(a) CROSS JOIN range(-4, 5) y(b)"
)

for _name, (_query, _text) in searches.SEARCHES.items():
    register(_name, _query, _text)
