"""Base relations of the queries, as DataFrames and as DuckDB SQL.

strings (id, part, w, lang, source): the strings that cover every text of ``documents``; graphs (id, w, n, m, lang,
source), edges and arcs (id, u, v), chars (id, pos, c): what they decode to.  bench, bgraphs (m: proper edges, x, d, cls), bedges: the
same of ``benchmark``, with shorter strings.  thin (id, n, u, v): bgraphs less the edges whose ends add up to a
multiple of 4, so that some are not connected, and thin_graphs (id, n, edges) the same by graph; gtext: bgraphs as JSON.  pairs: all pairs of bgraphs with distances and bounds; both: each pair from
either side (q, o).  Tables of the input go by their own names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlet.operators import decode, pairs

Query = Callable[[SparkSession, str], DataFrame]
#: Letters of a string cut from documents and from benchmark texts.
DOC_PART, BENCH_PART = 24, 16
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows to all cores where there are fewer files than cores, as a file may be one row group and thus one task.  A table of
    many files stays as it is scanned, without an exchange."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows._jdf.inputFiles()) < cores else rows


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return decode.parts(spread(rows), "doc_id", "text", DOC_PART, "lang", "source")


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.parts(spread(table(spark, sf_dir, "benchmark").select("item_id", "text")), "item_id", "text", BENCH_PART)


def graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.graphs(strings(spark, sf_dir)).withColumn("m", F.size(decode.distinct_edges()))


def bgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With class cls: the benchmark item's number modulo 3."""
    cls = F.floor(F.col("id") / decode.PARTS) % 3
    return pairs.shaped(decode.graphs(bench(spark, sf_dir))).withColumn("cls", cls.cast("int"))


def bench_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs.measured(pairs.indexed(bgraphs(spark, sf_dir)))
    for s in "ij":
        found = found.withColumn(f"cls_{s}", (F.floor(F.col(f"id_{s}") / decode.PARTS) % 3).cast("int"))
    return found


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan of the pairs unfolds both sides."""
    sides = F.explode(F.array(F.struct(F.col("i").alias("q"), F.col("j").alias("o")), F.struct(F.col("j").alias("q"), F.col("i").alias("o"))))
    return bench_pairs(spark, sf_dir).select(sides.alias("_e"), "lev", "ham", "lb", "ub").select("_e.q", "_e.o", "lev", "ham", "lb", "ub")


def thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.expr("filter(edges, e -> (e.u + e.v) % 4 <> 0)")
    return bgraphs(spark, sf_dir).withColumn("edges", kept)


def chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = strings(spark, sf_dir).select("id", F.posexplode(F.split("w", "")).alias("pos", "c"))
    return each.where("c <> ''").withColumn("pos", F.col("pos") + 1)


RELATIONS: dict[str, Query] = {
    "strings": strings,
    "bench": bench,
    "graphs": lambda s, d: graphs(s, d).drop("edges", "part"),
    "edges": lambda s, d: decode.edge_rows(graphs(s, d)),
    "arcs": lambda s, d: decode.edge_rows(graphs(s, d), directed=True),
    "bgraphs": lambda s, d: bgraphs(s, d).drop("edges", "part"),
    "bedges": lambda s, d: decode.edge_rows(bgraphs(s, d)),
    "bindexed": lambda s, d: pairs.indexed(bgraphs(s, d)).select("id", "idx", "w", "n", "m", "cls"),
    "thin": lambda s, d: decode.edge_rows(thin(s, d)).where("u <> v"),
    "thin_graphs": lambda s, d: thin(s, d).select("id", "n", "edges"),
    "gtext": lambda s, d: bgraphs(s, d).select("id", decode.graph_json().alias("graph")),
    "chars": chars,
    "pairs": bench_pairs,
    "both": both,
    **{n: lambda s, d, n=n: table(s, d, n) for n in TABLES},
}


def _decoding(name: str, source: str, key: str, length: int, more: str) -> str:
    step = """SELECT id, w, i + 1,
   CASE c WHEN 'V' THEN list_concat(ring[1:p + 1], [n], ring[p + 2:]) WHEN 'v' THEN list_concat(ring[1:s + 1], [n], ring[s + 2:]) ELSE ring END,
   CASE c WHEN 'N' THEN (p + 1) % len(ring) WHEN 'P' THEN (p + len(ring) - 1) % len(ring) WHEN 'v' THEN p + (p > s)::INT ELSE p END,
   CASE c WHEN 'n' THEN (s + 1) % len(ring) WHEN 'p' THEN (s + len(ring) - 1) % len(ring) WHEN 'V' THEN s + (s > p)::INT ELSE s END,
   n + (c IN ('V', 'v'))::INT,
   CASE c WHEN 'V' THEN list_append(e, {'u': ring[p + 1], 'v': n}) WHEN 'v' THEN list_append(e, {'u': ring[s + 1], 'v': n})
     WHEN 'C' THEN list_append(e, {'u': ring[p + 1], 'v': ring[s + 1]}) WHEN 'c' THEN list_append(e, {'u': ring[s + 1], 'v': ring[p + 1]}) ELSE e END"""
    return f"""{name}_w AS (SELECT {key} AS k, {more} translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{decode.FROM}', '{decode.TO}') AS w FROM {source}),
 {name}_s AS (SELECT k * {decode.PARTS} + part AS id, part, substr(w, part * {length} + 1, {length}) AS w, {more} k
   FROM (SELECT *, unnest(range(0, greatest((length(w) + {length} - 1) // {length}, 1))) AS part FROM {name}_w)),
 {name}_t AS (SELECT id, w, 0 AS i, [0] AS ring, 0::BIGINT AS p, 0::BIGINT AS s, 1 AS n, []::STRUCT(u INT, v INT)[] AS e FROM {name}_s
  UNION ALL {step} FROM (SELECT *, substr(w, i + 1, 1) AS c FROM {name}_t WHERE i < length(w))),
 {name}_g AS (SELECT id, w, n, e, list_distinct(list_transform(e, lambda x: least(x.u, x.v)::BIGINT * {pairs.CODE} + greatest(x.u, x.v))) AS l FROM {name}_t WHERE i = length(w)),
 {name}_a AS (SELECT DISTINCT id, x.u AS u, x.v AS v FROM (SELECT id, unnest(e) AS x FROM {name}_g)),
 {name}_e AS (SELECT id, (x // {pairs.CODE})::INT AS u, (x % {pairs.CODE})::INT AS v FROM (SELECT id, unnest(l) AS x FROM {name}_g))"""


PRELUDE = f"""WITH RECURSIVE {_decoding("d", "documents", "doc_id", DOC_PART, "lang, source, ")}, {_decoding("b", "benchmark", "item_id", BENCH_PART, "")},
 strings AS (SELECT id, part, w, lang, source FROM d_s), bench AS (SELECT id, part, w FROM b_s),
 graphs AS (SELECT id, d_g.w AS w, n, len(l)::INT AS m, lang, source FROM d_g JOIN (SELECT id, lang, source FROM d_s) USING (id)),
 arcs AS (SELECT * FROM d_a), edges AS (SELECT * FROM d_e), bedges AS (SELECT * FROM b_e),
 chars AS (SELECT id, p AS pos, substr(w, p, 1) AS c FROM (SELECT id, w, unnest(range(1, length(w) + 1)) AS p FROM d_s)),
 b_x AS (SELECT id, w, n, (id // {decode.PARTS} % 3)::INT AS cls, list_sort(list_filter(l, lambda c: c // {pairs.CODE} <> c % {pairs.CODE})) AS x FROM b_g),
 b_d AS (SELECT *, list_transform(range(0, n), lambda k: len(list_filter(x, lambda c: c // {pairs.CODE} = k OR c % {pairs.CODE} = k))) AS degrees FROM b_x),
 b_o AS (SELECT *, list_sort(list_transform(range(0, n), lambda k: -degrees[k + 1] * {pairs.CODE} + k)) AS o FROM b_d),
 b_r AS (SELECT *, list_transform(range(0, n), lambda k: list_position(o, -degrees[k + 1] * {pairs.CODE} + k) - 1) AS r FROM b_o),
 bgraphs AS (SELECT id, w, n, cls, len(x)::INT AS m, x, list_reverse_sort(degrees) AS d, list_sort(list_transform(x, lambda c:
   least(r[c // {pairs.CODE} + 1], r[c % {pairs.CODE} + 1])::BIGINT * {pairs.CODE} + greatest(r[c // {pairs.CODE} + 1], r[c % {pairs.CODE} + 1]))) AS y FROM b_r),
 thin AS (SELECT id, u, v FROM b_e WHERE (u + v) % 4 <> 0 AND u <> v), thin_graphs AS (SELECT id, n FROM bgraphs), gtext AS (SELECT id, n, l FROM b_g),
 reach(id, v) AS (SELECT id, 0 FROM bgraphs UNION SELECT r.id, t.v FROM reach r JOIN (SELECT id, u, v FROM thin UNION ALL SELECT id, v, u FROM thin) t ON r.id = t.id AND r.v = t.u),
 b_i AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS idx, count(*) OVER () AS total FROM bgraphs),
 bindexed AS (SELECT id, idx, w, n, m, cls FROM b_i),
 pairs AS (SELECT a.idx * a.total - a.idx * (a.idx + 1) // 2 + b.idx - a.idx - 1 AS k, a.idx AS i, b.idx AS j, a.id AS id_i, b.id AS id_j, a.n AS n_i, b.n AS n_j,
           a.m AS m_i, b.m AS m_j, a.cls AS cls_i, b.cls AS cls_j, levenshtein(a.w, b.w) AS lev, a.m + b.m - 2 * len(list_intersect(a.x, b.x)) AS ham,
           abs(a.n - b.n) + list_sum(list_transform(range(1, greatest(a.n, b.n) + 1), lambda q: abs(coalesce(a.d[q], 0) - coalesce(b.d[q], 0)))) / 2 AS lb,
           (abs(a.n - b.n) + a.m + b.m - 2 * greatest(len(list_intersect(a.x, b.x)), len(list_intersect(a.y, b.y))))::DOUBLE AS ub
           FROM b_i a JOIN b_i b ON a.idx < b.idx),
 "both" AS (SELECT i AS q, j AS o, lev, ham, lb, ub FROM pairs UNION ALL SELECT j, i, lev, ham, lb, ub FROM pairs)
"""

#: Words of the shared SQL that the engines write differently.
SPARK = {"text": "STRING", "series": "explode(sequence(1, l + 1))"}
DUCK = {"text": "VARCHAR", "series": "unnest(range(1, l + 2))"}


def fill(sql: str, words: dict[str, str]) -> str:
    for k, v in words.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


def pearson(x: str, y: str) -> str:
    """Pearson's r as SQL; null where one of them does not vary, which the engines' own corr refuses or answers unlike."""
    return f"(covar_samp(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)) / nullif(stddev_samp(CAST({x} AS DOUBLE)) * stddev_samp(CAST({y} AS DOUBLE)), CAST(0 AS DOUBLE)))"


def spark_query(sql: str, words: dict[str, str]) -> Query:
    """The shared text as a query over the relations it names."""
    whole = fill(sql, words)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {n: f(spark, sf_dir) for n, f in RELATIONS.items() if "{" + n + "}" in whole}
        return spark.sql(whole, **used)

    return run


def duck_sql(sql: str, words: dict[str, str]) -> str:
    """The shared text as DuckDB SQL."""
    return f"{PRELUDE} SELECT * FROM ({fill(fill(sql, words), {n: chr(34) + n + chr(34) for n in RELATIONS})}) AS q"
