"""Nearest neighbours by a hierarchical navigable small-world graph for each shard.

Vectors are dealt to shards by the hash of their id: about two for each core, of ``LEAST_ROWS`` to ``MOST_ROWS``.  A shard's graph is
built in one task and stored as one row of flat arrays: vectors, ids, and for each level a matrix of
neighbour positions.  Each shard's row goes to one task, and the queries come to it in blocks, so that
vectors move once; the task holds one shard and one block at a time.  A shard answers with its nearest by exact double
distances on the original vectors, and the answers are merged per query.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part, neither as query nor as candidate; only vectors of the query's dimension are candidates; equal vectors
share a node, so copies do not crowd the graph; rows that repeat an id are one candidate each, and a query
never meets its own id; rows that repeat an id and vector ask once, and an id on several vectors asks once for
each of them, with ranks of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringlet.llm.common import Scratch, table, tidy

LEAST_ROWS, MOST_ROWS, QUERY_BLOCK, M, EF_BUILD, EF_SEARCH, K = 4096, 65_536, 1024, 16, 80, 96, 10


class Graph:
    """Flat neighbour arrays: ``links[level]`` is (nodes, 2 M or M) of positions, -1 for none."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray] | None = None, entry: int = 0):
        self.x, self.norm = x, (x.astype(np.float64) ** 2).sum(axis=1).astype(np.float32)
        self.links, self.entry = links or [], entry
        self.seen = np.zeros(len(x), np.int32)
        self.turn = 0

    def near(self, q: np.ndarray, at: np.ndarray | list[int]) -> np.ndarray:
        """Squared distances less the query's norm."""
        return self.norm[at] - 2 * (self.x[at] @ q)

    def search(self, q: np.ndarray, starts: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ``ef`` nearest found on a level, nearest first."""
        self.turn += 1
        seen, links = self.seen, self.links[level]
        todo, best = [], []
        for d, i in starts:
            seen[i] = self.turn
            heappush(todo, (d, i))
            heappush(best, (-d, i))
        while todo:
            d, i = heappop(todo)
            if d > -best[0][0] and len(best) >= ef:
                break
            next_ = links[i]
            next_ = next_[next_ >= 0]
            next_ = next_[seen[next_] != self.turn]
            if not len(next_):
                continue
            seen[next_] = self.turn
            far = self.near(q, next_)
            if len(best) >= ef:
                keep = far < -best[0][0]
                far, next_ = far[keep], next_[keep]
            for e, j in zip(far.tolist(), next_.tolist(), strict=True):
                if len(best) < ef:
                    heappush(best, (-e, j))
                elif e < -best[0][0]:
                    heapreplace(best, (-e, j))
                else:
                    continue
                heappush(todo, (e, j))
        return sorted((-d, i) for d, i in best)

    def descend(self, q: np.ndarray, down_to: int) -> list[tuple[float, int]]:
        at = [(float(self.near(q, [self.entry])[0]), self.entry)]
        for level in range(len(self.links) - 1, down_to, -1):
            at = self.search(q, at, 1, level)
        return at

    def spread(self, found: list[tuple[float, int]], q_norm: float, most: int) -> list[int]:
        """Neighbours that are nearer to the node than to one another; the nearest fill up."""
        if len(found) <= most:
            return [i for _, i in found]
        at = np.array([i for _, i in found])
        d = np.array([d for d, _ in found]) + q_norm
        between = self.norm[at][:, None] + self.norm[at][None] - 2 * (self.x[at] @ self.x[at].T)
        kept: list[int] = []
        closest = np.full(len(at), np.inf)
        for k in range(len(at)):
            if closest[k] > d[k]:
                kept.append(k)
                if len(kept) == most:
                    break
                closest = np.minimum(closest, between[k])
        rest = [k for k in range(len(at)) if k not in set(kept)]
        return at[kept + rest[: most - len(kept)]].tolist()

    def connect(self, i: int, found: list[tuple[float, int]], level: int) -> None:
        links = self.links[level]
        width = links.shape[1]
        chosen = self.spread(found, float(self.norm[i]), M)
        links[i, : len(chosen)] = chosen
        for j in chosen:
            row = links[j]
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = i
            else:
                around = np.append(row, i)
                order = self.near(self.x[j], around)
                by = np.argsort(order, kind="stable")
                kept = self.spread(list(zip(order[by].tolist(), around[by].tolist(), strict=True)), float(self.norm[j]), width)
                row[:] = -1
                row[: len(kept)] = kept


def build(x: np.ndarray, ids: np.ndarray) -> Graph:
    """Insert all rows; a node's level is drawn from the hash of its id."""
    draw = np.array([xxhash.xxh3_64_intdigest(int(i).to_bytes(8, "little", signed=True)) for i in ids], np.float64)
    levels = np.floor(-np.log((draw + 1) / 2.0**64) / np.log(M)).astype(int).clip(0, 12)
    g = Graph(x, [np.full((len(x), 2 * M if k == 0 else M), -1, np.int32) for k in range(levels.max(initial=0) + 1)])
    every, g.links = g.links, []
    for i, level in enumerate(levels.tolist()):
        if i == 0:
            g.entry, g.links = 0, every[: level + 1]
            continue
        q = g.x[i]
        at = g.descend(q, level) if level < len(g.links) - 1 else [(float(g.near(q, [g.entry])[0]), g.entry)]
        for k in range(min(level, len(g.links) - 1), -1, -1):
            at = g.search(q, at, EF_BUILD, k)
            g.connect(i, at, k)
        if level >= len(g.links):
            g.links, g.entry = every[: level + 1], i
    return g


def _index(table: pa.Table) -> pa.Table:
    """One shard: distinct vectors as nodes, ids grouped by node."""
    ids = np.array(table.column("vec_id"), np.int64)
    dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
    x = np.array(table.column("embedding").combine_chunks().flatten(), np.float64).reshape(-1, dim)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    nodes, first, of = np.unique(x, axis=0, return_index=True, return_inverse=True)
    by = np.argsort(first)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    nodes, of = nodes[by], rank[of.ravel()]
    g = build(nodes.astype(np.float32), ids[first[by]])
    by_node = np.argsort(of, kind="stable")
    row = {
        "dim": [dim], "shard": [shard], "vectors": [nodes.tobytes()], "ids": [ids[by_node].tobytes()],
        "starts": [np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(nodes))))).astype(np.int64).tobytes()],
        "entry": [g.entry], "links": [[level.tobytes() for level in g.links]],
    }
    return pa.table(row, schema=INDEX_SCHEMA)


INDEX_SCHEMA = pa.schema([
    ("dim", pa.int32()), ("shard", pa.int32()), ("vectors", pa.binary()), ("ids", pa.binary()), ("starts", pa.binary()),
    ("entry", pa.int32()), ("links", pa.list_(pa.binary())),
])
INDEX = "dim int, shard int, vectors binary, ids binary, starts binary, entry int, links array<binary>"


def usable(rows: DataFrame) -> DataFrame:
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    vector = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"))
    ok = F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda v: v != 0)
    return rows.where(ok & F.col("vec_id").isNotNull()).withColumn("dim", F.size("embedding"))


def _tasks(shards: int) -> int:
    """A fixed number, as adaptive coalescing goes by bytes and shards are few bytes but much work; more than there are shards, as
    few shards hashed to as many tasks often meet."""
    return max(shards, min(8 * shards, 4096))


def build_index(rows: DataFrame, scratch: Scratch, shard_rows: int | None = None) -> DataFrame:
    """The stored index of ``usable`` rows: one row of flat arrays for each dimension and shard."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    shards = max(1, round(n / (shard_rows or max(LEAST_ROWS, min(MOST_ROWS, n // (2 * cores))))))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(_tasks(shards), "dim", "shard")
    return scratch.write(dealt.groupBy("dim", "shard").applyInArrow(_index, INDEX), "index")


def _answer(batches: Iterator[pa.RecordBatch], k: int, ef: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of shard: the shard's arrays (block -1), then blocks of queries."""
    g = exact = ids = starts = None
    for batch in batches:
        for at in range(batch.num_rows):
            r = batch.slice(at, 1).to_pylist()[0]
            if r["block"] < 0:
                exact = np.frombuffer(r["vectors"], np.float64).reshape(-1, r["dim"])
                links = [np.frombuffer(b, np.int32).reshape(len(exact), -1) for b in r["links"]]
                g = Graph(exact.astype(np.float32), links, r["entry"])
                ids, starts = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["starts"], np.int64)
                continue
            out: tuple[list, list, list, list] = ([], [], [], [])
            for query, ask, vector in zip(r["queries"], r["asks"], r["query_vectors"], strict=True):
                q = np.array(vector)
                q32 = q.astype(np.float32)
                found = np.array([i for _, i in g.search(q32, g.descend(q32, 0), ef, 0)])
                score = np.sqrt(((exact[found] - q) ** 2).sum(axis=1))
                # A node stands for its copies; those with the query's own id go before the first k are taken.
                each = []
                for s, i in zip(score.tolist(), found.tolist(), strict=True):
                    copies = ids[starts[i] : starts[i + 1]]
                    each += [(s, j) for j in copies[copies != query][:k].tolist()]
                for s, j in sorted(each)[:k]:
                    for column, value in zip(out, (query, ask, j, s), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], ["query_id", "ask", "vec_id", "score"])


def nearest(index: DataFrame, queries: DataFrame, k: int = K, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each of ``queries`` (vec_id, embedding, dim)."""
    queries = queries.dropDuplicates(["vec_id", "embedding"])
    queries = queries.withColumn("ask", F.row_number().over(Window.partitionBy("vec_id").orderBy("embedding")))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int").alias("block")
    asked = queries.select("dim", block, "vec_id", "ask", "embedding").groupBy("dim", "block").agg(
        F.collect_list("vec_id").alias("queries"), F.collect_list("ask").alias("asks"), F.collect_list("embedding").alias("query_vectors")
    )
    shards = index.select("dim", "shard")
    asked = shards.join(asked, "dim")
    rows = index.withColumn("block", F.lit(-1)).unionByName(asked, allowMissingColumns=True)
    rows = rows.repartition(_tasks(max(shards.count(), 1)), "dim", "shard").sortWithinPartitions("dim", "shard", "block")
    answers = rows.select("dim", "block", "vectors", "ids", "starts", "entry", "links", "queries", "asks", "query_vectors")
    answers = answers.mapInArrow(tidy(lambda it: _answer(it, k, ef)), "query_id long, ask int, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id", "ask").orderBy("score", "vec_id"))
    return answers.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, scratch = usable(table(spark, sf_dir, "embeddings")), Scratch(spark, "hnsw")
    return nearest(build_index(rows, scratch), rows.where("vec_id % 100 = 0"))
