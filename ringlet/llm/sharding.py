"""Sharding over fixed virtual slots.

Each record is hashed into one of ``n_slots`` virtual slots.  Bytes are summed per slot (map-side combined, at most
``n_slots`` rows reach the driver).  The slot-to-shard map is stored by version in a folder of its table's name: its first
version deals slots evenly, whatever they hold; each run reads the latest version and rebalances it on the sums,
slot by slot, and stores what it changed as the next version.  Records never move except with their slot.

Defined results: null text has size 1 (zero bytes plus one); a null ``doc_id`` is hashed by
its text instead, so that rows without an id spread out; repeated rows fall into one
slot; very long texts count with all their bytes; columns besides doc_id and text play no part; an empty table gives an
empty result and an even map.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringlet.llm.common import Scratch, shared_dir

N_SLOTS = 4096
N_SHARDS = 8
#: Parts of the scan by which the places of a slot are counted.
PARTS = 1024
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long"


@dataclass(frozen=True)
class SlotMap:
    """One version of the slot-to-shard map; ``shards[v]`` is the shard of slot v."""

    version: int
    n_shards: int
    shards: tuple[int, ...]
    weights: tuple[int, ...]

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for shard, weight in zip(self.shards, self.weights, strict=True):
            out[shard] += weight
        return out

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, v, s, w) for v, (s, w) in enumerate(zip(self.shards, self.weights, strict=True))]
        return spark.createDataFrame(rows, MAP_SCHEMA)


def fit_map(weights: list[int], n_shards: int = N_SHARDS) -> SlotMap:
    """Version 1: heaviest slot first, each to the least loaded shard."""
    heap = [(0, 0, s) for s in range(n_shards)]
    shards = [0] * len(weights)
    for v in sorted(range(len(weights)), key=lambda v: (-weights[v], v)):
        load, slots, s = heapq.heappop(heap)
        shards[v] = s
        heapq.heappush(heap, (load + weights[v], slots + 1, s))
    return SlotMap(1, n_shards, tuple(shards), tuple(weights))


def even_map(n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> SlotMap:
    """Version 1 of a map that knows nothing of the data: stretches of slots."""
    return SlotMap(1, n_shards, tuple(v * n_shards // n_slots for v in range(n_slots)), (0,) * n_slots)


def rebalance(old: SlotMap, weights: list[int], n_shards: int | None = None, tolerance: float = 0.001) -> SlotMap:
    """The next version, or the old one with these weights if no slot moves.

    Again and again the fullest shard hands the emptiest the slot that comes nearest to evening them out, until they are within
    ``tolerance`` of the mean or no slot helps.  When shards are added, slots move only into the new ones."""
    n_shards = n_shards or old.n_shards
    if n_shards < old.n_shards:
        raise ValueError("shards can only be added")
    shards, load = list(old.shards), [0] * n_shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    for v, s in enumerate(shards):
        load[s] += weights[v]
        held[s].append((weights[v], v))
    for s in held:
        s.sort()
    grown = n_shards > old.n_shards
    givers, takers = range(old.n_shards if grown else n_shards), range(old.n_shards if grown else 0, n_shards)
    mean, moved = sum(weights) / n_shards, n_shards > old.n_shards
    while True:
        g, t = max(givers, key=lambda s: (load[s], -s)), min(takers, key=lambda s: (load[s], s))
        gap = load[g] - load[t]
        if gap <= tolerance * mean:
            break
        at = bisect.bisect_left(held[g], (gap // 2, -1))
        best = min((held[g][k] for k in (at - 1, at) if 0 <= k < len(held[g]) and 0 < held[g][k][0] < gap), key=lambda x: (abs(2 * x[0] - gap), x), default=None)
        if best is None:
            break
        held[g].remove(best)
        bisect.insort(held[t], best)
        shards[best[1]], moved = t, True
        load[g] -= best[0]
        load[t] += best[0]
    return SlotMap(old.version + moved, n_shards, tuple(shards), tuple(weights))


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored_versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a map that were written whole."""
    p, fs = _folder(spark, path)
    if not fs.exists(p):
        return []
    done = lambda at: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS"))
    return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(p) if f.getPath().getName().startswith("version=") and done(f.getPath()))


def store_map(spark: SparkSession, path: str, made: SlotMap) -> None:
    made.to_df(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={made.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
    """A version of a stored map, the latest if none is named; None if there is none."""
    known = stored_versions(spark, path)
    if not known:
        return None
    rows = spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version or known[-1]}").orderBy("virtual_slot").collect()
    return SlotMap(version or known[-1], max(r.shard for r in rows) + 1, tuple(r.shard for r in rows), tuple(r.bytes for r in rows))


def map_path(spark: SparkSession, name: str) -> str:
    """Where the map of a table is kept."""
    return f"{shared_dir(spark)}/ringlet-slot-maps/{hashlib.md5(name.encode()).hexdigest()}"


def virtual_slot(doc_id: Column, text: Column, n_slots: int = N_SLOTS) -> Column:
    key = F.when(doc_id.isNull(), F.xxhash64(F.lit("null"), text)).otherwise(F.xxhash64(doc_id))
    return F.pmod(key, F.lit(n_slots)).cast("int")


def slotted(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot; texts stay behind in the scan."""
    doc_id, text = F.col("doc_id"), F.col("text")
    return docs.select(
        doc_id,
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        virtual_slot(doc_id, text, n_slots).alias("virtual_slot"),
    )


def slot_sums(rows: DataFrame, n_slots: int = N_SLOTS) -> list[int]:
    """Bytes of each slot; at most ``n_slots`` rows come to the driver."""
    weights = [0] * n_slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect():
        weights[r.virtual_slot] = r.b
    return weights


def shard_documents(
    spark: SparkSession, docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, slot_map: SlotMap | None = None, name: str | None = None
) -> tuple[DataFrame, SlotMap]:
    """Each row's shard, and its place there, gapless from 0.

    ``slot_map``, or else the latest stored map of ``name``, or else an even one is rebalanced; with a name, each new version is
    stored.  The map and the first place of each slot have ``n_slots`` rows whatever the input, and are broadcast; the parts' are not.  Rows are written
    once with the part of the scan that they came from; places are counted within (slot, part), and the parts before, so that a
    slot that one repeated doc_id fills is still spread over tasks.
    """
    scratch = Scratch(spark, "slots")
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("_part")
    rows = scratch.write(slotted(docs, n_slots).select("*", part), "rows")
    path = map_path(spark, name) if name else None
    old = slot_map or (load_map(spark, path) if path else None) or even_map(n_slots, n_shards)
    if path and not stored_versions(spark, path):
        store_map(spark, path, old)
    new = rebalance(old, slot_sums(rows, n_slots), n_shards)
    if path and new.version > old.version:
        store_map(spark, path, new)

    shards = F.broadcast(spark.createDataFrame(list(enumerate(new.shards)), "virtual_slot int, shard int"))
    counts = rows.groupBy("virtual_slot", "_part").agg(F.count("*").alias("_n")).join(shards, "virtual_slot")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    slots = counts.groupBy("shard", "virtual_slot").agg(F.sum("_n").alias("_s"))
    slots = slots.select("virtual_slot", "shard", F.coalesce(F.sum("_s").over(before("shard").orderBy("virtual_slot")), F.lit(0)).alias("_first"))
    starts = counts.select("virtual_slot", "_part", F.coalesce(F.sum("_n").over(before("virtual_slot").orderBy("_part")), F.lit(0)).alias("_start"))
    starts = scratch.write(starts.join(F.broadcast(slots), "virtual_slot"), "starts")
    place = F.row_number().over(Window.partitionBy("virtual_slot", "_part").orderBy("doc_id", "text_crc32", "size")) - 1
    out = rows.withColumn("_place", place).join(starts.hint("merge"), ["virtual_slot", "_part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("_first") + F.col("_start") + F.col("_place")).alias("slot"), "virtual_slot"), new


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ringlet.llm.common import table

    out, made = shard_documents(spark, table(spark, sf_dir, "documents"), name=f"{sf_dir}/documents")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(made.version).alias("map_version"),
    )
