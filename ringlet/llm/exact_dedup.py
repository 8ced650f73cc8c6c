"""Exact deduplication as a stateful stream.

Rows stream in from files.  A RocksDB-backed aggregation without watermark or expiry keeps, per
digest of the normalised text, the stable identifier that stays (largest doc_id), the
locator of its content (file and row) and the number of rows seen.  What changes goes,
micro-batch by micro-batch, to a change table; counts only grow, so the latest state of
a digest is the row with the largest count, and replayed batches overwrite themselves.
Digests hit more than once are then checked on full bytes: the smallest and the largest
normalised text of a digest must be the same bytes.  Digests that fail are grouped
again by their whole text.

Defined results: null text counts as empty; only A-Z are folded; among rows of the
largest doc_id the one latest by (file, row) stays, so repeated rows leave one; null
doc_ids lose to any other, and a group of null doc_ids alone keeps one row with a null keep_id;
very long texts are compared whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlet.llm.common import Scratch, ascii_lower, rescan, stable_files

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.metricsEnabled": "false",
}
FILES_PER_TRIGGER = 64
#: Bits that mark the digests that were hit: 8 MB.
MARKS = 1 << 26


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _located(rows: DataFrame, digest: Callable[[Column], Column], *more: Column) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    at = F.struct(
        F.col("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    ).alias("_at")
    return rows.select(*more, F.col("doc_id").alias("_id"), at, digest(norm).alias("_digest"), norm.alias("_norm"))


def keyed_state(
    spark: SparkSession, files: tuple[str, str], schema, scratch: Scratch, digest: Callable[[Column], Column] = sha256,
    files_per_trigger: int = FILES_PER_TRIGGER,
) -> DataFrame:
    """Run the stream over ``files`` (folder, pattern); return the state: digest, last, n."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", files[1])
    stream = stream.option("maxFilesPerTrigger", files_per_trigger).parquet(files[0])
    state = _located(stream, digest).groupBy("_digest").agg(F.max("_at").alias("last"), F.count("*").alias("n"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{scratch.path}/changes/batch={number}")

    # A state store is a database with files of its own: no more of them than the input has splits.
    splits = spark.read.schema(schema).option("pathGlobFilter", files[1]).parquet(files[0]).rdd.getNumPartitions()
    stores = max(1, min(splits, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    settings = {**STATE_CONF, "spark.sql.streaming.internal.stateStore.partitions": str(stores)}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        query = (
            state.writeStream.outputMode("update").foreachBatch(put).trigger(availableNow=True)
            .option("checkpointLocation", f"{scratch.path}/stream").start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    empty = spark.createDataFrame([], state.schema)
    batches = query.lastProgress["batchId"] + 1 if query.lastProgress else 0
    if not _exists(spark, f"{scratch.path}/changes"):
        return empty
    changes = spark.read.schema(state.schema).parquet(f"{scratch.path}/changes")
    if batches == 1:
        return changes
    return changes.groupBy("_digest").agg(F.max_by("last", "n").alias("last"), F.max("n").alias("n"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def marked(rows: DataFrame, hits: DataFrame, bits: int = MARKS) -> DataFrame:
    """The rows whose ``_digest`` may be one of ``hits``: all that are, and few others while hits are much fewer than ``bits``.  The
    hits' marks are ``bits`` bits in stretches of 32,768, so that what is broadcast has ``bits`` / 8 bytes at most."""
    place = lambda d: F.pmod(F.xxhash64(d), F.lit(bits))
    marks = hits.select(place("_digest").alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_marks"))
    rows = rows.withColumn("_p", place("_digest")).withColumn("_at", F.bitmap_bit_position("_p")).withColumn("_bucket", F.bitmap_bucket_number("_p"))
    rows = rows.join(F.broadcast(marks), "_bucket")
    byte = F.conv(F.hex(F.expr("substring(_marks, cast(_at div 8 + 1 as int), 1)")), 16, 10).cast("int")
    is_set = F.expr("shiftright(_byte, cast(_at % 8 as int)) & 1") == 1
    return rows.withColumn("_byte", byte).where(is_set).drop("_p", "_at", "_bucket", "_marks", "_byte")


def groups(
    docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_trigger: int = FILES_PER_TRIGGER,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Every row: _id, _keep (the doc_id that stays), _size of the group, _kept and _digest; ``carry`` names more
    columns of ``docs``, returned as _carry_0 and so on, so that none clashes with ours."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    files, schema = stable_files(docs, scratch), docs.schema
    state = keyed_state(spark, files, schema, scratch, digest, files_per_trigger)
    scan = rescan(docs, files)
    held = [F.col(f"_carry_{k}") for k in range(len(carry))]
    rows = _located(scan, digest, *[F.col(f"`{c}`").alias(f"_carry_{k}") for k, c in enumerate(carry)])

    # Full bytes of the digests that were hit: the join's skew can be split; min and max
    # combine within each task before their exchange, so copies do not pile up.  Texts that no
    # hit can concern do not enter the exchange.
    hits = state.where("n > 1").select("_digest")
    clash = (
        marked(rows.select("_digest", "_norm"), hits).join(hits, "_digest")
        .groupBy(F.concat("_digest", F.lit("")).alias("_clash")).agg(F.min("_norm").alias("a"), F.max("_norm").alias("b"))
        .where("a <> b").select("_clash")
    )
    clash = scratch.write(clash, "clash")
    if clash.isEmpty():
        joined = rows.drop("_norm").join(state, "_digest")
    else:
        bad = rows.join(clash, F.col("_digest") == F.col("_clash"), "left_semi")
        exact = bad.groupBy("_norm").agg(F.max("_at").alias("last"), F.count("*").alias("n"))
        joined = (
            rows.drop("_norm").join(clash, F.col("_digest") == F.col("_clash"), "left_anti").join(state, "_digest")
            .unionByName(bad.join(exact, "_norm").drop("_norm"))
        )
    return joined.select(
        *held,
        F.col("_id"), F.col("last.doc_id").alias("_keep"), F.col("n").alias("_size"),
        (F.col("_at") == F.col("last")).alias("_kept"), "_digest",
    )


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ringlet.llm.common import table

    return groups(table(spark, sf_dir, "documents")).select(
        F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"), F.col("_digest").alias("text_sha256"),
    )


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
      FROM documents)
WINDOW w AS (PARTITION BY h)
"""


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that stay, with the columns of ``docs``: of equal texts (null: empty; A-Z folded) the one of the largest doc_id,
    null ids last; repeated rows leave one; an empty table stays empty."""
    return groups(docs, carry=tuple(docs.columns)).where("_kept").select(*[F.col(f"_carry_{k}").alias(c) for k, c in enumerate(docs.columns)])
