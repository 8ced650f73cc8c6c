"""Mixing sources to target weights, by blocks.

The words of a source form one line: documents in a pseudorandom order, cut into blocks of
``BLOCK`` words.  Targets come from the weights by water filling.  Every output shard has the same number of
slots, but for one, and draws how many of them each source fills: a source's share of the shard's slots
rounded down, and for the slots that leaves over a multinomial draw with the fractions lost as
probabilities (a residual multinomial: it has the multinomial's means, and a spread of a few blocks instead of one that
would miss the targets of small tables).  A source's slots, counted through the shards, are mapped through its own
pseudorandom permutation of block indices (swap-or-not, exact for any block count), epoch after
epoch, and blocks are joined by index.  Slots after the third epoch stay empty, so that no document is taken
more than three times; by then the source has all that its target can be.

Only DataFrame functions are used.  A hot source is spread over ``BUCKETS`` pieces of its line,
whose sums alone pass the prefix-sum windows; its blocks are hashed by index.  Windows without a partition see one row
for each source.

Defined results: null or blank text has size 0 and nothing is taken of it; null sources are one
source, last; repeated rows are rows of their own; with no words at all, every target is 0;
an empty table gives an empty result; very long texts lie over many blocks and are never cut short.  All draws are
hashes, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringlet.llm.common import WORD, Scratch, rescan, stable_files

BLOCK, BUCKETS, SHARDS, SEED, ROUNDS, MOST = 64, 4096, 8, 20_240_501, 24, 3
#: Slots that one row of the slot generator unfolds.
CHUNK = 4096
#: A word with the white space after it, and before it at the start of a text.
WORD_AND_SPACE = r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``src`` (place by code point, null last), ``weight`` and ``target`` to source, source_size.

    Target: min(3 x size, level x weight); the level that makes the sum right lies where,
    with sources ordered by cap over weight, all before are capped and none from there on.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cap, by = F.col("source_size") * MOST, Window.orderBy("ratio", "src")
    t = sources.withColumn("src", n).withColumn("weight", F.col("src") % 3 + 1).withColumn("ratio", cap / F.col("weight"))
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    t = t.withColumn("level", left / F.sum("weight").over(after)).withColumn("at", F.row_number().over(by))
    fits = F.when(F.col("level") <= F.col("ratio") * (1 + 1e-12), F.struct("at", "level"))
    t = t.withColumn("level", F.min(fits).over(everything)["level"])
    target = F.least(cap.cast("double"), F.col("level") * F.col("weight"))
    return t.select("source", "source_size", "src", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def permuted(x: Column, n: Column, src: Column, rounds: int = ROUNDS, seed: int = SEED) -> Column:
    """Swap-or-not: a permutation of 0 .. n-1 for each source."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(seed), src, r), n) - x, n)
        swap = F.xxhash64(F.lit(seed + 1), src, r, F.greatest(x, other)).bitwiseAND(1) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x, step)


def _unfolded(rows: DataFrame, count: str, to: str) -> DataFrame:
    """``to`` runs over 0 .. count-1 for each row, chunks dealt over the tasks.

    The number of tasks is fixed, as chunks are few bytes but much work: adaptive
    coalescing, which goes by bytes, would put all of them in one task.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = rows.where(f"{count} > 0").withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {CHUNK}"))))
    chunks = chunks.repartition(tasks, "src", "_c")
    last = F.least(F.col(count) - F.col("_c") * CHUNK, F.lit(CHUNK).cast("long")) - 1
    inner = chunks.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return inner.withColumn(to, F.col("_c") * CHUNK + F.col("_i")).drop("_c", "_i")


def shard_counts(planned: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """src, blocks, shard, n: the draw of each shard's slots over the sources (src, blocks, drawn: slots wanted)."""
    everything = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = planned.select("src", "blocks", "drawn", F.sum("drawn").over(everything).alias("all")).where("drawn > 0")
    cells = cells.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("_t", F.round("all").cast("long"))
    slots = F.expr(f"_t div {shards} + if(shard < _t % {shards}, 1, 0)")
    cells = cells.withColumn("slots", slots).withColumn("exact", F.col("slots") * F.col("drawn") / F.col("all"))
    cells = cells.withColumn("whole", F.floor("exact")).withColumn("part", F.col("exact") - F.col("whole"))
    left = cells.groupBy("shard").agg(
        (F.first("slots") - F.sum("whole")).alias("left"), F.array_sort(F.collect_list(F.struct("src", "blocks", "part"))).alias("each")
    )
    # One draw for each slot left: the source in whose stretch of the summed fractions a hashed point falls.
    draws = left.where(F.col("left") > 0).withColumn("_r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("left"))))
    point = F.xxhash64(F.lit(seed + 2), "shard", "_r").bitwiseAND((1 << 53) - 1) / float(1 << 53)
    draws = draws.withColumn("_u", point * F.aggregate("each", F.lit(0.0), lambda s, x: s + x["part"]))
    picked = F.expr("""aggregate(each, named_struct('upto', 0D, 'src', cast(null as int), 'blocks', cast(null as bigint), 'done', false),
        (s, x) -> if(s.done, s, named_struct('upto', s.upto + x.part, 'src', x.src, 'blocks', x.blocks, 'done', s.upto + x.part > _u)))""")
    draws = draws.withColumn("_p", picked).select(F.col("_p.src").alias("src"), F.col("_p.blocks").alias("blocks"), "shard", F.lit(1).cast("long").alias("n"))
    every = cells.select("src", "blocks", "shard", F.col("whole").alias("n")).unionByName(draws)
    return every.groupBy("src", "blocks", "shard").agg(F.sum("n").alias("n")).where("n > 0")


@dataclass
class Mix:
    """rows: key, src, at, size, source_size, target; counts: src, blocks, shard, n; slots: shard, place,
    src, epoch, block; pieces: src, at, block, n (times taken), shards (that take it), lo, hi (its words)."""

    rows: DataFrame
    counts: DataFrame
    slots: DataFrame
    pieces: DataFrame


def mix(rows: DataFrame, scratch: Scratch, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, order: tuple[str, ...] = ()) -> Mix:
    """Plan the mix of ``rows`` (key columns, source, size): see the module's text.  ``order`` names the keys that place a row
    on its source's line, all if none; the others only tell equal rows apart."""
    keys = sorted((c for c in rows.columns if c not in ("source", "size")), key=lambda c: (c not in order, c))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "size", *(order or keys)), F.lit(BUCKETS)).cast("int")
    rows = scratch.write(rows.withColumn("bucket", bucket), "rows")
    sums = scratch.write(rows.groupBy("source", "bucket").agg(F.sum("size").alias("s")), "sums")
    planned = targets(sums.groupBy("source").agg(F.sum("s").alias("source_size")))
    planned = planned.withColumn("blocks", F.ceil(F.col("source_size") / block))
    drawn = F.col("target") * F.col("blocks") / F.when(F.col("source_size") > 0, F.col("source_size"))
    planned = scratch.write(planned.withColumn("drawn", F.coalesce(drawn, F.lit(0.0))), "targets")

    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0).cast("long")))
    starts = starts.join(planned, starts.source.eqNullSafe(planned.source)).select(
        starts.source.alias("_source"), F.col("bucket").alias("_bucket"), "base", "src", "source_size", "target"
    )
    inside = Window.partitionBy("source", "bucket").orderBy("size", *keys).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(inside))
    rows = rows.join(starts, rows.source.eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    at = F.when(F.col("size") > 0, F.col("base") + F.col("upto") - F.col("size"))
    rows = scratch.write(rows.select(*keys, "size", "src", at.alias("at"), "source_size", "target"), "line")

    counts = scratch.write(shard_counts(planned, shards, seed), "counts")
    first = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    slots = _unfolded(counts.withColumn("first", first), "n", "place").withColumn("_j", F.col("first") + F.col("place"))
    slots = slots.select(
        "shard", "place", "src", F.expr("_j div blocks").alias("epoch"),
        permuted(F.col("_j") % F.col("blocks"), F.col("blocks"), F.col("src"), seed=seed).alias("block"),
    )
    slots = slots.where(F.col("epoch") < MOST)
    drawn_blocks = slots.groupBy("src", "block").agg(F.count("*").alias("n"), F.collect_set("shard").alias("shards"))
    k = F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).alias("block")
    pieces = rows.where("at IS NOT NULL").select("src", "at", "size", k)
    pieces = pieces.join(drawn_blocks.hint("merge"), ["src", "block"]).select(
        "src", "at", "block", "n", "shards",
        F.greatest(F.col("block") * block, F.col("at")).alias("lo"),
        F.least((F.col("block") + 1) * block, F.col("at") + F.col("size")).alias("hi"),
    )
    return Mix(rows, counts, slots, pieces)


def sized(docs: DataFrame, *keys: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*keys, F.col("source"), size.alias("size"))


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ringlet.llm.common import table

    made = mix(sized(table(spark, sf_dir, "documents"), F.col("doc_id")), Scratch(spark, "mix"))
    # The shards of a text's blocks, as bits: a text may lie in many blocks, but there are few shards.
    bits = F.aggregate("shards", F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x)))
    taken = made.pieces.groupBy("src", "at").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("n")).alias("taken"), F.bit_or(bits).alias("shard_bits"))
    none = F.lit(0).cast("long")
    return made.rows.join(taken.hint("merge"), ["src", "at"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), F.coalesce("shard_bits", none).alias("shard_bits")
    )


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a row for each time that a document is taken, with the words taken
    then (its whole text where all its blocks are); same columns.  Documents of which
    nothing is taken go, null and blank ones among them; equal rows are rows of their own; an empty table stays empty."""
    scratch = Scratch(spark, "mixstage")
    files, schema = stable_files(docs, scratch), docs.schema
    scan = rescan(docs, files)
    where = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    # Where a row lies changes from run to run, so that its id and text place it.
    made = mix(sized(scan, where.alias("_key"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash")), scratch, order=("_id", "_hash"))
    taken = made.pieces.groupBy("src", "at").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "n"))).alias("_taken"))
    taken = made.rows.join(taken, ["src", "at"]).select("_key", "_taken", "at", "size")
    full = scan.select(*[F.col(f"`{c}`").alias(f"_in_{c}") for c in docs.columns], where.alias("_key")).join(taken, "_key")
    times = F.array_max(F.transform("_taken", lambda p: p["n"]))
    full = full.withColumn("_epoch", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    full = full.withColumn("_now", F.filter("_taken", lambda p: p["n"] >= F.col("_epoch")))
    words = F.regexp_extract_all("_in_text", F.lit(WORD_AND_SPACE), F.lit(0))
    part = F.transform("_now", lambda p: F.array_join(F.slice("_words", (p["lo"] - F.col("at") + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")), ""))
    held = F.aggregate("_now", F.lit(0).cast("long"), lambda s, p: s + p["hi"] - p["lo"])
    full = full.withColumn("_words", words).withColumn("_text", F.when(held == F.col("size"), F.col("_in_text")).otherwise(F.array_join(part, "")))
    made_up = {"text": F.col("_text"), "n_chars": F.length("_text").cast(schema["n_chars"].dataType if "n_chars" in docs.columns else "long")}
    return full.select(*[made_up.get(c, F.col(f"`_in_{c}`")).alias(c) for c in docs.columns])
