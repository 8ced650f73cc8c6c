"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

1. Every text gets its shingle set, a signature of 128 coordinates from two permutations, and 32
   band keys of 4 coordinates (a pair at the threshold meets in some band but for 5 in a
   million).  Equal sets are one class from here on.
2. Star pairs: in every band bucket each class meets the smallest one.  They are verified on
   full sets; links give connected components.
3. Buckets that still hold several components are cut into blocks, of ``BLOCK`` texts or ``BLOCK_SHINGLES`` shingles at
   most on average, and every pair of blocks
   goes to one task, which verifies exactly the pairs of different components there and emits
   links only.  A pair that meets in several buckets is taken up in the first.  No bucket is capped,
   and no task holds more than two blocks.
4. Components again, over all links.

Defined results: null or blank text has an empty set, is linked with nothing and is kept; very long texts are read
whole; columns besides doc_id and text play no part; repeated rows are one class; the row that stays is the first by (doc_id, file, row), null doc_ids last; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlet.llm.common import Scratch, rescan, stable_files, tidy
from ringlet.llm.shingles import BANDS, COORDS, band_keys, forget, overlap, shingle_set, signature

PERCENT = 75
#: Signatures of linked sets agree in 96 of 128 coordinates on average; under 64 is 6.5 deviations off.
LEAST_EQUAL = COORDS // 2
BLOCK, BLOCK_SHINGLES = 512, 500_000


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "row", "doc_id", "n_shingles", "cls", "bands", "sig"]
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text in batch.column(3):
            found = shingle_set(text.as_py())
            out[0].append(len(found))
            if len(found):
                sig = signature(found)
                cls = xxhash.xxh3_128_digest(found.tobytes())
                row = (cls, band_keys(sig).tolist(), sig.astype(np.uint8).tobytes())
            else:
                row = (None, None, None)
            for column, value in zip(out[1:], row, strict=True):
                column.append(value)
        arrays = [batch.column(i) for i in range(3)] + [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, text_a, text_b -> the linked a, b."""
    last, held = None, None
    for batch in batches:
        a, b, ta, tb = (batch.column(i) for i in range(4))
        keep = []
        for i in range(batch.num_rows):
            if (key := a[i].as_py()) != last:
                last, held = key, shingle_set(ta[i].as_py())
            if linked(held, shingle_set(tb[i].as_py())):
                keep.append(i)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], ["a", "b"])


def _verify_blocks(table: pa.Table) -> pa.Table:
    """One pair of blocks of one bucket: links between different components."""
    key, p, q = (table.column(c)[0].as_py() for c in ("key", "p", "q"))  # blocks p and q of the bucket of key
    block, cls = np.array(table.column("block")), table.column("cls").to_pylist()
    labels = np.unique(np.array(table.column("label").to_pylist(), dtype=object), return_inverse=True)[1]
    sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, COORDS)
    keys = np.array(table.column("keys").to_pylist(), np.int64).reshape(-1, BANDS)
    sizes = np.array(table.column("n"))
    texts, sets, top = table.column("text"), {}, list(range(int(labels.max()) + 1))
    links: list[tuple[bytes, bytes]] = []

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    def get(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_set(texts[i].as_py())
        return sets[i]

    left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
    here = int(np.flatnonzero(keys[left[0]] == key)[0])
    for i in left:
        others = right[right > i] if p == q else right
        lo, hi = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        ok = (labels[others] != labels[i]) & (100 * lo >= PERCENT * hi)
        others = others[ok]
        if here and len(others):  # 0 marks bands whose bucket is done
            first = (keys[others, :here] == keys[i, :here]) & (keys[i, :here] != 0)
            others = others[~first.any(axis=1)]
        if len(others):
            equal = (sigs[others] == sigs[i]).sum(axis=1)
            others = others[equal >= LEAST_EQUAL]
        for j in others:
            if (x := root(labels[i])) != (y := root(labels[j])) and linked(get(i), get(j)):
                top[x] = y
                links.append((cls[i], cls[j]))
    sets.clear()
    forget()
    return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label: the smallest node of its component.  Smallest labels spread along the
    links and jump along labels; each round is a written table."""
    both = scratch.write(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label"))
    labels, turn = scratch.write(labels, f"{name}-0"), 0
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("far"))
        new = labels.join(near, labels.node == near.a).join(jump, F.col("label") == F.col("_n"))
        new = new.select("node", F.least("label", "near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved"))
        new = scratch.write(new, f"{name}-{turn + 1}")
        scratch.drop(f"{name}-{turn}")
        labels, turn = new.select("node", "label"), turn + 1
        if new.where("moved").isEmpty():
            return labels


def grouped(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row: doc_id, n_shingles, component_id, kept, and whether it is the row that stays."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    files, schema = stable_files(docs, scratch), docs.schema
    scan = rescan(docs, files)
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    kind = schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("binary").alias("text")
    signed = scan.select(*where, F.col("doc_id"), text).mapInArrow(
        tidy(_sign, forget), f"file string, row long, doc_id {kind}, n_shingles long, cls binary, bands array<long>, sig binary"
    )
    signed = scratch.write(signed, "signed")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    classes = signed.where("cls IS NOT NULL").groupBy("cls").agg(
        F.min(first).alias("first"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")
    )
    classes = scratch.write(classes, "classes")
    banded = classes.select(F.posexplode("bands").alias("band", "key"), "cls")
    shared = banded.groupBy("key").agg(F.min("cls").alias("a"), F.count("*").alias("m")).where("m > 1")
    banded = scratch.write(banded.join(shared, "key"), "buckets")

    # The classes that meet another, with one text each.
    met = banded.select("cls").distinct()
    at = classes.join(met, "cls").select("cls", "n", "sig", F.col("first.file").alias("_file"), F.col("first.row").alias("_row"))
    texts = scan.select(*where, text).join(at, (F.col("file") == F.col("_file")) & (F.col("row") == F.col("_row")))
    texts = scratch.write(texts.select("cls", "n", "sig", "text"), "texts")

    pairs = banded.where("cls <> a").select("a", F.col("cls").alias("b")).distinct()
    other = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    pairs = pairs.join(texts.withColumnsRenamed({"cls": "b", "text": "text_b", "sig": "sig_b", "n": "n_b"}), "b")
    pairs = pairs.join(other, "a").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT)
    links = pairs.select("a", "b", "text_a", "text_b").mapInArrow(tidy(_verify_pairs, forget), "a binary, b binary")
    links = scratch.write(links, "links-1")
    labels = components(links, scratch, "first")

    # Buckets of three and more that still hold several components, in blocks.
    held = banded.where("m > 2").join(labels, F.col("cls") == F.col("node"), "left")
    held = scratch.write(held.select("key", "band", "cls", "m", F.coalesce("label", "cls").alias("label")), "held")
    sizes = classes.select("cls", F.col("n").alias("_n"))
    mixed = held.join(sizes, "cls").groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.sum("_n").alias("weight")).where("x <> y").select("key", "weight")
    held = scratch.write(held.join(mixed, "key"), "mixed")
    keys = held.groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("band", "key"))).alias("by_band"))
    keys = keys.select("cls", F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.coalesce(F.try_element_at("by_band", b), F.lit(0).cast("long"))).alias("keys"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    parts = held.join(texts.join(keys, "cls"), "cls").withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
    parts = parts.withColumn("_x", F.explode(F.sequence(F.lit(0), blocks - 1)))
    parts = parts.withColumn("p", F.least("block", "_x")).withColumn("q", F.greatest("block", "_x"))
    more = parts.groupBy("key", "p", "q").applyInArrow(_verify_blocks, "a binary, b binary")
    more = scratch.write(more, "links-2")
    if not more.isEmpty():
        chained = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b")
        labels = components(more.union(chained), scratch, "second")
    scratch.drop("texts", "held", "mixed", "buckets")

    named = classes.select("cls", "first").join(labels, F.col("cls") == F.col("node"), "left")
    named = named.select("cls", "first", F.coalesce("label", "cls").alias("label"))
    heads = named.groupBy("label").agg(F.min("first").alias("head"))
    named = scratch.write(named.join(heads, "label").select("cls", "head"), "named")
    out = signed.select("file", "row", "doc_id", "n_shingles", "cls").join(named, "cls", "left")
    out = out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")))
    stays = F.col("cls").isNull() | ((F.col("file") == F.col("head.file")) & (F.col("row") == F.col("head.row")))
    out = out.withColumn("stays", stays)
    if not carry:
        return out.select("doc_id", "n_shingles", "component_id", "stays")
    gone = scratch.write(out.where("NOT stays").select(F.col("file").alias("_file"), F.col("row").alias("_row")), "gone")
    full = scan.select(*[F.col(f"`{c}`").alias(f"_carry_{k}") for k, c in enumerate(carry)], *[c.alias(f"_at_{i}") for i, c in enumerate(where)])
    full = full.join(gone, (F.col("_at_0") == F.col("_file")) & (F.col("_at_1") == F.col("_row")), "left_anti")
    return full.select(*[F.col(f"_carry_{k}").alias(c) for k, c in enumerate(carry)])


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ringlet.llm.common import table

    return grouped(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the first by doc_id (null ids last), with the columns of ``docs``; null and blank texts are groups of
    their own, and all stay; an empty table stays empty."""
    return grouped(docs, carry=tuple(docs.columns))


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT rowid AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT row_number() OVER (ORDER BY doc_id, text) AS rowid, doc_id, text FROM documents)),
 sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
   ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
 cls AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS c, any_value(s) AS s, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY 1),
 posts AS (SELECT c, n, unnest(s) AS x FROM cls),
 links AS (SELECT a.c AS a, b.c AS b FROM posts a JOIN posts b ON a.x = b.x AND a.c <> b.c
           GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
 reach(c, d) AS (SELECT c, c FROM cls UNION SELECT reach.c, links.b FROM reach JOIN links ON reach.d = links.a),
 rows AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(list_sort(s), chr(10))) END AS c FROM sets),
 firsts AS (SELECT c, min(doc_id) AS f FROM rows WHERE c IS NOT NULL GROUP BY 1),
 comp AS (SELECT reach.c, min(f) AS f FROM reach JOIN firsts ON firsts.c = reach.d GROUP BY 1)
SELECT doc_id, n AS n_shingles, coalesce(f, doc_id) AS component_id, coalesce(doc_id = coalesce(f, doc_id), true) AS kept
FROM rows LEFT JOIN comp USING (c)
"""
