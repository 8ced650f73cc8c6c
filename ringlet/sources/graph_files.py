"""Readers of graph collections: GXL and CXL files, array files, JSON, pair lists, shards.

Every reader takes paths that Spark can open.  Files that cannot be parsed are rows of their own (``problem``), not errors.
Graphs are rows (id, n, edges), edges u < v without loops or repeats.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringlet.operators import decode
from ringlet.operators.pairs import pair_index

_EDGES = f"array<{decode.EDGE}>"


def base_name(path: Column) -> Column:
    """The file's name without folders and its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def _texts(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def read_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, label, split (the index file's name) of CXL indexes."""
    rows = _texts(spark, path)
    each = F.arrays_zip(F.xpath("xml", F.lit("//print/@file")).alias("file"), F.xpath("xml", F.lit("//print/@class")).alias("label"))
    return rows.select(base_name(F.col("path")).alias("split"), F.inline(each)).select("file", "label", "split")


def first_split(index: DataFrame, splits: tuple[str, ...] = ("train", "validation", "valid", "test")) -> DataFrame:
    """One row for each file: that of the first split that lists it."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, splits)), F.col("split")), F.lit(0))
    order = Window.partitionBy("file").orderBy(F.when(rank == 0, len(splits) + 1).otherwise(rank), "split", "label")
    return index.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def _ends(xml: Column) -> Column:
    return F.arrays_zip(F.xpath(xml, F.lit("//edge/@from")).alias("source"), F.xpath(xml, F.lit("//edge/@to")).alias("target"))


def read_gxl(spark: SparkSession, path: str | list[str], pattern: str = "*.gxl") -> DataFrame:
    """id (the file's name), n, edges, n_unknown (edges with an end that is no node), problem.  Node names are sorted and numbered;
    loops go, and attributes are not read."""
    rows = _texts(spark, path, pattern).select(base_name(F.col("path")).alias("id"), "xml")
    good = F.col("xml").rlike(r"(?s)<gxl[\s>].*</gxl>\s*$")
    safe = F.when(good, F.col("xml")).otherwise("<gxl></gxl>")
    rows = rows.withColumn("_x", safe).withColumn("_names", F.array_sort(F.array_distinct(F.xpath("_x", F.lit("//node/@id"))))).withColumn("_ends", _ends(F.col("_x")))
    place = lambda c: (F.array_position(F.col("_names"), c) - 1).cast("int")
    numbered = F.transform("_ends", lambda e: F.struct(place(e["source"]).alias("u"), place(e["target"]).alias("v")))
    rows = rows.withColumn("_all", numbered).withColumn("_known", F.filter("_all", lambda e: (e["u"] >= 0) & (e["v"] >= 0)))
    plain = F.transform(F.filter("_known", lambda e: e["u"] != e["v"]), lambda e: F.struct(F.least(e["u"], e["v"]).alias("u"), F.greatest(e["u"], e["v"]).alias("v")))
    return rows.select(
        "id", F.when(good, F.size("_names")).alias("n"), F.when(good, F.array_sort(F.array_distinct(plain))).alias("edges"),
        (F.size("_all") - F.size("_known")).alias("n_unknown"), F.when(~good, F.lit("no complete gxl element")).alias("problem"),
    )


def observed_attributes(spark: SparkSession, path: str | list[str], pattern: str = "*.gxl") -> DataFrame:
    """element, name, n_files: the attributes of nodes and edges that reading drops."""
    rows = _texts(spark, path, pattern).where(F.col("xml").rlike(r"(?s)<gxl[\s>].*</gxl>\s*$"))
    each = [rows.select(F.lit(e).alias("element"), F.explode(F.array_distinct(F.xpath("xml", F.lit(f"//{e}/attr/@name")))).alias("name")) for e in ("node", "edge")]
    return each[0].unionByName(each[1]).groupBy("element", "name").agg(F.count("*").alias("n_files"))


def read_collection(spark: SparkSession, folder: str, enumeration: str = "index") -> dict[str, DataFrame]:
    """A folder of GXL files with CXL indexes: graphs (id, label, split, n, edges), absent (listed files that are not there) and problems.
    ``directory`` takes every GXL file instead of the listed ones."""
    if enumeration not in ("index", "directory"):
        raise ValueError(f"enumeration is index or directory, not {enumeration}")
    files = read_gxl(spark, folder)
    fine = files.where("problem IS NULL").drop("problem", "n_unknown")
    problems = files.where("problem IS NOT NULL").select("id", "problem")
    if enumeration == "directory":
        none = F.lit(None).cast("string")
        return {"graphs": fine.select("id", none.alias("label"), none.alias("split"), "n", "edges"), "absent": files.select("id").limit(0), "problems": problems}
    listed = first_split(_index_of(spark, folder)).select(base_name(F.col("file")).alias("id"), "label", "split")
    return {
        "graphs": listed.join(fine, "id").select("id", "label", "split", "n", "edges"),
        "absent": listed.join(files.select("id"), "id", "left_anti").select("id"), "problems": problems.join(listed.select("id"), "id", "left_semi"),
    }


def _index_of(spark: SparkSession, folder: str) -> DataFrame:
    rows = _texts(spark, folder, "*.cxl")
    each = F.arrays_zip(F.xpath("xml", F.lit("//print/@file")).alias("file"), F.xpath("xml", F.lit("//print/@class")).alias("label"))
    return rows.select(base_name(F.col("path")).alias("split"), F.inline(each)).select("file", "label", "split")


def read_arrays(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """id, split, label, n, edges of .npz cohorts: graph_ids, splits, labels, n_nodes, n_edges, edge_offsets, edges (2 rows)."""
    schema = f"id string, split string, label string, n int, edges {_EDGES}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as f:
                    ids, offsets, ends = f["graph_ids"], f["edge_offsets"], f["edges"]
                    rows = [
                        (str(ids[k]), str(f["splits"][k]), str(f["labels"][k]), int(f["n_nodes"][k]), [{"u": int(u), "v": int(v)} for u, v in ends[:, offsets[k] : offsets[k + 1]].T])
                        for k in range(len(ids))
                    ]
                yield pd.DataFrame(rows, columns=["id", "split", "label", "n", "edges"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_matrix(spark: SparkSession, path: str, key: str) -> DataFrame:
    """k, i, j, value of the upper triangle of a square matrix in an .npz file; inf, nan and negative entries are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as f:
                    m = f[key].astype(float)
                n = len(m)
                for i in range(n):
                    j, v = np.arange(i + 1, n), m[i, i + 1 :]
                    v = np.where(np.isfinite(v) & (v >= 0), v, np.nan)
                    yield pd.DataFrame({"k": i * n - i * (i + 1) // 2 + j - i - 1, "i": i, "j": j, "value": pd.Series(v, dtype=object).where(~np.isnan(v), None)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "k long, i int, j int, value double")


def whole_distance(value: Column, within: float = 0.01) -> Column:
    """A distance that is nearly whole, as a whole one."""
    return F.when(F.abs(value - F.round(value)) < within, F.round(value)).otherwise(value)


def split_ids(rows: DataFrame, name: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Adds id, ``{name}_{split}_{place:04d}``, and idx over all splits in their order, to rows (split, place)."""
    rank = F.array_position(F.array(*map(F.lit, splits)), F.col("split"))
    sizes = rows.groupBy(rank.alias("_rank")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_rank", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = rows.withColumn("_rank", rank).join(starts, "_rank").withColumn("idx", F.col("_start") + F.col("place"))
    return out.withColumn("id", F.format_string(f"{name}_%s_%04d", F.col("split"), F.col("place").cast("int"))).drop("_rank", "_start")


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """id, w, length of JSON files {"strings": {id: {"string", "length"}}}."""
    rows = spark.read.text(path, wholetext=True)
    got = F.from_json("value", "strings map<string, struct<string:string,length:int>>")
    return rows.select(F.explode(got["strings"]).alias("id", "s")).select("id", F.col("s.string").alias("w"), F.col("s.length").alias("length"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """idx, id, label, n, m of JSON files with arrays graph_ids, labels, node_counts, edge_counts."""
    rows = spark.read.text(path, wholetext=True)
    got = F.from_json("value", "dataset string, graph_ids array<string>, labels array<string>, node_counts array<int>, edge_counts array<int>")
    each = F.arrays_zip(got["graph_ids"].alias("id"), got["labels"].alias("label"), got["node_counts"].alias("n"), got["edge_counts"].alias("m"))
    return rows.select(got["dataset"].alias("dataset"), F.posexplode(each).alias("idx", "x")).select("dataset", "idx", "x.*")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Steps of traces written by ``sinks.write_trace``."""
    return spark.read.schema("id string, step int, instruction string, ring array<int>, primary_node int, secondary_node int, created_u int, created_v int, n_nodes int, n_edges int, partial string").json(path)


def read_pair_list(rows: DataFrame, n: int) -> DataFrame:
    """Distinct k of rows with pair_index, or pair_i and pair_j in any order; k outside the range is an error."""
    if "pair_index" in rows.columns:
        k = F.col("pair_index").cast("long")
    else:
        i, j = F.least("pair_i", "pair_j").cast("long"), F.greatest("pair_i", "pair_j").cast("long")
        k = F.when(i == j, F.raise_error(F.lit("a pair of a graph with itself"))).otherwise(pair_index(i, j, F.lit(n).cast("long")))
    total = n * (n - 1) // 2
    rows = rows.select(k.alias("k")).distinct()
    return rows.select(F.when((F.col("k") < 0) | (F.col("k") >= total), F.raise_error(F.concat(F.lit("no such pair: "), F.col("k").cast("string")))).otherwise(F.col("k")).alias("k"))


def read_shards(spark: SparkSession, folder: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """All rows of a folder of Parquet shards, with the shard's file; files named in ``exclude`` are left out."""
    rows = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(folder).withColumn("shard", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1))
    return rows.where(~F.col("shard").isin(list(exclude))) if exclude else rows


ROLE = {"k": "bigint", "lb": "double", "ub": "double"}


def role_rows(rows: DataFrame, role: str) -> DataFrame:
    """A role's rows, checked: k, and lb or ub of the right type."""
    need = {"k": ROLE["k"], **({"lb": "double"} if role == "lb" else {"ub": "double"})}
    types = dict(rows.dtypes)
    if missing := [c for c, t in need.items() if types.get(c) != t]:
        raise ValueError(f"role {role}: {', '.join(f'{c} {need[c]}' for c in missing)} missing or of another type")
    return rows.select(*need)


def methods_of(spark: SparkSession, folder: str) -> list[str]:
    """The methods of a table partitioned by method."""
    rows = spark.read.parquet(folder)
    return sorted(r.method for r in rows.select("method").distinct().collect()) if "method" in rows.columns else []


def read_artifacts(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """One dataset's pair distances, a column for each method, from a table partitioned by dataset and method."""
    rows = spark.read.parquet(folder).where(F.col("dataset") == dataset)
    return rows.groupBy("k", "i", "j").pivot("method").agg(F.first("value"))


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("graph string, n int, method string, seconds double").csv(path)


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with quoted fields that may hold separators, quotes and line ends."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def source_root(candidates: list[str], marker: str, named: str | None = None) -> str:
    """The folder that holds a marker file: the named one, else the first of the candidates."""
    import os

    for folder in [named] if named else candidates:
        if os.path.exists(os.path.join(folder, marker)):
            return folder
    raise FileNotFoundError(f"no {marker} in {named or ', '.join(candidates)}")


def manifest(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
