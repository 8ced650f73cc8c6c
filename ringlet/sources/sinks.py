"""Writers: cohorts, matrices, strings, traces, shards, manifests, report tables.

Tables are written by Spark's commit protocol; single files through the session's file system, under a hidden name that
is renamed when whole.  What is checked before writing raises, and nothing is written then.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlet.operators import decode


def cohort_faults(graphs: DataFrame) -> DataFrame:
    """One row of counts for graphs (id, n, edges): edges out of order or range, repeated edges, repeated ids; all must be 0."""
    bad = lambda f: F.sum(F.size(F.filter("edges", f)))
    return graphs.agg(
        F.coalesce(bad(lambda e: e["u"] >= e["v"]), F.lit(0)).alias("n_unordered"),
        F.coalesce(F.sum(F.size(F.filter("edges", lambda e: (e["v"] >= F.col("n")) | (e["u"] < 0)))), F.lit(0)).alias("n_out_of_range"),
        F.coalesce(F.sum(F.size("edges") - F.size(F.array_distinct("edges"))), F.lit(0)).alias("n_repeated"),
        (F.count("*") - F.countDistinct("id")).alias("n_same_id"),
    )


def content_digest(rows: DataFrame) -> str:
    """A digest of the rows that does not depend on their order: count, and sum and xor of row hashes."""
    h = F.xxhash64(*[F.to_json(F.struct(*rows.columns))])
    got = rows.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{got.n}:{got.x}:{got.s}".encode()).hexdigest()


def write_cohort(graphs: DataFrame, path: str, expected: int | None = None) -> dict:
    """Writes graphs (dataset and other columns may follow) as Parquet after the checks, and their manifest beside it."""
    faults = cohort_faults(graphs).first().asDict()
    if any(faults.values()):
        raise ValueError(f"cohort not written: {faults}")
    n = graphs.count()
    if expected is not None and n != expected:
        raise ValueError(f"cohort not written: {n} graphs, {expected} expected")
    graphs.write.mode("overwrite").parquet(path)
    made = {"n_graphs": n, "content_sha256": content_digest(graphs.sparkSession.read.parquet(path)), "columns": graphs.columns}
    write_text(graphs.sparkSession, f"{path}.manifest.json", json.dumps(made, indent=1, sort_keys=True))
    return made


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file, whole or not at all."""
    hidden, fs = _fs(spark, path.rsplit("/", 1)[0] + "/._" + path.rsplit("/", 1)[-1])
    target, _ = _fs(spark, path)
    out = fs.create(hidden, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(target, False)
    if not fs.rename(hidden, target):
        raise OSError(f"cannot rename to {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _fs(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if fs.exists(p) else None


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_matrix(pairs: DataFrame, path: str, dataset: str, method: str) -> None:
    """Pairs (k, i, j, value; null where unknown) as one partition of a table by dataset and method."""
    if pairs.where("i >= j OR value < 0").limit(1).count():
        raise ValueError("pairs not written: not the strict upper triangle, or a negative distance")
    rows = pairs.select("k", "i", "j", F.col("value").cast("double").alias("value"))
    rows.write.mode("overwrite").parquet(f"{path}/dataset={dataset}/method={method}")


def write_strings(strings: DataFrame, path: str) -> None:
    """id, w as JSON lines with the length; null strings stay, with their length null."""
    strings.select("id", F.col("w").alias("string"), F.length("w").alias("length")).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_trace(steps: DataFrame, path: str) -> None:
    steps.withColumn("id", F.col("id").cast("string")).write.mode("overwrite").json(path)


def fingerprint(k: DataFrame) -> str:
    """Names a set of pairs, however it is ordered."""
    return content_digest(k.select(F.col("k").cast("long").alias("k")).distinct())


def write_shard(rows: DataFrame, folder: str, index: int, target: DataFrame | None = None) -> None:
    """One shard of pair results, whole or not at all; with ``target`` the fingerprint of the pairs it belongs to."""
    mark = F.lit(fingerprint(target) if target is not None else None).cast("string")
    rows.withColumn("target", mark).write.mode("overwrite").parquet(f"{folder}/shard={index}")


def unfinished(target: DataFrame, folder: str) -> DataFrame:
    """The pairs of ``target`` that no shard of the same fingerprint has; shards of another target are an error."""
    spark = target.sparkSession
    p, fs = _fs(spark, folder)
    if not fs.exists(p):
        return target
    done, mark = spark.read.parquet(folder), fingerprint(target)
    if done.where(F.col("target") != mark).limit(1).count():
        raise ValueError("the shards belong to another set of pairs")
    return target.join(done.select("k").distinct(), "k", "left_anti")


def merge_shards(shards: DataFrame, total: int, value: str = "value") -> DataFrame:
    """One row for each k below ``total``; rows of one k must agree, and none may be missing."""
    merged = shards.groupBy("k").agg(F.min(value).alias(value), F.max(value).alias("_top"), F.count("*").alias("copies"))
    faults = merged.agg(F.count("*").alias("n"), F.count(F.when(F.col(value) != F.col("_top"), 1)).alias("apart"), F.count(F.when((F.col("k") < 0) | (F.col("k") >= total), 1)).alias("out")).first()
    if faults.n != total or faults.apart or faults.out:
        raise ValueError(f"shards not merged: {total - faults.n} pairs missing, {faults.apart} disagree, {faults.out} out of range")
    return merged.drop("_top")


def write_pair_csv(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def _cells(rows: DataFrame, digits: int) -> list[list[str]]:
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return [[show(v) for v in r] for r in rows.collect()]


def markdown(rows: DataFrame, digits: int = 3) -> str:
    """A table of few rows, such as aggregates."""
    body = _cells(rows, digits)
    return "\n".join(["| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns), *("| " + " | ".join(r) + " |" for r in body)])


def latex(rows: DataFrame, digits: int = 3, largest: tuple[str, ...] = (), smallest: tuple[str, ...] = ()) -> str:
    """The same for LaTeX; the best cell of the columns named is bold."""
    body, plain = _cells(rows, digits), rows.collect()
    for names, pick in ((largest, max), (smallest, min)):
        for name in names:
            at = rows.columns.index(name)
            known = [r[at] for r in plain if r[at] is not None]
            for r, cells in zip(plain, body, strict=True):
                if known and r[at] == pick(known):
                    cells[at] = rf"\textbf{{{cells[at]}}}"
    lines = [" & ".join(c.replace("_", r"\_") for c in rows.columns), *(" & ".join(r) for r in body)]
    return "\\begin{tabular}{" + "l" * len(rows.columns) + "}\n" + " \\\\\n".join(lines) + " \\\\\n\\end{tabular}"


def graph_documents(graphs: DataFrame) -> DataFrame:
    """id, text: each graph as JSON, for sinks of text."""
    return graphs.select("id", decode.graph_json().alias("text"))
