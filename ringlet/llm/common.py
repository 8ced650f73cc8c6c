"""Shared helpers of the training-data operators.

All intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
driver and executors share.  Only where that setting is absent (tests, a laptop)
a folder of our own is made.
"""

from __future__ import annotations

import ctypes
import gc
import posixpath
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word of the contracts: a run of anything but space and \\t \\n \\v \\f \\r.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="ringlet-"))
    spark.sparkContext.setCheckpointDir(_own_dir[0])
    return _own_dir[0]


def give_back() -> None:
    """Return a Python worker's freed memory to the system: workers outlive their tasks, and allocators keep what they once had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        return


def tidy(run: Callable[[Iterator], Iterator], forget: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """``run``, that empties its caches (``forget``) and gives its memory back at the end of each partition."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            give_back()

    return tidied


class Scratch:
    """Named intermediate tables below one fresh folder of the shared directory."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/ringlet-{what}-{uuid.uuid4().hex[:12]}"
        Scratch.made.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write and reread ``df``: cuts the lineage, survives lost executors."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more; all of them if none is named."""
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(sc.hadoopConfiguration()).delete(path, True)

    @staticmethod
    def drop_since(count: int) -> None:
        """Delete the folders made after the first ``count``, once what was built on them is written."""
        while len(Scratch.made) > count:
            Scratch.made.pop().drop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII texts take the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def stable_files(docs: DataFrame, scratch: Scratch) -> tuple[str, str]:
    """Folder and file pattern that hold exactly ``docs``; writes them where they are no plain scan."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString().strip()
    found = docs.inputFiles() if plan.startswith("Relation") and "parquet" in plan and "\n" not in plan else []
    if len(found) == 1:
        return posixpath.dirname(found[0]), re.sub(r"([\[\]{}*?\\])", r"\\\1", posixpath.basename(found[0]))
    tops = {posixpath.dirname(f) for f in found}
    if len(tops) == 1 and len(docs.sparkSession.read.schema(docs.schema).parquet(top := tops.pop()).inputFiles()) == len(found):
        return top, "*.parquet"
    scratch.write(docs, "rows")
    return f"{scratch.path}/rows", "*.parquet"


def rescan(docs: DataFrame, files: tuple[str, str]) -> DataFrame:
    """A batch scan of ``stable_files``: by its own path where that is one file or a whole folder."""
    reader, found = docs.sparkSession.read.schema(docs.schema), docs.inputFiles()
    if len(found) == 1 and posixpath.dirname(found[0]) == files[0]:
        return reader.parquet(found[0])
    return reader.option("pathGlobFilter", files[1]).parquet(files[0])
