"""What the operators share: scratch tables in the shared folder, word rules, batch helpers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space and the controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of rows that go to a Python worker at once, about.
BATCH_BYTES = 4 << 20
#: Bytes of text that a Python task works on at once; longer single texts form their own slice.
SLICE_BYTES = 8 << 20
#: The same where numpy makes several arrays of eight bytes for each byte of text.
NUMPY_BYTES = 1 << 19


def small_batches(df: DataFrame) -> DataFrame:
    """The same, in a session that hands rows to Python in batches of BATCH_BYTES, unless it has a setting of its own.

    Buffers of a batch lie outside of the heap, of two batches for each task, and grow by doubling.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local session without it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set: executors of {master or 'this cluster'} share no folder with the driver")
        found = f"file://{tempfile.mkdtemp(prefix='holdfast-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables of one query run, under a fresh name in the shared folder.

    A written table cuts the lineage, survives lost executors and gives the planner exact sizes.
    Tables that the returned DataFrame still reads stay; `drop` removes the others early.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/holdfast/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        # the written table replaces the shuffle files that led to it; they go once it is complete
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        try:
            df.write.option("compression", "zstd").parquet(self.path(name))
        finally:
            self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)
        return small_batches(self.spark.read.schema(df.schema).parquet(self.path(name)))

    def _at(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, *names: str) -> None:
        for name in names:
            path, fs = self._at(self.path(name))
            fs.delete(path, True)

    def only(self, *names: str) -> None:
        """Drop all tables but these."""
        path, fs = self._at(self.root)
        if fs.exists(path):
            self.drop(*(x for x in (s.getPath().getName() for s in fs.listStatus(path)) if x not in names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def word_count(text) -> F.Column:
    """Words of a text as a native expression; null counts as none."""
    text = F.coalesce(text, F.lit(""))
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.length(marks)).otherwise(F.lit(0)).cast("long")


def give_back() -> None:
    """Return freed memory to the system: workers stay alive between tasks, and glibc keeps what they freed."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, every: int = 0) -> Iterator[pa.RecordBatch]:
    """Cut batches evenly so that each slice holds about `limit` bytes of `column`; rows stay whole and in order.

    Memory is given back after a batch that ends `every` bytes or more: often keeps workers small, and costs time.
    """
    # the plain allocator gives large buffers back at once; a worker's memory is that of the batch at hand
    pa.set_memory_pool(pa.system_memory_pool())
    give_back()
    done = 0
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        whole = sum(sizes)
        share = whole / max(1, round(whole / limit))
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n / 2 > share:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
        batch = None
        done += whole
        if done >= every:
            give_back()
            done = 0
