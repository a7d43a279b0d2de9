"""A stream folded into versions of a state table.

The state is kept in buckets of its key, as the parts that its fold is made of. Each micro-batch folds its own
rows, merges them with the parts of the buckets that it touches, and writes only those buckets anew; a
manifest names for each bucket the batch that wrote it, and is renamed into place last. So a batch costs
what it touches, history is never read again, and a batch that is replayed finds its manifest and does nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from holdfast.operators import scans
from holdfast.streaming import state


@dataclass(frozen=True)
class Fold:
    """How rows become parts of a state, how parts are merged (further columns are keys), and what the state is."""

    keys: tuple[str, ...]
    parts: Callable[..., DataFrame]
    merge: Callable[..., DataFrame]
    finish: Callable[[DataFrame], DataFrame]


OBSERVATIONS = Fold(("object_id", "location_id"), scans.fold_parts, scans.merge_parts, scans.finish_parts)
COPIES = Fold(("copy_id",), state.copy_parts, state.merge_copies, state.finish_copies)


class StateTable:
    def __init__(self, spark: SparkSession, root: str, fold: Fold = OBSERVATIONS, buckets: int = 32):
        self.spark, self.root, self.fold, self.buckets = spark, root.rstrip("/"), fold, buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(self._path(folder))] if fs.exists(self._path(folder)) else []

    def versions(self) -> list[int]:
        """Batches that are applied: their manifests are there."""
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json"))

    def _manifest(self) -> dict[str, int]:
        found = self.versions()
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{found[-1]}.json", wholetext=True).first()[0]) if found else {}

    def _publish(self, manifest: dict[str, int], epoch: int) -> None:
        fs, hidden = self._fs(), self._path(f"manifests/_{epoch}.tmp")
        out = fs.create(hidden, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(hidden, self._path(f"manifests/{epoch}.json")):
            raise OSError(f"version {epoch} could not be published")

    def _read(self, manifest: dict[str, int], schema) -> DataFrame:
        paths = [f"{self.root}/state/{epoch}/bucket={bucket}" for bucket, epoch in manifest.items()]
        return self.spark.read.schema(schema).parquet(*paths)

    def current(self) -> DataFrame | None:
        manifest = self._manifest()
        if not manifest:
            return None
        bucket, epoch = next(iter(manifest.items()))
        return self.fold.finish(self._read(manifest, self.spark.read.parquet(f"{self.root}/state/{epoch}/bucket={bucket}").schema))

    def apply(self, batch: DataFrame, epoch: int, *context: DataFrame) -> None:
        """Fold a batch in. What a failed attempt left behind is overwritten, as no manifest names it."""
        done = self.versions()
        if done and epoch <= done[-1]:
            return
        staged = f"{self.root}/parts/{epoch}"
        bucket = F.pmod(F.xxhash64(*self.fold.keys), F.lit(self.buckets)).cast("int")
        self.fold.parts(batch, *context).withColumn("bucket", bucket).write.mode("overwrite").parquet(staged)
        fresh = self.spark.read.parquet(staged)
        touched = {str(r["bucket"]) for r in fresh.select("bucket").distinct().collect()}  # at most the buckets
        manifest = self._manifest()
        before = {b: e for b, e in manifest.items() if b in touched}
        rows = fresh
        if before:
            rows = fresh.unionByName(self._read(before, fresh.drop("bucket").schema).withColumn("bucket", bucket))
        if touched:
            self.fold.merge(rows, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/state/{epoch}")
        manifest |= dict.fromkeys(touched, epoch)
        self._publish(manifest, epoch)
        self._fs().delete(self._path(f"parts/{epoch}"), True)
        self._clear(manifest, epoch)

    def _clear(self, manifest: dict[str, int], epoch: int) -> None:
        """Drop what neither this version nor the one before it names, for readers that began with that one."""
        named = {f"{e}/bucket={b}" for b, e in manifest.items()}
        done = self.versions()
        if len(done) > 1:
            last = json.loads(self.spark.read.text(f"{self.root}/manifests/{done[-2]}.json", wholetext=True).first()[0])
            named |= {f"{e}/bucket={b}" for b, e in last.items()}
        for e in self._names("state"):
            if int(e) <= epoch:
                for b in self._names(f"state/{e}"):
                    if b.startswith("bucket=") and f"{e}/{b}" not in named:
                        self._fs().delete(self._path(f"state/{e}/{b}"), True)

    def follow(self, stream: DataFrame, *context: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(lambda df, epoch: self.apply(df, epoch, *context)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
