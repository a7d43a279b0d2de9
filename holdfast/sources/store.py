"""Catalogs as folders of tables with a manifest: created once, opened with their schema checked, copied and compared.

The manifest is renamed into place last, so a folder without it is no catalog, whatever else lies there.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators import scans
from holdfast.sources.adapter import TABLES, Catalog

VERSION = 1
#: Large tables and the key that their rows are kept together by, so that readers get sorted files of about equal size.
KEPT_BY = {"objects": "object_id", "files": "object_id", "file_refs": "file_id", "copies": "file_id", "observations": "object_id"}


class NotACatalog(ValueError):
    """There is no manifest, or one of another version or other tables."""


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def create(c: Catalog, root: str, revision: int = 1) -> None:
    """Write all tables and then the manifest; a folder that is there is refused."""
    spark = c.sites.sparkSession
    top, fs = _path(spark, root)
    if fs.exists(top):
        raise FileExistsError(root)
    manifest = {"version": VERSION, "revision": revision, "tables": {}}
    for name in TABLES:
        table: DataFrame = getattr(c, name)
        key = KEPT_BY.get(name)
        (table.repartition(key).sortWithinPartitions(key) if key else table).write.parquet(f"{root}/{name}")
        manifest["tables"][name] = {"schema": table.schema.jsonValue(), "rows": spark.read.parquet(f"{root}/{name}").count()}
    hidden = _path(spark, f"{root}/_manifest.tmp")[0]
    out = fs.create(hidden, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not fs.rename(hidden, _path(spark, f"{root}/manifest.json")[0]):
        raise OSError(f"{root} could not be published")


def manifest(spark: SparkSession, root: str) -> dict:
    path, fs = _path(spark, f"{root}/manifest.json")
    if not fs.exists(path):
        raise NotACatalog(f"{root} has no manifest")
    found = json.loads(spark.read.text(f"{root}/manifest.json", wholetext=True).first()[0])
    if found.get("version") != VERSION or set(found["tables"]) != set(TABLES):
        raise NotACatalog(f"{root} is of another version")
    return found


def open_catalog(spark: SparkSession, root: str) -> Catalog:
    """The tables, never created or changed; a table whose schema is not that of the manifest is an error."""
    tables = {}
    for name, entry in manifest(spark, root)["tables"].items():
        want, table = T.StructType.fromJson(entry["schema"]), spark.read.parquet(f"{root}/{name}")
        if [(f.name, f.dataType) for f in want.fields] != [(f.name, f.dataType) for f in table.schema.fields]:
            raise NotACatalog(f"{root}/{name} has another schema than the manifest says")
        tables[name] = table
    return Catalog(**tables)


def status(spark: SparkSession, root: str) -> DataFrame:
    """table, rows, expected, whole: what is there against what the manifest says."""
    c, known = open_catalog(spark, root), manifest(spark, root)["tables"]
    out = None
    for name in TABLES:
        n = F.count(F.lit(1))
        row = getattr(c, name).agg(n.alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit(known[name]["rows"]).cast("long").alias("expected"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("whole", F.col("rows") == F.col("expected"))


def compare(a: Catalog, b: Catalog) -> DataFrame:
    """table, rows, equal: whether a copy holds the same rows, by digests that do not depend on their order."""
    out = None
    for name in TABLES:
        left, right = (scans.ordered_digest(_plain(getattr(x, name))) for x in (a, b))
        row = left.crossJoin(right.toDF("other_rows", "other_digest"))  # one row each
        row = row.select(F.lit(name).alias("table"), "rows", (F.col("digest") == F.col("other_digest")).alias("equal"))
        out = row if out is None else out.unionByName(row)
    return out


def _plain(table: DataFrame) -> DataFrame:
    return table.select(*[F.lower(F.hex(f.name)).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name) for f in table.schema.fields])


def backup(spark: SparkSession, root: str, target: str) -> DataFrame:
    """A copy of a catalog in a new folder, and how it compares; a copy that differs is an error."""
    source = open_catalog(spark, root)
    create(source, target, manifest(spark, root)["revision"])
    found = compare(source, open_catalog(spark, target))
    if found.filter(~F.coalesce("equal", F.lit(False))).limit(1).count():
        raise OSError(f"{target} is not the same as {root}")
    return found
