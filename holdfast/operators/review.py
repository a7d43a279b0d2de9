"""Finding and reviewing files by content, across the copies that any file brings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast.functions import predicates as p
from holdfast.operators.find import Group
from holdfast.sources.adapter import Catalog


def _held(c: Catalog, g: Group, as_of: int) -> DataFrame:
    rows = c.copies.filter((F.col("state") == "present") & F.col("location_id").isin(*g.locations))
    if g.verified_within is not None:
        rows = rows.filter((F.col("verification_result") == "ok") & F.col("last_verified_ms").between(max(0, as_of - g.verified_within), as_of))
    return rows


def find_files(c: Catalog, groups: list[Group], as_of: int, collection: str | None = None) -> DataFrame:
    """Active files whose content is where the groups say. The first positive group also needs a path of its own there."""
    out = c.file_refs.filter(F.col("state") == "active").filter(F.col("content_id").isNotNull())
    if collection is not None:
        out = out.filter(F.col("collection_id") == collection)
    first = next((g for g in groups if not g.negated), None)
    for g in groups:
        out = out.join(_held(c, g, as_of).select("content_id"), "content_id", "left_anti" if g.negated else "left_semi")
        if g is first:
            out = out.join(sources(c, g).select("content_id"), "content_id", "left_semi")
    return out


def sources(c: Catalog, g: Group) -> DataFrame:
    """content_id, location_id, path: where the group's locations keep the content under a known path."""
    held = c.copies.filter((F.col("state") == "present") & F.col("location_id").isin(*g.locations) & F.col("content_id").isNotNull())
    return held.join(c.file_refs.select("file_id", "path"), "file_id").select("content_id", "location_id", "path").distinct()


def copy_metrics(c: Catalog) -> DataFrame:
    """By content: copies, present ones, last seen, last verified. Superseded copies don't count; external identity serves only without content."""
    rows = c.copies.filter(F.col("state") != "superseded").select("*", p.content_key(file=None).alias("key")).filter("key is not null")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.count_if(F.col("state") == "present").alias("present"), F.max("last_seen_ms").alias("last_seen_ms"), F.max(F.when(F.col("verification_result") == "ok", F.col("last_verified_ms"))).alias("last_verified_ms"))


def review_files(c: Catalog, files: DataFrame) -> DataFrame:
    """A page of files with its metrics: the join comes after the page."""
    keyed = files.withColumn("key", p.content_key())
    return keyed.join(copy_metrics(c), "key", "left").na.fill(0, ["copies", "present"])


def list_copies(c: Catalog, *, location: str | None = None, device: str | None = None, state: str | None = None, collection: str | None = None, content: str | None = None, seen_before: int | None = None, verified_before: int | None = None, result: str | None = None, file: str | None = None) -> DataFrame:
    """Copies by optional filters. The times before which include never."""
    rows = c.copies.join(c.locations.select("location_id", "device_id"), "location_id")
    for name, value in (("location_id", location), ("device_id", device), ("state", state), ("content_id", content), ("verification_result", result), ("file_id", file)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    for name, value in (("last_seen_ms", seen_before), ("last_verified_ms", verified_before)):
        if value is not None:
            rows = rows.filter(F.col(name).isNull() | (F.col(name) < value))
    if collection is not None:
        rows = rows.join(c.file_refs.filter(F.col("collection_id") == collection).select("file_id"), "file_id", "left_semi")
    return rows


def integrity_report(c: Catalog) -> DataFrame:
    """Corrupt copies, each with every verified present copy of the same content, newest first by rank."""
    bad = c.copies.filter(F.col("state") == "corrupt").select("content_id", F.col("copy_id").alias("corrupt_copy"), F.col("location_id").alias("corrupt_location"))
    good = c.copies.filter((F.col("state") == "present") & (F.col("verification_result") == "ok")).select("content_id", F.col("copy_id").alias("good_copy"), "last_verified_ms")
    return bad.join(good, "content_id", "left")


def review_contents(contents: DataFrame, hashes: DataFrame, files: DataFrame, limit: int = 100) -> DataFrame:
    """contents (content_id, ...) with all their hashes (content_id, algorithm, digest, source) and the first page of active files of each.

    A page is `limit` files by path, with a flag whether there are more; files are numbered and cut before they are gathered.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("a page has 1 to 1000 files")
    known = hashes.groupBy("content_id").agg(F.array_sort(F.collect_set(F.struct("algorithm", "digest", "source"))).alias("hashes"))
    own = W.partitionBy("content_id").orderBy("collection_id", "path", "file_id")
    active = files.filter((F.col("state") == "active") & F.col("content_id").isNotNull()).select("content_id", "collection_id", "path", "file_id")
    page = active.withColumn("_at", F.row_number().over(own)).filter(F.col("_at") <= limit + 1)
    page = page.groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("_at", "collection_id", "path", "file_id"))).alias("files"))
    rows = contents.join(known, "content_id", "left").join(page, "content_id", "left").withColumn("files", F.coalesce("files", F.array().cast(page.schema["files"].dataType)))
    return rows.withColumns({"more": F.size("files") > limit, "files": F.transform(F.slice("files", 1, limit), lambda x: x.dropFields("_at")), "hashes": F.coalesce("hashes", F.array().cast(known.schema["hashes"].dataType))})


def shared_identity(files: DataFrame) -> DataFrame:
    """Files that share an external identity with another one: file_id, other_id."""
    own = files.filter("external_id is not null").select("external_id", "file_id")
    return own.join(own.withColumnRenamed("file_id", "other_id"), "external_id").filter("file_id <> other_id").select("file_id", "other_id")
