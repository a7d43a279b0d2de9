"""State of collections, locations and their freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast.functions import predicates as p
from holdfast.sources.adapter import Catalog


def latest(rows: DataFrame, keys: list[str], *order: F.Column) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def latest_mounts(c: Catalog, mounted_only: bool = False) -> DataFrame:
    rows = c.mounts.filter(F.col("status") == "mounted") if mounted_only else c.mounts
    return latest(rows, ["archive_root_id", "host"], F.col("observed_ms").desc(), F.col("mount_id").desc())


def device_mounts(c: Catalog) -> DataFrame:
    """The last mounted mount of each device: filtered before it is ranked."""
    rows = c.mounts.filter(F.col("status") == "mounted").join(c.archive_roots.select("archive_root_id", "device_id"), "archive_root_id")
    return latest(rows, ["device_id"], F.col("observed_ms").desc(), F.col("mount_id").desc())


def collection_summary(c: Catalog) -> DataFrame:
    owned = c.copies.filter(F.col("state") != "superseded").join(c.file_refs.select("file_id", "collection_id"), "file_id")
    places = owned.groupBy("collection_id").agg(F.count_distinct("location_id").alias("locations"))
    files = c.file_refs.filter(F.col("state") == "active").groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if(F.col("content_id").isNull()).alias("unresolved"), F.count_distinct("content_id").alias("contents")
    )
    return c.collections.select("collection_id", "display_name").join(files, "collection_id", "left").join(places, "collection_id", "left").na.fill(0)


def location_states(c: Catalog) -> DataFrame:
    """Copies and bytes of each location by state, in columns, with last sight and last verification."""
    rows = c.copies.join(c.file_refs.select("file_id", "size"), "file_id")
    states = ("present", "missing", "corrupt", "unknown")
    aggs = []
    for s in states:
        own = F.col("state") == s
        aggs += [F.count_if(own).alias(f"{s}_copies"), F.coalesce(F.sum(F.when(own, F.col("size"))), F.lit(0)).alias(f"{s}_bytes")]
    aggs += [F.count_if(F.col("content_id").isNull()).alias("unresolved"), F.max("last_seen_ms").alias("last_inventory_ms"), F.max("last_verified_ms").alias("last_verification_ms")]
    return rows.groupBy("location_id").agg(*aggs)


def membership(c: Catalog) -> DataFrame:
    """Collections and the locations they touch: by a copy, or by a scan that has not failed."""
    seen = c.copies.join(c.file_refs.select("file_id", "collection_id"), "file_id").select("collection_id", "location_id")
    scanned = c.scans.filter(F.col("status").isin("running", "complete", "partial")).select("collection_id", "location_id")
    return seen.union(scanned).distinct()


def stale_presence(c: Catalog, now: int, days: dict[str, int]) -> DataFrame:
    """Present copies that were last seen before the cutoff of any collection that owns their content.

    Last seen is the later of the sighting and the end of the location's last complete scan of the
    collection. Counts are distinct contents: by location, by device (or service), and in the archive.
    """
    cutoffs = F.create_map(*[x for k, v in days.items() for x in (F.lit(k), F.lit(now - v * p.DAY_MS).cast("long"))])
    done = c.scans.filter(F.col("status") == "complete").groupBy("location_id", "collection_id").agg(F.max("finished_ms").alias("scanned_ms"))
    owners = c.file_refs.filter((F.col("state") == "active") & F.col("content_id").isNotNull()).select("content_id", "collection_id").distinct()
    held = c.copies.filter((F.col("state") == "present") & F.col("content_id").isNotNull()).join(c.file_refs.select("file_id", F.col("collection_id").alias("own")), "file_id")
    seen = held.join(done.withColumnRenamed("collection_id", "own"), ["location_id", "own"], "left").select("content_id", "location_id", F.greatest("last_seen_ms", "scanned_ms").alias("effective_ms"))
    stale = seen.join(owners, "content_id").filter(F.col("effective_ms") < F.try_element_at(cutoffs, F.col("collection_id"))).select("content_id", "location_id").distinct()
    rows = stale.join(c.locations.select("location_id", "device_id"), "location_id")
    holder = F.coalesce("device_id", F.concat(F.lit("service:"), "location_id"))
    every = F.array(F.struct(F.lit("location").alias("scope"), F.col("location_id").alias("id")), F.struct(F.lit("holder").alias("scope"), holder.alias("id")), F.struct(F.lit("archive").alias("scope"), F.lit("").alias("id")))
    return rows.select("content_id", F.explode(every).alias("x")).select("content_id", "x.*").distinct().groupBy("scope", "id").agg(F.count(F.lit(1)).alias("contents"))


def location_freshness(c: Catalog) -> DataFrame:
    """Last scan, last complete scan, and whether the location can be reached."""
    order = (F.col("started_ms").desc(), F.col("scan_id").desc())
    last = latest(c.scans, ["location_id"], *order).select("location_id", F.col("scan_id").alias("last_scan"), F.col("status").alias("last_status"))
    whole = latest(c.scans.filter(F.col("status") == "complete"), ["location_id"], *order).select("location_id", F.col("scan_id").alias("last_complete"), F.col("finished_ms").alias("complete_ms"))
    mount = device_mounts(c).select("device_id", F.col("host").alias("mounted_on"))
    rows = c.locations.join(last, "location_id", "left").join(whole, "location_id", "left").join(mount, "device_id", "left").join(c.devices.select("device_id", "fingerprint_status"), "device_id", "left")
    reach = (
        F.when(F.col("kind") == "service", "service").when(F.col("mounted_on").isNotNull() & (F.col("fingerprint_status") == "match"), "available")
        .when(F.col("mounted_on").isNotNull(), "unconfirmed").when(F.col("expected_availability") == "offline", "offline_expected").otherwise("unavailable")
    )
    return rows.select("location_id", "last_scan", "last_status", "last_complete", "complete_ms", reach.alias("availability"))
