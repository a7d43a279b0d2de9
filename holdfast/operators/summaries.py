"""Counts of copies and their health, by collection, location, device and site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast.functions import predicates as p
from holdfast.sources.adapter import Catalog


def _located(c: Catalog) -> DataFrame:
    """Locations with their site, by the location first."""
    return c.locations.join(c.devices.select("device_id", "current_site_id"), "device_id", "left").select("location_id", "device_id", p.location_first_site().alias("site"))


def collection_protection(c: Catalog, as_of: int, age: int) -> DataFrame:
    """Long form of each collection's histograms: collection_id, measure, bucket, n. Bucket 0 is always there.

    Copies are counted for each object before they meet the objects, so objects without files cost one row.
    """
    joined = c.files.join(c.objects.select("object_id", "expected"), "object_id").join(_located(c), "location_id", "left")
    present = F.col("presence") == "present"
    recent = p.verified_copy() & p.within("last_success_ms", as_of, age)
    counts = joined.groupBy("object_id").agg(
        F.count_if(present).alias("present_copies"), p.total(recent).alias("recent_copies"),
        F.count_distinct(F.when(present, F.col("site"))).alias("present_sites"), F.count_distinct(F.when(recent, F.col("site"))).alias("recent_sites"),
        F.max(p.flag(present & F.col("site").isNull())).alias("present_unknown_site"), F.max(p.flag(recent & F.col("site").isNull())).alias("recent_unknown_site"),
    )
    per = c.objects.select("object_id", "collection_id", "expected").join(counts, "object_id", "left")
    zero = lambda n: F.coalesce(n, F.lit(0))
    histograms = ("present_copies", "recent_copies", "present_sites", "recent_sites")
    # one pass: each object adds to four buckets and to the totals
    adds = [F.struct(F.lit(n).alias("measure"), zero(n).cast("long").alias("bucket"), F.lit(1).cast("long").alias("n")) for n in histograms]
    totals = {"total_files": F.lit(1), "without_expected": p.flag(F.col("expected").isNull()), "present_unknown_site": zero("present_unknown_site"), "recent_unknown_site": zero("recent_unknown_site")}
    adds += [F.struct(F.lit(n).alias("measure"), F.lit(0).cast("long").alias("bucket"), x.cast("long").alias("n")) for n, x in totals.items()]
    rows = per.select("collection_id", F.explode(F.array(*adds)).alias("x")).select("collection_id", "x.*")
    names = F.explode(F.array(*[F.lit(n) for n in (*histograms, *totals)])).alias("measure")
    floor = c.collections.select("collection_id", names).select("collection_id", "measure", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("n"))
    return rows.unionByName(floor).groupBy("collection_id", "measure", "bucket").agg(F.sum("n").alias("n"))


LOCATION_MEASURES = ("tracked", "present", "missing", "unknown", "verified", "recent", "stale", "unverified", "damaged", "never_verified", "unresolved", "without_recent_other_copy")


def location_summary(c: Catalog, as_of: int, age: int, location: str | None = None) -> DataFrame:
    """Twelve measures by location and collection.

    Another recent copy is a count for each object less this copy's own, not a correlated search.
    """
    joined = c.files.join(c.objects.select("object_id", "collection_id", "expected"), "object_id")
    healthy = F.coalesce(p.verified_copy() & (F.col("last_success_ms") <= as_of), F.lit(False))
    recent = F.coalesce(p.verified_copy() & p.within("last_success_ms", as_of, age), F.lit(False))
    marked = joined.withColumns({"healthy": healthy, "recent": recent})
    others = marked.filter("recent").groupBy("object_id").agg(F.count(F.lit(1)).alias("recent_copies"))
    mine = marked if location is None else marked.filter(F.col("location_id") == location)
    mine = mine.join(others, "object_id", "left")
    here, cutoff = F.col("presence") == "present", max(0, as_of - age)
    damaged = F.col("integrity") == "damaged"
    alone = F.coalesce("recent_copies", F.lit(0)) - F.col("recent").cast("int") == 0
    conditions = (
        F.lit(True), here, F.col("presence") == "missing", F.col("presence") == "unknown", F.col("healthy"), F.col("healthy") & (F.col("last_success_ms") >= cutoff), F.col("healthy") & (F.col("last_success_ms") < cutoff),
        here & ~damaged & ~F.col("healthy"), here & damaged, here & F.col("last_success_ms").isNull(), F.col("expected").isNull(), here & alone,
    )
    return mine.groupBy("location_id", "collection_id").agg(*[p.total(x).alias(n) for n, x in zip(LOCATION_MEASURES, conditions, strict=True)])


def location_totals(c: Catalog, as_of: int, age: int) -> DataFrame:
    """The measures of every location over its collections; locations without files have zeros."""
    sums = location_summary(c, as_of, age).groupBy("location_id").agg(*[F.sum(n).alias(n) for n in LOCATION_MEASURES])
    return c.locations.select("location_id").join(sums, "location_id", "left").na.fill(0)


SCOPES = ("archive", "collection_id", "location_id", "device_id", "site")
FILE_COUNTS = ("present_files", "missing_files", "unknown_files", "verified_present_files", "damaged_files")


def scope_summaries(c: Catalog, scopes: tuple[str, ...] = SCOPES) -> DataFrame:
    """kind, scope, and its objects and files, counted apart from each other. The archive and collections count objects without files too.

    Files meet their objects once, and are then summed by place and collection. Of an object's files on one
    device, or at one site, the first counts the object there, so nothing has to be made distinct.
    """
    joined = c.files.join(c.objects.select("object_id", "collection_id", "expected"), "object_id").join(_located(c), "location_id")
    first = lambda x: F.row_number().over(W.partitionBy("object_id", x).orderBy("location_id")) == 1
    conditions = (F.col("presence") == "present", F.col("presence") == "missing", F.col("presence") == "unknown", p.verified_copy(), F.col("integrity") == "damaged")
    marked = joined.select(
        "location_id", "device_id", "site", "collection_id", F.col("expected").isNull().alias("unresolved"), first("device_id").alias("on_device"), first("site").alias("at_site"),
        *[F.coalesce(x, F.lit(False)).alias(n) for n, x in zip(FILE_COUNTS, conditions, strict=True)],
    )
    counted = {"location_id": F.lit(True), "device_id": F.col("on_device"), "site": F.col("at_site")}
    sums = [x for k, v in counted.items() for x in (F.count_if(v).alias(f"{k}_objects"), F.count_if(v & F.col("unresolved")).alias(f"{k}_unresolved"))]
    places = marked.groupBy("location_id", "device_id", "site", "collection_id").agg(*sums, *[F.count_if(F.col(n)).alias(n) for n in FILE_COUNTS])
    zero = F.lit(0).cast("long")
    row = lambda kind, scope, objects, unresolved, counts: F.struct(F.lit(kind).alias("kind"), scope.alias("scope"), objects.alias("objects"), unresolved.alias("unresolved_objects"), *[x.alias(n) for n, x in zip(FILE_COUNTS, counts, strict=True)])
    files = [F.col(n) for n in FILE_COUNTS]
    each = {"archive": row("archive", F.lit("archive"), zero, zero, files), "collection_id": row("collection_id", F.col("collection_id"), zero, zero, files)}
    each |= {k: row(k, F.col(k), F.col(f"{k}_objects"), F.col(f"{k}_unresolved"), files) for k in counted}
    whole = c.objects.groupBy("collection_id").agg(F.count(F.lit(1)).alias("objects"), F.count_if(F.col("expected").isNull()).alias("unresolved"))
    alone = [row(k, F.lit("archive") if k == "archive" else F.col("collection_id"), F.col("objects"), F.col("unresolved"), [zero] * len(files)) for k in ("archive", "collection_id") if k in scopes]
    rows = places.select(F.explode(F.array(*[each[k] for k in scopes])).alias("x"))
    if alone:
        rows = rows.unionByName(whole.select(F.explode(F.array(*alone)).alias("x")))
    return rows.select("x.*").filter("scope is not null").groupBy("kind", "scope").agg(*[F.sum(n).alias(n) for n in ("objects", "unresolved_objects", *FILE_COUNTS)])


def scope_summary(c: Catalog, scope: str) -> DataFrame:
    """Objects and files of one kind of scope: archive, collection_id, location_id, device_id or site."""
    return scope_summaries(c, (scope,)).drop("kind")


def site_devices(c: Catalog) -> DataFrame:
    """Devices now at each site, retired ones too."""
    sites = c.sites.select(F.col("site_id"), F.col("display_name").alias("site_name"))
    return c.devices.join(sites, c.devices["current_site_id"] == sites["site_id"]).select("site_id", "site_name", "device_id", "status", "expected_availability")


def registry_state(c: Catalog, active_only: bool = True) -> DataFrame:
    """All dimension rows in one shape."""
    part = lambda d, kind, id_, name: d.select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), F.col(name).alias("name"), "status")
    rows = part(c.sites, "site", "site_id", "display_name").union(part(c.devices, "device", "device_id", "display_name")).union(part(c.locations, "location", "location_id", "display_name"))
    rows = rows.union(part(c.collections, "collection", "collection_id", "display_name")).union(part(c.archive_roots, "archive_root", "archive_root_id", "archive_root_id"))
    return rows.filter(F.col("status") == "active") if active_only else rows


def collection_of_location(c: Catalog) -> DataFrame:
    """The collection of each location, where its files tell exactly one active collection; else how many they tell."""
    active = c.collections.filter(F.col("status") == "active").select("collection_id")
    pairs = c.files.select("location_id", "object_id").join(c.objects.select("object_id", "collection_id"), "object_id").join(active, "collection_id", "left_semi").select("location_id", "collection_id").distinct()
    found = pairs.groupBy("location_id").agg(F.count(F.lit(1)).alias("n"), F.min("collection_id").alias("first"))
    return c.locations.select("location_id").join(found, "location_id", "left").select("location_id", F.coalesce("n", F.lit(0)).alias("collections"), F.when(F.col("n") == 1, F.col("first")).alias("collection_id"))


def health_check(c: Catalog) -> DataFrame:
    """Broken references and duplicate keys: check, violations."""
    def orphans(name: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
        lost = child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
        return lost.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")

    def doubles(name: str, table: DataFrame, *keys: str) -> DataFrame:
        return table.groupBy(*keys).count().filter("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations")).select(F.lit(name).alias("check"), "violations")

    parts = [
        orphans("files.object", c.files, "object_id", c.objects, "object_id"), orphans("files.location", c.files, "location_id", c.locations, "location_id"),
        orphans("objects.collection", c.objects, "collection_id", c.collections, "collection_id"), orphans("locations.device", c.locations, "device_id", c.devices, "device_id"),
        orphans("locations.site", c.locations, "site_id", c.sites, "site_id"), orphans("devices.site", c.devices, "current_site_id", c.sites, "site_id"), orphans("mounts.root", c.mounts, "archive_root_id", c.archive_roots, "archive_root_id"),
        doubles("files.key", c.files, "object_id", "location_id"), doubles("objects.path", c.objects, "collection_id", "path_encoding", "path_bytes"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
