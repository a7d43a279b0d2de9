"""Coverage of a collection's content by qualifying copies, whoever owns them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import predicates as p
from holdfast.sources.adapter import Catalog


def coverage(c: Catalog, seen_since: int, verified_since: int, checkin_since: int, home: str | None, collection: str | None = None, active: bool = True) -> DataFrame:
    """content_id -> copies, devices, sites, and flags. Cutoffs count; the future is accepted; a location counts once.

    The scan starts from the content of the collection, so copies of other content are dropped before anything is grouped.
    """
    wanted = c.file_refs.filter((F.col("state") == "active") & F.col("content_id").isNotNull() & F.lit(active))
    if collection is not None:
        wanted = wanted.filter(F.col("collection_id") == collection)
    error = F.col("error_code")
    held = c.copies.filter((F.col("state") == "present") & (F.col("last_seen_ms") >= seen_since) & (F.col("last_verified_ms") >= verified_since) & (F.col("integrity_code") == 1) & (error.isNull() | ~error.isin("read_error", "identity_mismatch")))
    eligible = held.select("content_id", "location_id").join(wanted.select("content_id"), "content_id", "left_semi").distinct()
    places = c.locations.filter(F.col("status") == "active").select("location_id", "device_id", "site_id", "expected_availability", "encryption_state")
    devices = c.devices.filter(F.col("status") == "active").select("device_id", "current_site_id", "identity_state", "fingerprint_status", "last_checkin_ms", F.lit(True).alias("known"))
    fit = F.col("device_id").isNull() | (F.col("known") & (F.col("identity_state") == "confirmed") & (F.col("fingerprint_status") == "match") & (F.col("last_checkin_ms") >= checkin_since))
    places = places.join(devices, "device_id", "left").filter(fit).select("location_id", "device_id", p.device_first_site().alias("site"), "expected_availability", "encryption_state")
    away = (F.col("site") != home) if home is not None else F.lit(False)
    return eligible.join(places, "location_id").groupBy("content_id").agg(
        F.count(F.lit(1)).alias("copies"), F.count_distinct("device_id").alias("devices"), F.count_distinct("site").alias("sites"), F.max(p.flag(away)).alias("has_offsite"),
        F.max(p.flag(F.col("expected_availability") == "offline")).alias("has_offline"), F.max(p.flag(away & (F.col("encryption_state") == "encrypted"))).alias("has_encrypted_offsite"),
    )


MEASURES = ("copies", "devices", "sites", "has_offsite", "has_offline", "has_encrypted_offsite")


def details(c: Catalog, covered: DataFrame, collection: str) -> DataFrame:
    files = c.file_refs.filter((F.col("state") == "active") & (F.col("collection_id") == collection))
    return files.join(covered, "content_id", "left").select("file_id", "path", "content_id", "size", *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in MEASURES])


def totals(rows: DataFrame, needs: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """details -> for each vector of least values: files, bytes, at risk, without content."""
    each = F.array(*[F.struct(F.lit(i).alias("vector"), *[F.lit(x).alias(f"need_{m}") for m, x in zip(MEASURES, v, strict=True)]) for i, v in enumerate(needs)])
    rows = rows.select("*", F.explode(each).alias("v"))
    short = F.lit(False)
    for m in MEASURES:
        short = short | (F.col(m) < F.col(f"v.need_{m}"))
    known = F.col("content_id").isNotNull()
    return rows.groupBy(F.col("v.vector").alias("vector")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"), F.count_if(known & short).alias("at_risk"), F.count_if(~known).alias("unresolved"))
