"""How far the metadata itself is protected, and whether its copies are independent of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import predicates as p
from holdfast.sources.adapter import Catalog


def topology(c: Catalog) -> DataFrame:
    """Active locations with a site: their storage domain and the risks they inherit, as a sorted set."""
    places = c.locations.filter(F.col("status") == "active").join(c.devices.select("device_id", "current_site_id"), "device_id", "left")
    domain = F.when(F.col("kind") == "service", F.concat(F.lit("service:"), "location_id")).otherwise(F.concat(F.lit("device:"), "device_id"))
    places = places.select("location_id", domain.alias("domain"), p.location_first_site().alias("site"), "archive_root_id", "device_id").filter("domain is not null and site is not null")
    kinds = (("location", "location_id"), ("archive_root", "archive_root_id"), ("device", "device_id"), ("site", "site"))
    asked = places.select("location_id", F.explode(F.array(*[F.struct(F.lit(t).alias("entity_type"), F.col(e).alias("entity_id")) for t, e in kinds])).alias("x")).select("location_id", "x.*")
    risks = asked.join(c.risk_assignments, ["entity_type", "entity_id"]).groupBy("location_id").agg(F.collect_set("risk_id").alias("risks"))
    return places.select("location_id", "domain", "site").join(risks, "location_id", "left").withColumn("risks", F.coalesce("risks", F.array().cast("array<string>")))


def independence(c: Catalog, destinations: DataFrame, catalog_location: str | None) -> DataFrame:
    """destinations (destination_id, location_id, local) -> status and reasons: overlap of storage, site or risk with the catalog's own place."""
    known = topology(c)
    own = known.filter(F.col("location_id") == F.lit(catalog_location)).agg(F.first("domain").alias("own_domain"), F.first("site").alias("own_site"), F.first("risks").alias("own_risks"))
    rows = destinations.join(known, "location_id", "left").join(own, F.lit(True))
    lost = F.when(F.col("local"), "local_remote_storage_identity_unverified").when(F.lit(catalog_location is None), "catalog_location_unconfigured").when(F.col("domain").isNull() | F.col("own_domain").isNull(), "location_topology_unresolved")
    overlap = F.array_compact(F.array(F.when(F.col("domain") == F.col("own_domain"), "same_storage_domain"), F.when(F.col("site") == F.col("own_site"), "same_site"), F.when(F.arrays_overlap("risks", "own_risks"), "shared_custom_risk_domain")))
    status = F.when(lost.isNotNull(), "unknown").when(F.size(overlap) == 0, "independent").otherwise("overlapping")
    return rows.select("destination_id", status.alias("status"), F.when(lost.isNotNull(), F.array(lost)).otherwise(overlap).alias("reasons"))


def protection(checkpoints: DataFrame, replications: DataFrame, destinations: DataFrame, applied_seq: int, topology_seq: int) -> DataFrame:
    """One row: how far events are checkpointed, committed and independently replicated, and how many are not.

    checkpoints (checkpoint_id, last_seq, committed); replications (checkpoint_id, destination_id, status,
    independence, event_seq); destinations (destination_id, status, event_seq). A replication counts if it
    is verified and independent, behind the last change of its destination and not before the last change
    of the topology, and its destination is active.
    """
    live = destinations.filter(F.col("status") == "active").select("destination_id", F.col("event_seq").alias("_changed"))
    good = replications.filter((F.col("status") == "verified") & (F.col("independence") == "independent")).join(live, "destination_id").filter((F.col("event_seq") > F.col("_changed")) & (F.col("event_seq") >= topology_seq))
    marked = checkpoints.join(good.select("checkpoint_id").distinct().withColumn("_safe", F.lit(True)), "checkpoint_id", "left")
    zero = lambda x: F.coalesce(F.max(x), F.lit(0))
    seq = F.col("last_seq")
    out = marked.agg(zero(seq).alias("checkpointed"), zero(F.when(F.col("committed"), seq)).alias("committed"), zero(F.when(F.col("committed") & F.col("_safe"), seq)).alias("protected"))
    gap = lambda c: F.greatest(F.lit(0), F.lit(applied_seq) - F.col(c))
    return out.select("*", gap("checkpointed").alias("uncheckpointed"), gap("committed").alias("uncommitted"), gap("protected").alias("unreplicated"))


def latest_replication(replications: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The replication of the furthest checkpoint of each destination; of several of one checkpoint the last by event_seq, then the greatest, so no order of rows decides."""
    rows = replications.join(checkpoints.select("checkpoint_id", "last_seq"), "checkpoint_id")
    return rows.groupBy("destination_id").agg(F.max(F.struct("last_seq", "checkpoint_id", "event_seq", "status", "independence")).alias("x")).select("destination_id", *[f"x.{c}" for c in ("checkpoint_id", "status", "independence", "event_seq")])
