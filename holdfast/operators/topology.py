"""Changes of the registry held against it before they are applied, and the topology that a scan needs.

Every function returns each change with the first fault that it has, or null. Changes carry an `action`:
register, update, retire, and move for devices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.sources.adapter import Catalog

#: States of the registry.
IDENTITIES, AVAILABILITIES = ("confirmed", "unavailable", "conflict"), ("online", "offline", "intermittent")
ROOT_FINGERPRINTS = ("filesystem_uuid", "filesystem_label", "partition_uuid", "partition_label", "mount_path", "path")
FINGERPRINT_STATES, MOUNT_STATES = ("match", "unavailable", "mismatch"), ("mounted", "unmounted", "mismatch")


def first_fault(*faults: tuple[str, Column]) -> Column:
    """The name of the first condition that holds; one that is unknown does not."""
    return F.coalesce(*[F.when(when, name) for name, when in faults])


def _empty(name: str) -> Column:
    return F.coalesce(F.trim(name) == "", F.lit(True))


def _none_of(name: str, values: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(name).isin(*values), F.lit(False))


def lifecycle(key: str) -> list[tuple[str, Column]]:
    """Faults that every kind of entity can have; `_known` tells that the registry has it."""
    register, retire = F.col("action") == "register", F.col("action") == "retire"
    return [
        ("id_required", _empty(key)), ("display_name_required", _empty("display_name")), ("status_not_retired", retire & (F.col("status") != "retired")), ("status_not_active", ~retire & (F.col("status") != "active")),
        ("already_exists", register & F.col("_known").isNotNull()), ("not_found", ~register & F.col("_known").isNull()),
    ]


def known(changes: DataFrame, table: DataFrame, key: str, **current: str) -> DataFrame:
    """changes with `_known` and current values (new name = column) of the registry's row."""
    return changes.join(table.select(key, F.lit(True).alias("_known"), *[F.col(v).alias(k) for k, v in current.items()]), key, "left")


def _refers(changes: DataFrame, table: DataFrame, key: str, column: str) -> DataFrame:
    """changes with a flag `_has_<column>` that the entity which the column names is there; null names nothing."""
    return changes.join(table.select(F.col(key).alias(column), F.lit(True).alias(f"_has_{column}")), column, "left")


def _lost(column: str) -> Column:
    return F.col(column).isNotNull() & F.col(f"_has_{column}").isNull()


def site_changes(changes: DataFrame, sites: DataFrame) -> DataFrame:
    rows = known(changes, sites, "site_id")
    return rows.select("change_id", first_fault(*lifecycle("site_id"), ("site_kind_required", _empty("site_kind"))).alias("fault"))


def policy_changes(changes: DataFrame, policies: DataFrame) -> DataFrame:
    """A policy's update must raise its version."""
    rows = known(changes, policies, "policy_id", _version="version")
    return rows.select("change_id", first_fault(*lifecycle("policy_id"), ("version_not_positive", F.col("version") <= 0), ("version_not_increased", (F.col("action") == "update") & (F.col("version") <= F.col("_version")))).alias("fault"))


def collection_changes(changes: DataFrame, c: Catalog) -> DataFrame:
    rows = _refers(_refers(known(changes, c.collections, "collection_id"), c.sites, "site_id", "home_site_id"), c.policies, "policy_id", "policy_id")
    return rows.select("change_id", first_fault(*lifecycle("collection_id"), ("home_site_not_found", _lost("home_site_id")), ("policy_not_found", _lost("policy_id"))).alias("fault"))


def device_changes(changes: DataFrame, devices: DataFrame, sites: DataFrame) -> DataFrame:
    """Devices (fingerprint, fingerprint_kind): evidence fits the identity state, a confirmed one is unique among active devices, and only a move changes the site."""
    rows = _refers(known(changes, devices, "device_id", _site="current_site_id"), sites, "site_id", "current_site_id")
    held = devices.filter((F.col("status") == "active") & (F.col("identity_state") == "confirmed")).groupBy("fingerprint_kind", "fingerprint").agg(F.min("device_id").alias("_least"), F.max("device_id").alias("_most"))
    rows = rows.withColumns({n: F.when(~_empty(n), F.trim(n)) for n in ("fingerprint", "fingerprint_kind")}).join(held, ["fingerprint_kind", "fingerprint"], "left")
    has, kind, state, move = F.col("fingerprint").isNotNull(), F.col("fingerprint_kind"), F.col("identity_state"), F.col("action") == "move"
    taken = (F.col("_least") != F.col("device_id")) | (F.col("_most") != F.col("device_id"))
    same = F.col("_site").eqNullSafe(F.col("current_site_id"))
    return rows.select("change_id", first_fault(
        *lifecycle("device_id"), ("site_not_found", _lost("current_site_id")), ("invalid_identity_state", _none_of("identity_state", IDENTITIES)), ("invalid_expected_availability", _none_of("expected_availability", AVAILABILITIES)),
        ("fingerprint_incomplete", has != kind.isNotNull()), ("fingerprint_required", state.isin("confirmed", "conflict") & ~has), ("fingerprint_not_allowed", (state == "unavailable") & has), ("fingerprint_of_a_root", F.lower(kind).isin(*ROOT_FINGERPRINTS)),
        ("fingerprint_taken", (state == "confirmed") & taken), ("site_changes_by_move", (F.col("action") == "update") & ~same), ("move_changes_nothing", move & same),
    ).alias("fault"))


def root_changes(changes: DataFrame, roots: DataFrame, devices: DataFrame) -> DataFrame:
    """Archive roots (device_id, path, fingerprint, fingerprint_kind, identity_state): one active root to a path, one to a confirmed fingerprint; updates keep all of these."""
    kept = ("device_id", "path", "fingerprint", "fingerprint_kind", "identity_state")
    rows = _refers(known(changes, roots, "archive_root_id", **{f"_now_{k}": k for k in kept}), devices, "device_id", "device_id")
    active = roots.filter(F.col("status") == "active")
    span = lambda d, name, *keys: d.groupBy(*keys).agg(F.min("archive_root_id").alias(f"_{name}_least"), F.max("archive_root_id").alias(f"_{name}_most"))
    rows = rows.join(span(active, "path", "device_id", "path"), ["device_id", "path"], "left").join(span(active.filter(F.col("identity_state") == "confirmed"), "mark", "fingerprint_kind", "fingerprint"), ["fingerprint_kind", "fingerprint"], "left")
    taken = lambda name: (F.col(f"_{name}_least") != F.col("archive_root_id")) | (F.col(f"_{name}_most") != F.col("archive_root_id"))
    has, kind, state = F.col("fingerprint").isNotNull(), F.col("fingerprint_kind").isNotNull(), F.col("identity_state")
    unfit = (has != kind) | ((state == "confirmed") & ~has) | ((state == "unavailable") & has)
    changed = reduce(lambda a, b: a | b, [~F.col(k).eqNullSafe(F.col(f"_now_{k}")) for k in kept])
    return rows.select("change_id", first_fault(
        *lifecycle("archive_root_id"), ("device_not_found", _lost("device_id")), ("invalid_identity_state", _none_of("identity_state", IDENTITIES)), ("evidence_does_not_fit", unfit),
        ("path_taken", taken("path")), ("fingerprint_taken", (state == "confirmed") & taken("mark")), ("evidence_changed", (F.col("action") != "register") & changed),
    ).alias("fault"))


def location_changes(changes: DataFrame, c: Catalog) -> DataFrame:
    """Locations (kind, archive_root_id, device_id, relative_path, site_id): on a root of the same device, or a service at a site."""
    rows = known(changes, c.locations, "location_id")
    rows = rows.join(c.archive_roots.select("archive_root_id", F.col("device_id").alias("_root_device")), "archive_root_id", "left")
    rows = _refers(rows, c.sites, "site_id", "site_id")
    disk, service = F.col("kind") == "filesystem", F.col("kind") == "service"
    whole = F.col("archive_root_id").isNotNull() & F.col("device_id").isNotNull() & F.col("relative_path").isNotNull()
    bare = F.col("archive_root_id").isNull() & F.col("device_id").isNull() & F.col("relative_path").isNull()
    return rows.select("change_id", first_fault(
        *lifecycle("location_id"), ("invalid_expected_availability", _none_of("expected_availability", AVAILABILITIES)), ("filesystem_incomplete", disk & ~whole), ("site_comes_from_device", disk & F.col("site_id").isNotNull()),
        ("root_of_another_device", disk & ~F.col("_root_device").eqNullSafe(F.col("device_id"))), ("service_needs_a_site_only", service & (F.col("site_id").isNull() | ~bare)), ("site_not_found", service & _lost("site_id")), ("invalid_kind", _none_of("kind", ("filesystem", "service"))),
    ).alias("fault"))


def risk_changes(changes: DataFrame, c: Catalog, domains: DataFrame) -> DataFrame:
    """Assignments (action assign or unassign, risk_id, entity_type, entity_id) of known domains (risk_id) to known entities."""
    entities = reduce(DataFrame.unionByName, [t.select(F.lit(kind).alias("entity_type"), F.col(key).alias("entity_id"), F.lit(True).alias("_there")) for kind, t, key in (("location", c.locations, "location_id"), ("archive_root", c.archive_roots, "archive_root_id"), ("device", c.devices, "device_id"), ("site", c.sites, "site_id"))])
    rows = _refers(changes, domains, "risk_id", "risk_id").join(entities, ["entity_type", "entity_id"], "left")
    rows = rows.join(c.risk_assignments.select("entity_type", "entity_id", "risk_id", F.lit(True).alias("_assigned")).distinct(), ["entity_type", "entity_id", "risk_id"], "left")
    assign = F.col("action") == "assign"
    return rows.select("change_id", first_fault(
        ("risk_not_found", F.col("_has_risk_id").isNull()), ("invalid_entity_type", _none_of("entity_type", ("location", "archive_root", "device", "site"))), ("entity_not_found", F.col("_there").isNull()),
        ("already_assigned", assign & F.col("_assigned").isNotNull()), ("not_assigned", ~assign & F.col("_assigned").isNull()),
    ).alias("fault"))


def mount_changes(changes: DataFrame, c: Catalog) -> DataFrame:
    """Mounts (mount_id, device_id, archive_root_id, mount_root, status, fingerprint_status): the root, if named, is one of the device."""
    rows = _refers(changes, c.devices, "device_id", "device_id").join(c.archive_roots.select("archive_root_id", F.col("device_id").alias("_root_device")), "archive_root_id", "left")
    named = F.col("archive_root_id").isNotNull()
    return rows.select("change_id", first_fault(
        ("device_not_found", F.col("_has_device_id").isNull()), ("archive_root_not_found", named & F.col("_root_device").isNull()), ("root_of_another_device", named & (F.col("_root_device") != F.col("device_id"))), ("mount_id_required", _empty("mount_id")),
        ("mount_root_required", _empty("mount_root")), ("invalid_mount_state", _none_of("status", MOUNT_STATES) | _none_of("fingerprint_status", FINGERPRINT_STATES)),
    ).alias("fault"))


def scan_topology(asked: DataFrame, c: Catalog) -> DataFrame:
    """asked (scan_id, collection_id, location_id, device_id, archive_root_id) -> the first thing that keeps the scan from starting.

    Collection, location, root and device must be active and name each other; an identity in conflict scans nothing.
    """
    active = lambda d, key, *names: d.filter(F.col("status") == "active").select(key, F.lit(True).alias(f"_{key}"), *[F.col(n).alias(f"_{key}_{n}") for n in names])
    rows = asked.join(active(c.collections, "collection_id"), "collection_id", "left").join(active(c.locations, "location_id", "kind", "device_id", "archive_root_id"), "location_id", "left")
    rows = rows.join(active(c.archive_roots, "archive_root_id", "device_id"), "archive_root_id", "left").join(active(c.devices, "device_id", "identity_state"), "device_id", "left")
    there = lambda key: F.col(f"_{key}").isNull()
    other = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    return rows.select("scan_id", first_fault(
        ("collection_not_active", there("collection_id")), ("location_not_active", there("location_id")), ("not_a_filesystem", F.col("_location_id_kind") != "filesystem"), ("archive_root_not_active", there("archive_root_id")), ("device_not_active", there("device_id")),
        ("location_on_another_device", other("_location_id_device_id", "device_id")), ("location_on_another_root", other("_location_id_archive_root_id", "archive_root_id")), ("root_on_another_device", other("_archive_root_id_device_id", "device_id")),
        ("device_identity_conflict", F.col("_device_id_identity_state") == "conflict"),
    ).alias("fault"))
