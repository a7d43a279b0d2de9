"""Policy evaluation: reasons for each copy, requirements for each file, and what would be lost with each domain."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import predicates as p
from holdfast.sources.adapter import Catalog


@dataclass(frozen=True)
class Requirements:
    """All fields are needed, no others are allowed, and counts and ages are positive."""

    min_qualifying_copies: int
    min_devices: int
    min_sites: int
    require_offsite_copy: bool
    require_offline_copy: bool
    require_encrypted_offsite: bool
    max_verification_age_days: int
    max_observation_age_days: int
    max_device_checkin_age_days: int

    @classmethod
    def parse(cls, text: str) -> Requirements:
        found = json.loads(text)
        if not isinstance(found, dict) or set(found) != set(cls.__dataclass_fields__):
            raise ValueError("requirements have exactly nine fields")
        out = cls(**found)
        for name, value in asdict(out).items():
            wants_flag = name.startswith("require_")
            if isinstance(value, bool) != wants_flag or not wants_flag and (not isinstance(value, int) or value <= 0):
                raise ValueError(f"{name}: not a valid value: {value!r}")
        return out


def contexts(c: Catalog) -> DataFrame:
    """Active collections that have a home site and a policy, with its requirements."""
    return c.collections.filter((F.col("status") == "active") & F.col("home_site_id").isNotNull()).join(c.policies, "policy_id").select("collection_id", "home_site_id", *c.policies.columns)


def unconfigured(c: Catalog) -> DataFrame:
    """Active collections that can't be evaluated, with the first reason."""
    known = c.policies.select("policy_id", F.lit(True).alias("_known"))
    homes = c.sites.select(F.col("site_id").alias("home_site_id"), F.col("status").alias("_site"))
    rows = c.collections.filter(F.col("status") == "active").join(known, "policy_id", "left").join(homes, "home_site_id", "left")
    reason = F.when(F.col("policy_id").isNull(), "policy_missing").when(F.col("_known").isNull(), "policy_unknown").when(F.col("home_site_id").isNull(), "home_site_missing").when(F.coalesce(F.col("_site") != "active", F.lit(True)), "home_site_inactive")
    return rows.select("collection_id", reason.alias("reason")).filter("reason is not null")


@dataclass(frozen=True)
class Reason:
    """Why a copy does not qualify: its name, when it holds, whether it leaves the state of the copy in doubt, and whether its place alone tells."""

    name: str
    when: Column
    doubt: bool = False
    place: bool = False


def _not(name: str, value: str) -> Column:
    return ~F.col(name).eqNullSafe(F.lit(value))


def _aged(time: str, days: str, now: int, label: str, only: Column | None = None) -> list[Reason]:
    return [Reason(f"{label}_{name}", fault if only is None else only & fault, True) for name, fault in p.policy_age_faults(time, F.col(days), now).items()]


#: The state or result itself is part of these names.
STATE, RESULT = "copy_state_", "verification_"


def reasons(now: int) -> list[Reason]:
    """All reasons, in the order in which they are told; STATE and RESULT stand for one for each value."""
    disk, site = F.col("kind") == "filesystem", F.col("site")
    away = F.col("encrypted_offsite") & F.col("is_offsite")
    return [
        Reason("object_identity_mismatch", ~F.col("copy_content").eqNullSafe(F.col("content_id"))),
        Reason(STATE, F.col("state") != "present"),
        Reason("verification_missing", F.col("verification_result").isNull(), True), Reason(RESULT, F.col("verification_result") != "ok"),
        *_aged("last_verified_ms", "verification_days", now, "verification"), *_aged("last_seen_ms", "observation_days", now, "observation"),
        Reason("location_inactive", F.col("location_status") != "active", place=True),
        Reason("location_untrusted", F.col("trust_level") == "untrusted", place=True), Reason("location_trust_unknown", _not("trust_level", "trusted") & _not("trust_level", "untrusted"), True, True),
        Reason("site_unknown", site.isNull(), True, True), Reason("site_inactive", site.isNotNull() & _not("site_status", "active"), place=True),
        Reason("archive_root_inactive", disk & _not("root_status", "active"), place=True), Reason("archive_root_device_mismatch", disk & ~F.col("root_device").eqNullSafe(F.col("device_id")), True, True),
        Reason("device_inactive", disk & _not("device_status", "active"), place=True), Reason("device_identity_unconfirmed", disk & _not("identity_state_device", "confirmed"), True, True), Reason("device_fingerprint_not_matched", disk & _not("fingerprint_status", "match"), True, True),
        *_aged("last_checkin_ms", "checkin_days", now, "device_checkin", disk), *_aged("fingerprint_match_ms", "checkin_days", now, "device_fingerprint", disk),
        Reason("location_kind_unknown", ~F.col("kind").isin("filesystem", "service"), True, True),
        Reason("offsite_copy_unencrypted", away & (F.col("encryption_state") == "unencrypted")), Reason("offsite_encryption_unknown", away & F.col("encryption_state").isNull(), True),
    ]


UNRESOLVED = "file_identity_not_resolved"


def _bits(known: list[Reason], which: Callable[[Reason], bool]) -> Column:
    """The reasons that hold as bits of one number, so all of them are plain arithmetic of one generated function."""
    zero = F.lit(0).cast("long")
    return reduce(lambda a, b: a + b, [F.when(r.when, F.lit(1 << i).cast("long")).otherwise(zero) for i, r in enumerate(known) if which(r)])


def places(c: Catalog, now: int) -> DataFrame:
    """Locations with what their device, root and site say: the reasons that these alone tell, and as `place` the
    device or service, device and site (by hashes) and the risks that any of these is assigned to, as a sorted set."""
    rows = (
        c.locations.withColumnRenamed("status", "location_status").withColumnRenamed("expected_availability", "location_availability").drop("display_name")
        .join(c.devices.withColumnRenamed("status", "device_status").withColumnRenamed("expected_availability", "device_availability").withColumnRenamed("identity_state", "identity_state_device").drop("display_name"), "device_id", "left")
        .join(c.archive_roots.select("archive_root_id", F.col("device_id").alias("root_device"), F.col("status").alias("root_status")), "archive_root_id", "left")
        .withColumn("site", p.location_first_site())
        .join(c.sites.select(F.col("site_id").alias("site"), F.col("status").alias("site_status")), "site", "left")
        .withColumn("effective_site", F.when(F.col("site_status") == "active", F.col("site")).otherwise(""))
    )
    entities = F.array(*[F.struct(F.lit(t).alias("entity_type"), F.col(e).alias("entity_id")) for t, e in (("location", "location_id"), ("archive_root", "archive_root_id"), ("device", "device_id"), ("site", "effective_site"))])
    risks = rows.select("location_id", F.explode(entities).alias("x")).select("location_id", "x.*").join(c.risk_assignments, ["entity_type", "entity_id"])
    risks = risks.groupBy("location_id").agg(F.array_sort(F.collect_set("risk_id")).alias("risks"))
    rows = rows.join(risks, "location_id", "left").withColumn("risks", F.coalesce("risks", F.array().cast("array<string>")))
    holder = F.coalesce(F.concat(F.lit("device:"), "device_id"), F.concat(F.lit("service:"), "location_id"))
    number = lambda x: F.when(F.col(x).isNotNull(), F.xxhash64(x))
    rows = rows.withColumns({"holder": holder, "place_mask": _bits(reasons(now), lambda r: r.place), "is_offline": (F.col("location_availability") == "offline") | F.coalesce(F.col("device_availability") == "offline", F.lit(False)), "is_encrypted": F.coalesce(F.col("encryption_state") == "encrypted", F.lit(False))})
    place = F.struct(number("holder").alias("holder"), number("device_id").alias("device"), number("effective_site").alias("site"), "risks")
    return rows.select("location_id", "kind", "device_id", "effective_site", "encryption_state", "last_checkin_ms", "fingerprint_match_ms", "holder", "risks", "place_mask", "is_offline", "is_encrypted", place.alias("place"))


GROUP = ["key", "collection_id", "usable"]


def files(c: Catalog) -> DataFrame:
    """Active files of evaluated collections with the group that they are judged in: collection, content, and whether their identity is settled."""
    usable = (F.col("identity_state") == "resolved") & F.col("content_id").isNotNull()
    rows = c.file_refs.filter(F.col("state") == "active").join(contexts(c).select("collection_id", "policy_id"), "collection_id")
    return rows.select("file_id", "collection_id", "policy_id", "size", "content_id", F.coalesce(p.content_key(file=None), F.lit("")).alias("key"), F.coalesce(usable, F.lit(False)).alias("usable"))


def assessed(c: Catalog, now: int) -> DataFrame:
    """Each copy in each group of files that it stands for, with its reasons as bits of `mask`; without any it qualifies.

    Copies belong to files by content, or else by external identity; one key serves both. Files of one
    collection and content are judged together (`files` counts them), so they don't multiply copies. Groups
    without copies keep one row with a null copy.
    """
    groups = files(c).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("files"), F.first("content_id").alias("content_id"))  # the key tells the content
    groups = groups.join(contexts(c).drop("version", "status"), "collection_id")
    copies = c.copies.filter(F.col("state") != "superseded").select("copy_id", "location_id", "content_id", "state", "last_seen_ms", "last_verified_ms", "verification_result", p.content_key(file=None).alias("key")).withColumnRenamed("content_id", "copy_content")
    copies = copies.filter("key is not null").join(places(c, now), "location_id", "left")
    copies = copies.withColumns({"effective_site": F.coalesce("effective_site", F.lit("")), "place_mask": F.coalesce("place_mask", F.lit(_mask(reasons(now), lambda r: r.name in ("location_trust_unknown", "site_unknown"))).cast("long"))})
    rows = groups.join(copies, "key", "left").withColumn("is_offsite", F.col("effective_site") != F.col("home_site_id"))
    known = reasons(now)
    torn = F.lit(False)
    for name in ("state", "verification_result"):
        torn = torn | F.coalesce(F.col(name).contains("unknown") | F.col(name).contains("mismatch"), F.lit(False))
    disk = F.col("kind") == "filesystem"
    fresh = [p.policy_expiry(t, F.col(d), now) for t, d in (("last_verified_ms", "verification_days"), ("last_seen_ms", "observation_days"))]
    fresh += [F.when(disk, p.policy_expiry(t, F.col("checkin_days"), now)) for t in ("last_checkin_ms", "fingerprint_match_ms")]
    there = F.col("copy_id").isNotNull()
    rows = rows.withColumn("mask", F.when(there & F.col("usable"), F.col("place_mask") + _bits(known, lambda r: not r.place)).otherwise(F.lit(0).cast("long")))
    return rows.select(
        "*", (there & F.col("usable") & (F.col("mask") == 0)).alias("qualifies"), (there & (~F.col("usable") | (F.col("mask").bitwiseAND(_mask(known, lambda r: r.doubt)) != 0))).alias("doubt"), (F.col("usable") & there & torn).alias("torn"),
        F.when(F.col("usable") & there, F.least(*fresh)).alias("expiry"),
    )


def _mask(known: list[Reason], which: Callable[[Reason], bool]) -> int:
    return sum(1 << i for i, r in enumerate(known) if which(r))


def reason_names(now: int) -> Column:
    """The names of an assessed copy's reasons."""
    value = {STATE: "state", RESULT: "verification_result"}
    name = lambda r: F.concat(F.lit(r.name), F.col(value[r.name])) if r.name in value else F.lit(r.name)
    found = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(1 << i) != 0, name(r)) for i, r in enumerate(reasons(now))]))
    return F.when(F.col("copy_id").isNull(), F.array().cast("array<string>")).when(~F.col("usable"), F.array(F.lit(UNRESOLVED))).otherwise(found)


def _domains() -> Column:
    """What a copy would be lost with: its device or service, its site, and the risks assigned to any of them, each once."""
    return F.concat(F.array(F.col("holder"), F.concat(F.lit("site:"), "effective_site")), F.transform("risks", lambda r: F.concat(F.lit("risk:"), r)))


def loss_scenarios(c: Catalog, copies: DataFrame) -> DataFrame:
    """For each file and domain: affected and remaining qualifying copies.

    Counted for each group of files; its domains (devices, sites and risks, so bounded by the dimensions) meet the files last.
    """
    good = copies.filter("qualifies")
    counts = good.select(*GROUP, F.explode(F.concat(F.array(F.lit("")), _domains())).alias("domain")).groupBy(*GROUP, "domain").agg(F.count(F.lit(1)).alias("affected"))
    listed = counts.groupBy(*GROUP).agg(F.max(F.when(F.col("domain") == "", F.col("affected"))).alias("copies"), F.collect_list(F.when(F.col("domain") != "", F.struct("domain", "affected"))).alias("each"))
    rows = files(c).select("file_id", *GROUP).join(listed, GROUP).select("file_id", "copies", F.explode("each").alias("x")).select("file_id", "copies", "x.*")
    return rows.select(
        "file_id", F.split_part("domain", F.lit(":"), F.lit(1)).alias("domain_kind"), F.expr("substr(domain, instr(domain, ':') + 1)").alias("domain_id"), "affected",
        (F.col("copies") - F.col("affected")).alias("remaining"), (F.col("copies") == F.col("affected")).alias("permanent_loss"),
    )


def evaluate(c: Catalog, now: int) -> DataFrame:
    """One row for each active file of an evaluated collection: counts, failed requirements, status, and until when the evidence holds.

    One aggregation of the copies of each group of files. All copies would be lost together if they have
    one holder, one site, or a risk in common; the set of their places is bounded by the dimensions.
    """
    copies, known = assessed(c, now), reasons(now)
    good = F.col("qualifies")
    needs = ["min_copies", "min_devices", "min_sites", "offsite", "offline", "encrypted_offsite"]
    per = copies.groupBy(*GROUP, *needs).agg(
        F.count_if(good).alias("copies"), F.collect_set(F.when(good, F.col("place"))).alias("places"),
        F.max(p.flag(good & F.col("is_offsite"))).alias("has_offsite"), F.max(p.flag(good & F.col("is_offline"))).alias("has_offline"), F.max(p.flag(good & F.col("is_offsite") & F.col("is_encrypted"))).alias("has_encrypted_offsite"),
        F.max(p.flag(F.col("doubt"))).alias("doubt"), F.min("expiry").alias("valid_until"), F.bit_or("mask").alias("mask"), F.max(p.flag(F.col("torn"))).alias("torn"),
    )
    different = lambda x: F.size(F.array_distinct(F.array_compact(F.transform("places", lambda y: y[x])))).cast("long")
    # copies that are nowhere known have no place
    shared = F.aggregate("places", F.get("places", F.lit(0))["risks"], lambda a, y: F.array_intersect(a, y["risks"]))
    per = per.withColumns({"devices": different("device"), "sites_n": different("site")})
    lost = (F.col("copies") > 0) & ((F.col("sites_n") == 1) | (different("holder") == 1) | F.coalesce(F.size(F.when(F.size("places") > 0, shared)) > 0, F.lit(False)))
    per = per.withColumn("lost", lost)
    failed = F.array_compact(F.array(
        F.when(F.col("copies") < F.col("min_copies"), "min_qualifying_copies"), F.when(F.col("devices") < F.col("min_devices"), "min_devices"), F.when(F.col("sites_n") < F.col("min_sites"), "min_sites"),
        F.when(F.col("offsite") & (F.col("has_offsite") == 0), "require_offsite_copy"), F.when(F.col("offline") & (F.col("has_offline") == 0), "require_offline_copy"),
        F.when(F.col("encrypted_offsite") & (F.col("has_encrypted_offsite") == 0), "require_encrypted_offsite"),
    ))
    out = per.withColumns({"failed": failed, "permanent_loss": p.flag(F.col("lost"))})
    bad = (F.size("failed") > 0) | (F.col("permanent_loss") == 1) | ~F.col("usable")
    status = F.when(~bad, "satisfied").when((F.col("doubt") == 1) | ~F.col("usable"), "uncertain").otherwise("violated")
    judged = out.select(*GROUP, "copies", "devices", F.col("sites_n").alias("sites"), "failed", "permanent_loss", status.alias("status"), "valid_until", actions(known).alias("actions"))
    return files(c).join(judged, GROUP).select("file_id", "collection_id", "policy_id", "size", "copies", "devices", "sites", "failed", "permanent_loss", "status", "valid_until", "actions")


def actions(known: list[Reason]) -> Column:
    """Recommended actions, a sorted set, from the reasons, failed requirements and losses."""
    has = lambda *words: F.col("mask").bitwiseAND(_mask(known, lambda r: any(w in r.name for w in words))) != 0
    return F.array_compact(F.array(
        F.when(has("device", "fingerprint"), "connect_device"), F.when((F.size("failed") > 0) | (F.col("permanent_loss") == 1), "create_copy"), F.when(~F.col("usable"), "resolve_identity"),
        F.when(has("unknown", "mismatch") | (F.col("torn") == 1), "review_topology"), F.when(has("observation"), "scan_again"), F.when(has("verification"), "verify_again"),
    ))


def rollup(c: Catalog, evaluated: DataFrame) -> DataFrame:
    """Counts and bytes of each policy and collection by status."""
    return evaluated.groupBy("policy_id", "collection_id", "status").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.min("valid_until").alias("valid_until"))
