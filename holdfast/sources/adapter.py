"""An inventory catalog derived from the driver's tables, and the same derivation as SQL common tables.

Digests are SHA-256 stand-ins for content hashes. Small dimensions come from nation and supplier, large
facts from orders (expected paths, file references) and lineitem (copies, grouped by order and supplier).
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = 1_007_164_800_000
WINDOW = 94_608_000_000
DAY = 86_400_000


@dataclass(frozen=True)
class Catalog:
    """The tables that operators read; each is lazy and pruned to what an operator uses."""

    sites: DataFrame
    devices: DataFrame
    archive_roots: DataFrame
    locations: DataFrame
    collections: DataFrame
    policies: DataFrame
    risk_assignments: DataFrame
    objects: DataFrame
    files: DataFrame
    file_refs: DataFrame
    copies: DataFrame
    mounts: DataFrame
    scans: DataFrame
    observations: DataFrame


def _ms(c: str) -> F.Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def _id(prefix: str, c) -> F.Column:
    return F.concat(F.lit(prefix), (F.col(c) if isinstance(c, str) else c).cast("string"))


def _digest(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


POLICIES = [
    # policy, version, copies, devices, sites, offsite, offline, encrypted offsite, verification, observation and check-in days
    ("policy_1", 1, 1, 1, 1, False, False, False, 20000, 20000, 1000),
    ("policy_2", 1, 2, 1, 2, True, False, False, 20000, 20000, 1200),
    ("policy_3", 2, 2, 2, 2, True, True, False, 3000, 20000, 1000),
    ("policy_4", 1, 3, 2, 2, True, False, True, 20000, 2500, 900),
]
POLICY_COLUMNS = "policy_id string, version int, min_copies int, min_devices int, min_sites int, offsite boolean, offline boolean, encrypted_offsite boolean, verification_days long, observation_days long, checkin_days long"


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    when, col, lit = F.when, F.col, F.lit
    nation, supplier, orders, events = read("nation"), read("supplier"), read("orders"), read("events")
    sites = nation.select(_id("site_", "n_nationkey").alias("site_id"), col("n_name").alias("display_name"), when(col("n_nationkey") % 11 == 5, "retired").otherwise("active").alias("status"))
    k = col("s_suppkey")
    device, service = _id("device_", k), k % 10 == 1
    devices = supplier.filter(~service).select(
        device.alias("device_id"), col("s_name").alias("display_name"), when(k % 10 != 0, _id("site_", "s_nationkey")).alias("current_site_id"),
        when(k % 17 == 3, "conflict").otherwise("confirmed").alias("identity_state"), when(k % 3 == 0, "offline").otherwise("online").alias("expected_availability"),
        (lit(AS_OF) - (k % 50) * (30 * DAY)).alias("last_checkin_ms"), when(k % 19 == 4, "mismatch").when(k % 19 != 5, "match").alias("fingerprint_status"),
        (lit(AS_OF) - (k % 45) * (30 * DAY)).alias("fingerprint_match_ms"), when(k % 23 == 6, "retired").otherwise("active").alias("status"),
    )
    archive_roots = supplier.filter(~service).select(_id("root_", k).alias("archive_root_id"), device.alias("device_id"), when(k % 31 == 7, "retired").otherwise("active").alias("status"))
    locations = supplier.select(
        _id("location_", k).alias("location_id"), col("s_name").alias("display_name"), when(service, "service").otherwise("filesystem").alias("kind"),
        when(service, _id("site_", "s_nationkey")).alias("site_id"), when(~service, device).alias("device_id"), when(~service, _id("root_", k)).alias("archive_root_id"),
        when(k % 4 == 0, "offline").otherwise("online").alias("expected_availability"), when(k % 2 == 0, "encrypted").when(k % 7 != 1, "unencrypted").alias("encryption_state"),
        when(k % 13 == 8, "untrusted").when(k % 13 != 9, "trusted").alias("trust_level"), when(k % 29 == 9, "retired").otherwise("active").alias("status"),
    )
    digit = F.substring("o_orderpriority", 1, 1)
    collections = orders.groupBy(digit.alias("p")).agg(F.max("o_orderpriority").alias("display_name")).select(
        _id("collection_", "p").alias("collection_id"), "display_name", _id("site_", "p").alias("home_site_id"), when(col("p") < "5", _id("policy_", "p")).alias("policy_id"), lit("active").alias("status")
    )
    n = col("n_nationkey")
    risk = nation.filter(n % 2 == 0).select(lit("site").alias("entity_type"), _id("site_", n).alias("entity_id"), _id("risk_", "n_regionkey").alias("risk_id"))
    risk = risk.union(supplier.filter(~service & (k % 6 == 0)).select(lit("device"), device, _id("risk_", k % 5))).union(supplier.filter(k % 9 == 2).select(lit("location"), _id("location_", k), lit("risk_power")))
    o = col("o_orderkey")
    unresolved = (col("o_orderstatus") == "P") & (o % 4 == 0)
    path = F.concat(F.date_format("o_orderdate", "yyyy/MM/"), F.lpad(o.cast("string"), 8, "0"))
    objects = orders.select(
        _id("object_", o).alias("object_id"), _id("collection_", digit).alias("collection_id"), lit("utf8").alias("path_encoding"), path.cast("binary").alias("path_bytes"),
        when(~unresolved, _digest(o.cast("string"))).alias("expected"), col("o_totalprice").cast("long").alias("expected_size"),
    )
    item = read("lineitem").groupBy("l_orderkey", "l_suppkey").agg(
        F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("line"), F.sum("l_quantity").cast("long").alias("q"), F.max("l_shipdate").alias("shipped")
    )
    lo, ls = col("l_orderkey"), col("l_suppkey")
    mix = lo + ls
    present = (col("flag") != "R") & (mix % 37 != 0)
    presence = when(col("flag") == "R", "missing").when(mix % 37 == 0, "unknown").otherwise("present")
    damaged = present & (mix % 13 == 0)
    integrity = when(damaged, "damaged").when(col("line") == "F", "verified").otherwise("unverified")
    at = _ms("shipped")
    item = item.withColumns({"presence": presence, "integrity": integrity, "at": at})
    files = item.select(
        _id("object_", lo).alias("object_id"), _id("location_", ls).alias("location_id"), "presence", "integrity", col("at").alias("last_check_ms"),
        when(col("presence") == "missing", "missing").when(col("integrity") == "damaged", "mismatch").when(mix % 41 == 0, "read_error").otherwise("ok").alias("last_check_result"),
        _digest(when((col("integrity") == "damaged") | (col("q") % 10 == 0), _id("-", lo)).otherwise(lo.cast("string"))).alias("observed"),
        when((col("integrity") != "unverified") | (mix % 3 != 0), col("at")).alias("last_success_ms"),
    )
    file_refs = orders.select(
        _id("file_", o).alias("file_id"), _id("collection_", digit).alias("collection_id"), path.alias("path"), when(~unresolved, _id("content_", F.floor(o / 4))).alias("content_id"),
        when(unresolved & (o % 8 == 0), _id("ext_", o)).alias("external_id"), when(o % 50 == 7, "removed").otherwise("active").alias("state"), when(unresolved, "unknown").otherwise("resolved").alias("identity_state"),
        _id("origin_", o % 3).alias("origin_id"), o.alias("origin_seq"), col("o_totalprice").cast("long").alias("size"),
    )
    owned = item.join(orders.select(o, "o_orderstatus"), lo == o)
    copies = owned.select(
        F.concat(lit("copy_"), lo.cast("string"), lit("_"), ls.cast("string")).alias("copy_id"), _id("file_", lo).alias("file_id"), _id("location_", ls).alias("location_id"),
        when(~unresolved, _id("content_", F.floor(lo / 4))).alias("content_id"), when(unresolved & (lo % 8 == 0), _id("ext_", lo)).alias("external_id"),
        when(mix % 43 == 0, "superseded").when(col("integrity") == "damaged", "corrupt").otherwise(col("presence")).alias("state"), (col("at") + (lo % 30) * DAY).alias("last_seen_ms"),
        when(col("integrity") != "unverified", col("at")).alias("last_verified_ms"),
        when(mix % 41 == 0, "read_error").when(col("integrity") == "damaged", "mismatch").when(col("integrity") == "verified", "ok").alias("verification_result"),
        when(col("integrity") == "verified", 1).when(col("integrity") == "damaged", 2).otherwise(0).alias("integrity_code"),
        when(mix % 41 == 0, "read_error").when(mix % 47 == 0, "identity_mismatch").when(mix % 53 == 0, "other_error").alias("error_code"),
    )
    e = col("event_id")
    mounts = events.select(e.alias("mount_id"), _id("root_", col("user_id") % 100 + 1).alias("archive_root_id"), col("event_type").alias("host"), when(e % 4 == 0, "unmounted").otherwise("mounted").alias("status"), _ms("ts").alias("observed_ms"))
    scans = supplier.select(
        _id("scan_", k).alias("scan_id"), _id("location_", k).alias("location_id"), _id("collection_", k % 5 + 1).alias("collection_id"), when(k % 3 == 0, "partial").when(k % 7 == 0, "running").otherwise("complete").alias("status"),
        (lit(AS_OF) - (k % 40 + 1) * (40 * DAY)).alias("started_ms"), (lit(AS_OF) - (k % 40) * (40 * DAY)).alias("finished_ms"), (k % 5 == 0).alias("had_errors"),
    )
    line = read("lineitem")
    number = col("l_linenumber")
    observations = line.select(
        _id("object_", lo).alias("object_id"), _id("location_", ls).alias("location_id"), _ms("l_shipdate").alias("time_ms"), (lo * 100 + number).alias("seq"),
        F.element_at(F.array(*map(lit, ("checksum", "checksum", "rejected", "read_error", "missing", "metadata_present", "checksum"))), ((mix + number) % 7 + 1).cast("int")).alias("kind"),
        _digest(when((lo + number) % 6 == 0, _id("-", lo)).otherwise(lo.cast("string"))).alias("observed"),
    )
    return Catalog(sites, devices, archive_roots, locations, collections, spark.createDataFrame(POLICIES, POLICY_COLUMNS), risk, objects, files, file_refs, copies, mounts, scans, observations)


TABLES = tuple(f.name for f in fields(Catalog))

_POLICY_ROWS = ", ".join("('%s', %d, %d, %d, %d, %s, %s, %s, %d, %d, %d)" % r for r in POLICIES)

#: The derivation for the SQL side, to be followed by further common tables or a SELECT.
SQL = f"""WITH sites AS (SELECT 'site_' || n_nationkey AS site_id, n_name AS display_name, CASE WHEN n_nationkey % 11 = 5 THEN 'retired' ELSE 'active' END AS status FROM nation),
devices AS (SELECT 'device_' || s_suppkey AS device_id, s_name AS display_name, CASE WHEN s_suppkey % 10 <> 0 THEN 'site_' || s_nationkey END AS current_site_id,
  CASE WHEN s_suppkey % 17 = 3 THEN 'conflict' ELSE 'confirmed' END AS identity_state, CASE WHEN s_suppkey % 3 = 0 THEN 'offline' ELSE 'online' END AS expected_availability,
  {AS_OF} - (s_suppkey % 50) * {30 * DAY} AS last_checkin_ms, CASE WHEN s_suppkey % 19 = 4 THEN 'mismatch' WHEN s_suppkey % 19 <> 5 THEN 'match' END AS fingerprint_status,
  {AS_OF} - (s_suppkey % 45) * {30 * DAY} AS fingerprint_match_ms, CASE WHEN s_suppkey % 23 = 6 THEN 'retired' ELSE 'active' END AS status FROM supplier WHERE s_suppkey % 10 <> 1),
archive_roots AS (SELECT 'root_' || s_suppkey AS archive_root_id, 'device_' || s_suppkey AS device_id, CASE WHEN s_suppkey % 31 = 7 THEN 'retired' ELSE 'active' END AS status FROM supplier WHERE s_suppkey % 10 <> 1),
locations AS (SELECT 'location_' || s_suppkey AS location_id, s_name AS display_name, CASE WHEN s_suppkey % 10 = 1 THEN 'service' ELSE 'filesystem' END AS kind,
  CASE WHEN s_suppkey % 10 = 1 THEN 'site_' || s_nationkey END AS site_id, CASE WHEN s_suppkey % 10 <> 1 THEN 'device_' || s_suppkey END AS device_id, CASE WHEN s_suppkey % 10 <> 1 THEN 'root_' || s_suppkey END AS archive_root_id,
  CASE WHEN s_suppkey % 4 = 0 THEN 'offline' ELSE 'online' END AS expected_availability, CASE WHEN s_suppkey % 2 = 0 THEN 'encrypted' WHEN s_suppkey % 7 <> 1 THEN 'unencrypted' END AS encryption_state,
  CASE WHEN s_suppkey % 13 = 8 THEN 'untrusted' WHEN s_suppkey % 13 <> 9 THEN 'trusted' END AS trust_level, CASE WHEN s_suppkey % 29 = 9 THEN 'retired' ELSE 'active' END AS status FROM supplier),
collections AS (SELECT 'collection_' || p AS collection_id, display_name, 'site_' || p AS home_site_id, CASE WHEN p < '5' THEN 'policy_' || p END AS policy_id, 'active' AS status
  FROM (SELECT substr(o_orderpriority, 1, 1) AS p, max(o_orderpriority) AS display_name FROM orders GROUP BY 1)),
policies(policy_id, version, min_copies, min_devices, min_sites, offsite, offline, encrypted_offsite, verification_days, observation_days, checkin_days) AS (VALUES {_POLICY_ROWS}),
risk_assignments AS (SELECT 'site' AS entity_type, 'site_' || n_nationkey AS entity_id, 'risk_' || n_regionkey AS risk_id FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT 'device', 'device_' || s_suppkey, 'risk_' || (s_suppkey % 5) FROM supplier WHERE s_suppkey % 10 <> 1 AND s_suppkey % 6 = 0
  UNION ALL SELECT 'location', 'location_' || s_suppkey, 'risk_power' FROM supplier WHERE s_suppkey % 9 = 2),
ordered AS (SELECT *, o_orderstatus = 'P' AND o_orderkey % 4 = 0 AS unresolved, 'collection_' || substr(o_orderpriority, 1, 1) AS collection_id, strftime(o_orderdate, '%Y/%m/') || lpad(o_orderkey::VARCHAR, 8, '0') AS path FROM orders),
objects AS (SELECT 'object_' || o_orderkey AS object_id, collection_id, 'utf8' AS path_encoding, path, CASE WHEN NOT unresolved THEN sha256(o_orderkey::VARCHAR) END AS expected, trunc(o_totalprice)::BIGINT AS expected_size FROM ordered),
item AS (SELECT *, CASE WHEN flag = 'R' THEN 'missing' WHEN mix % 37 = 0 THEN 'unknown' ELSE 'present' END AS presence, CASE WHEN flag <> 'R' AND mix % 37 <> 0 AND mix % 13 = 0 THEN 'damaged' WHEN line = 'F' THEN 'verified' ELSE 'unverified' END AS integrity
  FROM (SELECT l_orderkey, l_suppkey, l_orderkey + l_suppkey AS mix, max(l_returnflag) AS flag, max(l_linestatus) AS line, sum(l_quantity)::BIGINT AS q, epoch_ms(max(l_shipdate)) AS seen_at FROM lineitem GROUP BY l_orderkey, l_suppkey)),
files AS (SELECT 'object_' || l_orderkey AS object_id, 'location_' || l_suppkey AS location_id, presence, integrity, seen_at AS last_check_ms,
  CASE WHEN presence = 'missing' THEN 'missing' WHEN integrity = 'damaged' THEN 'mismatch' WHEN mix % 41 = 0 THEN 'read_error' ELSE 'ok' END AS last_check_result,
  sha256(CASE WHEN integrity = 'damaged' OR q % 10 = 0 THEN '-' ELSE '' END || l_orderkey) AS observed, CASE WHEN integrity <> 'unverified' OR mix % 3 <> 0 THEN seen_at END AS last_success_ms FROM item),
file_refs AS (SELECT 'file_' || o_orderkey AS file_id, collection_id, path, CASE WHEN NOT unresolved THEN 'content_' || (o_orderkey // 4) END AS content_id, CASE WHEN unresolved AND o_orderkey % 8 = 0 THEN 'ext_' || o_orderkey END AS external_id,
  CASE WHEN o_orderkey % 50 = 7 THEN 'removed' ELSE 'active' END AS state, CASE WHEN unresolved THEN 'unknown' ELSE 'resolved' END AS identity_state, 'origin_' || (o_orderkey % 3) AS origin_id, o_orderkey AS origin_seq, trunc(o_totalprice)::BIGINT AS size FROM ordered),
copies AS (SELECT 'copy_' || l_orderkey || '_' || l_suppkey AS copy_id, 'file_' || l_orderkey AS file_id, 'location_' || l_suppkey AS location_id, CASE WHEN NOT unresolved THEN 'content_' || (l_orderkey // 4) END AS content_id,
  CASE WHEN unresolved AND l_orderkey % 8 = 0 THEN 'ext_' || l_orderkey END AS external_id, CASE WHEN mix % 43 = 0 THEN 'superseded' WHEN integrity = 'damaged' THEN 'corrupt' ELSE presence END AS state, seen_at + (l_orderkey % 30) * {DAY} AS last_seen_ms,
  CASE WHEN integrity <> 'unverified' THEN seen_at END AS last_verified_ms, CASE WHEN mix % 41 = 0 THEN 'read_error' WHEN integrity = 'damaged' THEN 'mismatch' WHEN integrity = 'verified' THEN 'ok' END AS verification_result,
  CASE WHEN integrity = 'verified' THEN 1 WHEN integrity = 'damaged' THEN 2 ELSE 0 END AS integrity_code, CASE WHEN mix % 41 = 0 THEN 'read_error' WHEN mix % 47 = 0 THEN 'identity_mismatch' WHEN mix % 53 = 0 THEN 'other_error' END AS error_code
  FROM item JOIN ordered ON l_orderkey = o_orderkey),
mounts AS (SELECT event_id AS mount_id, 'root_' || (user_id % 100 + 1) AS archive_root_id, event_type AS host, CASE WHEN event_id % 4 = 0 THEN 'unmounted' ELSE 'mounted' END AS status, epoch_us(ts) // 1000 AS observed_ms FROM events),
scans AS (SELECT 'scan_' || s_suppkey AS scan_id, 'location_' || s_suppkey AS location_id, 'collection_' || (s_suppkey % 5 + 1) AS collection_id, CASE WHEN s_suppkey % 3 = 0 THEN 'partial' WHEN s_suppkey % 7 = 0 THEN 'running' ELSE 'complete' END AS status,
  {AS_OF} - (s_suppkey % 40 + 1) * {40 * DAY} AS started_ms, {AS_OF} - (s_suppkey % 40) * {40 * DAY} AS finished_ms, s_suppkey % 5 = 0 AS had_errors FROM supplier),
observations AS (SELECT 'object_' || l_orderkey AS object_id, 'location_' || l_suppkey AS location_id, epoch_ms(l_shipdate) AS time_ms, l_orderkey * 100 + l_linenumber AS seq,
  ['checksum', 'checksum', 'rejected', 'read_error', 'missing', 'metadata_present', 'checksum'][((l_orderkey + l_suppkey + l_linenumber) % 7 + 1)::INT] AS kind, sha256(CASE WHEN (l_orderkey + l_linenumber) % 6 = 0 THEN '-' ELSE '' END || l_orderkey) AS observed FROM lineitem)
"""
