"""Registered queries over stored evaluations, registry changes, and what is known of contents and paths."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from holdfast.functions import numbers
from holdfast.operators import evaluations, metadata, policy, review, scans, status, summaries, topology
from holdfast.plans.registry import _DEVICE_MOUNT, _LOCATION, _META, _POLICY, WINDOW, query
from holdfast.sources.adapter import AS_OF, DAY

INPUT_SEQ = 500


def _number(column: str, prefix: str) -> F.Column:
    return F.replace(column, F.lit(prefix), F.lit("")).cast("long")


_CACHED = f""", pol AS (SELECT policy_id, version, 'active' AS status, policy_id <> 'policy_4' AS enabled FROM policies),
ev AS (SELECT 'evaluation_' || k AS evaluation_id, 'policy_' || (k % 4 + 1) AS policy_id, k, CASE WHEN k % 9 = 0 THEN 'running' ELSE 'complete' END AS status, k AS files_expected, k + (k % 7 = 0)::INT AS files_evaluated, {INPUT_SEQ} + (k % 11 = 0)::INT AS input_seq, CASE WHEN k % 4 = 2 THEN 2 ELSE 1 END + (k % 13 = 0)::INT AS policy_version,
  CASE WHEN k % 19 = 0 THEN NULL WHEN k % 17 = 0 THEN {AS_OF} WHEN k % 5 = 0 THEN {AS_OF - DAY} ELSE {AS_OF + DAY} END AS valid_until_ms, 1 + (k % 23 = 0)::INT AS rules_version, k % 40 AS completed_ms FROM (SELECT replace(location_id, 'location_', '')::BIGINT AS k FROM locations)),
ru AS (SELECT evaluation_id, policy_id, k + (k % 31 = 0)::INT AS total, k - 2 AS satisfied, 1 AS violated, 1 AS uncertain FROM ev WHERE k % 29 <> 0),
fi AS (SELECT evaluation_id, 'file_' || n AS file_id, 'collection_' || (k % 5 + 1) AS collection_id, CASE WHEN n = 1 THEN 'violated' ELSE 'uncertain' END AS status FROM ev, (VALUES (1), (2)) t(n) WHERE NOT (k % 37 = 0 AND n = 2)),
va AS (SELECT e.evaluation_id, CASE WHEN e.status <> 'complete' THEN 'evaluation_incomplete' WHEN files_expected <> files_evaluated THEN 'file_count_mismatch' WHEN input_seq <> {INPUT_SEQ} THEN 'policy_input_advanced' WHEN policy_version <> p.version THEN 'policy_version_changed' WHEN p.status <> 'active' OR NOT p.enabled THEN 'policy_inactive'
  WHEN valid_until_ms <= {AS_OF} THEN 'freshness_expired' WHEN rules_version <> 1 THEN 'rules_version_changed' WHEN r.total IS NULL OR r.satisfied < 0 THEN 'rollup_missing_or_invalid' WHEN r.total <> files_expected OR r.satisfied + r.violated + r.uncertain <> r.total THEN 'rollup_count_mismatch'
  WHEN (SELECT count(*) FROM fi WHERE fi.evaluation_id = e.evaluation_id) <> r.violated + r.uncertain THEN 'finding_count_mismatch' END AS reason FROM ev e JOIN pol p USING (policy_id) LEFT JOIN ru r USING (evaluation_id)) """


def _stored(c):
    k = _number("location_id", "location_")
    rows = c.locations.select(k.alias("k"))
    k = F.col("k")
    one = lambda n: (k % n == 0).cast("int")
    done = rows.select(
        F.concat(F.lit("evaluation_"), k.cast("string")).alias("evaluation_id"), F.concat(F.lit("policy_"), (k % 4 + 1).cast("string")).alias("policy_id"), "k", F.when(k % 9 == 0, "running").otherwise("complete").alias("status"), k.alias("files_expected"), (k + one(7)).alias("files_evaluated"),
        (INPUT_SEQ + one(11)).alias("input_seq"), (F.when(k % 4 == 2, 2).otherwise(1) + one(13)).alias("policy_version"), F.when(k % 19 == 0, F.lit(None)).when(k % 17 == 0, AS_OF).when(k % 5 == 0, AS_OF - DAY).otherwise(AS_OF + DAY).cast("long").alias("valid_until_ms"), (1 + one(23)).alias("rules_version"), (k % 40).alias("completed_ms"),
    )
    rollups = done.filter(k % 29 != 0).select("evaluation_id", "policy_id", (k + one(31)).alias("total"), (k - 2).alias("satisfied"), F.lit(1).alias("violated"), F.lit(1).alias("uncertain"))
    found = done.select("evaluation_id", "k", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).filter(~((k % 37 == 0) & (F.col("n") == 2)))
    found = found.select("evaluation_id", F.concat(F.lit("file_"), F.col("n").cast("string")).alias("file_id"), F.concat(F.lit("collection_"), (k % 5 + 1).cast("string")).alias("collection_id"), F.when(F.col("n") == 1, "violated").otherwise("uncertain").alias("status"))
    policies = c.policies.select("policy_id", "version", F.lit("active").alias("status"), (F.col("policy_id") != "policy_4").alias("enabled"))
    return done.drop("k"), policies, rollups, found


@query("k27f_evaluation_validity", _CACHED + "SELECT evaluation_id, (reason IS NULL)::INT AS usable, reason FROM va UNION ALL SELECT 'evaluation_none', 0, 'unknown_evaluation'")
def _(c):
    done, policies, rollups, found = _stored(c)
    asked = done.select("evaluation_id").unionByName(c.policies.sparkSession.createDataFrame([("evaluation_none",)], "evaluation_id string"))
    return evaluations.validity(asked, done, policies, rollups, found, INPUT_SEQ, AS_OF).withColumn("usable", F.col("usable").cast("int"))


_LATEST = """, la AS (SELECT policy_id, arg_max(evaluation_id, (completed_ms, evaluation_id)) AS evaluation_id FROM ev WHERE status = 'complete' GROUP BY 1),
st AS (SELECT p.policy_id, la.evaluation_id, CASE WHEN la.evaluation_id IS NULL THEN 'evaluation_missing' ELSE va.reason END AS reason FROM pol p LEFT JOIN la USING (policy_id) LEFT JOIN va USING (evaluation_id) WHERE p.enabled AND p.policy_id IN (SELECT policy_id FROM collections WHERE status = 'active')) """


def _status(c):
    done, policies, rollups, found = _stored(c)
    return evaluations.cached_status(c.collections, done, policies, rollups, found, INPUT_SEQ, AS_OF), found


@query("e04_latest_evaluation", _CACHED + "SELECT policy_id, arg_max(evaluation_id, (completed_ms, evaluation_id)) AS evaluation_id FROM ev WHERE status = 'complete' GROUP BY 1")
def _(c):
    return evaluations.latest_complete(_stored(c)[0])


@query("k27g_cached_status", _CACHED + _LATEST + "SELECT st.policy_id, st.evaluation_id, st.reason, CASE WHEN reason IS NULL THEN total END AS total, CASE WHEN reason IS NULL THEN satisfied END AS satisfied, CASE WHEN reason IS NULL THEN violated END AS violated, CASE WHEN reason IS NULL THEN uncertain END AS uncertain FROM st LEFT JOIN ru USING (evaluation_id)")
def _(c):
    return _status(c)[0]


@query("k27g_findings_page", _CACHED + _LATEST + "SELECT st.policy_id, fi.evaluation_id, file_id, collection_id, fi.status FROM fi JOIN st USING (evaluation_id) WHERE st.reason IS NULL AND (st.policy_id, file_id) > ('policy_1', 'file_1') ORDER BY 1, 3 LIMIT 101")
def _(c):
    rows, found = _status(c)
    return evaluations.findings_page(rows, found, 100, ("policy_1", "file_1")).select("policy_id", "evaluation_id", "file_id", "collection_id", "status")


@query("k27g_stored_rollup", _POLICY + "SELECT 'e_' || policy_id AS evaluation_id, policy_id, count(*) AS total, count(*) FILTER (status = 'satisfied') AS satisfied, count(*) FILTER (status = 'violated') AS violated, count(*) FILTER (status = 'uncertain') AS uncertain, min(valid_until) AS valid_until_ms FROM stated GROUP BY 2")
def _(c):
    ids = c.policies.select("policy_id", F.concat(F.lit("e_"), "policy_id").alias("evaluation_id"))
    return evaluations.store(policy.evaluate(c, AS_OF), ids)[0]


@query("k27d_file_review", _POLICY + "SELECT file_id, policy_id, copies, devices, sites, failed, status, valid_until FROM stated WHERE file_id = 'file_9'")
def _(c):
    return evaluations.review_file(c, "file_9", AS_OF).select("file_id", "policy_id", "copies", "devices", "sites", F.array_join("failed", ",").alias("failed"), "status", "valid_until")


@query("k25_review_contents", """, f AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY collection_id, path, file_id) AS n, count(*) OVER (PARTITION BY content_id) AS m FROM file_refs WHERE state = 'active' AND content_id IS NOT NULL)
SELECT c.content_id, 'md5:' || md5(c.content_id) || ',sha256:' || sha256(c.content_id) AS hashes, coalesce((SELECT string_agg(file_id, ',' ORDER BY n) FROM f WHERE f.content_id = c.content_id AND n <= 2), '') AS files, coalesce((SELECT max((m > 2)::INT) FROM f WHERE f.content_id = c.content_id), 0) AS more FROM (SELECT DISTINCT content_id FROM file_refs WHERE content_id IS NOT NULL) c""")
def _(c):
    contents = c.file_refs.filter("content_id is not null").select("content_id").distinct()
    data = F.col("content_id").cast("binary")
    made = F.array(F.struct(F.lit("sha256").alias("algorithm"), F.sha2(data, 256).alias("digest"), F.lit("read").alias("source")), F.struct(F.lit("md5").alias("algorithm"), F.md5(data).alias("digest"), F.lit("import").alias("source")))
    hashes = contents.select("content_id", F.explode(made).alias("x")).select("content_id", "x.*")
    rows = review.review_contents(contents, hashes, c.file_refs, 2)
    text = lambda column, f: F.array_join(F.transform(column, f), ",").alias(column)
    return rows.select("content_id", text("hashes", lambda x: F.concat(x["algorithm"], F.lit(":"), x["digest"])), text("files", lambda x: x["file_id"]), F.col("more").cast("int").alias("more"))


@query("c15_shared_identity", "SELECT a.file_id, b.file_id AS other_id FROM (SELECT file_id, 'x' || (origin_seq // 3) AS e FROM file_refs) a JOIN (SELECT file_id, 'x' || (origin_seq // 3) AS e FROM file_refs) b ON a.e = b.e AND a.file_id <> b.file_id")
def _(c):
    return review.shared_identity(c.file_refs.withColumn("external_id", F.concat(F.lit("x"), F.floor(F.col("origin_seq") / 3).cast("string"))))


_SEEN = f""", seen AS (SELECT c.file_id, c.copy_id, c.location_id, f.collection_id, f.path, c.state, c.last_seen_ms AS last_at, 'scan_' || (c.integrity_code + 1) AS last_scan, c.content_id, c.external_id, f.state AS file_state FROM copies c JOIN file_refs f USING (file_id)),
listing AS (SELECT 'scan_' || (1 + length(path) % 2) AS scan_id, collection_id, location_id, path FROM seen WHERE state <> 'unknown'),
cand AS (SELECT 'scan_1' AS scan_id, location_id, 'path' AS kind, file_id AS subject, last_at + CASE WHEN state = 'missing' THEN 1 ELSE -1 END AS at FROM seen UNION ALL SELECT 'scan_1', location_id, 'copy', copy_id, last_at + CASE WHEN state = 'corrupt' THEN 1 ELSE 0 END FROM seen) """


def _seen(c):
    rows = c.copies.join(c.file_refs.select("file_id", "collection_id", "path"), "file_id").withColumn("last_at", F.col("last_seen_ms"))
    listing = rows.filter("state <> 'unknown'").select(F.concat(F.lit("scan_"), (1 + F.length("path") % 2).cast("string")).alias("scan_id"), "collection_id", "location_id", "path")
    observed = rows.select("file_id", "location_id", "path", "state", "last_at", F.concat(F.lit("scan_"), (F.col("integrity_code") + 1).cast("string")).alias("last_scan"))
    held = rows.select("copy_id", "location_id", "path", "state", "content_id", "external_id", F.col("last_at").alias("state_at"))
    told = lambda kind, subject, at: rows.select(F.lit("scan_1").alias("scan_id"), "location_id", F.lit(kind).alias("kind"), F.col(subject).alias("subject"), at.alias("at"))
    last = F.col("last_at")
    missing = told("path", "file_id", last + F.when(F.col("state") == "missing", 1).otherwise(-1)).unionByName(told("copy", "copy_id", last + F.when(F.col("state") == "corrupt", 1).otherwise(0)))
    return listing, observed, held, missing


@query("k56_known_entries", _SEEN + """SELECT l.scan_id, l.location_id, l.path, s.file_id, h.copy_id, s.state AS path_state, h.state AS copy_state, (s.last_scan = l.scan_id)::INT AS observed_by_scan, (l.scan_id = 'scan_1' AND (s.state = 'missing' OR coalesce(h.state = 'corrupt', false)))::INT AS pending_missing
FROM listing l JOIN seen s ON s.collection_id = l.collection_id AND s.location_id = l.location_id AND s.path = l.path AND s.file_state = 'active' LEFT JOIN seen h ON h.location_id = l.location_id AND h.path = l.path AND h.state <> 'superseded'""")
def _(c):
    listing, observed, held, missing = _seen(c)
    return scans.known_entries(listing, observed, c.file_refs, held, missing).withColumns({n: F.col(n).cast("int") for n in ("observed_by_scan", "pending_missing")})


@query("k56_known_copies", _SEEN + "SELECT l.scan_id, l.location_id, l.path, h.copy_id, h.state, h.content_id, h.external_id, (l.scan_id = 'scan_1' AND h.state = 'corrupt')::INT AS pending_missing FROM listing l JOIN seen h ON h.location_id = l.location_id AND h.path = l.path AND h.state <> 'superseded'")
def _(c):
    listing, _, held, missing = _seen(c)
    return scans.known_copies(listing.drop("collection_id"), held, missing).withColumn("pending_missing", F.col("pending_missing").cast("int"))


@query("f08_listed_first", ", r AS (SELECT state, path, size, row_number() OVER (PARTITION BY state ORDER BY path) AS n FROM (SELECT c.state, f.path, f.size FROM copies c JOIN file_refs f USING (file_id) QUALIFY row_number() OVER (PARTITION BY c.state, f.path) = 1)) SELECT state, count(*) AS count, sum(size)::BIGINT AS bytes, string_agg(path, ',' ORDER BY n) FILTER (n <= 20) AS listed, (count(*) > 20)::INT AS truncated FROM r GROUP BY 1")
def _(c):
    rows = c.copies.join(c.file_refs.select("file_id", "path", "size"), "file_id").select("state", "path", "size").distinct()
    found = scans.listed(rows, "state", ["path"], "size")
    return found.select("state", "count", "bytes", F.array_join(F.transform("listed", lambda x: x["path"]), ",").alias("listed"), F.col("truncated").cast("int").alias("truncated"))


_CHANGED = ", ch AS (SELECT *, replace(device_id, 'device_', '')::BIGINT AS k, ['register', 'update', 'move', 'retire'][replace(device_id, 'device_', '')::BIGINT % 4 + 1] AS action FROM devices) "


@query("k58_device_changes", _CHANGED + """, x AS (SELECT device_id AS change_id, k, action, CASE WHEN k % 4 = 0 AND k % 3 <> 0 THEN 'new_' || device_id ELSE device_id END AS device_id, CASE WHEN k % 33 = 5 THEN ' ' ELSE display_name END AS display_name, CASE WHEN (action = 'retire') <> (k % 26 = 7) THEN 'retired' ELSE 'active' END AS status,
  CASE WHEN k % 21 = 2 THEN 'site_none' WHEN k % 8 = 2 OR k % 8 = 1 THEN 'site_3' ELSE current_site_id END AS site, CASE WHEN k % 34 = 9 THEN 'odd' ELSE identity_state END AS identity_state, CASE WHEN k % 35 = 8 THEN 'never' ELSE expected_availability END AS availability,
  CASE WHEN k % 16 <> 4 THEN 'print_' || (k % 90) END AS fingerprint, CASE WHEN k % 22 = 6 THEN 'Mount_Path' WHEN k % 18 <> 4 THEN 'serial' END AS fingerprint_kind, current_site_id FROM ch),
held AS (SELECT device_id, 'print_' || (replace(device_id, 'device_', '')::BIGINT % 90) AS fingerprint, 'serial' AS fingerprint_kind FROM devices WHERE status = 'active' AND identity_state = 'confirmed')
SELECT change_id, CASE WHEN trim(display_name) = '' THEN 'display_name_required' WHEN action = 'retire' AND status <> 'retired' THEN 'status_not_retired' WHEN action <> 'retire' AND status <> 'active' THEN 'status_not_active' WHEN action = 'register' AND device_id IN (SELECT device_id FROM devices) THEN 'already_exists'
  WHEN action <> 'register' AND device_id NOT IN (SELECT device_id FROM devices) THEN 'not_found' WHEN site IS NOT NULL AND site NOT IN (SELECT site_id FROM sites) THEN 'site_not_found' WHEN identity_state NOT IN ('confirmed', 'unavailable', 'conflict') THEN 'invalid_identity_state' WHEN availability NOT IN ('online', 'offline', 'intermittent') THEN 'invalid_expected_availability'
  WHEN (fingerprint IS NULL) <> (fingerprint_kind IS NULL) THEN 'fingerprint_incomplete' WHEN fingerprint IS NULL THEN 'fingerprint_required' WHEN fingerprint_kind = 'Mount_Path' THEN 'fingerprint_of_a_root'
  WHEN identity_state = 'confirmed' AND EXISTS (SELECT 1 FROM held h WHERE h.fingerprint = x.fingerprint AND h.fingerprint_kind = x.fingerprint_kind AND h.device_id <> x.device_id) THEN 'fingerprint_taken'
  WHEN action = 'update' AND site IS DISTINCT FROM current_site_id THEN 'site_changes_by_move' WHEN action = 'move' AND site IS NOT DISTINCT FROM current_site_id THEN 'move_changes_nothing' END AS fault FROM x""")
def _(c):
    k, action = F.col("k"), F.col("action")
    mark = F.concat(F.lit("print_"), (_number("device_id", "device_") % 90).cast("string"))
    devices = c.devices.withColumns({"fingerprint": mark, "fingerprint_kind": F.lit("serial")})
    rows = devices.withColumn("k", _number("device_id", "device_")).withColumn("action", F.element_at(F.array(*map(F.lit, ("register", "update", "move", "retire"))), (k % 4 + 1).cast("int")))
    changes = rows.select(
        F.col("device_id").alias("change_id"), "action", F.when((k % 4 == 0) & (k % 3 != 0), F.concat(F.lit("new_"), "device_id")).otherwise(F.col("device_id")).alias("device_id"), F.when(k % 33 == 5, " ").otherwise(F.col("display_name")).alias("display_name"),
        F.when((action == "retire") != (k % 26 == 7), "retired").otherwise("active").alias("status"), F.when(k % 21 == 2, "site_none").when((k % 8 == 2) | (k % 8 == 1), "site_3").otherwise(F.col("current_site_id")).alias("current_site_id"),
        F.when(k % 34 == 9, "odd").otherwise(F.col("identity_state")).alias("identity_state"), F.when(k % 35 == 8, "never").otherwise(F.col("expected_availability")).alias("expected_availability"),
        F.when(k % 16 != 4, F.col("fingerprint")).alias("fingerprint"), F.when(k % 22 == 6, "Mount_Path").when(k % 18 != 4, "serial").alias("fingerprint_kind"),
    )
    return topology.device_changes(changes, devices, c.sites)


@query("k58_location_changes", """, x AS (SELECT l.*, replace(location_id, 'location_', '')::BIGINT AS k FROM locations l), y AS (SELECT location_id AS change_id, kind, CASE WHEN k % 12 = 5 THEN 'root_' || (k + 1) WHEN k % 12 = 7 THEN NULL ELSE archive_root_id END AS root, device_id, CASE WHEN kind = 'service' AND k % 3 <> 0 THEN NULL ELSE 'p' END AS relative_path,
CASE WHEN k % 20 = 4 THEN 'site_2' WHEN k % 30 = 21 THEN 'site_none' ELSE site_id END AS site FROM x) SELECT change_id, CASE WHEN kind = 'filesystem' AND (root IS NULL OR device_id IS NULL OR relative_path IS NULL) THEN 'filesystem_incomplete' WHEN kind = 'filesystem' AND site IS NOT NULL THEN 'site_comes_from_device' WHEN kind = 'filesystem' AND (SELECT r.device_id FROM archive_roots r WHERE r.archive_root_id = y.root) IS DISTINCT FROM device_id THEN 'root_of_another_device'
WHEN kind = 'service' AND (site IS NULL OR root IS NOT NULL OR device_id IS NOT NULL OR relative_path IS NOT NULL) THEN 'service_needs_a_site_only' WHEN kind = 'service' AND site NOT IN (SELECT site_id FROM sites) THEN 'site_not_found' END AS fault FROM y""")
def _(c):
    k = _number("location_id", "location_")
    changes = c.locations.select(
        F.col("location_id").alias("change_id"), "location_id", F.lit("update").alias("action"), "display_name", F.lit("active").alias("status"), "kind", "expected_availability", "device_id", F.when(k % 12 == 5, F.concat(F.lit("root_"), (k + 1).cast("string"))).when(k % 12 != 7, F.col("archive_root_id")).alias("archive_root_id"),
        F.when((F.col("kind") != "service") | (k % 3 == 0), "p").alias("relative_path"), F.when(k % 20 == 4, "site_2").when(k % 30 == 21, "site_none").otherwise(F.col("site_id")).alias("site_id"),
    )
    return topology.location_changes(changes, c)


@query("k59_scan_topology", """, x AS (SELECT location_id AS scan_id, l.*, replace(location_id, 'location_', '')::BIGINT AS k FROM locations l), y AS (SELECT scan_id, location_id, kind, status, 'collection_' || (k % 6 + 1) AS collection_id, device_id AS own_device, archive_root_id AS own_root, CASE WHEN k % 10 = 2 THEN 'device_' || (k + 2) ELSE device_id END AS device_id, CASE WHEN k % 14 = 3 THEN 'root_' || (k + 1) ELSE archive_root_id END AS root FROM x)
SELECT scan_id, CASE WHEN collection_id NOT IN (SELECT collection_id FROM collections WHERE status = 'active') THEN 'collection_not_active' WHEN y.status <> 'active' THEN 'location_not_active' WHEN kind <> 'filesystem' THEN 'not_a_filesystem' WHEN r.archive_root_id IS NULL THEN 'archive_root_not_active' WHEN d.device_id IS NULL THEN 'device_not_active'
WHEN own_device IS DISTINCT FROM y.device_id THEN 'location_on_another_device' WHEN own_root IS DISTINCT FROM y.root THEN 'location_on_another_root' WHEN r.device_id IS DISTINCT FROM y.device_id THEN 'root_on_another_device' WHEN d.identity_state = 'conflict' THEN 'device_identity_conflict' END AS fault
FROM y LEFT JOIN archive_roots r ON r.archive_root_id = y.root AND r.status = 'active' LEFT JOIN devices d ON d.device_id = y.device_id AND d.status = 'active'""")
def _(c):
    k = _number("location_id", "location_")
    asked = c.locations.select(
        F.col("location_id").alias("scan_id"), "location_id", F.concat(F.lit("collection_"), (k % 6 + 1).cast("string")).alias("collection_id"), F.when(k % 10 == 2, F.concat(F.lit("device_"), (k + 2).cast("string"))).otherwise(F.col("device_id")).alias("device_id"),
        F.when(k % 14 == 3, F.concat(F.lit("root_"), (k + 1).cast("string"))).otherwise(F.col("archive_root_id")).alias("archive_root_id"),
    )
    return topology.scan_topology(asked, c)


@query("e02_device_mounts", f"SELECT device_id, host FROM {_DEVICE_MOUNT}")
def _(c):
    return status.device_mounts(c).select("device_id", "host")


@query("e05_latest_replication", _META + "SELECT r.destination_id, arg_max(r.checkpoint_id, (c.last_seq, c.checkpoint_id)) AS checkpoint_id, arg_max(r.status, (c.last_seq, c.checkpoint_id)) AS status FROM (SELECT * FROM rp UNION ALL SELECT 'scan_1', destination_id, 'failed', 'unknown', 5 FROM rp) r JOIN cp c USING (checkpoint_id) GROUP BY 1")
def _(c):
    checkpoints = c.scans.select(F.col("scan_id").alias("checkpoint_id"), F.floor(F.col("started_ms") / 1_000_000).alias("last_seq"))
    own = c.locations.select(
        F.concat(F.lit("scan_"), F.replace("location_id", F.lit("location_"), F.lit(""))).alias("checkpoint_id"), F.col("location_id").alias("destination_id"), F.when(F.col("kind") == "service", "verified").otherwise("pending").alias("status"),
        F.when(F.col("encryption_state") == "unencrypted", "independent").otherwise("unknown").alias("independence"), (100_000 + 3 * F.length("location_id")).cast("long").alias("event_seq"),
    )
    # the failures are event 5, before all others: location_1, which has two rows of scan_1, keeps its own, as the SQL does that takes its rows in order
    both = own.unionByName(own.withColumns({"checkpoint_id": F.lit("scan_1"), "status": F.lit("failed"), "independence": F.lit("unknown"), "event_seq": F.lit(5).cast("long")}))
    return metadata.latest_replication(both, checkpoints).select("destination_id", "checkpoint_id", "status")


@query("h19_percent", f", s AS ({_LOCATION}) SELECT location_id, collection_id, CASE WHEN tracked = 0 THEN 0.0 ELSE round(100.0::DOUBLE * verified / tracked, 1) END AS verified_percent FROM s")
def _(c):
    return summaries.location_summary(c, AS_OF, WINDOW).select("location_id", "collection_id", numbers.percent("verified", "tracked").alias("verified_percent"))


@query("k54_interleaved_scans", ", sc AS (SELECT scan_id, 'location_' || (replace(scan_id, 'scan_', '')::BIGINT % 10) AS location_id, collection_id, started_ms, finished_ms FROM scans) SELECT DISTINCT s.scan_id FROM sc s JOIN sc x ON x.location_id = s.location_id AND x.collection_id = s.collection_id AND x.scan_id <> s.scan_id AND x.started_ms BETWEEN s.started_ms AND s.finished_ms")
def _(c):
    # ten locations, so that scans of one overlap
    return scans.interleaved_scans(dataclasses.replace(c, scans=c.scans.withColumn("location_id", F.concat(F.lit("location_"), (_number("scan_id", "scan_") % 10).cast("string")))))


@query("k51_rebuild_equivalence", ", n AS (SELECT replace(object_id, 'object_', '')::BIGINT % 50 AS r FROM (SELECT DISTINCT object_id, location_id FROM observations)) SELECT count(*) FILTER (r IN (3, 7)) AS only_a, count(*) FILTER (r = 7) AS only_b FROM n")
def _(c):
    # the fold of everything against that of the objects' halves put together, with some rows lost and some changed on the way
    half = F.crc32(F.col("object_id").cast("binary")) % 2
    whole = scans.fold_observations(c.observations, c.objects)
    parts = [scans.fold_observations(c.observations.filter(half == i), c.objects) for i in (0, 1)]
    rest = _number("object_id", "object_") % 50
    other = parts[0].unionByName(parts[1]).filter(rest != 3).withColumn("events", F.col("events") + F.when(rest == 7, 1).otherwise(0))
    return scans.equal_tables(whole, other)
