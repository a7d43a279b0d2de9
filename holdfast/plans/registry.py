"""Registered queries over the derived catalog, and their SQL counterparts, written from the semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators import access, find, history, metadata, migrate, policy, review, risk, scans, status, summaries
from holdfast.operators.find import Filter, Group
from holdfast.sources import annex
from holdfast.sources.adapter import AS_OF, DAY, SQL, WINDOW, catalog
from holdfast.streaming import log

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The same queries as functions of a catalog, wherever it comes from.
OF_CATALOG: dict = {}

HOME = "site_1"
DAYS = {f"collection_{i}": 300 * i + 1500 for i in range(1, 6)}
SINCE = (AS_OF - 3000 * DAY, AS_OF - 3200 * DAY, AS_OF - 1000 * DAY)
NEEDS = [(2, 2, 2, 1, 1, 1), (0, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0), (0, 3, 0, 0, 0, 0), (0, 0, 3, 0, 0, 0), (0, 0, 0, 1, 0, 0), (0, 0, 0, 0, 1, 0), (0, 0, 0, 0, 0, 1)]
GROUP_A, GROUP_B = tuple(f"location_{i}" for i in range(1, 41)), tuple(f"location_{i}" for i in range(30, 71))


def query(name: str, sql: str | None = None):
    """Register a function of a catalog; `sql` follows the derivation's common tables."""
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(catalog(spark, sf_dir))

        QUERIES[name], OF_CATALOG[name] = run, f
        if sql is not None:
            ORACLES[name] = SQL + sql
        return f

    return add


def _in(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


GOOD = "f.presence = 'present' AND f.integrity = 'verified' AND f.last_check_result = 'ok' AND f.observed = o.expected AND f.last_success_ms IS NOT NULL"
FRESH = f"f.last_success_ms BETWEEN {AS_OF - WINDOW} AND {AS_OF}"


def _some(where: str) -> str:
    return f"EXISTS (SELECT 1 FROM files f WHERE f.object_id = o.object_id AND {where})"


@query("k01_find_objects", f"SELECT o.object_id, o.collection_id, o.path FROM objects o WHERE o.expected IS NOT NULL AND {_some(f'f.location_id IN ({_in(GROUP_A)}) AND {GOOD}')} AND NOT {_some(f'f.location_id IN ({_in(GROUP_B)}) AND {GOOD} AND {FRESH}')}")
def _(c):
    want = Filter(groups=(Group(GROUP_A), Group(GROUP_B, negated=True, verified_within=WINDOW)))
    return find.find_objects(c, want, AS_OF).select("object_id", "collection_id", F.col("path_bytes").cast("string").alias("path"))


for _name, _args, _where in (
    ("k02_copies_below_present", {}, "f.presence = 'present'"), ("k02_copies_below_verified", {"verified_copies": True}, GOOD), ("k02_copies_below_recent", {"verified_within": WINDOW}, f"{GOOD} AND {FRESH}"),
):
    @query(_name, f"SELECT o.object_id FROM objects o WHERE (SELECT count(*) FROM files f WHERE f.object_id = o.object_id AND {_where}) < 2")
    def _(c, args=_args):
        return find.find_objects(c, Filter(copies_below=2, **args), AS_OF).select("object_id")


@query("b04_unresolved_by_prefix", "SELECT object_id, path FROM objects WHERE expected IS NULL AND starts_with(path, '1995/0')")
def _(c):
    return find.find_objects(c, Filter(identity="unresolved", prefix=("utf8", b"1995/0")), AS_OF).select("object_id", F.col("path_bytes").cast("string").alias("path"))


@query("f02_page_after_key", "SELECT collection_id, path FROM objects WHERE (collection_id, path_encoding, path) > ('collection_2', 'utf8', '1994/06/') ORDER BY collection_id, path_encoding, path LIMIT 101")
def _(c):
    rows = find.page(c.objects, 100, ["collection_2", "utf8", b"1994/06/"])
    return rows.select("collection_id", F.col("path_bytes").cast("string").alias("path"))


@query("k03_show_objects", """SELECT o.object_id, o.collection_id, count(f.location_id)::INT AS copies, coalesce(string_agg(l.display_name || ':' || f.presence || ':' || coalesce(l.site_id, d.current_site_id, '-'), ',' ORDER BY l.display_name, l.location_id), '') AS listing
FROM objects o LEFT JOIN files f USING (object_id) LEFT JOIN locations l USING (location_id) LEFT JOIN devices d USING (device_id) WHERE o.collection_id = 'collection_1' GROUP BY ALL""")
def _(c):
    shown = find.show_objects(c, c.objects.filter("collection_id = 'collection_1'"))
    line = F.transform("copies", lambda x: F.concat_ws(":", x["location_name"], x["presence"], F.coalesce(x["site"], F.lit("-"))))
    return shown.select("object_id", "collection_id", F.size("copies").alias("copies"), F.array_join(line, ",").alias("listing"))


@query("k05_resolve_names", """, names AS (SELECT path AS name FROM objects WHERE collection_id = 'collection_3' UNION ALL SELECT object_id FROM objects WHERE collection_id = 'collection_4' UNION ALL SELECT '/archive/' || path FROM objects WHERE collection_id = 'collection_5' UNION ALL SELECT 'nothing'),
hits AS (SELECT n.name, o.object_id, 1 AS r FROM names n JOIN objects o ON n.name = o.path UNION ALL SELECT n.name, o.object_id, 2 FROM names n JOIN objects o ON n.name = o.object_id UNION ALL SELECT n.name, o.object_id, 3 FROM names n JOIN objects o ON n.name = '/archive/' || o.path)
SELECT n.name, CASE WHEN count(h.r) = 1 THEN min(h.object_id) END AS object_id, count(h.r) AS matches FROM names n LEFT JOIN (SELECT * FROM hits QUALIFY r = min(r) OVER (PARTITION BY name)) h USING (name) GROUP BY n.name""")
def _(c):
    path, of = F.col("path_bytes"), lambda i: c.objects.filter(F.col("collection_id") == f"collection_{i}")
    names = of(3).select(path.alias("name")).union(of(4).select(F.col("object_id").cast("binary"))).union(of(5).select(F.concat(F.lit(b"/archive/"), path))).union(c.objects.sparkSession.createDataFrame([(bytearray(b"nothing"),)], "name binary"))
    return find.resolve(c, names, b"/archive").select(F.col("name").cast("string").alias("name"), "object_id", "matches")


def _scope(expr: str, label: str, files_from: str, objects_from: str) -> str:
    return f"""SELECT '{label}' AS kind, a.scope, a.objects, a.unresolved_objects, coalesce(b.p, 0) AS present_files, coalesce(b.m, 0) AS missing_files, coalesce(b.u, 0) AS unknown_files, coalesce(b.v, 0) AS verified_present_files, coalesce(b.d, 0) AS damaged_files
FROM (SELECT {expr} AS scope, count(DISTINCT o.object_id) AS objects, count(DISTINCT o.object_id) FILTER (o.expected IS NULL) AS unresolved_objects FROM {objects_from} WHERE {expr} IS NOT NULL GROUP BY 1) a LEFT JOIN
(SELECT {expr} AS scope, count(*) FILTER (f.presence = 'present') AS p, count(*) FILTER (f.presence = 'missing') AS m, count(*) FILTER (f.presence = 'unknown') AS u, count(*) FILTER ({GOOD}) AS v, count(*) FILTER (f.integrity = 'damaged') AS d FROM {files_from} GROUP BY 1) b USING (scope)"""


_JOINED = "files f JOIN objects o USING (object_id) JOIN locations l USING (location_id) LEFT JOIN devices d USING (device_id)"


@query("k06_scope_summaries", " UNION ALL ".join((_scope("'archive'", "archive", _JOINED, "objects o"), _scope("o.collection_id", "collection_id", _JOINED, "objects o"), *(_scope(e, k, _JOINED, _JOINED) for e, k in (("l.location_id", "location_id"), ("l.device_id", "device_id"), ("coalesce(l.site_id, d.current_site_id)", "site"))))))
def _(c):
    return summaries.scope_summaries(c)


_HEALTHY = f"coalesce({GOOD} AND f.last_success_ms <= {AS_OF}, false)"
_LOCATION = f"""SELECT f.location_id, o.collection_id, count(*) AS tracked, count(*) FILTER (f.presence = 'present') AS present, count(*) FILTER (f.presence = 'missing') AS missing, count(*) FILTER (f.presence = 'unknown') AS unknown,
count(*) FILTER ({_HEALTHY}) AS verified, count(*) FILTER ({_HEALTHY} AND f.last_success_ms >= {AS_OF - WINDOW}) AS recent, count(*) FILTER ({_HEALTHY} AND f.last_success_ms < {AS_OF - WINDOW}) AS stale,
count(*) FILTER (f.presence = 'present' AND f.integrity <> 'damaged' AND NOT {_HEALTHY}) AS unverified, count(*) FILTER (f.presence = 'present' AND f.integrity = 'damaged') AS damaged, count(*) FILTER (f.presence = 'present' AND f.last_success_ms IS NULL) AS never_verified,
count(*) FILTER (o.expected IS NULL) AS unresolved, count(*) FILTER (f.presence = 'present' AND NOT EXISTS (SELECT 1 FROM files x WHERE x.object_id = f.object_id AND x.location_id <> f.location_id AND x.presence = 'present' AND x.integrity = 'verified' AND x.last_check_result = 'ok' AND x.observed = o.expected AND x.last_success_ms BETWEEN {AS_OF - WINDOW} AND {AS_OF})) AS without_recent_other_copy
FROM files f JOIN objects o USING (object_id) GROUP BY 1, 2"""


@query("k07_location_summary", _LOCATION)
def _(c):
    return summaries.location_summary(c, AS_OF, WINDOW)


@query("k07_location_totals", f", s AS ({_LOCATION}) SELECT location_id, {', '.join(f'coalesce(sum({m}), 0)::BIGINT AS {m}' for m in summaries.LOCATION_MEASURES)} FROM locations LEFT JOIN s USING (location_id) GROUP BY 1")
def _(c):
    return summaries.location_totals(c, AS_OF, WINDOW)


_MEASURES = ("present_copies", "recent_copies", "present_sites", "recent_sites", "total_files", "without_expected", "present_unknown_site", "recent_unknown_site")


@query("k08_collection_protection", f""", per AS (SELECT o.object_id, o.collection_id, count(*) FILTER (f.presence = 'present') AS present_copies, count(*) FILTER ({GOOD} AND {FRESH}) AS recent_copies, count(DISTINCT CASE WHEN f.presence = 'present' THEN s END) AS present_sites,
count(DISTINCT CASE WHEN {GOOD} AND {FRESH} THEN s END) AS recent_sites, (o.expected IS NULL)::INT AS without_expected, coalesce(max((f.presence = 'present' AND s IS NULL)::INT), 0) AS present_unknown_site, coalesce(max(({GOOD} AND {FRESH} AND s IS NULL)::INT), 0) AS recent_unknown_site
FROM objects o LEFT JOIN (SELECT f.*, coalesce(l.site_id, d.current_site_id) AS s FROM files f JOIN locations l USING (location_id) LEFT JOIN devices d USING (device_id)) f USING (object_id) GROUP BY o.object_id, o.collection_id, o.expected),
long AS ({" UNION ALL ".join(f"SELECT collection_id, '{m}' AS measure, {m}::BIGINT AS bucket, 1 AS n FROM per" for m in _MEASURES[:4])} UNION ALL SELECT collection_id, 'total_files', 0, 1 FROM per UNION ALL {" UNION ALL ".join(f"SELECT collection_id, '{m}', 0, {m} FROM per" for m in _MEASURES[5:])}
UNION ALL SELECT collection_id, m, 0, 0 FROM collections, (SELECT unnest([{_in(_MEASURES)}]) AS m))
SELECT collection_id, measure, bucket, sum(n)::BIGINT AS n FROM long GROUP BY 1, 2, 3""")
def _(c):
    return summaries.collection_protection(c, AS_OF, WINDOW)


@query("k09_site_devices", "SELECT s.site_id, s.display_name AS site_name, d.device_id, d.status, d.expected_availability FROM devices d JOIN sites s ON s.site_id = d.current_site_id")
def _(c):
    return summaries.site_devices(c)


_TARGET = "location_7"


@query("k10_removal_preview", f"SELECT o.object_id, f.presence, f.integrity FROM objects o JOIN files f USING (object_id) JOIN locations l USING (location_id) WHERE f.location_id = '{_TARGET}' AND l.status = 'active' AND f.presence <> 'missing' AND o.expected IS NOT NULL AND {GOOD}")
def _(c):
    return find.removal_preview(c, Filter(groups=(Group((_TARGET,)),)), AS_OF).select("object_id", "presence", "integrity")


@query("k11_mark_removed", f"""SELECT f.object_id, f.location_id, CASE WHEN gone THEN 'missing' ELSE f.presence END AS presence, CASE WHEN gone THEN 'unverified' ELSE f.integrity END AS integrity, CASE WHEN gone THEN {AS_OF} ELSE f.last_check_ms END AS last_check_ms, f.observed
FROM (SELECT f.*, f.location_id = '{_TARGET}' AND {GOOD} AND f.presence <> 'missing' AS gone FROM files f JOIN objects o USING (object_id)) f WHERE f.location_id IN ('{_TARGET}', 'location_8')""")
def _(c):
    selected = find.removal_preview(c, Filter(groups=(Group((_TARGET,)),)), AS_OF)
    rows = find.mark_removed(c, selected, AS_OF).filter(F.col("location_id").isin(_TARGET, "location_8"))
    return rows.select("object_id", "location_id", "presence", "integrity", "last_check_ms", F.lower(F.hex("observed")).alias("observed"))


@query("k12_host_copy", f"SELECT o.object_id, o.path, o.expected_size FROM objects o WHERE o.expected IS NOT NULL AND {_some(f'f.location_id = {chr(39)}location_3{chr(39)} AND {GOOD}')} AND NOT {_some('f.location_id = ' + chr(39) + 'location_4' + chr(39) + ' AND f.presence = ' + chr(39) + 'present' + chr(39))}")
def _(c):
    return find.host_copy(c, "location_3", "location_4", AS_OF).select("object_id", F.col("path_bytes").cast("string").alias("path"), "expected_size")


@query("k13_host_remove", f"""SELECT o.object_id, max(f.last_success_ms) AS last_verified, max(f.last_success_ms) + {WINDOW} AS expires FROM objects o JOIN files f USING (object_id) WHERE f.location_id IN ({_in(GROUP_B)}) AND {GOOD} AND {FRESH}
AND EXISTS (SELECT 1 FROM files t WHERE t.object_id = o.object_id AND t.location_id = 'location_5' AND t.presence = 'present' AND t.integrity = 'verified' AND t.last_check_result = 'ok' AND t.observed = o.expected AND t.last_success_ms IS NOT NULL) GROUP BY o.object_id""")
def _(c):
    return find.host_remove(c, "location_5", GROUP_B, WINDOW, AS_OF).select("object_id", "last_verified", "expires")


@query("k14_due_for_verification", f"SELECT object_id FROM files WHERE location_id = 'location_9' AND (integrity <> 'verified' OR presence <> 'present' OR last_success_ms IS NULL OR last_success_ms <= {AS_OF - WINDOW})")
def _(c):
    return find.due_for_verification(c, "location_9", AS_OF - WINDOW).select("object_id")


_VERIFIED = "f.presence = 'present' AND f.integrity = 'verified' AND f.last_check_result = 'ok' AND f.observed = o.expected"


@query("k15_copy_worklist", f"SELECT o.object_id FROM objects o WHERE {_some('f.location_id = ' + chr(39) + 'location_10' + chr(39) + ' AND ' + _VERIFIED)} AND NOT {_some('f.location_id = ' + chr(39) + 'location_11' + chr(39) + ' AND ' + _VERIFIED)}")
def _(c):
    return find.copy_worklist(c, "location_10", "location_11").select("object_id")


_REGISTRY = "SELECT 'site' AS kind, site_id AS id, display_name AS name, status FROM sites UNION ALL SELECT 'device', device_id, display_name, status FROM devices UNION ALL SELECT 'location', location_id, display_name, status FROM locations UNION ALL SELECT 'collection', collection_id, display_name, status FROM collections UNION ALL SELECT 'archive_root', archive_root_id, archive_root_id, status FROM archive_roots"


@query("k16_registry_state", f"SELECT * FROM ({_REGISTRY}) WHERE status = 'active'")
def _(c):
    return summaries.registry_state(c)


@query("k17_collection_of_location", "SELECT l.location_id, count(DISTINCT o.collection_id) AS collections, CASE WHEN count(DISTINCT o.collection_id) = 1 THEN min(o.collection_id) END AS collection_id FROM locations l LEFT JOIN files f USING (location_id) LEFT JOIN objects o USING (object_id) GROUP BY 1")
def _(c):
    return summaries.collection_of_location(c)


@query("k19_health_check", """SELECT 'files.object' AS "check", count(*) AS violations FROM files f ANTI JOIN objects USING (object_id) UNION ALL SELECT 'files.location', count(*) FROM files ANTI JOIN locations USING (location_id) UNION ALL SELECT 'objects.collection', count(*) FROM objects ANTI JOIN collections USING (collection_id)
UNION ALL SELECT 'locations.device', count(*) FROM locations l WHERE device_id IS NOT NULL AND device_id NOT IN (SELECT device_id FROM devices) UNION ALL SELECT 'locations.site', count(*) FROM locations WHERE site_id IS NOT NULL AND site_id NOT IN (SELECT site_id FROM sites)
UNION ALL SELECT 'devices.site', count(*) FROM devices WHERE current_site_id IS NOT NULL AND current_site_id NOT IN (SELECT site_id FROM sites) UNION ALL SELECT 'mounts.root', count(*) FROM mounts WHERE archive_root_id NOT IN (SELECT archive_root_id FROM archive_roots)
UNION ALL SELECT 'files.key', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM files GROUP BY object_id, location_id HAVING count(*) > 1) UNION ALL SELECT 'objects.path', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM objects GROUP BY collection_id, path HAVING count(*) > 1)""")
def _(c):
    return summaries.health_check(c)


@query("k20_find_files", f"""SELECT f.file_id FROM file_refs f WHERE f.state = 'active' AND EXISTS (SELECT 1 FROM copies x WHERE x.content_id = f.content_id AND x.state = 'present' AND x.location_id IN ({_in(GROUP_A)}))
AND NOT EXISTS (SELECT 1 FROM copies x WHERE x.content_id = f.content_id AND x.state = 'present' AND x.location_id IN ({_in(GROUP_B)}) AND x.verification_result = 'ok' AND x.last_verified_ms BETWEEN {AS_OF - WINDOW} AND {AS_OF})""")
def _(c):
    return review.find_files(c, [Group(GROUP_A), Group(GROUP_B, True, WINDOW)], AS_OF).select("file_id")


@query("k21_copy_metrics", "SELECT coalesce('object:' || content_id, 'external:' || external_id) AS key, count(*) AS copies, count(*) FILTER (state = 'present') AS present, max(last_seen_ms) AS last_seen_ms, max(last_verified_ms) FILTER (verification_result = 'ok') AS last_verified_ms FROM copies WHERE state <> 'superseded' AND coalesce(content_id, external_id) IS NOT NULL GROUP BY 1")
def _(c):
    return review.copy_metrics(c)


@query("k22_matching_sources", f"SELECT DISTINCT c.content_id, c.location_id, f.path FROM copies c JOIN file_refs f USING (file_id) WHERE c.state = 'present' AND c.content_id IS NOT NULL AND c.location_id IN ({_in(GROUP_A)})")
def _(c):
    return review.sources(c, Group(GROUP_A))


@query("k23_review_files", "SELECT f.file_id, f.state, coalesce(m.n, 0) AS copies, coalesce(m.p, 0) AS present FROM file_refs f LEFT JOIN (SELECT coalesce('o:' || content_id, 'e:' || external_id) AS k, count(*) AS n, count(*) FILTER (state = 'present') AS p FROM copies WHERE state <> 'superseded' GROUP BY 1) m ON m.k = coalesce('o:' || f.content_id, 'e:' || f.external_id) WHERE f.collection_id = 'collection_2'")
def _(c):
    return review.review_files(c, c.file_refs.filter("collection_id = 'collection_2'")).select("file_id", "state", "copies", "present")


@query("k24_list_copies", f"SELECT c.copy_id, c.location_id, c.state FROM copies c JOIN locations l USING (location_id) WHERE c.state = 'present' AND (c.last_verified_ms IS NULL OR c.last_verified_ms < {AS_OF - 2000 * DAY}) AND c.file_id IN (SELECT file_id FROM file_refs WHERE collection_id = 'collection_1')")
def _(c):
    return review.list_copies(c, state="present", verified_before=AS_OF - 2000 * DAY, collection="collection_1").select("copy_id", "location_id", "state")


# policies: reasons as rows first, then everything is counted from them
_RULES = [
    ("object_identity_mismatch", "f.content_id IS DISTINCT FROM c.content_id", 0), ("verification_missing", "c.verification_result IS NULL", 1), ("location_inactive", "l.status <> 'active'", 0), ("location_untrusted", "l.trust_level = 'untrusted'", 0), ("location_trust_unknown", "l.trust_level IS NULL", 1),
    ("site_unknown", "p.site IS NULL", 1), ("site_inactive", "p.site_status <> 'active'", 0), ("archive_root_inactive", "l.kind = 'filesystem' AND p.root_status IS DISTINCT FROM 'active'", 0), ("device_inactive", "l.kind = 'filesystem' AND d.status IS DISTINCT FROM 'active'", 0),
    ("device_identity_unconfirmed", "l.kind = 'filesystem' AND d.identity_state IS DISTINCT FROM 'confirmed'", 1), ("device_fingerprint_not_matched", "l.kind = 'filesystem' AND d.fingerprint_status IS DISTINCT FROM 'match'", 1),
    ("offsite_copy_unencrypted", "f.encrypted_offsite AND p.esite <> f.home_site_id AND l.encryption_state = 'unencrypted'", 0), ("offsite_encryption_unknown", "f.encrypted_offsite AND p.esite <> f.home_site_id AND l.encryption_state IS NULL", 1),
]
for _time, _days, _label, _only in (("c.last_verified_ms", "f.verification_days", "verification", ""), ("c.last_seen_ms", "f.observation_days", "observation", ""), ("d.last_checkin_ms", "f.checkin_days", "device_checkin", "l.kind = 'filesystem' AND "), ("d.fingerprint_match_ms", "f.checkin_days", "device_fingerprint", "l.kind = 'filesystem' AND ")):
    _RULES += [(f"{_label}_time_missing", f"{_only}{_time} IS NULL", 1), (f"{_label}_time_in_future", f"{_only}{_time} > {AS_OF}", 1), (f"{_label}_stale", f"{_only}{_time} <= {AS_OF} AND {_time} + {_days} * {DAY}::BIGINT <= {AS_OF}", 1)]
_POLICY = f""", places AS (SELECT l.location_id, coalesce(l.site_id, d.current_site_id) AS site, s.status AS site_status, r.status AS root_status, CASE WHEN s.status = 'active' THEN s.site_id ELSE '' END AS esite
  FROM locations l LEFT JOIN devices d USING (device_id) LEFT JOIN sites s ON s.site_id = coalesce(l.site_id, d.current_site_id) LEFT JOIN archive_roots r USING (archive_root_id)),
pf AS (SELECT f.file_id, f.collection_id, f.content_id, f.size, f.identity_state = 'resolved' AND f.content_id IS NOT NULL AS usable, coalesce('o' || f.content_id, 'e' || f.external_id) AS k, k.home_site_id, q.* FROM file_refs f JOIN collections k USING (collection_id) JOIN policies q USING (policy_id) WHERE f.state = 'active'),
assessed AS (SELECT f.*, c.copy_id, c.location_id, l.device_id, l.archive_root_id, p.esite, p.esite <> f.home_site_id AS away, l.expected_availability = 'offline' OR coalesce(d.expected_availability = 'offline', false) AS is_offline, coalesce(l.encryption_state = 'encrypted', false) AS is_encrypted,
  list_filter([CASE WHEN c.state <> 'present' THEN 'copy_state_' || c.state END, CASE WHEN c.verification_result <> 'ok' THEN 'verification_' || c.verification_result END, {", ".join(f"CASE WHEN {w} THEN '{n}' END" for n, w, _ in _RULES)}], lambda x: x IS NOT NULL) AS found,
  least(CASE WHEN c.last_verified_ms <= {AS_OF} AND c.last_verified_ms + f.verification_days * {DAY}::BIGINT > {AS_OF} THEN c.last_verified_ms + f.verification_days * {DAY}::BIGINT END, CASE WHEN c.last_seen_ms <= {AS_OF} AND c.last_seen_ms + f.observation_days * {DAY}::BIGINT > {AS_OF} THEN c.last_seen_ms + f.observation_days * {DAY}::BIGINT END,
    CASE WHEN l.kind = 'filesystem' AND d.last_checkin_ms <= {AS_OF} AND d.last_checkin_ms + f.checkin_days * {DAY}::BIGINT > {AS_OF} THEN d.last_checkin_ms + f.checkin_days * {DAY}::BIGINT END, CASE WHEN l.kind = 'filesystem' AND d.fingerprint_match_ms <= {AS_OF} AND d.fingerprint_match_ms + f.checkin_days * {DAY}::BIGINT > {AS_OF} THEN d.fingerprint_match_ms + f.checkin_days * {DAY}::BIGINT END) AS expiry
  FROM pf f LEFT JOIN (SELECT *, coalesce('o' || content_id, 'e' || external_id) AS k FROM copies WHERE state <> 'superseded') c USING (k) LEFT JOIN locations l USING (location_id) LEFT JOIN devices d USING (device_id) LEFT JOIN places p USING (location_id)),
judged AS (SELECT *, CASE WHEN copy_id IS NULL THEN []::VARCHAR[] WHEN NOT usable THEN ['file_identity_not_resolved'] ELSE found END AS reasons FROM assessed),
good AS (SELECT * FROM judged WHERE copy_id IS NOT NULL AND len(reasons) = 0),
loss AS (SELECT DISTINCT file_id, copy_id, domain FROM (SELECT file_id, copy_id, coalesce('device:' || device_id, 'service:' || location_id) AS domain FROM good UNION ALL SELECT file_id, copy_id, 'site:' || esite FROM good
  UNION ALL SELECT g.file_id, g.copy_id, 'risk:' || r.risk_id FROM good g JOIN risk_assignments r ON (r.entity_type = 'location' AND r.entity_id = g.location_id) OR (r.entity_type = 'archive_root' AND r.entity_id = g.archive_root_id) OR (r.entity_type = 'device' AND r.entity_id = g.device_id) OR (r.entity_type = 'site' AND r.entity_id = g.esite))),
scenarios AS (SELECT file_id, domain, count(*) AS affected, t.n - count(*) AS remaining FROM loss JOIN (SELECT file_id, count(*) AS n FROM good GROUP BY 1) t USING (file_id) GROUP BY file_id, domain, t.n),
evaluated AS (SELECT file_id, collection_id, policy_id, any_value(size) AS size, count(*) FILTER (copy_id IS NOT NULL AND len(reasons) = 0) AS copies, count(DISTINCT device_id) FILTER (copy_id IS NOT NULL AND len(reasons) = 0) AS devices, count(DISTINCT esite) FILTER (copy_id IS NOT NULL AND len(reasons) = 0) AS sites,
  coalesce(bool_or(copy_id IS NOT NULL AND len(list_filter(reasons, lambda x: x IN ({_in([n for n, _, u in _RULES if u] + ["file_identity_not_resolved"])}))) > 0), false) AS doubt, bool_or(usable) AS usable, min(CASE WHEN usable THEN expiry END) AS valid_until, list_distinct(flatten(list(reasons))) AS told,
  min_copies, min_devices, min_sites, offsite, offline, encrypted_offsite, coalesce(bool_or(len(reasons) = 0 AND copy_id IS NOT NULL AND away), false) AS has_off, coalesce(bool_or(len(reasons) = 0 AND copy_id IS NOT NULL AND is_offline), false) AS has_line, coalesce(bool_or(len(reasons) = 0 AND copy_id IS NOT NULL AND away AND is_encrypted), false) AS has_enc,
  EXISTS (SELECT 1 FROM scenarios s WHERE s.file_id = judged.file_id AND s.remaining = 0) AS lost FROM judged GROUP BY file_id, collection_id, policy_id, min_copies, min_devices, min_sites, offsite, offline, encrypted_offsite),
final AS (SELECT *, array_to_string(list_filter([CASE WHEN copies < min_copies THEN 'min_qualifying_copies' END, CASE WHEN devices < min_devices THEN 'min_devices' END, CASE WHEN sites < min_sites THEN 'min_sites' END, CASE WHEN offsite AND NOT has_off THEN 'require_offsite_copy' END, CASE WHEN offline AND NOT has_line THEN 'require_offline_copy' END, CASE WHEN encrypted_offsite AND NOT has_enc THEN 'require_encrypted_offsite' END], lambda x: x IS NOT NULL), ',') AS failed FROM evaluated),
stated AS (SELECT *, CASE WHEN failed = '' AND NOT lost AND usable THEN 'satisfied' WHEN doubt OR NOT usable THEN 'uncertain' ELSE 'violated' END AS status FROM final) """


_SAYS = lambda *words: "list_bool_or([false] || list_transform(told, lambda x: " + " OR ".join(f"contains(x, '{w}')" for w in words) + "))"


@query("k27_evaluate_policies", _POLICY + f"""SELECT file_id, collection_id, policy_id, copies, devices, sites, failed, lost::INT AS permanent_loss, status, valid_until, array_to_string(list_filter([CASE WHEN {_SAYS('device', 'fingerprint')} THEN 'connect_device' END, CASE WHEN failed <> '' OR lost THEN 'create_copy' END, CASE WHEN NOT usable THEN 'resolve_identity' END,
CASE WHEN {_SAYS('unknown', 'mismatch')} THEN 'review_topology' END, CASE WHEN {_SAYS('observation')} THEN 'scan_again' END, CASE WHEN {_SAYS('verification')} THEN 'verify_again' END], lambda x: x IS NOT NULL), ',') AS actions FROM stated""")
def _(c):
    return policy.evaluate(c, AS_OF).withColumns({"failed": F.array_join("failed", ","), "actions": F.array_join("actions", ",")}).drop("size")


@query("k27_rollup", _POLICY + "SELECT policy_id, collection_id, status, count(*) AS files, sum(size)::BIGINT AS bytes, min(valid_until) AS valid_until FROM stated GROUP BY 1, 2, 3")
def _(c):
    return policy.rollup(c, policy.evaluate(c, AS_OF))


@query("k27_copy_reasons", _POLICY + "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM judged) GROUP BY 1")
def _(c):
    return policy.assessed(c, AS_OF).select(F.explode(policy.reason_names(AS_OF)).alias("reason"), "files").groupBy("reason").agg(F.sum("files").alias("n"))


@query("k27e_unconfigured", ", x AS (SELECT k.collection_id, CASE WHEN k.policy_id IS NULL THEN 'policy_missing' WHEN q.policy_id IS NULL THEN 'policy_unknown' WHEN k.home_site_id IS NULL THEN 'home_site_missing' WHEN s.status IS DISTINCT FROM 'active' THEN 'home_site_inactive' END AS reason FROM collections k LEFT JOIN policies q USING (policy_id) LEFT JOIN sites s ON s.site_id = k.home_site_id) SELECT * FROM x WHERE reason IS NOT NULL")
def _(c):
    return policy.unconfigured(c)


@query("k29_loss_scenarios", _POLICY + "SELECT file_id, split_part(domain, ':', 1) AS domain_kind, split_part(domain, ':', 2) AS domain_id, affected, remaining, (remaining = 0)::INT AS permanent_loss FROM scenarios")
def _(c):
    return policy.loss_scenarios(c, policy.assessed(c, AS_OF)).withColumn("permanent_loss", F.col("permanent_loss").cast("int"))


_COVERED = f""", covered AS (SELECT e.content_id, count(*) AS copies, count(DISTINCT e.device_id) AS devices, count(DISTINCT e.site) AS sites, max((e.site <> '{HOME}')::INT) AS off, max((e.expected_availability = 'offline')::INT) AS line, max((e.site <> '{HOME}' AND e.encryption_state = 'encrypted')::INT) AS enc FROM
(SELECT DISTINCT c.content_id, l.location_id, l.device_id, coalesce(d.current_site_id, l.site_id) AS site, l.expected_availability, l.encryption_state FROM copies c JOIN locations l ON l.location_id = c.location_id AND l.status = 'active' LEFT JOIN devices d ON d.device_id = l.device_id AND d.status = 'active'
WHERE c.state = 'present' AND c.last_seen_ms >= {SINCE[0]} AND c.last_verified_ms >= {SINCE[1]} AND c.integrity_code = 1 AND coalesce(c.error_code, '') NOT IN ('read_error', 'identity_mismatch') AND (l.device_id IS NULL OR (d.identity_state = 'confirmed' AND d.fingerprint_status = 'match' AND d.last_checkin_ms >= {SINCE[2]}))) e GROUP BY 1),
det AS (SELECT f.file_id, f.content_id, f.size, coalesce(copies, 0)::BIGINT AS copies, coalesce(devices, 0)::BIGINT AS devices, coalesce(sites, 0)::BIGINT AS sites, coalesce(off, 0)::BIGINT AS has_offsite, coalesce(line, 0)::BIGINT AS has_offline, coalesce(enc, 0)::BIGINT AS has_encrypted_offsite
FROM file_refs f LEFT JOIN covered USING (content_id) WHERE f.state = 'active' AND f.collection_id = 'collection_1') """


def _risk(c):
    return risk.details(c, risk.coverage(c, *SINCE, HOME, "collection_1"), "collection_1")


@query("k32_risk_details", _COVERED + "SELECT * FROM det")
def _(c):
    return _risk(c).drop("path")


@query("k32_risk_totals", _COVERED + " UNION ALL ".join(f"SELECT {i} AS vector, count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (content_id IS NOT NULL AND ({' OR '.join(f'{m} < {x}' for m, x in zip(risk.MEASURES, v, strict=True))})) AS at_risk, count(*) FILTER (content_id IS NULL) AS unresolved FROM det" for i, v in enumerate(NEEDS)))
def _(c):
    return risk.totals(_risk(c), NEEDS)


@query("k33_collection_summary", "SELECT k.collection_id, k.display_name, (SELECT count(*) FROM file_refs f WHERE f.collection_id = k.collection_id AND f.state = 'active') AS files, (SELECT coalesce(sum(size), 0)::BIGINT FROM file_refs f WHERE f.collection_id = k.collection_id AND f.state = 'active') AS bytes, (SELECT count(*) FROM file_refs f WHERE f.collection_id = k.collection_id AND f.state = 'active' AND content_id IS NULL) AS unresolved, (SELECT count(DISTINCT content_id) FROM file_refs f WHERE f.collection_id = k.collection_id AND f.state = 'active') AS contents, (SELECT count(DISTINCT c.location_id) FROM copies c JOIN file_refs f USING (file_id) WHERE f.collection_id = k.collection_id AND c.state <> 'superseded') AS locations FROM collections k")
def _(c):
    return status.collection_summary(c)


@query("k34_location_states", "SELECT c.location_id, " + ", ".join(f"count(*) FILTER (c.state = '{s}') AS {s}_copies, coalesce(sum(f.size) FILTER (c.state = '{s}'), 0)::BIGINT AS {s}_bytes" for s in ("present", "missing", "corrupt", "unknown")) + ", count(*) FILTER (c.content_id IS NULL) AS unresolved, max(last_seen_ms) AS last_inventory_ms, max(last_verified_ms) AS last_verification_ms FROM copies c JOIN file_refs f USING (file_id) GROUP BY 1")
def _(c):
    return status.location_states(c)


@query("k35_membership", "SELECT DISTINCT f.collection_id, c.location_id FROM copies c JOIN file_refs f USING (file_id) UNION SELECT collection_id, location_id FROM scans WHERE status IN ('running', 'complete', 'partial')")
def _(c):
    return status.membership(c)


@query("k36_stale_presence", f""", cut(collection_id, cutoff) AS (VALUES {", ".join(f"('{k}', {AS_OF - v * DAY})" for k, v in DAYS.items())}),
stale AS (SELECT DISTINCT c.content_id, c.location_id, coalesce(l.device_id, 'service:' || l.location_id) AS holder FROM copies c JOIN file_refs own USING (file_id) JOIN locations l USING (location_id) JOIN file_refs f ON f.content_id = c.content_id AND f.state = 'active' JOIN cut ON cut.collection_id = f.collection_id
LEFT JOIN (SELECT location_id, collection_id, max(finished_ms) AS done_ms FROM scans WHERE status = 'complete' GROUP BY 1, 2) s ON s.location_id = c.location_id AND s.collection_id = own.collection_id WHERE c.state = 'present' AND greatest(c.last_seen_ms, s.done_ms) < cut.cutoff)
SELECT 'location' AS scope, location_id AS id, count(DISTINCT content_id) AS contents FROM stale GROUP BY 2 UNION ALL SELECT 'holder', holder, count(DISTINCT content_id) FROM stale GROUP BY 2 UNION ALL SELECT 'archive', '', count(DISTINCT content_id) FROM stale""")
def _(c):
    return status.stale_presence(c, AS_OF, DAYS)


_DEVICE_MOUNT = "(SELECT r.device_id, m.host FROM mounts m JOIN archive_roots r USING (archive_root_id) WHERE m.status = 'mounted' QUALIFY row_number() OVER (PARTITION BY r.device_id ORDER BY m.observed_ms DESC, m.mount_id DESC) = 1)"


@query("k37_location_freshness", f"""SELECT l.location_id, (SELECT arg_max(scan_id, (started_ms, scan_id)) FROM scans s WHERE s.location_id = l.location_id) AS last_scan, (SELECT arg_max(status, (started_ms, scan_id)) FROM scans s WHERE s.location_id = l.location_id) AS last_status, (SELECT arg_max(scan_id, (started_ms, scan_id)) FROM scans s WHERE s.location_id = l.location_id AND status = 'complete') AS last_complete,
(SELECT arg_max(finished_ms, (started_ms, scan_id)) FROM scans s WHERE s.location_id = l.location_id AND status = 'complete') AS complete_ms, CASE WHEN l.kind = 'service' THEN 'service' WHEN m.host IS NOT NULL AND d.fingerprint_status = 'match' THEN 'available' WHEN m.host IS NOT NULL THEN 'unconfirmed' WHEN l.expected_availability = 'offline' THEN 'offline_expected' ELSE 'unavailable' END AS availability
FROM locations l LEFT JOIN devices d USING (device_id) LEFT JOIN {_DEVICE_MOUNT} m USING (device_id)""")
def _(c):
    return status.location_freshness(c)


@query("e01_latest_mounts", "SELECT archive_root_id, host, mount_id, status, observed_ms FROM mounts QUALIFY row_number() OVER (PARTITION BY archive_root_id, host ORDER BY observed_ms DESC, mount_id DESC) = 1")
def _(c):
    return status.latest_mounts(c).select("archive_root_id", "host", "mount_id", "status", "observed_ms")


@query("k40_integrity_report", "SELECT b.content_id, b.copy_id AS corrupt_copy, b.location_id AS corrupt_location, g.copy_id AS good_copy, g.last_verified_ms FROM copies b LEFT JOIN copies g ON g.content_id = b.content_id AND g.state = 'present' AND g.verification_result = 'ok' WHERE b.state = 'corrupt'")
def _(c):
    return review.integrity_report(c)


def _reachable(c):
    return c.locations.join(status.device_mounts(c).select("device_id"), "device_id", "left_semi").select("location_id")


def _requested(c):
    return c.file_refs.filter("collection_id in ('collection_1', 'collection_2')").select(F.col("origin_seq").alias("ordinal"), "file_id")


@query("k31_access_states", f""", near AS (SELECT l.location_id FROM locations l WHERE l.device_id IN (SELECT device_id FROM {_DEVICE_MOUNT})), held AS (SELECT coalesce('o' || c.content_id, 'e' || c.external_id) AS k, c.copy_id, c.location_id, l.device_id FROM copies c JOIN locations l USING (location_id) WHERE c.state = 'present' AND l.status = 'active'),
loc AS (SELECT k, arg_min(copy_id, (location_id, copy_id)) AS copy_id FROM held WHERE location_id IN (SELECT location_id FROM near) GROUP BY 1), att AS (SELECT DISTINCT k FROM held WHERE device_id IN (SELECT device_id FROM devices WHERE status = 'active'))
SELECT f.origin_seq AS ordinal, f.file_id, CASE WHEN f.collection_id <> 'collection_1' THEN 'wrong_collection' WHEN f.state = 'removed' THEN 'removed' WHEN loc.k IS NOT NULL THEN 'accessible' WHEN att.k IS NOT NULL THEN 'attachment_required' ELSE 'no_known_copy' END AS access, CASE WHEN f.collection_id = 'collection_1' AND f.state = 'active' THEN loc.copy_id END AS copy_id
FROM file_refs f LEFT JOIN loc ON loc.k = coalesce('o' || f.content_id, 'e' || f.external_id) LEFT JOIN att ON att.k = coalesce('o' || f.content_id, 'e' || f.external_id) WHERE f.collection_id IN ('collection_1', 'collection_2')""")
def _(c):
    return access.access_states(c, _requested(c), _reachable(c), "collection_1")


@query("k31_attachment_plan", """, held AS (SELECT DISTINCT coalesce('o' || c.content_id, 'e' || c.external_id) AS k, l.device_id FROM copies c JOIN locations l USING (location_id) WHERE c.state = 'present' AND l.status = 'active' AND l.device_id IN (SELECT device_id FROM devices WHERE status = 'active')),
wanted AS (SELECT coalesce('o' || content_id, 'e' || external_id) AS k, count(*) AS n FROM file_refs WHERE state = 'active' AND collection_id IN ('collection_1', 'collection_2') GROUP BY 1), sets AS (SELECT k, any_value(n) AS n, list(DISTINCT device_id) AS ds FROM wanted JOIN held USING (k) GROUP BY 1),
plan AS (SELECT * FROM (WITH RECURSIVE r(step, device_id, newly_covered, chosen) AS (SELECT 0, NULL::VARCHAR, 0::BIGINT, []::VARCHAR[] UNION ALL
  SELECT r.step + 1, b.d, b.c, list_append(r.chosen, b.d) FROM r, LATERAL (SELECT d, sum(n)::BIGINT AS c FROM (SELECT unnest(ds) AS d, n FROM sets WHERE NOT list_has_any(ds, r.chosen)) GROUP BY d ORDER BY c DESC, d LIMIT 1) b) SELECT * FROM r))
SELECT step, device_id, newly_covered FROM plan WHERE step > 0""")
def _(c):
    return access.attachment_plan(c, _requested(c), _reachable(c).limit(0))


@query("k41_introduced_files", "SELECT file_id, origin_id, origin_seq FROM file_refs WHERE state = 'active' AND origin_seq > CASE origin_id WHEN 'origin_0' THEN 5000 WHEN 'origin_1' THEN 12000 ELSE 0 END")
def _(c):
    base = c.file_refs.sparkSession.createDataFrame([("origin_0", 5000), ("origin_1", 12000)], "origin_id string, seq long")
    return access.introduced(c, base).select("file_id", "origin_id", "origin_seq")


_FOLD = """, ev AS (SELECT o.*, x.expected, CASE kind WHEN 'checksum' THEN CASE WHEN x.expected IS NULL OR o.observed = x.expected THEN 'verified' ELSE 'damaged' END WHEN 'rejected' THEN 'damaged' WHEN 'missing' THEN 'unverified' END AS sets FROM observations o JOIN objects x USING (object_id)),
rk AS (SELECT *, max(CASE WHEN sets IS NOT NULL THEN (time_ms, seq) END) OVER w AS set_at FROM ev WINDOW w AS (PARTITION BY object_id, location_id)) """


@query("k48_fold_observations", _FOLD + """SELECT object_id, location_id, arg_max(CASE kind WHEN 'read_error' THEN 'unknown' WHEN 'missing' THEN 'missing' ELSE 'present' END, (time_ms, seq)) AS presence,
CASE coalesce(max(sets) FILTER ((time_ms, seq) = set_at), 'unverified') WHEN 'damaged' THEN 'damaged' WHEN 'verified' THEN CASE WHEN count(*) FILTER (kind = 'read_error' AND (time_ms, seq) > set_at) > 0 THEN 'unverified' ELSE 'verified' END ELSE 'unverified' END AS integrity,
max(time_ms) FILTER (kind <> 'metadata_present') AS last_check_ms, max(time_ms) FILTER (kind = 'checksum' AND sets = 'verified') AS last_success_ms, count(*) AS events FROM rk GROUP BY 1, 2""")
def _(c):
    return scans.fold_observations(c.observations, c.objects).drop("last_check_result", "observed")


@query("k30_scan_candidates", """SELECT s.scan_id, c.copy_id, c.location_id, f.collection_id FROM copies c JOIN file_refs f USING (file_id) JOIN scans s ON s.location_id = c.location_id AND s.collection_id = f.collection_id WHERE c.state = 'present' AND s.status = 'complete' AND NOT s.had_errors AND c.last_seen_ms <= s.started_ms""")
def _(c):
    return scans.missing_candidates(c, c.copies.limit(0).select(F.lit("").alias("scan_id"), "copy_id"))


@query("k30_publish_missing", """, cand AS (SELECT s.scan_id, c.copy_id FROM copies c JOIN file_refs f USING (file_id) JOIN scans s ON s.location_id = c.location_id AND s.collection_id = f.collection_id WHERE c.state = 'present' AND s.status = 'complete' AND NOT s.had_errors AND c.last_seen_ms <= s.started_ms),
valid AS (SELECT scan_id FROM cand GROUP BY 1 HAVING count(*) % 3 <> 0) SELECT c.location_id, CASE WHEN c.copy_id IN (SELECT copy_id FROM cand WHERE scan_id IN (SELECT scan_id FROM valid)) THEN 'missing' ELSE c.state END AS state, count(*) AS n FROM copies c GROUP BY 1, 2""")
def _(c):
    found = scans.missing_candidates(c, c.copies.limit(0).select(F.lit("").alias("scan_id"), "copy_id"))
    n = F.count(F.lit(1))
    declared = found.groupBy("scan_id").agg(F.when(n % 3 == 0, n + 1).otherwise(n).alias("n"))
    return scans.publish_missing(c, found, declared).groupBy("location_id", "state").agg(n.alias("n"))


@query("k42_scan_preview", """, known AS (SELECT path, expected_size AS size, expected_size * 10 AS mtime_ms, CASE WHEN expected_size % 7 = 0 THEN 'missing' ELSE 'present' END AS presence, CASE WHEN expected_size % 5 = 0 THEN 'unverified' ELSE 'verified' END AS integrity FROM objects WHERE collection_id <> 'collection_5'),
listing AS (SELECT path, expected_size + (expected_size % 11 = 0)::INT AS size, CASE WHEN expected_size % 13 <> 0 THEN expected_size * 10 END AS mtime_ms FROM objects WHERE collection_id <> 'collection_4')
SELECT path, CASE WHEN l.path IS NULL THEN 'gone' WHEN k.presence IS NULL THEN 'new' WHEN coalesce(l.size = k.size AND l.mtime_ms = k.mtime_ms AND k.presence = 'present' AND k.integrity = 'verified', false) THEN 'unchanged' WHEN k.presence = 'missing' THEN 'returned' ELSE 'changed' END AS kind FROM listing l FULL JOIN known k USING (path)""")
def _(c):
    s = F.col("expected_size")
    path = F.col("path_bytes").cast("string").alias("path")
    known = c.objects.filter("collection_id <> 'collection_5'").select(path, s.alias("size"), (s * 10).alias("mtime_ms"), F.when(s % 7 == 0, "missing").otherwise("present").alias("presence"), F.when(s % 5 == 0, "unverified").otherwise("verified").alias("integrity"))
    listing = c.objects.filter("collection_id <> 'collection_4'").select(path, (s + (s % 11 == 0).cast("int")).alias("size"), F.when(s % 13 != 0, s * 10).alias("mtime_ms"))
    return scans.classify_listing(listing, known)


_STAGED = ", staged AS (SELECT 'stage/' || o_orderkey AS path, 'content_' || (o_orderkey // 3) AS hash FROM orders), kn AS (SELECT content_id AS hash, collection_id FROM file_refs WHERE state = 'active' AND content_id IS NOT NULL)"


def _staged(c):
    staged = c.file_refs.select(F.concat(F.lit("stage/"), F.col("origin_seq").cast("string")).alias("path"), F.concat(F.lit("content_"), F.floor(F.col("origin_seq") / 3).cast("string")).alias("hash"))
    return staged, c.file_refs.filter("state = 'active' AND content_id IS NOT NULL").select(F.col("content_id").alias("hash"), "collection_id")


@query("k44_stage_audit", _STAGED + " SELECT path, CASE WHEN NOT EXISTS (SELECT 1 FROM kn WHERE kn.hash = s.hash) THEN 'new' WHEN EXISTS (SELECT 1 FROM kn WHERE kn.hash = s.hash AND collection_id = 'collection_1') THEN 'known_in_selected' ELSE 'known_in_other' END AS kind, (SELECT count(DISTINCT collection_id) FROM kn WHERE kn.hash = s.hash) AS collections, count(*) OVER (PARTITION BY hash) AS staged_copies, (path <> min(path) OVER (PARTITION BY hash))::INT AS duplicate FROM staged s")
def _(c):
    return scans.stage_audit(*_staged(c), "collection_1").withColumn("duplicate", F.col("duplicate").cast("int"))


@query("k45_stage_protection", _STAGED + ", st(collection_id, state) AS (VALUES ('collection_1', 'satisfied'), ('collection_2', 'at_risk'), ('collection_3', 'unknown'), ('collection_4', 'satisfied'), ('collection_5', 'at_risk')) SELECT hash, CASE WHEN bool_or(state = 'at_risk') THEN 'at_risk' WHEN bool_or(state <> 'satisfied') THEN 'unknown' ELSE 'satisfied' END AS dominant, coalesce(arg_max(state, collection_id) FILTER (state <> 'satisfied'), 'satisfied') AS last FROM (SELECT DISTINCT s.hash, kn.collection_id, st.state FROM staged s JOIN kn USING (hash) JOIN st USING (collection_id)) GROUP BY 1")
def _(c):
    states = c.files.sparkSession.createDataFrame([(f"collection_{i}", s) for i, s in enumerate(("satisfied", "at_risk", "unknown", "satisfied", "at_risk"), 1)], "collection_id string, state string")
    return scans.stage_protection(*_staged(c), states)


@query("k46_stage_import", _STAGED + " SELECT hash, min(path) AS path FROM staged WHERE hash NOT IN (SELECT hash FROM kn) GROUP BY 1")
def _(c):
    return scans.stage_import(*_staged(c))


@query("k47_duplicate_content", "SELECT count(*) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS redundant FROM (SELECT count(*) AS n FROM file_refs WHERE content_id IS NOT NULL GROUP BY content_id HAVING count(*) > 1)")
def _(c):
    return scans.duplicates(c.file_refs, "content_id")


def _device_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    return scans.device_history(o.select(text("device_", F.col("o_custkey")).alias("device_id"), text("site_", F.col("o_orderkey") % 25).alias("site_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("arrived_ms")))


QUERIES["e08_device_history"] = _device_history
ORACLES["e08_device_history"] = "SELECT 'device_' || o_custkey AS device_id, 'site_' || (o_orderkey % 25) AS site_id, epoch_ms(o_orderdate) AS arrived_ms, lead(epoch_ms(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, 'site_' || (o_orderkey % 25)) AS departed_ms FROM orders"

_LOG = """WITH rec AS (SELECT 'origin_' || (user_id % 4) AS origin_id, event_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS origin_seq, sha256(event_id::VARCHAR) AS hash FROM events),
chain AS (SELECT origin_id, origin_seq, hash, CASE WHEN event_id % 101 = 0 THEN hash ELSE lag(hash) OVER (PARTITION BY origin_id ORDER BY event_id) END AS previous_hash FROM rec), """


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    own = W.partitionBy("o").orderBy("event_id")
    rows = e.select("event_id", (F.col("user_id") % 4).alias("o"), F.sha2(F.col("event_id").cast("string").cast("binary"), 256).alias("hash"))
    return rows.select(
        F.concat(F.lit("origin_"), F.col("o").cast("string")).alias("origin_id"), F.row_number().over(own).cast("long").alias("origin_seq"), "hash",
        F.when(F.col("event_id") % 101 == 0, F.col("hash")).otherwise(F.lag("hash").over(own)).alias("previous_hash"),
    )


QUERIES["i12_chain_faults"] = lambda spark, sf_dir: log.chain_faults(_log(spark, sf_dir).filter(~F.col("hash").startswith("00")))
ORACLES["i12_chain_faults"] = _LOG + """p AS (SELECT *, lag(hash) OVER w AS h, lag(origin_seq) OVER w AS s FROM chain WHERE NOT starts_with(hash, '00') WINDOW w AS (PARTITION BY origin_id ORDER BY origin_seq)),
q AS (SELECT origin_id, origin_seq, CASE WHEN s IS NULL THEN CASE WHEN previous_hash IS NOT NULL THEN 'first_record_has_previous' WHEN origin_seq <> 1 THEN 'gap' END WHEN origin_seq = s THEN 'rewritten' WHEN origin_seq <> s + 1 THEN 'gap' WHEN previous_hash IS DISTINCT FROM h THEN 'broken_link' END AS fault FROM p) SELECT * FROM q WHERE fault IS NOT NULL"""
QUERIES["g06_frontier"] = lambda spark, sf_dir: log.frontier(_log(spark, sf_dir).dropDuplicates(["origin_id", "origin_seq"])).select("origin_id", "seq")
ORACLES["g06_frontier"] = _LOG + "x AS (SELECT 1) SELECT origin_id, max(origin_seq) AS seq FROM chain GROUP BY 1"


@query("k04_object_history", "SELECT seq AS history_id, time_ms, kind FROM observations WHERE object_id = 'object_7' ORDER BY time_ms, seq LIMIT 51")
def _(c):
    return history.object_history(c.observations.withColumnRenamed("seq", "history_id"), "object_7", 50).select("history_id", "time_ms", "kind")


@query("k18_running_jobs", "SELECT scan_id AS job_id, started_ms FROM scans WHERE status = 'running'")
def _(c):
    return history.jobs(c.scans.withColumnRenamed("scan_id", "job_id")).select("job_id", "started_ms")


@query("k55_scan_counts", "SELECT location_id AS scan_id, count(*) FILTER (state = 'present') AS new, count(*) FILTER (state = 'corrupt') AS changed, count(DISTINCT file_id) FILTER (integrity_code = 1) AS verified FROM copies GROUP BY 1")
def _(c):
    change = F.when(F.col("state") == "present", "new").when(F.col("state") == "corrupt", "changed")
    return history.scan_counts(c.copies.select(F.col("location_id").alias("scan_id"), "file_id", change.alias("change"), F.when(F.col("integrity_code") == 1, "verified").alias("integrity")))


@query("k57_acceptance_preview", "SELECT f.file_id, f.content_id AS expected, 'content_' || (f.origin_seq // 5) AS observed FROM file_refs f WHERE f.state = 'active' AND f.identity_state = 'resolved' AND f.origin_seq % 9 <> 0 AND f.content_id <> 'content_' || (f.origin_seq // 5)")
def _(c):
    seen = c.file_refs.select("file_id", F.concat(F.lit("content_"), F.floor(F.col("origin_seq") / 5).cast("string")).alias("observed"))
    return history.acceptance_preview(c.file_refs.withColumn("annex", F.col("origin_seq") % 9 == 0).withColumnRenamed("content_id", "expected"), seen)


_TOPOLOGY = """, topo AS (SELECT l.location_id, CASE WHEN l.kind = 'service' THEN 'service:' || l.location_id ELSE 'device:' || l.device_id END AS domain, coalesce(l.site_id, d.current_site_id) AS site, l.archive_root_id, l.device_id FROM locations l LEFT JOIN devices d USING (device_id) WHERE l.status = 'active' AND coalesce(l.site_id, d.current_site_id) IS NOT NULL),
risks AS (SELECT DISTINCT t.location_id, r.risk_id FROM topo t JOIN risk_assignments r ON (r.entity_type = 'location' AND r.entity_id = t.location_id) OR (r.entity_type = 'archive_root' AND r.entity_id = t.archive_root_id) OR (r.entity_type = 'device' AND r.entity_id = t.device_id) OR (r.entity_type = 'site' AND r.entity_id = t.site)) """


@query("k39_metadata_independence", _TOPOLOGY + """SELECT l.location_id AS destination_id, CASE WHEN l.encryption_state IS NULL THEN 'local_remote_storage_identity_unverified' WHEN t.domain IS NULL THEN 'location_topology_unresolved'
ELSE array_to_string(list_filter([CASE WHEN t.domain = o.domain THEN 'same_storage_domain' END, CASE WHEN t.site = o.site THEN 'same_site' END, CASE WHEN EXISTS (SELECT 1 FROM risks a JOIN risks b USING (risk_id) WHERE a.location_id = t.location_id AND b.location_id = 'location_2') THEN 'shared_custom_risk_domain' END], lambda x: x IS NOT NULL), ',') END AS reasons
FROM locations l LEFT JOIN topo t USING (location_id) LEFT JOIN topo o ON o.location_id = 'location_2'""")
def _(c):
    found = metadata.independence(c, c.locations.select(F.col("location_id").alias("destination_id"), "location_id", F.col("encryption_state").isNull().alias("local")), "location_2")
    return found.select("destination_id", F.array_join("reasons", ",").alias("reasons"))


_META = ", cp AS (SELECT scan_id AS checkpoint_id, started_ms // 1000000 AS last_seq, NOT had_errors AS committed FROM scans), ds AS (SELECT location_id AS destination_id, status, 100000 + length(display_name) AS event_seq FROM locations), rp AS (SELECT 'scan_' || replace(location_id, 'location_', '') AS checkpoint_id, location_id AS destination_id, CASE WHEN kind = 'service' THEN 'verified' ELSE 'pending' END AS status, CASE WHEN encryption_state = 'unencrypted' THEN 'independent' ELSE 'unknown' END AS independence, 100000 + 3 * length(location_id) AS event_seq FROM locations) "


@query("k38_metadata_protection", _META + """, x AS (SELECT coalesce(max(last_seq), 0) AS checkpointed, coalesce(max(last_seq) FILTER (committed), 0) AS committed, coalesce(max(last_seq) FILTER (committed AND checkpoint_id IN (SELECT r.checkpoint_id FROM rp r JOIN ds d USING (destination_id) WHERE r.status = 'verified' AND r.independence = 'independent' AND d.status = 'active' AND r.event_seq > d.event_seq AND r.event_seq >= 100005)), 0) AS protected FROM cp)
SELECT *, greatest(0, 1100000 - checkpointed) AS uncheckpointed, greatest(0, 1100000 - committed) AS uncommitted, greatest(0, 1100000 - protected) AS unreplicated FROM x""")
def _(c):
    n = F.length("location_id")
    checkpoints = c.scans.select(F.col("scan_id").alias("checkpoint_id"), F.floor(F.col("started_ms") / 1_000_000).alias("last_seq"), (~F.col("had_errors")).alias("committed"))
    destinations = c.locations.select(F.col("location_id").alias("destination_id"), "status", (100_000 + F.length("display_name")).cast("long").alias("event_seq"))
    replications = c.locations.select(
        F.concat(F.lit("scan_"), F.replace("location_id", F.lit("location_"), F.lit(""))).alias("checkpoint_id"), F.col("location_id").alias("destination_id"), F.when(F.col("kind") == "service", "verified").otherwise("pending").alias("status"),
        F.when(F.col("encryption_state") == "unencrypted", "independent").otherwise("unknown").alias("independence"), (100_000 + 3 * n).cast("long").alias("event_seq"),
    )
    return metadata.protection(checkpoints, replications, destinations, 1_100_000, 100_005)


@query("k53_mapped_state", "SELECT location_id, CASE WHEN state = 'missing' THEN 'missing' WHEN state IN ('present', 'corrupt') AND error_code IS DISTINCT FROM 'read_error' THEN 'present' ELSE 'unknown' END AS presence, CASE WHEN state = 'corrupt' OR integrity_code = 2 THEN 'damaged' WHEN state = 'present' AND integrity_code = 1 AND error_code IS NULL THEN 'verified' ELSE 'unverified' END AS integrity, count(*) AS n FROM copies GROUP BY 1, 2, 3")
def _(c):
    return migrate.mapped_state(c.copies).groupBy("location_id", "presence", "integrity").agg(F.count(F.lit(1)).alias("n"))


_KEYS = ", k AS (SELECT object_id, CASE expected_size % 4 WHEN 0 THEN 'SHA256-s' || expected_size || '--' || expected WHEN 1 THEN 'SHA256E-s' || expected_size || '-m5--' || expected || '.txt' WHEN 2 THEN 'WORM-s' || expected_size || '--' || expected ELSE 'SHA256-s' || expected_size || expected END AS key FROM objects WHERE expected IS NOT NULL) "


@query("a10_annex_keys", _KEYS + "SELECT object_id, regexp_extract(key, '^[A-Z0-9]*') AS backend, TRY_CAST(regexp_extract(split_part(key, '--', 1), '-s([^-]*)', 1) AS BIGINT) AS size, CASE WHEN key LIKE 'SHA256%--%' THEN substr(split_part(key, '--', 2), 1, 64) END AS sha256, (key LIKE 'SHA256%--%')::INT AS supported FROM k")
def _(c):
    digest, size = F.lower(F.hex("expected")), F.col("expected_size").cast("string")
    make = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    kind = F.col("expected_size") % 4
    key = F.when(kind == 0, make("SHA256-s", size, "--", digest)).when(kind == 1, make("SHA256E-s", size, "-m5--", digest, ".txt")).when(kind == 2, make("WORM-s", size, "--", digest)).otherwise(make("SHA256-s", size, digest))
    rows = c.objects.filter("expected is not null").select("object_id", key.alias("key"))
    parsed = rows.select("object_id", annex.parse_key("key").alias("k"))
    return parsed.select("object_id", "k.backend", "k.size", "k.sha256", F.col("k.supported").cast("int").alias("supported"))


@query("a10_annex_locations", ", l AS (SELECT object_id AS key, location_id AS uuid, kind, seq FROM observations) SELECT key, uuid, arg_max(CASE WHEN kind = 'missing' THEN 'missing' WHEN kind = 'read_error' THEN 'unknown' ELSE 'present' END, seq) AS state FROM l GROUP BY 1, 2")
def _(c):
    sign = F.when(F.col("kind") == "missing", "0").when(F.col("kind") == "read_error", "X").otherwise("1")
    line = F.struct("seq", F.concat(F.col("time_ms").cast("string"), F.lit("s "), sign, F.lit(" "), "location_id").alias("line"))
    logs = c.observations.groupBy(F.col("object_id").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("blob"))
    return annex.location_states(logs)


from holdfast.plans import logs, reviews  # noqa: E402, F401 - these register further queries
