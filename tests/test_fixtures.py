"""Hand-made catalogs with known numbers."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from holdfast.operators import find, policy, risk, summaries
from holdfast.operators.find import Filter, Group
from holdfast.sources.adapter import DAY, POLICY_COLUMNS, Catalog

Z, ONE = bytes(32), b"\x01" * 32
SCHEMAS = {
    "sites": "site_id string, display_name string, status string",
    "devices": "device_id string, display_name string, current_site_id string, identity_state string, expected_availability string, last_checkin_ms long, fingerprint_status string, fingerprint_match_ms long, status string",
    "archive_roots": "archive_root_id string, device_id string, status string",
    "locations": "location_id string, display_name string, kind string, site_id string, device_id string, archive_root_id string, expected_availability string, encryption_state string, trust_level string, status string",
    "collections": "collection_id string, display_name string, home_site_id string, policy_id string, status string",
    "policies": POLICY_COLUMNS,
    "risk_assignments": "entity_type string, entity_id string, risk_id string",
    "objects": "object_id string, collection_id string, path_encoding string, path_bytes binary, expected binary, expected_size long",
    "files": "object_id string, location_id string, presence string, integrity string, last_check_ms long, last_check_result string, observed binary, last_success_ms long",
    "file_refs": "file_id string, collection_id string, path string, content_id string, external_id string, state string, identity_state string, origin_id string, origin_seq long, size long",
    "copies": "copy_id string, file_id string, location_id string, content_id string, external_id string, state string, last_seen_ms long, last_verified_ms long, verification_result string, integrity_code int, error_code string",
    "mounts": "mount_id long, archive_root_id string, host string, status string, observed_ms long",
    "scans": "scan_id string, location_id string, collection_id string, status string, started_ms long, finished_ms long, had_errors boolean",
    "observations": "object_id string, location_id string, time_ms long, seq long, kind string, observed binary",
}


def build(spark, **rows) -> Catalog:
    return Catalog(**{f.name: spark.createDataFrame([dict(zip([c.split()[0] for c in SCHEMAS[f.name].split(", ")], r, strict=True)) for r in rows.get(f.name, [])], SCHEMAS[f.name]) for f in dataclasses.fields(Catalog)})


def location(name, kind="service", site=None, device=None, status="active", availability="online", encryption="unencrypted", trust="trusted", root=None):
    return (name, name, kind, site, device, root, availability, encryption, trust, status)


def device(name, site, **x):
    base = {"identity": "confirmed", "availability": "online", "checkin": 100, "fingerprint": "match", "match": 100, "status": "active"} | x
    return (name, name, site, base["identity"], base["availability"], base["checkin"], base["fingerprint"], base["match"], base["status"])


# The boundary cases of protection and location counts, whose expected numbers must match those of the semantics:
# a site without a name, a retired place, times equal to the cutoff, before it and in the future, other content, no content.


def protection(spark, disk_site=None):
    def file(o, loc, presence="present", integrity="verified", time=101):
        result = {"missing": "missing"}.get(presence, {"damaged": "mismatch"}.get(integrity, "ok"))
        return (o, loc, presence, integrity, time, result, Z, time)

    return build(
        spark,
        locations=[location("home1", site="home"), location("home2", site="home", status="retired"), location("office", site="office"), location("unknown", "filesystem", device="disk")],
        devices=[device("disk", disk_site)],
        collections=[(c, c, None, None, "active") for c in ("c", "other", "empty")],
        objects=[(o, "other" if o == "j" else "c", "utf8", o.encode(), None if o == "g" else Z, 1) for o in "abcdefghij"],
        files=[
            file("a", "home1", time=100), file("a", "home2", time=100), file("b", "home1"), file("b", "office"), file("c", "home1", "missing"), file("d", "home1", integrity="damaged"),
            file("e", "unknown"), file("g", "home1", integrity="unverified"), file("h", "home1", time=201), file("i", "home1", time=99), file("j", "home1"),
        ],
    )


def histogram(c, collection):
    out = {}
    for r in summaries.collection_protection(c, 200, 100).filter(F.col("collection_id") == collection).collect():
        out.setdefault(r["measure"], {})[r["bucket"]] = r["n"]
    return out


def test_collection_protection(spark):
    found = histogram(protection(spark), "c")
    assert found["total_files"] == {0: 9} and found["without_expected"] == {0: 1}
    assert found["present_copies"] == {0: 2, 1: 5, 2: 2} and found["recent_copies"] == {0: 6, 1: 1, 2: 2}
    assert found["present_sites"] == {0: 3, 1: 5, 2: 1} and found["recent_sites"] == {0: 7, 1: 1, 2: 1}
    assert found["present_unknown_site"] == {0: 1} and found["recent_unknown_site"] == {0: 1}


def test_collection_protection_with_known_disk_site(spark):
    c = protection(spark, "home")
    found = histogram(c, "c")
    assert found["present_unknown_site"] == {0: 0} and found["present_sites"] == {0: 2, 1: 6, 2: 1} and found["recent_sites"] == {0: 6, 1: 2, 2: 1}
    empty = histogram(c, "empty")
    assert empty["total_files"] == {0: 0} and empty["present_copies"] == {0: 0}


def test_location_summary(spark):
    rows = [
        ("a", "c", "present", "verified", 100, "ok", Z, 100), ("b", "c", "present", "verified", 99, "ok", Z, 99), ("c", "c", "present", "unverified", None, None, None, None),
        ("d", "c", "present", "damaged", 101, "mismatch", ONE, None), ("e", "c", "missing", "verified", 101, "missing", Z, 100), ("f", "c", "unknown", "unverified", None, None, None, None),
        ("g", "c", "present", "unverified", None, None, None, None), ("h", "c", "present", "verified", 101, "read_error", Z, 100), ("i", "c", "present", "verified", 101, "ok", ONE, 100),
        ("j", "d", "present", "verified", 101, "ok", Z, 101), ("k", "d", "present", "verified", 101, "ok", Z, 101), ("future", "c", "present", "verified", 201, "ok", Z, 201),
    ]
    good = lambda o, loc, t, seen=Z: (o, loc, "present", "verified", t, "ok", seen, t)
    elsewhere = [good("a", "other", 100), good("b", "other", 99), ("c", "other", "missing", "verified", 101, "missing", Z, 101), ("d", "other", "present", "damaged", 101, "mismatch", Z, 101), good("h", "other", 101, ONE), good("j", "other", 101), good("k", "retired", 101), good("future", "other", 201)]
    c = build(
        spark, locations=[location(x) for x in ("l", "other", "retired", "empty")], collections=[("c", "Files", None, None, "active"), ("d", "Media", None, None, "active")],
        objects=[(o, coll, "utf8", o.encode(), None if o == "g" else Z, 1) for o, coll, *_ in rows], files=[(o, "l", *rest) for o, _, *rest in rows] + elsewhere,
    )
    totals = {r["location_id"]: r.asDict() for r in summaries.location_totals(c, 200, 100).collect()}
    want = {"tracked": 12, "present": 10, "missing": 1, "unknown": 1, "verified": 4, "recent": 3, "stale": 1, "unverified": 5, "damaged": 1, "never_verified": 3, "unresolved": 1, "without_recent_other_copy": 7}
    assert {k: totals["l"][k] for k in want} == want
    assert all(totals["empty"][k] == 0 for k in want)
    assert [r["collection_id"] for r in summaries.location_summary(c, 200, 100, "l").orderBy("collection_id").collect()] == ["c", "d"]


def seven(spark, change=None):
    names = [f"object_{i:08d}" for i in range(1, 8)]
    objects = [[n, "c", "utf8", f"path/{i:08d}".encode(), Z, 1] for i, n in enumerate(names, 1)]
    files = {(n, "disk"): [n, "disk", "present", "verified", 100, "ok", Z, 100] for n in names}
    if change:
        change(names, objects, files)
    return names, build(spark, objects=objects, files=list(files.values()), locations=[location(x) for x in ("disk", "backup", "other")], collections=[("c", "c", None, None, "active")])


def found(rows, names):
    return sorted(names.index(r["object_id"]) + 1 for r in rows.collect())


def test_copies_below(spark):
    def change(names, objects, files):
        for n in names[1:]:
            files[n, "backup"] = [n, "backup", "present", "verified", 100, "ok", Z, 100]
        del files[names[0], "disk"]
        files[names[2], "backup"][3:6] = ["damaged", 100, "mismatch"]
        files[names[3], "backup"][2] = "missing"
        files[names[4], "backup"][3], files[names[4], "backup"][7] = "unverified", None
        files[names[5], "backup"][7] = 90
        objects[6][4] = None

    names, c = seven(spark, change)
    go = lambda **x: found(find.find_objects(c, Filter(**x), 120), names)
    assert go(copies_below=2) == [1, 4]
    assert go(copies_below=2, verified_copies=True) == [1, 3, 4, 5, 7]
    assert go(copies_below=2, verified_within=20) == [1, 3, 4, 5, 6, 7]
    assert go(copies_below=2, verified_within=20, groups=(Group(("disk",)),)) == [3, 4, 5, 6]
    assert go(copies_below=0) == []
    assert go(groups=(Group(("disk",)), Group(("backup",), True))) == [3, 4, 5]


def test_filter_errors(spark):
    _, c = seven(spark)
    for bad in (Filter(path=("utf8", b"a"), prefix=("utf8", b"a")), Filter(verified_copies=True), Filter(groups=(Group(()),)), Filter(identity="odd"), Filter(groups=tuple(Group(("x",)) for _ in range(33)))):
        with pytest.raises(ValueError):
            find.find_objects(c, bad, 1)


def test_prefix_and_bytes(spark):
    def change(names, objects, files):
        objects[0][2:4] = ["unix_bytes", b"folder/\xff"]
        objects[1][2:4] = ["unix_bytes", b"folder/\xff\xff/x"]

    names, c = seven(spark, change)
    assert found(find.find_objects(c, Filter(path=("unix_bytes", b"folder/\xff")), 1), names) == [1]
    assert found(find.find_objects(c, Filter(prefix=("unix_bytes", b"folder/\xff")), 1), names) == [1, 2]
    assert found(find.find_objects(c, Filter(prefix=("unix_bytes", b"")), 1), names) == [1, 2]
    assert found(find.find_objects(c, Filter(prefix=("utf8", b"folder")), 1), names) == []


def policies(spark, verified=900_000, assigned=True):
    now_day = 900_000
    return build(
        spark, sites=[("home", "home", "active"), ("remote", "remote", "active")],
        devices=[device("device_1", "home", checkin=now_day, match=now_day), device("device_2", "remote", availability="offline", checkin=now_day, match=now_day)],
        archive_roots=[("root_1", "device_1", "active"), ("root_2", "device_2", "active")],
        locations=[location("loc_1", "filesystem", device="device_1", root="root_1"), location("loc_2", "filesystem", device="device_2", root="root_2", encryption="encrypted")],
        collections=[("c", "c", "home", "p", "active"), ("bare", "bare", None, "p", "active")],
        policies=[("p", 1, 2, 2, 2, True, False, False, 1, 1, 1)],
        risk_assignments=[("archive_root", "root_1", "risk_power"), ("site", "home", "risk_power")] + ([("device", "device_2", "risk_power")] if assigned else []),
        file_refs=[("file_1", "c", "a", "content", None, "active", "resolved", "o", 1, 10)],
        copies=[("copy_1", "file_1", "loc_1", "content", None, "present", now_day, now_day, "ok", 1, None), ("copy_2", "file_1", "loc_2", "content", None, "present", now_day, verified, "ok" if verified else None, 1, None)],
    )


def test_policy_shared_risk_violates(spark):
    c = policies(spark)
    row = policy.evaluate(c, 1_000_000).first()
    assert row["status"] == "violated" and row["copies"] == 2 and row["permanent_loss"] == 1 and row["valid_until"] == 87_300_000
    lost = policy.loss_scenarios(c, policy.assessed(c, 1_000_000)).filter("permanent_loss").collect()
    assert [(r["domain_kind"], r["domain_id"], r["affected"], r["remaining"]) for r in lost] == [("risk", "risk_power", 2, 0)]
    assert [tuple(r) for r in policy.unconfigured(c).collect()] == [("bare", "home_site_missing")]


def test_policy_satisfied_and_uncertain(spark):
    assert policy.evaluate(policies(spark, assigned=False), 1_000_000).first()["status"] == "satisfied"
    c = policies(spark, verified=None, assigned=False)
    row = policy.evaluate(c, 1_000_000).first()
    assert row["status"] == "uncertain" and "verify_again" in row["actions"]
    reasons = {x for r in policy.assessed(c, 1_000_000).withColumn("names", policy.reason_names(1_000_000)).collect() for x in r["names"]}
    assert reasons == {"verification_missing", "verification_time_missing"}
    # stale at exactly time + age
    assert policy.evaluate(policies(spark, assigned=False), 900_000 + DAY).first()["status"] == "uncertain"


def test_requirements():
    good = '{"min_qualifying_copies": 1, "min_devices": 1, "min_sites": 1, "require_offsite_copy": false, "require_offline_copy": false, "require_encrypted_offsite": false, "max_verification_age_days": 1, "max_observation_age_days": 1, "max_device_checkin_age_days": 1}'
    assert policy.Requirements.parse(good).min_sites == 1
    for bad in (good.replace('"min_sites": 1', '"min_sites": 0'), good.replace("}", ', "more": 1}'), good.replace('"min_devices": 1, ', ""), good.replace("false", "0", 1), "[]"):
        with pytest.raises(ValueError):
            policy.Requirements.parse(bad)


def covered(spark, only_local=False, copy=None, disk=None, local="active", cutoffs=(100, 100, 100), seen=100, verified=100):
    base = {"state": "present", "integrity": 1, "error": None} | (copy or {})
    rows = [("c1", "f1", "local", "x", None, base["state"], seen, verified, "ok", base["integrity"], base["error"]), ("c2", "f2", "local", "x", None, base["state"], seen, verified, "ok", base["integrity"], base["error"])]
    rows += [] if only_local else [("c3", "f1", "service", "x", None, "present", 100, 100, "ok", 1, None)]
    c = build(
        spark, devices=[device("d", "home", **(disk or {}))], locations=[location("local", "filesystem", device="d", status=local), location("service", site="away", availability="offline", encryption="encrypted")],
        file_refs=[("f1", "selected", "a", "x", None, "active", "resolved", "o", 1, 5), ("f2", "selected", "b", "x", None, "active", "resolved", "o", 2, 5), ("f3", "other", "c", "x", None, "active", "resolved", "o", 3, 5), ("f4", "selected", "d", None, None, "active", "unknown", "o", 4, 5), ("f5", "selected", "e", "y", None, "removed", "resolved", "o", 5, 5)],
        copies=rows,
    )
    return c, risk.details(c, risk.coverage(c, *cutoffs, "home", "selected"), "selected")


def test_risk_coverage(spark):
    c, rows = covered(spark)
    first = rows.orderBy("file_id").first()
    assert [first[m] for m in risk.MEASURES] == [2, 1, 2, 1, 1, 1] and rows.count() == 3
    totals = {r["vector"]: r for r in risk.totals(rows, [(2, 2, 2, 1, 1, 1), (0, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0)]).collect()}
    assert [totals[i]["at_risk"] for i in range(3)] == [2, 0, 2] and totals[0]["unresolved"] == 1 and totals[0]["bytes"] == 15
    assert risk.coverage(c, 100, 100, 100, "home", "selected", active=False).count() == 0


@pytest.mark.parametrize(
    "change, copies",
    [({"copy": {"state": s}}, 0) for s in ("missing", "corrupt", "unknown", "superseded")]
    + [({"copy": {"integrity": 0}}, 0), ({"copy": {"error": "read_error"}}, 0), ({"copy": {"error": "identity_mismatch"}}, 0), ({"copy": {"error": "other_error"}}, 1), ({"seen": 99}, 0), ({"verified": None}, 0), ({"local": "retired"}, 0)]
    + [({"disk": d}, 0) for d in ({"status": "retired"}, {"identity": "conflict"}, {"fingerprint": "mismatch"}, {"fingerprint": None}, {"checkin": 99}, {"checkin": None})]
    + [({"cutoffs": (200, 300, 100), "seen": 200, "verified": 300}, 1), ({"cutoffs": (200, 300, 100), "seen": 199, "verified": 300}, 0), ({"cutoffs": (200, 300, 100), "seen": 200, "verified": 299}, 0)],
)
def test_risk_coverage_of_one_location(spark, change, copies):
    _, rows = covered(spark, only_local=True, **change)
    assert rows.filter("file_id = 'f1'").first()["copies"] == copies
