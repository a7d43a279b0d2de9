"""Helpers at the edge: cursors, paths, digests, log checks and folds."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from holdfast.functions import blake3, cursor, paths
from holdfast.functions import predicates as p
from holdfast.operators import find, scans
from holdfast.streaming import log
from holdfast.streaming.versions import StateTable


def test_blake3_vectors(spark):
    assert blake3.digest(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3.digest(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    rows = spark.createDataFrame([(b"abc",), (None,)], "x binary").select(blake3.blake3(F.col("x")).alias("h")).collect()
    assert rows[0]["h"] == blake3.digest(b"abc") and rows[1]["h"] is None


@given(st.binary(max_size=6))
def test_prefix_upper(prefix):
    upper = p.prefix_upper(prefix)
    assert upper is None and not prefix.strip(b"\xff") or upper is not None and prefix + b"\xff" * 9 < upper and upper[:-1] == prefix[: len(upper) - 1]


def test_cursor():
    text = cursor.encode("a", 3, {"x": 1}, 9, ["c", b"\xff"])
    assert cursor.decode(text, "a", 3, {"x": 1}, 9) == ["c", b"\xff"]
    with pytest.raises(cursor.StaleCursor):
        cursor.decode(text, "a", 4, {"x": 1}, 9)
    with pytest.raises(cursor.InvalidCursor):
        cursor.decode(text, "a", 3, {"x": 2}, 9)
    with pytest.raises(cursor.InvalidCursor):
        cursor.decode("%%", "a", 3, {"x": 2}, 9)


def test_pages_cover_all_rows(spark):
    rows = spark.range(2501).select(F.lit("c").alias("collection_id"), F.lit("utf8").alias("path_encoding"), F.lpad(F.col("id").cast("string"), 5, "0").cast("binary").alias("path_bytes"))
    seen, after = [], None
    while True:
        got = find.page(rows, 1000, after).collect()
        seen += [r["path_bytes"] for r in got[:1000]]
        if len(got) <= 1000:
            break
        after = [got[999][k] for k in find.KEY]
    assert len(seen) == len(set(seen)) == 2501 and seen == sorted(seen)
    with pytest.raises(ValueError):
        find.page(rows, 0)


def test_paths(spark):
    assert paths.duration_ms("30d") == 30 * 86_400_000
    for bad in ("0d", "d", "3x", "-1h", "1.5h"):
        with pytest.raises(ValueError):
            paths.duration_ms(bad)
    rows = spark.createDataFrame([("utf8", "é/x".encode(), "a/b"), ("utf8", b"\xff\xfb", "a//b"), ("unix_bytes", b"a", "/a"), ("utf8", b"", "a/../b"), ("utf8", b"x", "a/."), ("utf8", b"x", "")], "e string, b binary, p string")
    out = rows.select(paths.text_or_base64("e", "b").alias("o"), paths.is_normal("p").alias("n"), F.hex(paths.entity_key("e")).alias("k")).collect()
    assert [(r["o"]["text"], r["o"]["base64"]) for r in out][:3] == [("é/x", None), (None, "__s"), (None, "YQ")]
    assert [r["n"] for r in out] == [True, False, False, False, False, False]
    assert out[0]["k"] == "000000000000000475746638".upper()
    assert paths.manifest_line(b"a\tb\\\n\xff") == "a\\tb\\\\\\n\udcff" and paths.shown("a\x07\udcff") == "a\\x07\\xff"
    under = spark.createDataFrame([(b"a",), (b"a/b",), (b"ab",)], "p binary").filter(p.under_any("p", [b"a"])).count()
    assert under == 2


def records(spark, rows):
    return spark.createDataFrame(rows, "origin_id string, origin_seq long, hash string, previous_hash string")


def test_chain_faults(spark):
    good = [("o", 1, "a", None), ("o", 2, "b", "a"), ("q", 1, "z", None)]
    assert log.chain_faults(records(spark, good)).count() == 0
    bad = good + [("o", 4, "d", "b"), ("o", 5, "e", "x"), ("r", 1, "f", "f"), ("s", 2, "g", None)]
    assert {(r["origin_id"], r["fault"]) for r in log.chain_faults(records(spark, bad)).collect()} == {("o", "gap"), ("o", "broken_link"), ("r", "first_record_has_previous"), ("s", "gap")}


def test_frontiers(spark):
    a = spark.createDataFrame([("o", 2, "b"), ("p", 1, "x")], "origin_id string, seq long, hash string")
    b = spark.createDataFrame([("o", 3, "c"), ("p", 1, "x")], "origin_id string, seq long, hash string")
    assert {tuple(r) for r in log.union_frontiers(a, b).collect()} == {("o", 3, "c"), ("p", 1, "x")}
    clash = spark.createDataFrame([("p", 1, "y")], "origin_id string, seq long, hash string")
    with pytest.raises(Exception, match="disagree"):
        log.union_frontiers(a, clash).collect()


def test_batches(spark):
    kind = "batch_id string, type string, first_item_index int, items array<string>, item_count int"
    rows = [("a", "batch_start", None, None, None), ("a", "batch_chunk", 0, ["x", "y"], None), ("a", "batch_chunk", 2, ["z"], None), ("a", "batch_complete", None, None, 3)]
    rows += [("b", "batch_start", None, None, None), ("b", "batch_chunk", 0, ["x"], None)]
    rows += [("c", "batch_start", None, None, None), ("c", "batch_chunk", 1, ["x"], None), ("c", "batch_complete", None, None, 1), ("d", "batch_start", None, None, None), ("d", "batch_complete", None, None, 0)]
    assert {tuple(r) for r in log.complete_batches(spark.createDataFrame(rows, kind)).collect()} == {("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z")}


def test_defaults_and_requests(spark):
    rows = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"c": "4"})], "defaults map<string,string>, item map<string,string>")
    assert [r["item"] for r in log.with_defaults(rows).collect()] == [{"a": "1", "b": "3"}, {"c": "4"}]
    applied = spark.createDataFrame([("k", "r")], "operation_key string, request string")
    assert log.new_requests(applied, spark.createDataFrame([("k", "r"), ("n", "s"), ("n", "s")], "operation_key string, request string")).count() == 1
    with pytest.raises(Exception, match="another request"):
        log.new_requests(applied, spark.createDataFrame([("k", "t")], "operation_key string, request string")).collect()


def test_conflicts(spark):
    seen = spark.createDataFrame([("p", "x", "o1", 5, "r1"), ("p", "y", "o2", 3, "r2"), ("q", "x", "o1", 6, "r3"), ("q", "y", "o2", 4, "r4")], "path string, content string, origin_id string, origin_seq long, record_id string")
    known = spark.createDataFrame([("r4", "o1", 6)], "record_id string, origin_id string, seq long")
    assert [r["path"] for r in log.conflicts(seen, known).collect()] == ["p"]


OBSERVED, SEEN = "path string, content string, origin_id string, origin_seq long, record_id string", "record_id string, origin_id string, seq long"


def test_conflicts_equal_brute_force(spark):
    import random

    rnd = random.Random(7)
    seen = [(f"p{i % 300}", rnd.choice([None, "x", "y", "z"][: i % 300 % 3 + 2]), f"o{rnd.randint(1, 3)}", rnd.randint(1, 6), f"r{i}") for i in range(1200)]
    known = {(f"r{i}", f"o{o}"): rnd.randint(0, 6) for i in range(1200) for o in (1, 2, 3) if rnd.random() < 0.9}
    met = lambda a, b: a[0] == b[0] and a[1] != b[1] and a[2] != b[2] and known.get((b[4], a[2]), 0) < a[3] and known.get((a[4], b[2]), 0) < b[3]
    expected = {a[0] for a in seen for b in seen if met(a, b)}
    found = log.conflicts(spark.createDataFrame(seen, OBSERVED), spark.createDataFrame([(*k, v) for k, v in known.items()], SEEN))
    assert sorted(r["path"] for r in found.collect()) == sorted(expected) and 0 < len(expected) < 300


def most_rows(plan) -> int:
    """The most rows that any node of an executed plan made."""
    inner = [plan.executedPlan()] if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [plan.plan()] if plan.getClass().getSimpleName().endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(most_rows, inner)])


def test_conflicts_do_not_pair_records(spark):
    # 2,000 observations of one path, each by a record that has seen all before it
    seen = [("p", f"x{i}", f"o{i % 2}", i + 1, f"r{i}") for i in range(2000)]
    known = [(f"r{i}", f"o{o}", i) for i in range(2000) for o in (0, 1)]
    found = log.conflicts(spark.createDataFrame(seen, OBSERVED), spark.createDataFrame(known, SEEN))
    assert found.collect() == [] and most_rows(found._jdf.queryExecution().executedPlan()) <= 3 * 2000


def test_latest_replication_does_not_depend_on_the_order_of_rows(spark):
    from holdfast.operators import metadata

    checkpoints = spark.createDataFrame([("c1", 5), ("c2", 9)], "checkpoint_id string, last_seq long")
    rows = [("c2", "d", "failed", "unknown", 2), ("c2", "d", "verified", "unknown", 1), ("c1", "d", "verified", "unknown", 3), ("c1", "e", "verified", "unknown", 7), ("c1", "e", "pending", "unknown", 7)]
    for order in (rows, rows[::-1]):
        found = metadata.latest_replication(spark.createDataFrame(order, "checkpoint_id string, destination_id string, status string, independence string, event_seq int").coalesce(1), checkpoints)
        assert {tuple(r) for r in found.collect()} == {("d", "c2", "failed", "unknown", 2), ("e", "c1", "verified", "unknown", 7)}


def machine(events, expected):
    """The state machine, one observation after another."""
    state = {"presence": None, "integrity": "unverified", "success": None}
    for kind, observed, t in events:
        good = observed == expected
        if kind == "checksum":
            state |= {"presence": "present", "integrity": "verified" if good else "damaged"} | ({"success": t} if good else {})
        elif kind == "rejected":
            state |= {"presence": "present", "integrity": "damaged"}
        elif kind == "read_error":
            state |= {"presence": "unknown", "integrity": "damaged" if state["integrity"] == "damaged" else "unverified"}
        elif kind == "missing":
            state |= {"presence": "missing", "integrity": "unverified"}
        else:
            keeps = state["integrity"] == "damaged" or state["presence"] == "present"
            state |= {"integrity": state["integrity"] if keeps else "unverified", "presence": "present"}
    return state["presence"], state["integrity"], state["success"]


def test_fold_is_the_state_machine(spark):
    import random

    rng = random.Random(4)
    cases = {f"o{i}": [(rng.choice(("checksum", "rejected", "read_error", "missing", "metadata_present")), rng.choice((b"g", b"b")), t // 2) for t in range(rng.randint(1, 6))] for i in range(300)}
    rows = [(o, "l", t, n, kind, seen) for o, events in cases.items() for n, (kind, seen, t) in enumerate(events)]
    got = scans.fold_observations(spark.createDataFrame(rows, "object_id string, location_id string, time_ms long, seq long, kind string, observed binary"), spark.createDataFrame([(o, b"g") for o in cases], "object_id string, expected binary"))
    assert {r["object_id"]: (r["presence"], r["integrity"], r["last_success_ms"]) for r in got.collect()} == {o: machine(e, b"g") for o, e in cases.items()}


def test_stream_equals_batch(spark, tmp_path):
    kind = "object_id string, location_id string, time_ms long, seq long, kind string, observed binary"
    rows = [(f"o{i % 7}", f"l{i % 3}", i, i, ("checksum", "read_error", "missing", "metadata_present")[i % 4 if i % 5 else 0], b"g" if i % 6 else b"b") for i in range(120)]
    objects = spark.createDataFrame([(f"o{i}", b"g") for i in range(7)], "object_id string, expected binary")
    table = StateTable(spark, f"file://{tmp_path}/state")
    for i in range(3):
        spark.createDataFrame(rows[i * 40 : i * 40 + 40], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
        table.follow(stream, objects, checkpoint=f"{tmp_path}/checkpoint").awaitTermination()
    whole = scans.fold_observations(spark.createDataFrame(rows, kind), objects)
    assert sorted(table.current().collect()) == sorted(whole.collect()) and len(table.versions()) == 3
    table.apply(spark.createDataFrame(rows[:40], kind), table.versions()[-1], objects)
    assert len(table.versions()) == 3


def test_equal_tables_and_fingerprint(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string")
    assert tuple(scans.equal_tables(a, a.orderBy("b")).first()) == (0, 0)
    assert tuple(scans.equal_tables(a, a.distinct()).first()) == (1, 0)
    assert scans.fingerprint(a).first() == scans.fingerprint(a.orderBy(F.desc("a"))).first()


def test_last_expectation_follows_causes(spark):
    from holdfast.operators import migrate

    rows = [("f", "h", "o1", 5, 0, "r1"), ("f", "h", "o2", 3, 0, "r2"), ("f", "x", "o2", 9, 0, "r9"), ("g", "h", "o1", 1, 0, "s1"), ("g", "h", "o1", 1, 2, "s2")]
    expected = spark.createDataFrame(rows, "file_id string, hash string, origin_id string, seq long, item int, record_id string")
    projected = spark.createDataFrame([("f", "h"), ("g", "h")], "file_id string, hash string")
    for saw, last in ((("r1", "o2", 3), "r1"), (("r2", "o1", 5), "r2")):
        frontiers = spark.createDataFrame([saw], "record_id string, origin_id string, seq long")
        got = {r["file_id"]: r["record_id"] for r in migrate.last_expectation(expected, projected, frontiers).collect()}
        assert got == {"f": last, "g": "s2"}


def test_subject_history_pages(spark):
    from holdfast.operators import history

    items = spark.createDataFrame([("o", i, 0, {"file": "f" if i % 2 else "g"}) for i in range(10)], "origin_id string, origin_seq long, item_index int, item map<string,string>")
    assert [r["origin_seq"] for r in history.subject_history(items, "f", 1, 2).collect()] == [3, 5, 7]


def test_annex_logs(spark):
    from holdfast.sources import annex

    logs = spark.createDataFrame([("k", "9s 1 u\n1s 0 u\n5s X v\n")], "key string, blob string")
    assert {(r["uuid"], r["state"]) for r in annex.location_states(logs).collect()} == {("u", "missing"), ("v", "unknown")}
    with pytest.raises(Exception, match="malformed"):
        annex.location_states(spark.createDataFrame([("k", "1s 1")], "key string, blob string")).collect()
    trees = spark.createDataFrame([("120000", ".git/annex/objects/a/b/K/K"), ("120000", "x/K/L"), ("100644", "/annex/objects/K\nrest"), ("100644", "text")], "mode string, blob string")
    assert [r["k"] for r in trees.select(annex.key_of_pointer("mode", "blob").alias("k")).collect()] == ["K", None, "K", None]


def test_attachment_plan_is_greedy(spark, monkeypatch):
    from holdfast.operators import access

    from .test_fixtures import build, device, location

    copies = [(f"c{i}{d}", f"f{i}", f"l{d}", f"x{i}", None, "present", 1, 1, "ok", 1, None) for d, files in {"a": (1, 2), "b": (2, 3, 4), "c": (1,)}.items() for i in files]
    c = build(spark, devices=[device(d, None) for d in "abc"], locations=[location(f"l{d}", "filesystem", device=d) for d in "abc"], file_refs=[(f"f{i}", "k", "p", f"x{i}", None, "active", "resolved", "o", i, 1) for i in range(1, 6)], copies=copies)
    requested = spark.createDataFrame([(i, f"f{i}") for i in range(1, 6)], "ordinal long, file_id string")
    none = c.locations.limit(0).select("location_id")
    assert [tuple(r) for r in access.attachment_plan(c, requested, none).orderBy("step").collect()] == [(1, "b", 3), (2, "a", 1)]
    monkeypatch.setattr(access, "MAX_CLASSES", 1)
    assert [tuple(r) for r in access.attachment_plan(c, requested, none).orderBy("step").collect()] == [(1, "b", 3), (2, "a", 1)]
    states = {r["file_id"]: r["access"] for r in access.access_states(c, requested, spark.createDataFrame([("lb",)], "location_id string"), "k").collect()}
    assert states == {"f1": "attachment_required", "f2": "accessible", "f3": "accessible", "f4": "accessible", "f5": "no_known_copy"}
    lines = spark.createDataFrame([(1, '"f1"'), (2, '{"file_ref_id": "f2"}'), (3, '"f1"')], "ordinal long, line string")
    assert {tuple(r) for r in access.parse_requests(lines).select("ordinal", "file_id").collect()} == {(1, "f1"), (2, "f2")}


@pytest.mark.parametrize("room", [1, 25, 90, 10**6])
def test_attachment_plan_equals_step_by_step(spark, monkeypatch, room):
    import random

    from holdfast.operators import access

    rnd = random.Random(room)
    classes = {tuple(sorted(rnd.sample([f"d{i}" for i in range(30)], rnd.randint(1, 5)))): rnd.randint(1, 4) for _ in range(60)}
    expected, left = [], dict(classes)
    while left:
        brings = {d: sum(n for ds, n in left.items() if d in ds) for ds in left for d in ds}
        best = min(brings, key=lambda d: (-brings[d], d))
        expected.append((len(expected) + 1, best, brings[best]))
        left = {ds: n for ds, n in left.items() if best not in ds}
    rows = spark.createDataFrame([(list(ds), n) for ds, n in classes.items()], "devices array<string>, n long").repartition(3).cache()
    monkeypatch.setattr(access, "MAX_CLASSES", room)
    assert access._steps(rows, None) == expected and access._steps(rows, 4) == expected[:4]


def test_attachment_plan_takes_many_classes_in_few_jobs(spark):
    from holdfast.operators import access

    # 120,000 contents on pairs of 500 devices; one job for each step would be hundreds
    rows = spark.range(120_000).select(F.array((F.col("id") % 500).cast("string"), (500 + F.col("id") % 240).cast("string"), (1000 + F.col("id")).cast("string")).alias("devices"), F.lit(1).cast("long").alias("n"))
    tracker, group = spark.sparkContext.statusTracker(), "attachment-jobs"
    spark.sparkContext.setJobGroup(group, group)
    steps = access._steps(rows, None)
    spark.sparkContext.setJobGroup("", "")
    assert sum(s[2] for s in steps) == 120_000 and len(steps) >= 240 and len(tracker.getJobIdsForGroup(group)) < 20


def test_state_in_buckets(spark, tmp_path):
    """Copies folded batch by batch: untouched buckets stay as they are, a replayed batch changes nothing, old files go."""
    from holdfast.streaming import state
    from holdfast.streaming.versions import COPIES

    kind = "copy_id string, file_id string, location_id string, content_id string, kind string, result string, time_ms long, at long"
    kinds = (("content_observed", None), ("copy_verification_failed", "hash_mismatch"), ("copy_verification_failed", "read_error"), ("scan_missing_candidate", None))
    rows = [(f"c{i * i % 17}", f"f{i * i % 17}", "l", f"x{i % 4}", *kinds[(i * 7 + i // 5) % 4], 1000 - i if i % 6 else 5000, i) for i in range(90)]
    table = StateTable(spark, f"file://{tmp_path}/state", COPIES, buckets=8)
    for n, part in enumerate((rows[:40], rows[40:45], [], rows[45:])):
        table.apply(spark.createDataFrame(part, kind), n)
        written = {p.name for p in (tmp_path / "state/state").glob(f"{n}/bucket=*")}
        assert len(written) <= len({r[0] for r in part})
    table.apply(spark.createDataFrame(rows[:40], kind), 3)
    whole = spark.createDataFrame(rows, kind)
    assert sorted(map(str, table.current().collect())) == sorted(map(str, state.finish_copies(state.copy_parts(whole)).collect())) and table.versions() == [0, 1, 2, 3]
    named = set(table._manifest().items())
    left = {(p.name.removeprefix("bucket="), int(p.parent.name)) for p in (tmp_path / "state/state").glob("*/bucket=*")}
    assert named <= left and len(left) <= 2 * len(named)
    assert {r["copy_id"] for r in state.unknown_copies(state.copy_parts(whole.filter("kind <> 'content_observed'"))).collect()} == {r[0] for r in rows if r[4] != "content_observed"}


def plain_files(rows, saw):
    """Paths folded one observation after another."""
    out = {}
    for path, content, origin, seq, record in rows:
        old, conflict = out.get(path, (None, False))
        if old and old[0] != content and not conflict:
            conflict = saw.get((record, old[1]), 0) < old[2]
        out[path] = ((content, origin, seq), conflict)
    return {p: (None if c else x[0], c) for p, (x, c) in out.items()}


def test_files_fold_in_parts(spark):
    import random

    from holdfast.plans.logs import merge_files
    from holdfast.streaming import state

    rng = random.Random(8)
    rows = [(f"p{rng.randint(0, 12)}", f"x{rng.randint(0, 1)}", f"o{rng.randint(0, 2)}", i, f"r{i}") for i in range(60)]
    saw = {(r[4], f"o{k}"): rng.randint(max(0, r[3] - 25), r[3]) for r in rows for k in range(3)}
    known = spark.createDataFrame([(r, o, s) for (r, o), s in saw.items()], "record_id string, origin_id string, seq long")
    items = spark.createDataFrame([("c", p, f"f{p}", x, o, s, r, s) for p, x, o, s, r in rows], "collection_id string, path string, file_id string, content_id string, origin_id string, origin_seq long, record_id string, at long")
    want = plain_files(rows, saw)
    assert 0 < sum(c for _, c in want.values()) < len(want)
    for cut in (0, 20, 45):
        first = state.file_parts(items.filter(F.col("at") < cut), known)
        both = merge_files(first, state.file_parts(items.filter(F.col("at") >= cut), known, first))
        assert {r["path"]: (r["content_id"], r["identity_state"] == "conflict") for r in state.finish_files(both).collect()} == want
    moved = items.unionByName(items.limit(1).withColumns({"file_id": F.lit("other"), "at": F.lit(99).cast("long")}))
    with pytest.raises(Exception, match="another file id"):
        state.file_parts(moved, known).collect()


def test_unknown_kinds_and_failures_are_errors(spark):
    from holdfast.streaming import state

    kind = "copy_id string, file_id string, location_id string, content_id string, kind string, result string, time_ms long, at long"
    one = lambda k, r=None: spark.createDataFrame([("c", "f", "l", "x", k, r, 1, 1)], kind)
    assert len(state.KINDS) == 40 and state.checked(one("job_started")).count() == 1
    with pytest.raises(Exception, match="unknown item kind odd"):
        state.dispatch(one("odd"))["job_started"].collect()
    with pytest.raises(Exception, match="not a verification failure"):
        state.copy_parts(one("copy_verification_failed", "ok")).collect()


def test_registry_faults(spark):
    from holdfast.operators import topology

    from .test_fixtures import build, device, location

    c = build(spark, sites=[("s", "s", "active")], devices=[device("d", "s")], locations=[location("l", "filesystem", device="d", root="r")], archive_roots=[("r", "d", "active")], policies=[], collections=[("k", "k", "s", None, "active")], risk_assignments=[("site", "s", "q")])
    fault = lambda df: {r["change_id"]: r["fault"] for r in df.collect()}
    rows = [("a", "register", "s", "s", "active", "x"), ("b", "update", "t", "t", "active", "x"), ("c", "update", "s", "s", "active", ""), ("d", "retire", "s", "s", "retired", "x"), ("e", "register", "", "s", "active", "x")]
    assert fault(topology.site_changes(spark.createDataFrame(rows, "change_id string, action string, site_id string, display_name string, status string, site_kind string"), c.sites)) == {"a": "already_exists", "b": "not_found", "c": "site_kind_required", "d": None, "e": "id_required"}
    policies = spark.createDataFrame([("p", 3)], "policy_id string, version int")
    rows = [("a", "update", "p", "p", "active", 3), ("b", "update", "p", "p", "active", 4), ("c", "register", "q", "q", "active", 0)]
    assert fault(topology.policy_changes(spark.createDataFrame(rows, "change_id string, action string, policy_id string, display_name string, status string, version int"), policies)) == {"a": "version_not_increased", "b": None, "c": "version_not_positive"}
    rows = [("a", "update", "k", "k", "active", "none", None), ("b", "update", "k", "k", "active", "s", "p"), ("c", "update", "k", "k", "active", None, None)]
    assert fault(topology.collection_changes(spark.createDataFrame(rows, "change_id string, action string, collection_id string, display_name string, status string, home_site_id string, policy_id string"), c)) == {"a": "home_site_not_found", "b": "policy_not_found", "c": None}
    kind = "archive_root_id string, device_id string, path string, fingerprint string, fingerprint_kind string, identity_state string, status string, display_name string"
    roots = spark.createDataFrame([("r", "d", "/x", "1", "fs", "confirmed", "active", "r")], kind)
    rows = [("a", "register", "n", "d", "/x", "2", "fs", "confirmed", "active", "n"), ("b", "register", "n", "d", "/y", "1", "fs", "confirmed", "active", "n"), ("c", "update", "r", "d", "/y", "1", "fs", "confirmed", "active", "r"), ("d", "update", "r", "d", "/x", "1", "fs", "confirmed", "active", "new name"), ("e", "register", "n", "z", "/y", None, None, "unavailable", "active", "n"), ("f", "register", "n", "d", "/y", None, None, "confirmed", "active", "n")]
    assert fault(topology.root_changes(spark.createDataFrame(rows, "change_id string, action string, " + kind), roots, c.devices)) == {"a": "path_taken", "b": "fingerprint_taken", "c": "evidence_changed", "d": None, "e": "device_not_found", "f": "evidence_does_not_fit"}
    rows = [("a", "assign", "q", "site", "s"), ("b", "unassign", "q", "device", "d"), ("c", "assign", "q", "shelf", "s"), ("d", "assign", "z", "site", "s"), ("e", "assign", "q", "device", "none"), ("f", "unassign", "q", "site", "s")]
    domains = spark.createDataFrame([("q",)], "risk_id string")
    assert fault(topology.risk_changes(spark.createDataFrame(rows, "change_id string, action string, risk_id string, entity_type string, entity_id string"), c, domains)) == {"a": "already_assigned", "b": "not_assigned", "c": "invalid_entity_type", "d": "risk_not_found", "e": "entity_not_found", "f": None}
    rows = [("a", "m", "d", "r", "/m", "mounted", "match"), ("b", "m", "d", "none", "/m", "mounted", "match"), ("c", "", "d", None, "/m", "mounted", "match"), ("d", "m", "z", None, "/m", "mounted", "match"), ("e", "m", "d", None, "/m", "gone", "match")]
    assert fault(topology.mount_changes(spark.createDataFrame(rows, "change_id string, mount_id string, device_id string, archive_root_id string, mount_root string, status string, fingerprint_status string"), c)) == {"a": None, "b": "archive_root_not_found", "c": "mount_id_required", "d": "device_not_found", "e": "invalid_mount_state"}


def test_findings_pages(spark):
    from holdfast.operators import evaluations

    status = spark.createDataFrame([("p", "e1", None), ("q", "e2", "freshness_expired"), ("r", "e3", None)], "policy_id string, evaluation_id string, reason string")
    findings = spark.createDataFrame([(e, f"f{i:02d}", "c", "violated" if i % 2 else "uncertain") for e in ("e1", "e2", "e3") for i in range(10)], "evaluation_id string, file_id string, collection_id string, status string")
    seen, after = [], None
    while True:
        got = [tuple(r) for r in evaluations.findings_page(status, findings, 7, after).select("policy_id", "file_id").collect()]
        seen += got[:7]
        if len(got) <= 7:
            break
        after = got[6]
    assert seen == [(p, f"f{i:02d}") for p in "pr" for i in range(10)]
    assert evaluations.findings_page(status, findings, 50, state="violated", policy_id="p").count() == 5
    for bad in ({"limit": 0}, {"limit": 1, "state": "satisfied"}):
        with pytest.raises(ValueError):
            evaluations.findings_page(status, findings, **bad)


def test_checked_counters(spark):
    from holdfast.functions import numbers

    rows = spark.createDataFrame([(2**62,), (2**62,)], "n long")
    assert rows.agg(numbers.saturating_sum("n").alias("n")).first()["n"] == 2**63 - 1
    with pytest.raises(Exception, match="out of range"):
        rows.agg(numbers.checked_sum("n")).collect()
    assert [r["p"] for r in spark.createDataFrame([(1, 3), (0, 0), (2, 2)], "a int, b int").select(numbers.percent("a", "b").alias("p")).collect()] == [33.3, 0.0, 100.0]
    assert spark.createDataFrame([(-1,), (86_400_000,)], "t long").select(numbers.utc_text("t").alias("t")).collect() == [("1969-12-31T23:59:59Z",), ("1970-01-02T00:00:00Z",)]
