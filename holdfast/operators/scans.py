"""What scans and checks tell: state folds, missing files, unchanged files, staged files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import predicates as p
from holdfast.sources.adapter import Catalog


def fold_parts(observations: DataFrame, objects: DataFrame) -> DataFrame:
    """What the state of each (object, location) is made of: greatest rows of its observations by time and seq.

    The state machine needs no sequential pass. Checksums, rejections and absences set the integrity;
    read errors and metadata sightings behind the last of these keep damage, and a read error takes
    verification away. So the fold is one aggregation with partial sums on the map side, and parts of
    earlier and later observations are put together by `merge_parts`.
    """
    at = F.struct("time_ms", "seq")
    kind = F.col("kind")
    rows = observations.join(objects.select("object_id", "expected"), "object_id").withColumn("at", at)
    match = F.col("expected").isNull() | (F.col("observed") == F.col("expected"))
    sets = F.when(kind == "checksum", F.when(match, "verified").otherwise("damaged")).when(kind == "rejected", "damaged").when(kind == "missing", "unverified")
    result = F.when(kind == "checksum", F.when(match, "ok").otherwise("mismatch")).when(kind == "rejected", "mismatch").when(kind == "read_error", "read_error").when(kind == "missing", "missing")
    presence = F.when(kind == "read_error", "unknown").when(kind == "missing", "missing").otherwise("present")
    return rows.groupBy("object_id", "location_id").agg(
        F.max(F.struct("at", presence.alias("value"))).alias("presence"), F.max(F.when(sets.isNotNull(), F.struct("at", sets.alias("value")))).alias("setter"), F.max(F.when(kind == "read_error", F.col("at"))).alias("error_at"),
        F.max(F.when(result.isNotNull(), F.struct("at", result.alias("result"), F.when(kind.isin("checksum", "rejected"), F.col("observed")).alias("observed")))).alias("check"),
        F.max(F.when(result == "ok", F.col("time_ms"))).alias("last_success_ms"), F.count(F.lit(1)).alias("events"),
    )


def merge_parts(parts: DataFrame, *keys: str) -> DataFrame:
    """Parts of the same keys as one; `keys` are further columns that go with them."""
    greatest = ("presence", "setter", "error_at", "check", "last_success_ms")
    return parts.groupBy("object_id", "location_id", *keys).agg(*[F.max(x).alias(x) for x in greatest], F.sum("events").alias("events"))


def finish_parts(parts: DataFrame) -> DataFrame:
    value, lost = F.col("setter.value"), F.col("error_at") > F.col("setter.at")
    integrity = F.when(value == "damaged", "damaged").when((value == "verified") & ~F.coalesce(lost, F.lit(False)), "verified").otherwise("unverified")
    return parts.select("object_id", "location_id", F.col("presence.value").alias("presence"), integrity.alias("integrity"), F.col("check.at.time_ms").alias("last_check_ms"), F.col("check.result").alias("last_check_result"), F.col("check.observed").alias("observed"), "last_success_ms", "events")


def fold_observations(observations: DataFrame, objects: DataFrame) -> DataFrame:
    """The state of each (object, location) after its observations in the order of time and seq."""
    return finish_parts(fold_parts(observations, objects))


def missing_candidates(c: Catalog, seen: DataFrame) -> DataFrame:
    """scan_id, copy_id: copies present at a scan's location and in its collection that it did not see (seen: scan_id, copy_id).

    Only complete scans without errors publish what they miss.
    """
    whole = c.scans.filter((F.col("status") == "complete") & ~F.col("had_errors")).select("scan_id", "location_id", "collection_id", "started_ms")
    held = c.copies.filter(F.col("state") == "present").join(c.file_refs.select("file_id", "collection_id"), "file_id")
    # a sighting after the scan began outdates it
    expected = held.join(whole, ["location_id", "collection_id"]).filter(F.col("last_seen_ms") <= F.col("started_ms"))
    return expected.join(seen, ["scan_id", "copy_id"], "left_anti").select("scan_id", "copy_id", "location_id", "collection_id")


def publish_missing(c: Catalog, candidates: DataFrame, declared: DataFrame) -> DataFrame:
    """The copies table after publication. declared (scan_id, n): a scan whose count differs publishes nothing."""
    counted = candidates.groupBy("scan_id").agg(F.count(F.lit(1)).alias("found"))
    valid = counted.join(declared, "scan_id").filter(F.col("found") == F.col("n")).select("scan_id")
    gone = candidates.join(valid, "scan_id", "left_semi").select("copy_id", F.lit(True).alias("_gone")).distinct()
    return c.copies.join(gone, "copy_id", "left").withColumn("state", F.when(F.col("_gone"), "missing").otherwise(F.col("state"))).drop("_gone")


def classify_listing(listing: DataFrame, known: DataFrame) -> DataFrame:
    """listing (path, size, mtime_ms) against known (path, size, mtime_ms, presence, integrity): new, unchanged, changed, returned or gone.

    A null mtime is never unchanged; neither is a copy whose integrity is not good.
    """
    both = listing.select("path", F.col("size").alias("size2"), F.col("mtime_ms").alias("mtime2"), F.lit(True).alias("listed")).join(known, "path", "full")
    same = (F.col("size") == F.col("size2")) & (F.col("mtime_ms") == F.col("mtime2")) & (F.col("presence") == "present") & (F.col("integrity") == "verified")
    kind = F.when(F.col("listed").isNull(), "gone").when(F.col("presence").isNull(), "new").when(F.coalesce(same, F.lit(False)), "unchanged").when(F.col("presence") == "missing", "returned").otherwise("changed")
    return both.select("path", kind.alias("kind"))


def stage_audit(staged: DataFrame, known: DataFrame, selected: str) -> DataFrame:
    """staged (path, hash) against known (hash, collection_id): new, known in the selected collection, or in another; copies inside the stage are numbered."""
    owners = known.groupBy("hash").agg(F.max(p.flag(F.col("collection_id") == selected)).alias("here"), F.count_distinct("collection_id").alias("collections"))
    groups = staged.groupBy("hash").agg(F.count(F.lit(1)).alias("staged_copies"), F.min("path").alias("first_path"))
    rows = staged.join(groups, "hash").join(owners, "hash", "left")
    kind = F.when(F.col("here").isNull(), "new").when(F.col("here") == 1, "known_in_selected").otherwise("known_in_other")
    return rows.select("path", kind.alias("kind"), F.coalesce("collections", F.lit(0)).alias("collections"), "staged_copies", (F.col("path") != F.col("first_path")).alias("duplicate"))


def stage_import(staged: DataFrame, known: DataFrame) -> DataFrame:
    """Staged paths whose hash the catalog lacks, one for each hash."""
    fresh = staged.join(known.select("hash"), "hash", "left_anti")
    return fresh.groupBy("hash").agg(F.min("path").alias("path"))


def stage_protection(staged: DataFrame, known: DataFrame, satisfied: DataFrame) -> DataFrame:
    """Protection of each staged hash over its collections. satisfied (collection_id, state in satisfied, at_risk, unknown).

    Two conventions: `dominant` lets at_risk win; `last` is the state of the last unsatisfied collection by id.
    """
    rows = staged.select("hash").distinct().join(known.select("hash", "collection_id").distinct(), "hash").join(satisfied, "collection_id")
    bad = F.col("state") != "satisfied"
    dominant = F.when(F.max(p.flag(F.col("state") == "at_risk")) == 1, "at_risk").when(F.max(p.flag(bad)) == 1, "unknown").otherwise("satisfied")
    return rows.groupBy("hash").agg(dominant.alias("dominant"), F.coalesce(F.max_by("state", F.when(bad, F.col("collection_id"))), F.lit("satisfied")).alias("last"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Groups of equal keys and how many rows are beyond the first: groups, redundant."""
    groups = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"))


def interleaved_scans(c: Catalog) -> DataFrame:
    """Scans during which another one of the same location and collection started."""
    other = c.scans.select(F.col("scan_id").alias("other"), "location_id", "collection_id", F.col("started_ms").alias("other_ms"))
    rows = c.scans.join(other, ["location_id", "collection_id"]).filter((F.col("other") != F.col("scan_id")) & F.col("other_ms").between(F.col("started_ms"), F.col("finished_ms")))
    return rows.select("scan_id").distinct()


def device_history(moves: DataFrame) -> DataFrame:
    """moves (device_id, site_id, arrived_ms) -> stays with their ends; the open one has none."""
    from pyspark.sql import Window as W

    return moves.withColumn("departed_ms", F.lead("arrived_ms").over(W.partitionBy("device_id").orderBy("arrived_ms", "site_id")))


def known_entries(listing: DataFrame, observations: DataFrame, files: DataFrame, copies: DataFrame, candidates: DataFrame) -> DataFrame:
    """What is known of each listed path (scan_id, collection_id, location_id, path): file, copy, their states, and two flags.

    observations (file_id, location_id, path, state, last_at, last_scan); files (file_id, collection_id, state);
    copies (copy_id, location_id, path, state, state_at); candidates (scan_id, location_id, kind, subject, at):
    a scan's missing ones count while nothing newer was told of the path or copy.
    """
    active = files.filter(F.col("state") == "active").select("file_id", "collection_id")
    seen = observations.withColumnRenamed("state", "path_state").join(active, "file_id")
    held = copies.filter(F.col("state") != "superseded").select("copy_id", "location_id", "path", F.col("state").alias("copy_state"), "state_at")
    rows = listing.join(seen, ["collection_id", "location_id", "path"]).join(held, ["location_id", "path"], "left")
    newest = candidates.groupBy("scan_id", "location_id", "kind", "subject").agg(F.max("at").alias("_at"))
    of = lambda kind, key: newest.filter(F.col("kind") == kind).select("scan_id", "location_id", F.col("subject").alias(key), F.col("_at").alias(f"_{kind}_at"))
    rows = rows.join(of("path", "file_id"), ["scan_id", "location_id", "file_id"], "left").join(of("copy", "copy_id"), ["scan_id", "location_id", "copy_id"], "left")
    newer = F.coalesce(F.col("_path_at") > F.col("last_at"), F.lit(False)) | F.coalesce(F.col("_copy_at") > F.col("state_at"), F.lit(False))
    return rows.select("scan_id", "location_id", "path", "file_id", "copy_id", "path_state", "copy_state", F.coalesce(F.col("last_scan") == F.col("scan_id"), F.lit(False)).alias("observed_by_scan"), newer.alias("pending_missing"))


def known_copies(listing: DataFrame, copies: DataFrame, candidates: DataFrame) -> DataFrame:
    """The copy at each listed path (scan_id, location_id, path), its state, and whether the scan's newer candidate says it is missing."""
    held = copies.filter(F.col("state") != "superseded").select("copy_id", "location_id", "path", "state", "content_id", "external_id", "state_at")
    newest = candidates.filter(F.col("kind") == "copy").groupBy("scan_id", "location_id", F.col("subject").alias("copy_id")).agg(F.max("at").alias("_at"))
    rows = listing.join(held, ["location_id", "path"]).join(newest, ["scan_id", "location_id", "copy_id"], "left")
    return rows.select("scan_id", "location_id", "path", "copy_id", "state", "content_id", "external_id", F.coalesce(F.col("_at") > F.col("state_at"), F.lit(False)).alias("pending_missing"))


def listed(rows: DataFrame, category: str, order: list[str], size: str, limit: int = 20) -> DataFrame:
    """Each category with its count and bytes, the first `limit` rows of it by an order, and whether there are more.

    The rows are numbered inside a category and cut before they are gathered.
    """
    from pyspark.sql import Window as W

    totals = rows.groupBy(category).agg(F.count(F.lit(1)).alias("count"), F.sum(size).alias("bytes"))
    # the limit goes below the shuffle: each task keeps its own first rows only
    first = rows.withColumn("_at", F.row_number().over(W.partitionBy(category).orderBy(*order))).filter(F.col("_at") <= limit)
    names = first.groupBy(category).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.struct(*order).alias("x")))), lambda y: y["x"]).alias("listed"))
    return totals.join(names, category).withColumn("truncated", F.col("count") > limit)


def equal_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """only_a, only_b: rows, with their multiplicities, that the other table lacks."""
    b = b.select(*a.columns)
    left = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_a"))
    return left.join(b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_b")), F.lit(True))


def ordered_digest(rows: DataFrame, digits: int = 3) -> DataFrame:
    """One digest of a table's rows in an order of their own: 16 ** digits groups of row digests, sorted and hashed, then hashed together.

    Equal tables have equal digests, however they are partitioned; values go in with their length, nulls apart.
    """
    value = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    own = F.sha2(F.concat(*[value(c) for c in sorted(rows.columns)]).cast("binary"), 256)
    groups = rows.select(own.alias("d")).groupBy(F.substring("d", 1, digits).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "").cast("binary"), 256).alias("h"))
    listing = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), "")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(listing.cast("binary"), 256).alias("digest"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """An order-independent digest: rows and the XOR of their hashes, in four parts."""
    digest = F.sha2(F.to_json(F.struct(*rows.columns)), 256)
    parts = [F.bit_xor(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long")).alias(f"x{i}") for i in range(4)]
    return rows.agg(F.count(F.lit(1)).alias("rows"), *parts)
