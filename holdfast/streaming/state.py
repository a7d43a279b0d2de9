"""Log items to the current state of files and copies.

Items are dispatched by kind and folded by `at`, their place in the order of application. A fold keeps
greatest rows by that place, so parts of earlier and later items merge to what one pass gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The kinds of log items.
ITEM_KINDS = frozenset("archive_initialized archive_updated client_enrolled client_revoked content_observed copy_verification_failed scan_started scan_missing_candidate scan_completed annex_import_started annex_entry_observed annex_import_completed job_started job_finished".split())
REGISTRY_KINDS = frozenset(
    "site_registered site_updated site_retired policy_registered policy_updated policy_retired collection_registered collection_updated collection_retired device_registered device_updated device_moved device_retired archive_root_registered archive_root_updated archive_root_retired location_registered location_updated location_retired risk_domain_registered risk_domain_updated risk_domain_retired risk_assigned risk_unassigned device_checked_in device_mount_observed".split()
)
KINDS = ITEM_KINDS | REGISTRY_KINDS
#: Results of a failed verification.
FAILURES = ("hash_mismatch", "read_error", "identity_mismatch")


def checked(items: DataFrame) -> DataFrame:
    """Items whose kind is known; another kind is an error, raised inside the filter so that no plan drops it."""
    fail = F.raise_error(F.concat(F.lit("unknown item kind "), F.coalesce("kind", F.lit("null")))).cast("boolean")
    return items.filter(F.when(F.col("kind").isin(*sorted(KINDS)), F.lit(True)).otherwise(fail))


def dispatch(items: DataFrame) -> dict[str, DataFrame]:
    """One table for each kind; each is a filter of the same checked items."""
    rows = checked(items)
    return {kind: rows.filter(F.col("kind") == kind) for kind in sorted(KINDS)}


def latest(items: DataFrame, key: str, values: list[str], ended: tuple[str, ...] = ()) -> DataFrame:
    """The current row of each key: the values of its last item by `at`; keys whose last item is of an `ended` kind are gone."""
    last = items.groupBy(key).agg(F.max(F.struct("at", "kind", *values)).alias("x")).select(key, "x.*")
    return last.filter(~F.col("kind").isin(*ended)).select(key, *values) if ended else last.select(key, *values)


def registry_state(items: DataFrame, entity: str, key: str, values: list[str]) -> DataFrame:
    """Current entities from their registered, updated, moved and retired items, with `status`."""
    own = items.filter(F.col("kind").isin(*[k for k in sorted(REGISTRY_KINDS) if k.startswith(f"{entity}_") and k.rpartition("_")[0] == entity]))
    rows = own.withColumn("status", F.when(F.col("kind") == f"{entity}_retired", "retired").otherwise("active"))
    return latest(rows, key, ["status", *values])


def copy_parts(items: DataFrame) -> DataFrame:
    """items (copy_id, file_id, location_id, content_id, kind, result, time_ms, at) -> parts of each copy's state.

    A content observation finds a copy present and good; a failed verification finds it corrupt (mismatch) or
    leaves it unknown; a published absence finds it missing and says nothing of its bytes.
    """
    kind, result = F.col("kind"), F.col("result")
    good, failed, gone = kind == "content_observed", kind == "copy_verification_failed", kind == "scan_missing_candidate"
    wrong = failed & (result == "hash_mismatch")
    fine = F.when(failed & ~F.coalesce(result.isin(*FAILURES), F.lit(False)), F.raise_error(F.concat(F.lit("not a verification failure: "), F.coalesce(result, F.lit("null")))).cast("boolean")).otherwise(good | failed | gone)
    rows = items.filter(fine)
    state = F.when(good, "present").when(gone, "missing").when(wrong, "corrupt").otherwise("unknown")
    integrity = F.when(good, 1).when(wrong, 2).when(failed, 0)
    return rows.groupBy("copy_id").agg(
        F.max(F.struct("at", "file_id", "location_id", state.alias("state"))).alias("last"), F.max(F.when(good, F.struct("at", "content_id"))).alias("content"),
        F.max(F.when(good | wrong | gone, F.struct("at", "time_ms"))).alias("seen"), F.max(F.when(integrity.isNotNull(), F.struct("at", integrity.alias("code"), F.when(failed, result).alias("error")))).alias("checked"),
        F.max(F.when(good, F.col("time_ms"))).alias("last_success_ms"), F.count(F.lit(1)).alias("items"),
    )


def merge_copies(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy("copy_id", *keys).agg(*[F.max(x).alias(x) for x in ("last", "content", "seen", "checked", "last_success_ms")], F.sum("items").alias("items"))


def finish_copies(parts: DataFrame) -> DataFrame:
    """Copies that no content observation has introduced have no content; `unknown_copies` tells them."""
    return parts.select(
        "copy_id", "last.file_id", "last.location_id", F.col("content.content_id").alias("content_id"), "last.state", F.col("seen.time_ms").alias("last_presence_ms"),
        F.col("checked.code").alias("integrity_code"), F.col("checked.error").alias("error_code"), "last_success_ms", "items",
    )


def unknown_copies(parts: DataFrame) -> DataFrame:
    """Copies that failures or absences name, though nothing was ever observed of them."""
    return parts.filter("content is null").select("copy_id")


def file_parts(observed: DataFrame, frontiers: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """observed (collection_id, path, file_id, content_id, origin_id, origin_seq, record_id, at) -> what is known of each path.

    Content that differs from what the path had conflicts, unless its record had seen the one before (frontiers:
    record_id, origin_id, seq). A conflict stays. `before` are the parts of earlier items; each path's last
    observation among them comes first, so folding in parts gives what one pass gives.
    """
    names = ["collection_id", "path", "file_id", "content_id", "origin_id", "origin_seq", "record_id", "at"]
    rows = observed.select(*names, F.lit(False).alias("conflict"), F.lit(1).cast("long").alias("n"))
    if before is not None:
        rows = rows.unionByName(before.select("collection_id", "path", *[F.col(f"last.{x}").alias(x) for x in names[2:]], "conflict", F.col("items").alias("n")))
    own = W.partitionBy("collection_id", "path").orderBy("at")
    rows = rows.withColumn("was", F.lag(F.struct("content_id", "origin_id", "origin_seq", "file_id")).over(own))
    seen = frontiers.select("record_id", F.col("origin_id").alias("_origin"), F.col("seq").alias("_seq"))
    differs = rows.filter(F.col("was").isNotNull() & ~F.col("was.content_id").eqNullSafe(F.col("content_id")))
    # only observations that change something ask the frontiers
    apart = differs.join(seen, (differs["record_id"] == seen["record_id"]) & (F.col("was.origin_id") == F.col("_origin")), "left").filter(F.coalesce("_seq", F.lit(0)) < F.col("was.origin_seq"))
    torn = apart.select("collection_id", "path").distinct().withColumn("_torn", F.lit(True))
    last = rows.groupBy("collection_id", "path").agg(F.max(F.struct("at", *[x for x in names[2:] if x != "at"])).alias("last"), F.max("conflict").alias("conflict"), F.sum("n").alias("items"), (F.min("file_id") != F.max("file_id")).alias("_moved"))
    moved = F.raise_error(F.concat(F.lit("another file id for path "), "path")).cast("boolean")
    found = last.join(torn, ["collection_id", "path"], "left").withColumn("conflict", F.when(F.col("_moved"), moved).otherwise(F.col("conflict") | F.coalesce("_torn", F.lit(False))))
    return found.select("collection_id", "path", "last", "conflict", "items")


def finish_files(parts: DataFrame) -> DataFrame:
    return parts.select("collection_id", "path", "last.file_id", F.when(~F.col("conflict"), F.col("last.content_id")).alias("content_id"), F.when(F.col("conflict"), "conflict").otherwise("resolved").alias("identity_state"), "items")


def input_marker(items: DataFrame, relevant: list[str]) -> DataFrame:
    """One row: how far items are applied, and the last place of a kind that evaluations depend on."""
    return items.agg(F.coalesce(F.max("at"), F.lit(0)).alias("applied_at"), F.coalesce(F.max(F.when(F.col("kind").isin(*relevant), F.col("at"))), F.lit(0)).alias("policy_input_at"))
