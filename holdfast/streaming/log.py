"""Hash-chained logs: checks, batches, item defaults, frontiers, and folds of a stream into versions.

Order is the position (origin_id, origin_seq), never the time, so there are no watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def chain_faults(records: DataFrame) -> DataFrame:
    """records (origin_id, origin_seq, hash, previous_hash) -> those that break the chain, with the fault."""
    # a record is held against the one of the seq before it, so one origin's log is spread over all tasks
    same = W.partitionBy("origin_id", "origin_seq").orderBy("hash")
    rows = records.withColumn("_copy", F.row_number().over(same))
    before = records.groupBy("origin_id", (F.col("origin_seq") + 1).alias("origin_seq")).agg(F.max("hash").alias("_hash"), F.lit(True).alias("_there"))
    first = records.groupBy("origin_id").agg(F.min("origin_seq").alias("_first"))
    rows = rows.join(before, ["origin_id", "origin_seq"], "left").join(first, "origin_id")
    fault = (
        F.when(F.col("_copy") > 1, "rewritten").when(F.col("origin_seq") == F.col("_first"), F.when(F.col("previous_hash").isNotNull(), "first_record_has_previous").when(F.col("origin_seq") != 1, "gap"))
        .when(F.col("_there").isNull(), "gap").when(~F.col("previous_hash").eqNullSafe(F.col("_hash")), "broken_link")
    )
    return rows.select("origin_id", "origin_seq", fault.alias("fault")).filter("fault is not null")


def frontier(records: DataFrame) -> DataFrame:
    """The last record of each origin."""
    return records.groupBy("origin_id").agg(F.max_by(F.struct("origin_seq", "hash"), "origin_seq").alias("x")).select("origin_id", F.col("x.origin_seq").alias("seq"), F.col("x.hash").alias("hash"))


def union_frontiers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Greatest seq of each origin; one seq with two hashes is a conflict."""
    rows = a.unionByName(b)
    tops = rows.groupBy("origin_id").agg(F.max("seq").alias("seq"))
    same = rows.join(tops, ["origin_id", "seq"]).groupBy("origin_id", "seq").agg(F.min("hash").alias("hash"), F.max("hash").alias("_other"))
    return same.select("origin_id", F.when(F.col("hash") != F.col("_other"), F.raise_error(F.concat(F.lit("frontiers disagree on "), "origin_id"))).otherwise(F.col("seq")).cast("long").alias("seq"), "hash")


def since(records: DataFrame, cursor: DataFrame) -> DataFrame:
    """Records behind a cursor (origin_id, seq)."""
    return records.join(cursor.select("origin_id", F.col("seq").alias("_seq")), "origin_id", "left").filter(F.col("origin_seq") > F.coalesce("_seq", F.lit(0))).drop("_seq")


def with_defaults(items: DataFrame, defaults: str = "defaults", item: str = "item") -> DataFrame:
    """Maps of defaults overlaid by the item's own keys. Defaults may not hold `kind`."""
    own = F.col(item)
    rest = F.map_filter(defaults, lambda k, _: ~F.array_contains(F.map_keys(own), k))
    merged = F.map_concat(F.coalesce(rest, F.create_map().cast("map<string,string>")), own)
    return items.withColumn(item, F.when(F.map_contains_key(defaults, "kind"), F.raise_error(F.lit("defaults hold kind"))).otherwise(merged))


def complete_batches(records: DataFrame) -> DataFrame:
    """records (batch_id, type, first_item_index, items, item_count) -> items of batches that are whole: started, consecutive chunks, completed with the right count."""
    chunk = F.col("type") == "batch_chunk"
    own = W.partitionBy("batch_id").orderBy("first_item_index")
    chunks = records.filter(chunk).withColumn("_n", F.size("items"))
    placed = chunks.withColumn("_expected", F.coalesce(F.sum("_n").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sums = placed.groupBy("batch_id").agg(F.sum("_n").alias("n"), F.max((F.col("_expected") != F.col("first_item_index")).cast("int")).alias("gap"))
    ends = records.filter(~chunk).groupBy("batch_id").agg(F.count_if(F.col("type") == "batch_start").alias("starts"), F.max(F.when(F.col("type") == "batch_complete", F.col("item_count"))).alias("declared"))
    whole = ends.join(sums, "batch_id", "left").filter((F.col("starts") == 1) & (F.col("declared") == F.coalesce("n", F.lit(0))) & (F.coalesce("gap", F.lit(0)) == 0)).select("batch_id")
    return chunks.join(whole, "batch_id", "left_semi").select("batch_id", F.posexplode("items").alias("_at", "item"), "first_item_index").select("batch_id", (F.col("first_item_index") + F.col("_at")).alias("item_index"), "item")


def new_requests(applied: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming (operation_key, request) without those applied before; one key with another request is an error."""
    known = applied.select("operation_key", F.col("request").alias("_request"))
    rows = incoming.dropDuplicates(["operation_key", "request"]).join(known, "operation_key", "left")
    clash = F.col("_request").isNotNull() & (F.col("_request") != F.col("request"))
    # inside the filter, so that no plan can drop the rows before they are checked
    fresh = F.when(clash, F.raise_error(F.lit("an operation key was used for another request")).cast("boolean")).otherwise(F.col("_request").isNull())
    return rows.filter(fresh).drop("_request")


def conflicts(observed: DataFrame, frontiers: DataFrame) -> DataFrame:
    """Paths with concurrent observations of different content.

    observed (path, content, origin_id, origin_seq, record_id); frontiers (record_id, origin_id, seq): what a record had seen.
    Records are not paired: each is one row for every other origin of its path, swept in order.
    """
    # only paths with several contents and origins can hold any; the others need no frontier
    several = observed.groupBy("path").agg((F.min("origin_id") < F.max("origin_id")).alias("_o"), F.min(F.struct("content")).alias("_a"), F.max(F.struct("content")).alias("_b")).filter(F.col("_o") & (F.col("_a") != F.col("_b")))
    rows = observed.filter("origin_id is not null and record_id is not null").join(several.select("path"), "path", "left_semi")
    met = rows.select("path", F.col("origin_id").alias("other")).distinct()
    seen = frontiers.select("record_id", F.col("origin_id").alias("other"), F.col("seq").alias("seen"))
    seen = rows.join(met, "path").filter(F.col("origin_id") != F.col("other")).join(seen, ["record_id", "other"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    # of two origins, records a of the first and b of the second are apart if seen(b) < seq(a) and seen(a) < seq(b). In the order of
    # seq(a) and seen(b), a is held against the greatest seq(b) so far, and against the greatest of another content than that one's.
    first = F.col("origin_id") < F.col("other")
    seq, y = F.col("origin_seq"), F.when(~first, F.struct("origin_seq", "content"))
    points = seen.select("path", F.least("origin_id", "other").alias("o1"), F.greatest("origin_id", "other").alias("o2"), F.when(first, seq).otherwise(F.col("seen")).alias("x"), first.alias("a"), F.when(first, F.col("seen")).alias("seen"), "content", y.alias("y"))
    pair = W.partitionBy("path", "o1", "o2").orderBy("x", F.desc("a"), "y")
    so_far = pair.rowsBetween(W.unboundedPreceding, W.currentRow)
    best = points.withColumn("best", F.max("y").over(so_far)).withColumn("before", F.lag("best").over(pair))
    # a record that meets one of another content leaves the lesser of the two behind: the greatest of those is the second best
    lesser = F.when(F.col("y.content").eqNullSafe(F.col("before.content")), None).otherwise(F.least("y", "before"))
    best = best.withColumn("second", F.max(F.when(F.col("y").isNotNull() & F.col("before").isNotNull(), lesser)).over(so_far))
    apart = lambda b: F.coalesce(F.col(f"{b}.origin_seq") > F.col("seen"), F.lit(False)) & ~F.col(f"{b}.content").eqNullSafe(F.col("content"))
    return best.filter(F.col("a") & (apart("best") | apart("second"))).select("path").distinct()


def running_freshness(checks: DataFrame) -> DataFrame:
    """checks (copy_id, seq, time_ms) -> the latest time so far: a clock that goes back does not make evidence older."""
    own = W.partitionBy("copy_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return checks.withColumn("fresh_ms", F.max("time_ms").over(own))
