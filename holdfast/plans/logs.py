"""Registered queries over logs, folds and helpers, derived from the driver's events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions import numbers, paths
from holdfast.operators import migrate, scans
from holdfast.plans.registry import _LOG, ORACLES, QUERIES, _log
from holdfast.streaming import log, state


def raw(name: str, sql: str):
    """Register a function of the session and the folder of tables."""
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _id(prefix: str, *parts) -> F.Column:
    return F.concat(F.lit(prefix), *[x for i, p in enumerate(parts) for x in ([F.lit("_")] if i else []) + [p.cast("string")]])


#: Items before this place are folded first, the others are merged into what that gives.
CUT = 400

_ITEMS = """WITH items AS (SELECT event_id AS pos, 'origin_' || (user_id % 4) AS origin_id, 'collection_' || (p % 3 + 1) AS collection_id, 'path_' || p AS path, 'file_' || p AS file_id, 'content_' || p || '_' || (event_id // 400 + CASE WHEN event_id % 211 = 0 THEN 1 ELSE 0 END) AS content_id, 'location_' || (event_id % 5) AS location_id, 'copy_' || p || '_' || (event_id % 5) AS copy_id,
epoch_us(ts) // 1000 - (event_id % 17) * 60000 AS time_ms, CASE event_id % 9 WHEN 0 THEN 'copy_verification_failed' WHEN 1 THEN 'scan_missing_candidate' ELSE 'content_observed' END AS kind, CASE WHEN event_id % 9 = 0 THEN ['hash_mismatch', 'read_error', 'identity_mismatch'][(event_id // 9) % 3 + 1] END AS result FROM (SELECT *, (user_id * 7 + event_id) % 400 AS p FROM events)) """


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    path = (u * 7 + e) % 400
    version = F.floor(e / 400) + F.when(e % 211 == 0, 1).otherwise(0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        e.alias("at"), _id("origin_", u % 4).alias("origin_id"), e.alias("origin_seq"), _id("record_", e).alias("record_id"), _id("collection_", path % 3 + 1).alias("collection_id"), _id("path_", path).alias("path"), _id("file_", path).alias("file_id"),
        _id("content_", path, version).alias("content_id"), _id("location_", e % 5).alias("location_id"), _id("copy_", path, e % 5).alias("copy_id"), (F.unix_millis(F.col("ts").cast("timestamp")) - (e % 17) * 60_000).alias("time_ms"),
        F.when(e % 9 == 0, "copy_verification_failed").when(e % 9 == 1, "scan_missing_candidate").otherwise("content_observed").alias("kind"),
        F.when(e % 9 == 0, F.element_at(F.array(*map(F.lit, state.FAILURES)), (F.floor(e / 9) % 3 + 1).cast("int"))).alias("result"),
    )


def _frontiers(rows: DataFrame) -> DataFrame:
    """Every record has seen its own origin up to itself, and the others up to some items before."""
    each = rows.select("record_id", "at", F.col("origin_id").alias("own"), F.explode(F.array(*[F.lit(f"origin_{i}") for i in range(4)])).alias("origin_id"))
    return each.select("record_id", "origin_id", F.when(F.col("own") == F.col("origin_id"), F.col("at") - 1).otherwise(F.col("at") - F.col("at") % 97 * 20).alias("seq"))


@raw("k50_copies", _ITEMS + """SELECT copy_id, arg_max(file_id, pos) AS file_id, arg_max(location_id, pos) AS location_id, arg_max(content_id, pos) FILTER (kind = 'content_observed') AS content_id,
arg_max(CASE WHEN kind = 'content_observed' THEN 'present' WHEN kind = 'scan_missing_candidate' THEN 'missing' WHEN result = 'hash_mismatch' THEN 'corrupt' ELSE 'unknown' END, pos) AS state, arg_max(time_ms, pos) FILTER (kind <> 'copy_verification_failed' OR result = 'hash_mismatch') AS last_presence_ms,
arg_max(CASE WHEN kind = 'content_observed' THEN 1 WHEN result = 'hash_mismatch' THEN 2 ELSE 0 END, pos) FILTER (kind <> 'scan_missing_candidate') AS integrity_code, nullif(arg_max(coalesce(result, ''), pos) FILTER (kind <> 'scan_missing_candidate'), '') AS error_code, max(time_ms) FILTER (kind = 'content_observed') AS last_success_ms, count(*) AS items FROM items GROUP BY 1""")
def _(spark, sf_dir):
    rows = items(spark, sf_dir)
    first, later = (state.copy_parts(rows.filter(x)) for x in (F.col("at") < CUT, F.col("at") >= CUT))
    return state.finish_copies(state.merge_copies(first.unionByName(later)))


@raw("k50_files", _ITEMS + """, w AS (SELECT *, lag(content_id) OVER p AS c0, lag(origin_id) OVER p AS o0, lag(pos) OVER p AS a0 FROM items WHERE kind = 'content_observed' WINDOW p AS (PARTITION BY collection_id, path ORDER BY pos)),
x AS (SELECT *, coalesce(c0 <> content_id AND CASE WHEN o0 = origin_id THEN pos - 1 ELSE pos - pos % 97 * 20 END < a0, false) AS torn FROM w)
SELECT collection_id, path, arg_max(file_id, pos) AS file_id, CASE WHEN NOT bool_or(torn) THEN arg_max(content_id, pos) END AS content_id, CASE WHEN bool_or(torn) THEN 'conflict' ELSE 'resolved' END AS identity_state, count(*) AS items FROM x GROUP BY 1, 2""")
def _(spark, sf_dir):
    rows = items(spark, sf_dir).filter("kind = 'content_observed'")
    known = _frontiers(rows)
    first = state.file_parts(rows.filter(F.col("at") < CUT), known)
    return state.finish_files(merge_files(first, state.file_parts(rows.filter(F.col("at") >= CUT), known, first)))


def merge_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Parts after a batch, and those of paths that it did not touch; `after` was folded from `before`, so it has all of them."""
    return after.unionByName(before.join(after, ["collection_id", "path"], "left_anti"))


@raw("i04_dispatch", _ITEMS + "SELECT kind, count(*) AS n, count(DISTINCT copy_id) AS copies FROM items GROUP BY 1")
def _(spark, sf_dir):
    tables = state.dispatch(items(spark, sf_dir))
    some = [tables[k] for k in ("content_observed", "copy_verification_failed", "scan_missing_candidate")]
    return some[0].unionByName(some[1]).unionByName(some[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("copy_id").alias("copies"))


@raw("i06_registry_state", "SELECT 'device_' || (user_id % 50) AS device_id, arg_max(CASE WHEN event_id % 10 = 9 THEN 'retired' ELSE 'active' END, event_id) AS status, arg_max('site_' || (event_id % 25), event_id) AS site_id FROM events GROUP BY 1")
def _(spark, sf_dir):
    e = F.col("event_id")
    kind = F.when(e % 10 == 9, "device_retired").when(e % 10 == 8, "device_moved").when(e % 10 == 7, "device_registered").otherwise("device_updated")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(e.alias("at"), kind.alias("kind"), _id("device_", F.col("user_id") % 50).alias("device_id"), _id("site_", e % 25).alias("site_id"))
    return state.registry_state(rows, "device", "device_id", ["site_id"])


@raw("i10_input_marker", "SELECT max(event_id) AS applied_at, max(event_id) FILTER (event_id % 9 = 0) AS policy_input_at FROM events")
def _(spark, sf_dir):
    return state.input_marker(items(spark, sf_dir), ["copy_verification_failed"])


@raw("i02_whole_batches", "SELECT 'batch_' || (event_id // 25) AS batch_id, event_id % 25 AS item_index, event_id::VARCHAR AS item FROM events WHERE (event_id // 25) % 11 <> 0 AND (event_id // 25) % 13 <> 3 AND (event_id // 25) % 7 <> 2 QUALIFY count(*) OVER (PARTITION BY event_id // 25) = 25")
def _(spark, sf_dir):
    e, b = F.col("event_id"), F.floor(F.col("event_id") / 25)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", b.alias("b"), F.floor(e % 25 / 5).alias("chunk"))
    torn = (F.col("b") % 13 == 3) & (F.col("chunk") == 2)
    chunks = rows.groupBy("b", "chunk").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    chunks = chunks.select("b", F.lit("batch_chunk").alias("type"), (F.col("chunk") * 5 + F.when(torn, 1).otherwise(0)).alias("first_item_index"), F.transform("ids", lambda x: x.cast("string")).alias("items"), F.lit(None).cast("long").alias("item_count"))
    none = F.lit(None).cast("array<string>").alias("items")
    batches = rows.select("b").distinct()
    starts = batches.filter(F.col("b") % 11 != 0).select("b", F.lit("batch_start").alias("type"), F.lit(None).cast("long").alias("first_item_index"), none, F.lit(None).cast("long").alias("item_count"))
    ends = batches.select("b", F.lit("batch_complete").alias("type"), F.lit(None).cast("long").alias("first_item_index"), none, F.when(F.col("b") % 7 == 2, 24).otherwise(25).cast("long").alias("item_count"))
    return log.complete_batches(chunks.unionByName(starts).unionByName(ends).withColumn("batch_id", _id("batch_", F.col("b"))).drop("b"))


@raw("i03_defaults", "SELECT event_id, event_type AS a, CASE WHEN event_id % 3 = 0 THEN 'own' ELSE 'default' END AS b, CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR END AS c FROM events")
def _(spark, sf_dir):
    e = F.col("event_id")
    own = F.map_filter(F.create_map(F.lit("b"), F.when(e % 3 == 0, "own"), F.lit("c"), F.when(e % 2 == 0, F.col("user_id").cast("string"))), lambda _, v: v.isNotNull())
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.lit("default")).alias("defaults"), own.alias("item"))
    return log.with_defaults(rows).select("event_id", *[F.try_element_at("item", F.lit(k)).alias(k) for k in "abc"])


@raw("i05_new_requests", "SELECT 'op_' || event_id AS operation_key, 'r_' || user_id AS request FROM events WHERE event_id % 3 <> 0")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", _id("op_", F.col("event_id")).alias("operation_key"), _id("r_", F.col("user_id")).alias("request"))
    incoming = rows.unionByName(rows).select("operation_key", "request")
    return log.new_requests(rows.filter(F.col("event_id") % 3 == 0).select("operation_key", "request"), incoming)


@raw("i07_conflicts", _ITEMS + """, o AS (SELECT * FROM items WHERE kind = 'content_observed'), f AS (SELECT DISTINCT a.collection_id || '/' || a.path AS path FROM o a JOIN o b ON a.collection_id = b.collection_id AND a.path = b.path AND a.pos < b.pos AND a.content_id <> b.content_id AND a.origin_id <> b.origin_id
WHERE b.pos - b.pos % 97 * 20 < a.pos AND a.pos - a.pos % 97 * 20 < b.pos) SELECT path FROM f""")
def _(spark, sf_dir):
    rows = items(spark, sf_dir).filter("kind = 'content_observed'")
    return log.conflicts(rows.select(F.concat_ws("/", "collection_id", "path").alias("path"), F.col("content_id").alias("content"), "origin_id", "origin_seq", "record_id"), _frontiers(rows))


@raw("i01_since_cursor", _LOG + "x AS (SELECT 1) SELECT origin_id, origin_seq, hash FROM chain WHERE origin_seq > CASE origin_id WHEN 'origin_0' THEN 100 WHEN 'origin_2' THEN 20 ELSE 0 END")
def _(spark, sf_dir):
    cursor = spark.createDataFrame([("origin_0", 100), ("origin_2", 20)], "origin_id string, seq long")
    return log.since(_log(spark, sf_dir), cursor).select("origin_id", "origin_seq", "hash")


@raw("g06_union_frontiers", _LOG + "x AS (SELECT 1) SELECT origin_id, max(origin_seq) AS seq, arg_max(hash, origin_seq) AS hash FROM chain GROUP BY 1")
def _(spark, sf_dir):
    rows = _log(spark, sf_dir)
    return log.union_frontiers(log.frontier(rows.filter("origin_seq <= 150")), log.frontier(rows.filter("origin_id <> 'origin_1' or origin_seq < 50").unionByName(rows.filter("origin_id = 'origin_1'"))))


@raw("e10_running_freshness", "SELECT user_id AS copy_id, event_id AS seq, epoch_us(ts) // 1000 - (event_id % 17) * 60000 AS time_ms, max(epoch_us(ts) // 1000 - (event_id % 17) * 60000) OVER (PARTITION BY user_id ORDER BY event_id) AS fresh_ms FROM events")
def _(spark, sf_dir):
    e = F.col("event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("copy_id"), e.alias("seq"), (F.unix_millis(F.col("ts").cast("timestamp")) - (e % 17) * 60_000).alias("time_ms"))
    return log.running_freshness(rows)


@raw("d15_fingerprint", "WITH h AS (SELECT sha256('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS d FROM orders) SELECT count(*) AS rows, " + ", ".join(f"bit_xor(('0x' || substr(d, {1 + 15 * i}, 15))::BIGINT) AS x{i}" for i in range(4)) + " FROM h")
def _(spark, sf_dir):
    return scans.fingerprint(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus"))


@raw("d12_ordered_digest", """WITH h AS (SELECT sha256(length(o_custkey::VARCHAR) || ':' || o_custkey || length(o_orderkey::VARCHAR) || ':' || o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE strlen(o_orderstatus) || ':' || o_orderstatus END) AS d FROM orders),
g AS (SELECT substr(d, 1, 3) AS g, count(*) AS n, sha256(string_agg(d, '' ORDER BY d)) AS h FROM h GROUP BY 1) SELECT sum(n)::BIGINT AS rows, sha256(string_agg(h, '' ORDER BY g)) AS digest FROM g""")
def _(spark, sf_dir):
    return scans.ordered_digest(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus")))


@raw("d14_checked_sums", "SELECT o_orderstatus, sum(o_orderkey * 1000000007)::BIGINT AS exact, least(sum(o_orderkey::HUGEINT * 900000000000000), 9223372036854775807)::BIGINT AS saturated FROM orders GROUP BY 1")
def _(spark, sf_dir):
    key = F.col("o_orderkey").cast("decimal(20,0)")  # the products leave the range of a long before the sums do
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").agg(numbers.checked_sum(key * 1_000_000_007).alias("exact"), numbers.saturating_sum(key * 900_000_000_000_000).alias("saturated"))


@raw("h07_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", numbers.utc_text(F.unix_millis(F.col("ts").cast("timestamp"))).alias("at"))


@raw("b13_json_predicate", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') <> '69'")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").filter(numbers.json_field_differs("props", "$.k", "69")).select("event_id")


@raw("h09_paths", """WITH p AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '/' || o_comment_ WHEN 1 THEN o_comment_ || '//x' WHEN 2 THEN 'a/../' || o_comment_ WHEN 3 THEN '' ELSE o_comment_ END AS path FROM (SELECT o_orderkey, o_orderstatus || '/' || o_orderpriority AS o_comment_ FROM orders))
SELECT o_orderkey, translate(rtrim(to_base64(encode(path)), '='), '+/', '-_') AS text, (length(path) > 0 AND len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..'))) = 0)::INT AS normal, lower(hex(encode(path))) AS hex, printf('%016x', strlen(path)) || lower(hex(encode(path))) AS key,
strlen(path)::INT AS bytes, split_part(path, '/', 1) AS kind, md5(path) AS md5, sha256(path) AS sha256 FROM p""")
def _(spark, sf_dir):
    o, text = F.col("o_orderkey"), F.concat_ws("/", "o_orderstatus", "o_orderpriority")
    path = F.when(o % 6 == 0, F.concat(F.lit("/"), text)).when(o % 6 == 1, F.concat(text, F.lit("//x"))).when(o % 6 == 2, F.concat(F.lit("a/../"), text)).when(o % 6 == 3, "").otherwise(text)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", path.alias("path")).withColumn("domain", F.replace("path", F.lit("/"), F.lit(":")))
    data = F.col("path").cast("binary")
    return rows.select("o_orderkey", paths.base64url(data).alias("text"), paths.is_normal("path").cast("int").alias("normal"), F.lower(F.hex(data)).alias("hex"), F.lower(F.hex(paths.entity_key("path"))).alias("key"), F.octet_length("path").alias("bytes"), paths.domain_parts("domain")[0].alias("kind"), F.md5(data).alias("md5"), F.sha2(data, 256).alias("sha256"))


@raw("k52_last_expectation", """WITH x AS (SELECT 'file_' || (user_id % 60) AS file_id, 'hash_' || (event_id % 3) AS hash, 'origin_' || (user_id % 4) AS origin_id, event_id AS seq, 0 AS item, 'record_' || event_id AS record_id FROM events)
SELECT file_id, arg_max(hash, seq) AS hash, arg_max(origin_id, seq) AS origin_id, max(seq) AS seq, 0 AS item, arg_max(record_id, seq) AS record_id FROM x WHERE hash = 'hash_0' GROUP BY 1""")
def _(spark, sf_dir):
    # every record has seen all before it, so the last one of each file is the one that nothing follows
    e, u = F.col("event_id"), F.col("user_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(_id("file_", u % 60).alias("file_id"), _id("hash_", e % 3).alias("hash"), _id("origin_", u % 4).alias("origin_id"), e.alias("seq"), F.lit(0).alias("item"), _id("record_", e).alias("record_id"))
    seen = rows.select("record_id", F.explode(F.array(*[F.lit(f"origin_{i}") for i in range(4)])).alias("origin_id"), (F.col("seq") - 1).alias("seq"))
    return migrate.last_expectation(rows, rows.select("file_id", F.lit("hash_0").alias("hash")).distinct(), seen)
