"""Queries of scrubbing, replication, schedules, caches, tiering and lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables, tiering, upkeep
from ..sources.shared import shared_folder
from ..sources.tables import AS_OF, access_events, objects, parts, table, uploads, versions
from ..streaming import caches, limiters
from .registry import query


def stored(spark: SparkSession, d: str) -> DataFrame:
    """Objects with a stored checksum: SHA-256 in hex or base64, MD5 in capitals; some wrong, unreadable or missing."""
    o, n = objects(spark, d), F.col("doc_id")
    c = F.col("content").cast("binary")
    sha, md5 = F.sha2(c, 256), F.md5(c)
    sums = F.when(n % 13 == 0, F.sha2(F.lit("x").cast("binary"), 256)).when(n % 11 == 0, "??").when(n % 7 == 0, "").when(n % 3 == 0, F.base64(F.unhex(sha))).when(n % 3 == 1, sha).otherwise(F.upper(md5))
    kind = F.when((n % 13 == 0) | (n % 3 < 2), "sha256").otherwise("MD5")
    return o.select("doc_id", "bucket", "key", "storage_tier", "content", sums.alias("checksum"), kind.alias("checksum_type"))


_RESULT = "CASE WHEN doc_id % 13 = 0 THEN 'corrupt' WHEN doc_id % 11 = 0 THEN 'error' ELSE 'ok' END"


@query("scrub_results", f"SELECT bucket, key, storage_tier, {_RESULT} AS result FROM objects WHERE storage_tier IN (0, 2, 3)", "objects")
def _scrub(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.scrub(stored(spark, d), (0, 2, 3), ("SHA256", "MD5"))


@query("scrub_counters", f"SELECT storage_tier, count(*) AS checked, count(CASE WHEN {_RESULT} = 'corrupt' THEN 1 END) AS corrupt, count(CASE WHEN {_RESULT} = 'error' THEN 1 END) AS errors FROM objects GROUP BY storage_tier", "objects")
def _scrub_counters(spark, d):
    return upkeep.scrub_stats(upkeep.scrub(stored(spark, d), (), ("SHA256", "MD5")))


@query("repair_log", "SELECT bucket, key, CASE WHEN doc_id % 2 = 0 THEN 'repaired' ELSE 'lost' END AS outcome FROM objects WHERE doc_id % 13 = 0", "objects")
def _repairs(spark, d):
    return upkeep.repairs(upkeep.scrub(stored(spark, d), (), ("SHA256", "MD5")), objects(spark, d).where("doc_id % 2 = 0"))


@query("put_digests", "SELECT doc_id, CASE WHEN doc_id % 13 = 0 OR doc_id % 11 = 0 THEN 'BadDigest' ELSE 'ok' END AS outcome FROM documents")
def _digests(spark, d):
    s = stored(spark, d)
    made = upkeep.put_outcome(F.col("content").cast("binary"), F.col("checksum"), F.col("checksum_type"), ("SHA256", "MD5"))
    return s.select("doc_id", F.coalesce(made, F.lit("BadDigest")).alias("outcome"))


@query("checksums_base64", "SELECT doc_id, base64(unhex(sha256(text))) AS sha256, base64(unhex(md5(text))) AS md5 FROM documents")
def _base64(spark, d):
    c = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", upkeep.base64_checksum(c, "SHA256").alias("sha256"), upkeep.base64_checksum(c, "MD5").alias("md5"))


@query("encrypted_round_trip", "SELECT doc_id, true AS same, true AS refused, 12 AS nonce, 16 AS tag FROM documents")
def _encrypted(spark, d):
    """Contents sealed and opened again; another key opens nothing."""
    key, other = (F.unhex(F.sha2(F.lit(k).cast("binary"), 256)) for k in ("k", "other"))
    rows = table(spark, d, "documents").select("doc_id", "text", upkeep.encrypt(F.col("text").cast("binary"), key).alias("s"))
    return rows.select("doc_id", (upkeep.decrypt(F.col("s"), key).cast("string") == F.col("text")).alias("same"), upkeep.decrypt(F.col("s"), other).isNull().alias("refused"), F.octet_length("s.nonce").alias("nonce"), F.octet_length("s.tag").alias("tag"))


@query("replication_jobs", "SELECT 'r' || n_nationkey AS rule, key FROM objects JOIN nation ON bucket = 'src' || (n_nationkey % 20) WHERE n_nationkey % 4 <> 3 AND (n_regionkey > 2 OR starts_with(key, 'en/'))", "objects")
def _jobs(spark, d):
    n = table(spark, d, "nation")
    rules = n.select(F.concat(F.lit("r"), "n_nationkey").alias("rule"), F.concat(F.lit("src"), F.col("n_nationkey") % 20).alias("bucket"), F.when(F.col("n_regionkey") > 2, "").otherwise("en/").alias("prefix"), F.col("n_name").alias("target"), (F.col("n_nationkey") % 4 != 3).alias("enabled"), F.col("n_regionkey").alias("priority"))
    return upkeep.replication_jobs(objects(spark, d), rules).select("rule", "key")


@query("replication_states", "SELECT l_orderkey AS job, count(*) AS attempts, CASE WHEN bool_or(ok) THEN 'completed' WHEN count(*) >= 3 THEN 'failed' ELSE 'pending' END AS status FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) > 40 AS ok FROM lineitem) WHERE l_linenumber <= 3 GROUP BY l_orderkey")
def _states(spark, d):
    attempts = parts(spark, d).select(F.col("upload_id").alias("job"), F.col("part_number").alias("attempt"), (F.col("size") > 40).alias("ok"))
    return upkeep.replication_status(attempts)


_COPIES = "s AS (SELECT bucket, key, arg_max(version_id, (modified_at, version_id)) AS v, max(modified_at) AS m FROM versions WHERE event_id % 2 = 0 GROUP BY ALL), t AS (SELECT bucket, key, arg_max(version_id, (modified_at, version_id)) AS v, max(modified_at) AS m FROM versions WHERE event_id % 2 = 1 GROUP BY ALL)"
for _mode, _wins in {"last-write-wins": "t.v IS NULL OR s.m >= t.m", "source-wins": "s.v IS NOT NULL"}.items():

    @query(f"conflicts_{_mode.replace('-', '_')}", f"WITH {_COPIES} SELECT coalesce(s.bucket, t.bucket) AS bucket, coalesce(s.key, t.key) AS key, CASE WHEN coalesce({_wins}, false) THEN s.v ELSE t.v END AS version, CASE WHEN coalesce({_wins}, false) THEN 'source' ELSE 'target' END AS origin FROM s FULL JOIN t ON s.bucket = t.bucket AND s.key = t.key", "versions")
    def _conflicts(spark, d, mode=_mode):
        copy = lambda half: versions(spark, d).where(F.col("event_id") % 2 == half).groupBy("bucket", "key").agg(F.max(F.struct("modified_at", "version_id")).alias("m")).select("bucket", "key", F.col("m.version_id").alias("version"), "m.modified_at")
        return upkeep.resolve(copy(0), copy(1), mode)


@query("replication_lag", "SELECT o_orderpriority AS bucket, CAST(epoch_ms(TIMESTAMP '1999-01-01') - epoch_ms(min(o_orderdate)) AS BIGINT) AS lag_ms FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def _lag(spark, d):
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("bucket"), F.col("o_orderdate").alias("created_at"))
    return upkeep.lag_ms(pending, F.lit("1999-01-01").cast("timestamp_ntz"))


@query("task_statuses", """WITH r AS (SELECT l_suppkey AS task, l_orderkey * 10 + l_linenumber AS id, l_shipdate AS moment, l_quantity AS duration, l_returnflag <> 'R' AS ok, l_linenumber AS retries, l_partkey,
row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC, l_partkey DESC) AS rn FROM lineitem)
SELECT s_suppkey AS task, s_suppkey % 3 <> 0 AS enabled, count(id) AS runs, count(CASE WHEN ok THEN 1 END) AS successes, round(coalesce(avg(duration), 0), 6) AS avg_duration, coalesce(max(retries), 0) AS max_retries, round(coalesce(count(CASE WHEN ok THEN 1 END) * 1.0 / nullif(count(id), 0), 0), 6) AS success_rate, max(moment) AS last_run FROM supplier LEFT JOIN (SELECT * FROM r WHERE rn <= 100) ON task = s_suppkey AND s_suppkey % 4 <> 1 GROUP BY s_suppkey""")
def _statuses(spark, d):
    """Suppliers as tasks, their line items as results; a quarter of the tasks never ran."""
    line = table(spark, d, "lineitem").where("l_suppkey % 4 <> 1")
    results = line.select(F.col("l_suppkey").alias("task"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("id"), F.col("l_shipdate").alias("started_at"), F.col("l_quantity").alias("duration"), (F.col("l_returnflag") != "R").alias("success"), F.col("l_linenumber").alias("retries"))
    tasks = table(spark, d, "supplier").select(F.col("s_suppkey").alias("task"), (F.col("s_suppkey") % 3 != 0).alias("enabled"))
    made = upkeep.task_status(results, tasks)
    return made.select("task", "enabled", "runs", "successes", F.round("avg_duration", 6).alias("avg_duration"), "max_retries", F.round("success_rate", 6).alias("success_rate"), "last_run")


@query("retry_delays", "SELECT upload_id, part_number AS attempt, CAST(least(60 * pow(2.0, part_number), 600) AS DOUBLE) AS delay FROM parts", "parts")
def _delays(spark, d):
    """Parts as attempts of the tiering task's schedule."""
    policy = upkeep.schedules(spark).where("task = 'tiering_decision'").select("first_delay", "longest_delay", "multiplier")
    rows = parts(spark, d).crossJoin(F.broadcast(policy))  # one row
    return rows.select("upload_id", F.col("part_number").alias("attempt"), upkeep.backoff(F.col("part_number"), F.col("first_delay"), F.col("longest_delay"), F.col("multiplier")).alias("delay"))


@query("backups_kept", f"SELECT event_id FROM events WHERE floor(date_diff('second', ts, TIMESTAMP '{AS_OF}') / 86400.0) <= 14")
def _backups(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("ts").alias("created_at"))
    return upkeep.backups_to_keep(rows, F.lit(AS_OF).cast("timestamp_ntz"), (1, 7, 14)).select("event_id")


@query("lifecycle_actions", f"""WITH v AS (SELECT bucket, key, min(modified_at) AS created_at, CAST(min(event_id) % 4 AS INTEGER) AS tier FROM versions GROUP BY ALL),
a AS (SELECT *, floor(date_diff('second', created_at, TIMESTAMP '{AS_OF}') / 86400.0) AS age FROM v),
x AS (SELECT *, (bucket = 'b1' AND age >= 28) OR (bucket = 'b2' AND starts_with(key, 'error/') AND age >= 5) AS expire, greatest(CASE WHEN bucket = 'b1' AND starts_with(key, 'view/') AND age >= 10 AND tier < 2 THEN 2 ELSE -1 END, CASE WHEN bucket = 'b2' AND age >= 20 AND tier < 3 THEN 3 ELSE -1 END) AS target FROM a)
SELECT bucket, key, CASE WHEN expire THEN 'expire' ELSE 'transition' END AS action, CASE WHEN expire THEN -1 ELSE target END AS target_tier FROM x WHERE expire OR target >= 0""", "versions")
def _lifecycle(spark, d):
    o = versions(spark, d).groupBy("bucket", "key").agg(F.min("modified_at").alias("created_at"), (F.min("event_id") % 4).cast("int").alias("storage_tier"))
    rules = spark.createDataFrame([("b1", "", 28, None, None), ("b1", "view/", None, 10, 2), ("b2", "error/", 5, None, None), ("b2", "", None, 20, 3)], "bucket string, prefix string, expire_days int, transition_days int, transition_tier int")
    return upkeep.lifecycle(o, rules, F.lit(AS_OF).cast("timestamp_ntz")).withColumn("target_tier", F.coalesce("target_tier", F.lit(-1)))


_DECAY = f"exp(-ln(2.0) * epoch(TIMESTAMP '{AS_OF}' - access_time) / (7 * 86400))"
_FREQ = f"freq AS (SELECT object_key, least(100.0, sum({_DECAY}) / 10) AS frequency, max(access_time) AS last_access FROM (SELECT *, row_number() OVER (PARTITION BY object_key ORDER BY access_time DESC, event_id DESC) AS rn FROM access_events) WHERE rn <= 1000 GROUP BY object_key)"
_HOURS = f"epoch(TIMESTAMP '{AS_OF}' - last_access) / 3600"
_SCORED = f"{_FREQ}, scored AS (SELECT bucket, CAST(doc_id AS VARCHAR) AS key, doc_id, storage_tier AS tier, last_access, round(greatest(0.0, least(100.0, 0.4 * frequency + 0.3 * CASE WHEN {_HOURS} < 1 THEN 100.0 WHEN {_HOURS} < 24 THEN 80.0 WHEN {_HOURS} < 168 THEN 50.0 WHEN {_HOURS} < 720 THEN 20.0 ELSE 0.0 END + 0.1 * 70.0 - 0.1 * 80.0 + 0.1 * CASE WHEN doc_id % 5 = 0 THEN 50 ELSE 0 END)), 6) AS score FROM objects JOIN freq ON CAST(doc_id AS VARCHAR) = object_key WHERE doc_id % 6 <> 0), decided AS (SELECT *, CASE WHEN score > 80 THEN 0 WHEN score > 60 THEN 1 WHEN score > 20 THEN 2 ELSE 3 END AS target FROM scored)"


def _keyed(spark, d) -> DataFrame:
    return objects(spark, d).withColumn("key", F.col("doc_id").cast("string"))


def _pins(spark, d) -> DataFrame:
    """Priorities of every fifth object; every sixth is pinned."""
    n = F.col("doc_id")
    held = _keyed(spark, d).select("key", F.when(n % 5 == 0, 50).alias("priority"), F.lit(False).alias("fixed_tier"), "doc_id")
    return tiering.pin(held.drop("doc_id"), held.where(n % 6 == 0).select("key", F.lit(True).alias("fixed_tier")))


def _decided(spark, d) -> DataFrame:
    return tiering.scores(_keyed(spark, d), access_events(spark, d), AS_OF, _pins(spark, d))


@query("tier_reasons", f"WITH {_SCORED} SELECT key, score, 'hotness score ' || printf('%.2f', score) || ': ' || ['HOT', 'WARM', 'COLD', 'ARCHIVE'][tier + 1] || ' to ' || ['HOT', 'WARM', 'COLD', 'ARCHIVE'][target + 1] AS reason FROM decided WHERE tier <> target", "objects", "access_events")
def _reasons(spark, d):
    made = _decided(spark, d).where("current_tier <> target_tier")
    return made.select("key", "score", tiering.reason(F.col("score"), F.col("current_tier"), F.col("target_tier")).alias("reason"))


@query("tier_latest", f"WITH {_SCORED} SELECT key, target AS target_tier FROM decided ORDER BY last_access DESC, key LIMIT 25", "objects", "access_events")
def _latest(spark, d):
    return tiering.latest_first(_decided(spark, d), 25).select("key", "target_tier")


@query("tier_migration", f"WITH {_SCORED} SELECT coalesce(target, storage_tier) AS storage_tier, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM objects o LEFT JOIN decided ON decided.key = CAST(o.doc_id AS VARCHAR) GROUP BY 1", "objects", "access_events")
def _migration(spark, d):
    """Decisions carried out, and the tiers' sizes afterwards."""
    o = _keyed(spark, d).select("bucket", "key", "size", "storage_tier")
    moved = tables.migrate(o, _decided(spark, d).where("current_tier <> target_tier"))
    return moved.groupBy("storage_tier").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query("tier_names", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 3 ELSE 2 END AS tier FROM customer")
def _tier_names(spark, d):
    name = F.when(F.col("c_mktsegment") == "BUILDING", "hot").when(F.col("c_mktsegment") == "MACHINERY", "ARCHIVE").otherwise("frozen")
    return table(spark, d, "customer").select("c_custkey", tiering.number_of(name).alias("tier"))


@query("prefetch_prefixes", "SELECT DISTINCT bucket || '/' || split_part(key, '/', 1) || '/' AS prefix FROM versions GROUP BY bucket, key HAVING count(*) > 2", "versions")
def _prefetch(spark, d):
    hot = versions(spark, d).groupBy("bucket", F.col("key").alias("object_key")).count().where("count > 2")
    return upkeep.prefetch(hot)


def trace(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests to ten caches: purchases write, errors delete, all else reads."""
    op = F.when(F.col("event_type") == "purchase", "put").when(F.col("event_type") == "error", "delete").otherwise("get")
    return table(spark, d, "events").select((F.col("user_id") % 10).cast("string").alias("key"), "ts", F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("item"), F.floor("value").alias("size"), op.alias("op"))


@query("cache_lru")
def _lru(spark, d):
    return caches.hit_rate(caches.replay(trace(spark, d), lambda: caches.LruCache(1500, 86400 * 5)))


@query("cache_oldest")
def _oldest(spark, d):
    return caches.hit_rate(caches.replay(trace(spark, d), lambda: caches.OldestCache(20, 86400 * 5)))


_READS = "t AS (SELECT user_id % 10 AS c, json_extract_string(props, '$.k') AS item, ts, event_id, event_type FROM events)"


@query("cache_ttl", f"""WITH RECURSIVE {_READS}, n AS (SELECT *, row_number() OVER (PARTITION BY c, item ORDER BY ts, event_id) AS rn FROM t),
f AS (SELECT c, item, rn, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS made, false AS hit, event_type NOT IN ('error', 'purchase') AS miss FROM n WHERE rn = 1
 UNION ALL SELECT n.c, n.item, n.rn, n.event_type, CASE WHEN n.event_type = 'error' THEN NULL WHEN n.event_type <> 'purchase' AND f.made IS NOT NULL AND epoch(n.ts - f.made) <= 432000 THEN f.made ELSE n.ts END, n.event_type NOT IN ('error', 'purchase') AND f.made IS NOT NULL AND epoch(n.ts - f.made) <= 432000, n.event_type NOT IN ('error', 'purchase') AND NOT (f.made IS NOT NULL AND epoch(n.ts - f.made) <= 432000) FROM f JOIN n ON n.c = f.c AND n.item = f.item AND n.rn = f.rn + 1)
SELECT CAST(c AS VARCHAR) AS key, count(CASE WHEN hit THEN 1 END) AS hits, count(CASE WHEN miss THEN 1 END) AS misses, round(count(CASE WHEN hit THEN 1 END) * 1.0 / count(CASE WHEN hit OR miss THEN 1 END), 6) AS hit_rate FROM f GROUP BY c""")
def _ttl(spark, d):
    return caches.hit_rate(caches.replay(trace(spark, d), lambda: caches.TtlCache(86400 * 5))).withColumn("hit_rate", F.round("hit_rate", 6))


@query("limit_adaptive")
def _adaptive(spark, d):
    t = trace(spark, d).withColumn("op", F.when(F.col("op") == "delete", "fail").otherwise("ok"))
    return caches.replay(t, lambda: caches.Adaptive(2e-5, 3, lambda: limiters.Breaker(3, 0.3, 86400, 2)))


_PEAK = "WITH e AS (SELECT user_id, ts AS moment, 1 AS d FROM events UNION ALL SELECT user_id, ts + INTERVAL 6 HOUR, -1 FROM events), r AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY moment, d ROWS UNBOUNDED PRECEDING) AS n FROM e)"


@query("concurrency_refused", f"{_PEAK} SELECT user_id, CAST(greatest(0, max(n) - 2) AS BIGINT) AS waiting FROM r GROUP BY user_id")
def _concurrency(spark, d):
    """How many of a user's requests (of six hours each) stand beyond two at once, at most."""
    from ..streaming.concurrency import peak

    rows = table(spark, d, "events").select("user_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL '6' HOUR")).alias("end"))
    return peak(rows, "user_id").select("user_id", F.greatest(F.lit(0), F.col("peak") - 2).alias("waiting"))




@query("store_stats", "SELECT (SELECT count(*) FROM objects) AS objects, (SELECT count(DISTINCT bucket) FROM objects) AS buckets, (SELECT CAST(sum(size) AS BIGINT) FROM objects) AS total_size, (SELECT count(*) FROM orders) AS uploads, (SELECT CAST(sum(f) AS BIGINT) FROM (SELECT ceil(count(*) / 100.0) AS f FROM events GROUP BY user_id % 5)) AS flushes", "objects")
def _store(spark, d):
    log = tables.wal(table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("bucket"), F.col("props").alias("data")))
    return upkeep.store_stats(objects(spark, d), uploads(spark, d), log)


@query("keys_by_bucket", "SELECT count(*) AS total, (SELECT string_agg(bucket || '=' || n, ',' ORDER BY bucket) FROM (SELECT bucket, count(*) AS n FROM objects GROUP BY bucket)) AS by_bucket FROM objects", "objects")
def _keys(spark, d):
    made = upkeep.keys_by_bucket(objects(spark, d))
    return made.select("total", F.array_join(F.transform(F.map_entries("by_bucket"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("by_bucket"))


@query("replication_totals", "SELECT count(*) AS total, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS completed, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS failed, count(CASE WHEN o_orderstatus NOT IN ('F', 'P') THEN 1 END) AS pending, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE 0 END) AS BIGINT) AS bytes FROM orders")
def _totals(spark, d):
    s = F.col("o_orderstatus")
    return upkeep.replication_totals(table(spark, d, "orders").select(F.when(s == "F", "completed").when(s == "P", "failed").otherwise("pending").alias("status"), F.col("o_orderkey").alias("size")))


@query("delete_blobs", "SELECT storage_tier, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM objects WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY storage_tier", "objects")
def _blobs(spark, d):
    o = objects(spark, d)
    return upkeep.delete_blobs(o, o.join(table(spark, d, "labels").where("quality = 0"), "doc_id", "left_semi"))


@query("query_latencies", "SELECT event_type AS \"index\", count(*) AS queries, round(avg(value), 6) AS avg_latency_ms FROM events GROUP BY event_type")
def _latencies(spark, d):
    made = upkeep.query_stats(table(spark, d, "events").select(F.col("event_type").alias("index"), F.col("value").alias("latency_ms")))
    return made.withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


@query("credential_of_key", "SELECT 'AK' || o_orderkey AS access_key, 'c' || o_custkey AS principal FROM orders WHERE o_orderkey IN (7, 8, 9) AND o_orderdate >= TIMESTAMP '1995-01-01'")
def _credential(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("AK"), "o_orderkey").alias("access_key"), F.concat(F.lit("c"), "o_custkey").alias("principal"), F.col("o_orderdate").alias("expires_at"))
    now = F.lit("1995-01-01").cast("timestamp_ntz")
    found = [upkeep.credential(o, f"AK{i}", now) for i in (7, 8, 9)]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("access_key", "principal")


@query("backup_restored", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _restored(spark, d):
    """Two tables written as a backup and read back."""
    path = shared_folder(spark, "backup")
    upkeep.snapshot({n: table(spark, d, n) for n in ("nation", "region")}, path)
    held = upkeep.restore(spark, path, ("nation", "region"))
    return held["nation"].join(held["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("schedule_switches", "SELECT c_custkey, c_mktsegment AS task, c_mktsegment <> 'BUILDING' AS enabled FROM customer")
def _switches(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("task"), F.lit(True).alias("enabled"))
    return upkeep.set_enabled(rows, ("BUILDING",), False)
