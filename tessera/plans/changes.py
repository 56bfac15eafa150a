"""Queries of mutations: puts, deletes, versions, multipart uploads, buckets, the write-ahead log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.network import arn
from ..operators import listing, tables, upkeep
from ..sources.tables import objects, parts, table, uploads, versions
from .registry import query


def puts(spark: SparkSession, d: str) -> DataFrame:
    """Writes of objects in five buckets, in order of time."""
    return versions(spark, d).select("bucket", "key", "size", F.col("modified_at").alias("at"), F.col("event_id").alias("id"))


_PUTS = "puts AS (SELECT bucket, key, size, modified_at AS moment, event_id AS id FROM versions)"


@query("put_objects", f"WITH {_PUTS}, every AS (SELECT 'b0' AS bucket, 'click/7/0' AS key, CAST(-1 AS BIGINT) AS size, TIMESTAMP '1970-01-01' AS moment, CAST(-1 AS BIGINT) AS id UNION ALL SELECT 'b0', 'kept', -2, TIMESTAMP '1970-01-01', -2 UNION ALL SELECT * FROM puts) SELECT bucket, count(*) AS object_count, CAST(sum(size) AS BIGINT) AS total_size FROM (SELECT bucket, key, arg_max(size, (moment, id)) AS size FROM every GROUP BY bucket, key) GROUP BY bucket", "versions")
def _put(spark: SparkSession, d: str) -> DataFrame:
    """Objects that were there are written over; counters come from what is there afterwards."""
    there = spark.range(1).select(F.explode(F.array(F.struct(F.lit("b0").alias("bucket"), F.lit("click/7/0").alias("key"), F.lit(-1).cast("long").alias("size")), F.struct(F.lit("b0").alias("bucket"), F.lit("kept").alias("key"), F.lit(-2).cast("long").alias("size")))).alias("o")).select("o.*")
    return tables.counters(tables.put_objects(there, puts(spark, d)))


@query("put_quotas", f"""WITH {_PUTS}, steps AS (SELECT *, lag(size) OVER (PARTITION BY bucket, key ORDER BY moment, id) AS old FROM puts),
run AS (SELECT *, sum(CASE WHEN old IS NULL THEN 1 ELSE 0 END) OVER w AS n, sum(size - coalesce(old, 0)) OVER w AS bytes FROM steps WINDOW w AS (PARTITION BY bucket ORDER BY moment, id ROWS UNBOUNDED PRECEDING)),
bad AS (SELECT bucket, min((moment, id)) AS first FROM run WHERE (bucket = 'b1' AND n > 40) OR (bucket = 'b2' AND bytes > 2000) OR (bucket = 'b3' AND (n > 100000 OR bytes > 1500)) GROUP BY bucket)
SELECT id, bucket, CASE WHEN (moment, id) >= first THEN 'quota' ELSE 'stored' END AS outcome FROM run LEFT JOIN bad USING (bucket)""", "versions")
def _quotas(spark, d):
    quotas = spark.createDataFrame([("b0", 0, None), ("b1", 40, None), ("b2", None, 2000), ("b3", 100000, 1500)], "bucket string, max_objects long, max_bytes long")
    return tables.admit(puts(spark, d), quotas).select("id", "bucket", "outcome")


@query("delete_outcomes", "SELECT event_id, CASE WHEN event_id % 6 = 0 AND ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-31' AND user_id % 2 = 1 THEN 'locked' WHEN user_id % 5 < 2 THEN 'marker' ELSE 'deleted' END AS outcome FROM events")
def _deletes(spark, d):
    e = table(spark, d, "events")
    locked = F.when(F.col("event_id") % 6 == 0, F.col("ts") + F.expr("INTERVAL '10' DAY"))
    outcome = tables.delete_outcome((F.col("user_id") % 5) < 2, F.coalesce(locked, F.lit("1970-01-01").cast("timestamp_ntz")), F.lit("2024-01-31").cast("timestamp_ntz"), F.col("user_id") % 2 == 0)
    return e.select("event_id", outcome.alias("outcome"))


@query("append_versions", "SELECT version_id, row_number() OVER (PARTITION BY bucket, key ORDER BY modified_at DESC, version_id DESC) = 1 AS is_latest FROM versions", "versions")
def _append(spark, d):
    """The second half of the writes is appended to the first."""
    v = versions(spark, d).select("bucket", "key", "version_id", "modified_at", F.lit(False).alias("is_latest"))
    half = F.col("modified_at") < F.lit("2024-01-16").cast("timestamp_ntz")
    return tables.append_versions(v.where(half), v.where(~half)).select("version_id", "is_latest")


def sent_parts(spark: SparkSession, d: str) -> DataFrame:
    """Line items as parts that were sent, some of them several times."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("upload_id"), F.col("l_linenumber").alias("part_number"), F.col("l_quantity").cast("long").alias("size"), F.concat(F.lit("<"), "l_partkey", F.lit(">")).alias("data"), F.col("l_shipdate").alias("at"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("id"))


_PARTS = "sent AS (SELECT l_orderkey AS upload_id, l_linenumber AS part_number, arg_max((CAST(l_quantity AS BIGINT), '<' || l_partkey || '>'), (l_shipdate, l_partkey * 100000 + l_suppkey)) AS p FROM lineitem GROUP BY ALL)"


@query("complete_uploads", f"WITH {_PARTS} SELECT upload_id, bucket, key, CAST(sum(p[1]) AS BIGINT) AS size, string_agg(CAST(part_number AS VARCHAR), ',' ORDER BY part_number) AS parts, string_agg(p[2], '' ORDER BY part_number) AS content FROM uploads JOIN sent USING (upload_id) GROUP BY ALL", "uploads")
def _complete(spark, d):
    made = tables.complete(uploads(spark, d), tables.upsert_parts(sent_parts(spark, d)), data="data")
    return made.withColumn("parts", F.array_join("parts", ","))


@query("complete_requested_parts", f"WITH {_PARTS} SELECT upload_id, CAST(sum(p[1]) AS BIGINT) AS size, count(*) AS parts FROM uploads JOIN sent USING (upload_id) WHERE part_number % 2 = 1 GROUP BY upload_id", "uploads")
def _requested(spark, d):
    """Completion with a list of the odd parts."""
    p = tables.upsert_parts(sent_parts(spark, d))
    made = tables.complete(uploads(spark, d), p, p.where("part_number % 2 = 1"))
    return made.select("upload_id", "size", F.size("parts").cast("long").alias("parts"))


@query("abort_uploads", "SELECT count(*) AS parts, (SELECT count(*) FROM uploads WHERE bucket <> '1-URGENT') AS uploads FROM parts JOIN uploads USING (upload_id) WHERE bucket <> '1-URGENT'", "parts", "uploads")
def _abort(spark, d):
    u, p = uploads(spark, d), parts(spark, d)
    left, rest = tables.abort(u, p.join(u.select("upload_id"), "upload_id", "left_semi"), u.where("bucket = '1-URGENT'"))
    return rest.agg(F.count("*").alias("parts")).crossJoin(left.agg(F.count("*").alias("uploads")))  # one row each


@query("delete_buckets", "SELECT bucket, count(*) AS objects FROM objects WHERE bucket NOT IN ('src1', 'src7') GROUP BY bucket", "objects")
def _delete_buckets(spark, d):
    """Buckets go with their objects."""
    o = objects(spark, d).select("bucket", "key")
    gone = o.where("bucket in ('src1', 'src7')").select("bucket").distinct()
    left, rest = tables.delete_buckets(o.select("bucket").distinct(), o, gone)
    return left.join(rest.groupBy("bucket").agg(F.count("*").alias("objects")), "bucket")


@query("create_buckets", "SELECT 'src' || n_nationkey AS bucket, CASE WHEN 'src' || n_nationkey IN (SELECT source FROM documents) THEN 'exists' ELSE 'created' END AS outcome, CASE WHEN n_regionkey = 0 THEN 'us-east-1' ELSE 'r' || n_regionkey END AS region, CASE WHEN n_nationkey % 2 = 0 THEN 'public-read' ELSE 'private' END AS acl, 'admin' AS owner FROM nation")
def _create_buckets(spark, d):
    n = table(spark, d, "nation")
    made = n.select(tables.new_bucket(F.concat(F.lit("src"), "n_nationkey"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("r"), "n_regionkey")).otherwise(" "), F.when(F.col("n_nationkey") % 2 == 0, "public-read"), F.lit(None).cast("string")).alias("b")).select("b.*")
    _, outcome = tables.create(objects(spark, d).select("bucket").distinct(), made, "bucket")
    return outcome.join(made, "bucket")


@query("wal_checked", "SELECT event_id AS id, CAST(floor((row_number() OVER (PARTITION BY 'b' || (user_id % 5) ORDER BY event_id) - 1) / 100.0) AS BIGINT) AS flush, event_id % 50 <> 0 AS intact FROM events")
def _wal(spark, d):
    """Entries with their CRC and flush; every fiftieth is damaged afterwards."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("b"), F.col("user_id") % 5).alias("bucket"), F.to_json(F.struct("event_type", "value", "ts")).alias("data"))
    damaged = tables.wal(e).withColumn("data", F.when(F.col("id") % 50 == 0, F.concat("data", F.lit("x"))).otherwise(F.col("data")))
    return damaged.select("id", "flush", tables.wal_intact(damaged).alias("intact"))


@query("replication_wal", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'pending' END AS status FROM orders")
def _replication_wal(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("key"), F.col("o_orderpriority").alias("bucket"), F.lit("put").alias("op"), "o_orderstatus")
    return upkeep.replication_wal(o.drop("o_orderstatus"), o.where("o_orderstatus = 'F'")).where("checksum is not null").select("id", "status")


@query("audit_json", "SELECT event_id, event_type AS operation, CAST(user_id AS VARCHAR) AS user_id, 'arn:aws:s3:::b' || (user_id % 5) AS resource FROM events WHERE event_type = 'error'")
def _audit(spark, d):
    """Audit entries as JSON lines, read back."""
    e = table(spark, d, "events").where("event_type = 'error'").select("event_id", F.col("event_type").alias("operation"), F.col("user_id").cast("string").alias("user_id"), arn(F.lit("s3"), F.concat(F.lit("b"), F.col("user_id") % 5)).alias("resource"))
    schema = "struct<event_id: long, operation: string, user_id: string, resource: string>"
    return upkeep.to_json_rows(e).select(F.from_json("value", schema).alias("r")).select("r.*")


@query("listing_xml", "SELECT bucket, count(*) AS n FROM objects GROUP BY bucket", "objects")
def _xml(spark, d):
    """A listing as XML, read back."""
    rows = objects(spark, d).groupBy("bucket").agg(F.count("*").alias("n"))
    return upkeep.to_xml_rows(rows, "Bucket").select(F.from_xml("value", "struct<bucket: string, n: long>", {"rowTag": "Bucket"}).alias("r")).select("r.*")


@query("access_log_files", "SELECT upper(event_type) AS operation, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed FROM events GROUP BY 1")
def _log_files(spark, d):
    """Access-log lines written as text files and read again."""
    from ..sources.shared import shared_folder
    from .listings import requests

    path = shared_folder(spark, "access-log")
    upkeep.write_log(listing.access_log_lines(requests(spark, d)), path)
    rows = listing.parse_access_log(spark.read.text(path))
    return rows.groupBy("operation").agg(F.count("*").alias("n"), F.count_if(F.col("status_code") == 500).alias("failed"))


@query("tiered_blobs", "SELECT storage_tier, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM objects WHERE storage_tier IN (0, 2) GROUP BY storage_tier", "objects")
def _tiered(spark, d):
    """Blobs written by tier; two tiers are read back."""
    from ..sources.shared import shared_folder

    path = shared_folder(spark, "tiers")
    upkeep.write_tiered(objects(spark, d).select("bucket", "key", "size", "content", "storage_tier"), path)
    return spark.read.parquet(path).where("storage_tier in (0, 2)").groupBy("storage_tier").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
