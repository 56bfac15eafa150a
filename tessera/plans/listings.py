"""Queries of listings and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import listing
from ..sources.tables import objects, parts, table, uploads, versions
from .registry import query

_VISIBLE = "newest AS (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY modified_at DESC, event_id DESC) AS rn FROM versions), visible AS (SELECT * FROM newest WHERE rn = 1 AND NOT delete_marker)"


@query("visible_objects", f"WITH {_VISIBLE} SELECT bucket, key, version_id, size FROM visible", "versions")
def _visible(spark: SparkSession, d: str) -> DataFrame:
    return listing.visible(versions(spark, d)).select("bucket", "key", "version_id", "size")


@query("list_objects", f"WITH {_VISIBLE} SELECT key, size, version_id FROM visible WHERE bucket = 'b2' AND starts_with(key, 'click/1') ORDER BY key LIMIT 15", "versions")
def _list(spark, d):
    return listing.list_objects(listing.visible(versions(spark, d)), "b2", "click/1", 15).select("key", "size", "version_id")


def _page_sql(bucket: str, prefix: str, delimiter: str, after: str, n: int) -> str:
    """A listing by two separate scans: distinct prefixes and plain keys, then the page's end."""
    at = len(prefix) + 1
    cut = f"strpos(substr(key, {at}), '{delimiter}')" if delimiter else "0"
    return f"""WITH {_VISIBLE}, mine AS (SELECT key, size FROM visible WHERE bucket = '{bucket}' AND substr(key, 1, {at - 1}) = '{prefix}'),
rolled AS (SELECT DISTINCT substr(key, 1, {at - 1} + {cut}) AS entry, 'prefix' AS kind, CAST(NULL AS BIGINT) AS size FROM mine WHERE {cut} > 0),
entries AS (SELECT * FROM rolled UNION ALL SELECT key, 'content', size FROM mine WHERE {cut} = 0),
placed AS (SELECT *, row_number() OVER (ORDER BY entry) AS rn, count(*) OVER () AS n FROM entries WHERE entry > '{after}')
SELECT CAST(rn - 1 AS INTEGER) AS place, entry, kind, coalesce(size, -1) AS size, n > {n} AS truncated, CASE WHEN n > {n} THEN max(entry) OVER () END AS next_token FROM placed WHERE rn <= {n}"""


for _name, _args in {
    "list_delimited": ("b1", "", "/", "", 3),
    "list_delimited_prefix": ("b3", "view/", "/", "view/2", 12),
    "list_v1_marker": ("b4", "error/", "", "error/5", 25),
    "list_v2_last_page": ("b0", "signup/9", "", "signup/99", 1000),
}.items():
    query(_name, _page_sql(*_args), "versions")(lambda spark, d, a=_args: listing.list_page(listing.visible(versions(spark, d)), *a).withColumn("size", F.coalesce("size", F.lit(-1))))


@query("list_versions", "SELECT key, version_id, delete_marker, size FROM versions WHERE bucket = 'b0' AND key LIKE 'view/%' ORDER BY key, version_id LIMIT 40", "versions")
def _list_versions(spark, d):
    return listing.list_versions(versions(spark, d), "b0", "view/", 40).select("key", "version_id", "delete_marker", "size")


@query("get_version", "SELECT bucket, key, version_id, size FROM versions WHERE event_id = 12", "versions")
def _get_version(spark, d):
    v = versions(spark, d)
    wanted = v.where("event_id = 12").select("bucket", "key", "version_id").first()
    return listing.get_version(v, *wanted).select("bucket", "key", "version_id", "size")


@query("list_uploads_page", "WITH live AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY upload_id) AS rn, count(*) OVER (PARTITION BY bucket) AS n FROM uploads WHERE expires_at > TIMESTAMP '1997-06-01 00:00:00') SELECT bucket, upload_id, key, n > 20 AS truncated FROM live WHERE rn <= 20", "uploads")
def _list_uploads(spark, d):
    return listing.list_uploads(uploads(spark, d), F.lit("1997-06-01").cast("timestamp_ntz"), 20).select("bucket", "upload_id", "key", "truncated")


@query("list_parts_pages", "WITH p AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY part_number) AS rn, count(*) OVER (PARTITION BY upload_id) AS n FROM parts WHERE part_number > 1) SELECT upload_id, part_number, size, n > 2 AS truncated, CASE WHEN n > 2 THEN max(part_number) OVER (PARTITION BY upload_id) ELSE 0 END AS next_marker FROM p WHERE rn <= 2", "parts")
def _list_parts(spark, d):
    return listing.list_parts(parts(spark, d), 1, 2).withColumn("next_marker", F.coalesce("next_marker", F.lit(0)))


@query("list_keys_page", "SELECT key, size, (SELECT count(*) FROM objects WHERE bucket = 'src4' AND key LIKE 'en/%') AS total FROM objects WHERE bucket = 'src4' AND key LIKE 'en/%' ORDER BY key LIMIT 10 OFFSET 5", "objects")
def _list_keys(spark, d):
    return listing.list_keys(objects(spark, d), "src4", "en/", 10, 5).select("key", "size", "total")


@query("byte_range_headers", """WITH h(header, a, z) AS (VALUES ('bytes=5-19', 5, 19), ('bytes=10-', 10, -1), ('bytes=-7', -1, 7), ('bytes=20-10', 20, 10), ('bytes=0-999999999', 0, 999999999), ('bytes=-', -1, -1), ('items=1-2', -1, -1)),
r AS (SELECT doc_id, size, header, CASE WHEN a >= 0 THEN a WHEN z >= 0 THEN greatest(0, size - z) END AS s, CASE WHEN a >= 0 AND z >= 0 THEN least(z, size - 1) ELSE size - 1 END AS e FROM objects, h)
SELECT doc_id, header, CASE WHEN s <= e AND s < size THEN s ELSE -1 END AS start, CASE WHEN s <= e AND s < size THEN e - s + 1 ELSE 0 END AS length FROM r""", "objects")
def _range_headers(spark, d):
    headers = F.explode(F.array(*[F.lit(h) for h in ("bytes=5-19", "bytes=10-", "bytes=-7", "bytes=20-10", "bytes=0-999999999", "bytes=-", "items=1-2")]))
    rows = objects(spark, d).select("doc_id", "size", headers.alias("header"))
    r = text.byte_range(F.col("header"), F.col("size"))
    return rows.select("doc_id", "header", F.coalesce(r.start, F.lit(-1)).alias("start"), F.coalesce(r.end - r.start + 1, F.lit(0)).alias("length"))


@query("conditional_reads", """WITH r AS (SELECT doc_id, md5(content) AS etag, doc_id % 6 AS c, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 48 AS INTEGER)) AS modified FROM objects)
SELECT doc_id, CASE c WHEN 0 THEN 304 WHEN 1 THEN 200 WHEN 2 THEN 200 WHEN 3 THEN 412 WHEN 4 THEN CASE WHEN modified <= TIMESTAMP '2024-01-02 00:00:00' THEN 304 ELSE 200 END ELSE 304 END AS status FROM r""", "objects")
def _conditional(spark, d):
    etag, c = F.md5(F.col("content").cast("binary")), F.col("doc_id") % 6
    modified = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("doc_id") % 48).cast("int"))
    none = F.when(c.isin(0, 5), etag).when(c == 1, F.lit("other"))
    match = F.when(c == 2, etag).when(c.isin(3, 5), F.lit("other"))
    since = F.when(c == 4, F.lit("2024-01-02").cast("timestamp_ntz"))
    return objects(spark, d).select("doc_id", listing.conditional_read(etag, modified, none, match, since).alias("status"))


@query("bucket_locations", "SELECT r_name AS region, CASE WHEN r_name = 'us-east-1' THEN '' ELSE r_name END AS location FROM (SELECT r_name FROM region UNION ALL SELECT 'us-east-1')")
def _locations(spark, d):
    regions = table(spark, d, "region").select(F.col("r_name").alias("region"))
    return regions.unionAll(spark.range(1).select(F.lit("us-east-1"))).select("region", listing.location(F.col("region")).alias("location"))


@query("read_attributes", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN strftime(TIMESTAMP '2025-01-01' + to_days(CAST(doc_id % 9 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') END AS retain_until, CASE WHEN doc_id % 2 = 0 THEN md5(content) END AS checksum FROM objects", "objects")
def _attributes(spark, d):
    o = objects(spark, d)
    mode = F.when(F.col("doc_id") % 3 == 0, "ENABLED").otherwise("OFF")
    until = F.lit("2025-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("doc_id") % 9).cast("int"))
    summed = F.when(F.col("doc_id") % 2 == 0, F.md5(F.col("content").cast("binary"))).otherwise("")
    made = o.select("doc_id", listing.retention_headers(mode, until, summed, F.lit("MD5")).alias("h"))
    return made.select("doc_id", F.try_element_at("h", F.lit("retain-until")).alias("retain_until"), F.try_element_at("h", F.lit("checksum-md5")).alias("checksum"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests of an access log; some have no user, keys hold a space."""
    e = table(spark, d, "events")
    return e.select(F.date_trunc("second", "ts").alias("timestamp"), F.concat(F.lit("10.0."), F.col("user_id") % 4, F.lit("."), F.col("user_id") % 200).alias("remote_ip"), F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("u"), "user_id")).alias("user_id"), F.upper("event_type").alias("operation"), F.concat(F.lit("b"), F.col("user_id") % 5).alias("bucket"), F.concat(F.lit("k "), F.get_json_object("props", "$.k")).alias("key"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), F.floor("value").alias("bytes_sent"), F.concat(F.lit("r"), "event_id").alias("request_id"))


@query("access_log_parsed", """SELECT date_trunc('second', ts) AS timestamp, '10.0.' || (user_id % 4) || '.' || (user_id % 200) AS remote_ip, CASE WHEN user_id % 10 <> 0 THEN 'u' || user_id ELSE '' END AS user_id, upper(event_type) AS operation, 'b' || (user_id % 5) AS bucket, 'k ' || json_extract_string(props, '$.k') AS key, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, CAST(floor(value) AS BIGINT) AS bytes_sent, 'r' || event_id AS request_id FROM events""")
def _access_log(spark, d):
    """Lines are written and read back as text fields."""
    return listing.parse_access_log(listing.access_log_lines(requests(spark, d))).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("audit_tail", "SELECT * FROM (SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)")
def _tail(spark, d):
    return listing.tail(table(spark, d, "events"), 100, "ts", "event_id").select("event_id", "user_id", "event_type")


@query("executions_by_object", "SELECT event_id, kind FROM versions WHERE bucket = 'b3' AND key = (SELECT min(key) FROM versions WHERE bucket = 'b3')", "versions")
def _executions(spark, d):
    """Executions of one object; an empty bucket or key doesn't filter."""
    v = versions(spark, d)
    key = v.where("bucket = 'b3'").agg(F.min("key")).first()[0]
    return by_object(v, "b3", key).select("event_id", "kind")


def by_object(rows: DataFrame, bucket: str = "", key: str = "") -> DataFrame:
    for column, value in (("bucket", bucket), ("key", key)):
        if value:
            rows = rows.where(F.col(column) == value)
    return rows
