"""Operators that are plain relational plans, as SQL that Spark and DuckDB both take.

`{name}` is a table or adapter; `@word(` is a function whose name differs between the two.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import ADAPTERS, DUCK, table

#: name -> (Spark's, DuckDB's).
DIALECT = {"@rlike(": ("rlike(", "regexp_matches("), "@bytes(": ("binary(", "encode("), "@first(": ("substring(", "array_slice(")}

SQL = {
    # listing and lookups
    "object_lookup": "SELECT bucket, key, size FROM {objects} WHERE bucket = 'src0' AND doc_id = (SELECT min(doc_id) FROM {objects} WHERE bucket = 'src0')",
    "list_buckets": "SELECT bucket, count(*) AS object_count, CAST(sum(size) AS BIGINT) AS total_size FROM {objects} GROUP BY bucket",
    "bucket_lookup": "SELECT DISTINCT bucket FROM {objects} WHERE bucket = 'src5'",
    "head_object": "SELECT bucket, key, size, content_type, storage_tier FROM {objects} WHERE doc_id = 17",
    "object_exists": "SELECT k.key, EXISTS (SELECT 1 FROM {objects} o WHERE o.key = k.key) AS found FROM (VALUES ('en/1'), ('en/999999999')) AS k(key)",
    "expired_uploads": "SELECT o_orderkey AS upload_id FROM {orders} WHERE o_orderdate + INTERVAL '24' HOUR < TIMESTAMP '1998-01-01 00:00:00'",
    "tail_history": "SELECT event_id, user_id, rn FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY access_time DESC, event_id DESC) AS rn FROM {access_events}) t WHERE rn <= 5",
    "readable_search": "SELECT v.id FROM {embeddings_ids} v WHERE EXISTS (SELECT 1 FROM {objects} o WHERE o.doc_id = v.id AND o.bucket IN ('src1', 'src2'))",
    # mutations
    "upsert_latest": "SELECT object_key, event_id, access_type FROM (SELECT object_key, event_id, access_type, row_number() OVER (PARTITION BY object_key ORDER BY access_time DESC, event_id DESC) AS rn FROM {access_events}) t WHERE rn = 1",
    "delete_objects": "SELECT bucket, count(*) AS object_count, greatest(CAST(0 AS BIGINT), CAST(sum(size) AS BIGINT)) AS total_size FROM {objects} o WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = o.doc_id AND l.quality = 0) GROUP BY bucket",
    "running_quota": "SELECT doc_id, bucket, running, running <= 20000 AS within FROM (SELECT doc_id, bucket, CAST(sum(size) OVER (PARTITION BY bucket ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM {objects}) t",
    "tier_migrate": "SELECT storage_tier, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM (SELECT CASE WHEN storage_tier = 0 AND size < 500 THEN 2 ELSE storage_tier END AS storage_tier, size FROM {objects}) t GROUP BY storage_tier",
    "version_latest": "SELECT bucket, max(doc_id) AS latest FROM {objects} GROUP BY bucket",
    "vector_delete": "SELECT e.id FROM {embeddings_ids} e WHERE NOT EXISTS (SELECT 1 FROM {objects} o WHERE o.doc_id = e.id AND o.bucket = 'src0')",
    # aggregates
    "tier_sizes": "SELECT storage_tier, CAST(sum(size) AS BIGINT) AS size FROM {objects} GROUP BY storage_tier",
    "sync_status": "SELECT o_orderpriority AS bucket, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS pending, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS failed FROM {orders} GROUP BY o_orderpriority",
    "cache_hit_rate": "SELECT user_id, CASE WHEN count(*) = 0 THEN 0.0e0 ELSE round(count(CASE WHEN access_type = 'view' THEN 1 END) * 1.0e0 / count(*), 6) END AS hit_rate FROM {access_events} GROUP BY user_id",
    "limiter_counters": "SELECT access_type AS limit_type, count(*) AS n FROM {access_events} GROUP BY access_type",
    "multipart_complete": "SELECT upload_id, CAST(sum(size) AS BIGINT) AS size, count(*) AS parts FROM {parts} GROUP BY upload_id",
    "concurrency_peak": "SELECT user_id, max(open_now) AS peak FROM (SELECT user_id, CAST(sum(d) OVER (PARTITION BY user_id ORDER BY moment, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS open_now FROM (SELECT user_id, access_time AS moment, 1 AS d FROM {access_events} UNION ALL SELECT user_id, access_time + INTERVAL '6' HOUR AS moment, -1 AS d FROM {access_events}) e) t GROUP BY user_id",
    "expired_credentials": "SELECT count(*) AS expired FROM {orders} WHERE o_orderdate < TIMESTAMP '1995-06-01 00:00:00'",
    # contents
    "arn_all": "SELECT concat('arn:aws:s3:::', bucket, '/', key) AS arn, bucket FROM {objects}",
    "list_parts_all": "SELECT upload_id, part_number, size FROM {parts} WHERE part_number > 2",
    "list_parts_text_order_all": "SELECT upload_id, part_number, row_number() OVER (PARTITION BY upload_id ORDER BY CAST(part_number AS VARCHAR(20))) AS place FROM {parts}",
    "auto_index_texts": "SELECT doc_id, md5(@first(@bytes(content), 1, 1048576)) AS text_md5 FROM {objects} WHERE content_type LIKE 'text/%' AND @rlike(content, '[^ \t\n\x0b\f\r]')",
    "score_threshold": "SELECT id, round(value, 6) AS score FROM (SELECT event_id AS id, value / 100.0e0 AS value FROM {events}) t WHERE value >= 0.7e0",
}

EXTRA = {
    "embeddings_ids": ("SELECT vec_id AS id FROM embeddings", lambda spark, d: table(spark, d, "embeddings").selectExpr("vec_id AS id")),
}
_RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations", "pages")


def names_in(body: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", body)))


def spark_query(body: str):
    for k, (own, _) in DIALECT.items():
        body = body.replace(k, own)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {n: ADAPTERS[n](spark, sf_dir) if n in ADAPTERS else EXTRA[n][1](spark, sf_dir) if n in EXTRA else table(spark, sf_dir, n) for n in names_in(body)}
        return spark.sql(body, **frames) if frames else spark.sql(body)

    return run


def duck_query(body: str) -> str:
    for k, (_, own) in DIALECT.items():
        body = body.replace(k, own)
    views = [f"{n} AS ({DUCK[n] if n in DUCK else EXTRA[n][0]})" for n in names_in(body) if n in DUCK or n in EXTRA]
    return (f"WITH {', '.join(views)} " if views else "") + re.sub(r"\{(\w+)\}", r"\1", body)
