"""Adapters: the driver's tables as the engine's tables, lazily and without extra columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable

#: The time every query takes as now.
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("bucket"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("key"), F.col("n_chars").alias("size"), F.lit("text/plain").alias("content_type"), F.col("text").alias("content"), (F.col("doc_id") % 4).cast("int").alias("storage_tier"), "doc_id")


def access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("object_key"), "user_id", F.col("event_type").alias("access_type"), F.col("ts").alias("access_time"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("values"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), (F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.col("vec_id") % 30)).alias("created_at"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of uploads; a part that was sent again counts once (the largest)."""
    p = table(spark, sf_dir, "lineitem")
    return p.groupBy(F.col("l_orderkey").alias("upload_id"), F.col("l_linenumber").alias("part_number")).agg(F.max("l_quantity").cast("long").alias("size"))


#: The same adapters for DuckDB, as common table expressions.
DUCK = {
    "objects": "SELECT source AS bucket, lang || '/' || CAST(doc_id AS VARCHAR) AS key, n_chars AS size, 'text/plain' AS content_type, text AS content, CAST(doc_id % 4 AS INTEGER) AS storage_tier, doc_id FROM documents",
    "access_events": "SELECT event_id, json_extract_string(props, '$.k') AS object_key, user_id, event_type AS access_type, ts AS access_time FROM events",
    "vectors": f"SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS \"values\", CAST(label AS VARCHAR) AS label, TIMESTAMP '{AS_OF}' - to_days(CAST(vec_id % 30 AS INTEGER)) AS created_at FROM embeddings",
    "parts": "SELECT l_orderkey AS upload_id, l_linenumber AS part_number, CAST(max(l_quantity) AS BIGINT) AS size FROM lineitem GROUP BY ALL",
}
ADAPTERS = {"objects": objects, "access_events": access_events, "vectors": vectors, "parts": parts}


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes and delete markers of objects in five buckets, one for each event."""
    e = table(spark, sf_dir, "events")
    k, t = F.get_json_object("props", "$.k"), F.col("event_type")
    return e.select("event_id", F.concat(F.lit("b"), F.col("user_id") % 5).alias("bucket"), F.concat_ws("/", t, k, (F.col("user_id") % 3).cast("string")).alias("key"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("version_id"), (F.col("event_id") % 7 == 0).alias("delete_marker"), F.floor("value").alias("size"), F.col("ts").alias("modified_at"), t.alias("kind"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multipart uploads that expire a day after they began."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("upload_id"), F.col("o_orderpriority").alias("bucket"), F.concat(F.lit("c"), F.col("o_custkey")).alias("key"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.expr("INTERVAL '24' HOUR")).alias("expires_at"))


DUCK["versions"] = "SELECT event_id, 'b' || (user_id % 5) AS bucket, event_type || '/' || json_extract_string(props, '$.k') || '/' || (user_id % 3) AS key, md5(CAST(event_id AS VARCHAR)) AS version_id, event_id % 7 = 0 AS delete_marker, CAST(floor(value) AS BIGINT) AS size, ts AS modified_at, event_type AS kind FROM events"
DUCK["uploads"] = "SELECT o_orderkey AS upload_id, o_orderpriority AS bucket, 'c' || o_custkey AS key, o_orderdate AS created_at, o_orderdate + INTERVAL 24 HOUR AS expires_at FROM orders"
ADAPTERS |= {"versions": versions, "uploads": uploads}
