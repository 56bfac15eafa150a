"""Queries of content pipelines and predicates."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import pipelines as P
from ..sources.tables import objects, table
from .registry import query

#: The content type that an object gets by its number, for pipelines of several kinds.
_KINDS = ("image/jpeg", "video/mp4", "text/plain", "application/pdf", "application/json", "audio/mpeg", "image/webp")


def uploads(spark: SparkSession, d: str) -> DataFrame:
    """Documents as uploads of several types, with metadata; every tenth content holds a card number."""
    o, n = objects(spark, d), F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (n % 7 + 1).cast("int"))
    card = F.when(n % 10 == 0, F.concat("content", F.lit(" card 4111 1111 1111 1234 end"))).otherwise(F.col("content"))
    return o.select("doc_id", F.concat(F.lit("in/"), "key").alias("key"), "bucket", card.alias("content"), "size", kind.alias("content_type"), F.create_map(F.lit("brand"), F.when(n % 3 == 0, "and").otherwise("other"), F.lit("author"), "bucket").alias("metadata"))


_KIND_SQL = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "][CAST(doc_id % 7 + 1 AS INTEGER)]"
_UPLOADS = f"ups AS (SELECT doc_id, 'in/' || lang || '/' || doc_id AS key, source AS bucket, n_chars AS size, {_KIND_SQL} AS kind, text || CASE WHEN doc_id % 10 = 0 THEN ' card 4111 1111 1111 1234 end' ELSE '' END AS content FROM documents)"

#: Filter, and the condition it stands for.
FILTERS = {
    "content-type matches image": "kind LIKE '%image%'",
    "content-type matches 'image/*' and size < 2KB": "kind LIKE 'image/%' AND size < 2048",
    "content-type matches 'text/*' or content-type matches 'application/json'": "kind LIKE 'text/%' OR kind = 'application/json'",
    "metadata.brand == 'and'": "doc_id % 3 = 0",
    "metadata.missing == 'x' or size >= 3000": "size >= 3000",
    "(size > 1KB or metadata.brand = and) and content-type != 'video/mp4'": "(size > 1024 OR doc_id % 3 = 0) AND kind <> 'video/mp4'",
    "": "true",
}


@query("pipeline_filters", f"WITH {_UPLOADS} " + " UNION ALL ".join(f"SELECT {i} AS filter, doc_id FROM ups WHERE {c}" for i, c in enumerate(FILTERS.values())))
def _filters(spark: SparkSession, d: str) -> DataFrame:
    made = F.array(*[F.when(P.condition(f), F.lit(i)) for i, f in enumerate(FILTERS)])
    return uploads(spark, d).select(F.explode(F.array_compact(made)).alias("filter"), "doc_id")


#: The configuration that the queries run.
CONFIG = json.dumps({"pipelines": [
    {"name": "image-pipeline", "trigger": "on_upload", "filter": "content-type matches image", "priority": 5, "steps": [{"name": "compress", "plugin": "image_compress"}, {"name": "extract", "plugin": "metadata_extract"}]},
    {"name": "video-pipeline", "trigger": "on_upload", "filter": "content-type matches video", "steps": [{"name": "thumb", "plugin": "video_thumbnail"}]},
    {"name": "redact", "trigger": "on_upload", "filter": "", "priority": 20, "steps": [{"name": "mask", "plugin": "encrypt_pii", "output": "{key}.redacted", "inline": False}, {"name": "resize", "plugin": "image_resize", "on_error": "skip"}, {"name": "mark", "plugin": "image_watermark"}, {"name": "pdf", "plugin": "pdf_to_text", "on_error": "fail"}, {"name": "extract", "plugin": "metadata_extract"}]},
    {"name": "off", "trigger": "on_upload", "enabled": False},
    {"name": "on-read", "trigger": "on_get", "filter": "content-type matches image"},
]})


@query("pipeline_matches", f"WITH {_UPLOADS} SELECT doc_id, 'redact' AS pipeline, 0 AS place FROM ups UNION ALL SELECT doc_id, 'image-pipeline', 1 FROM ups WHERE starts_with(kind, 'image/') UNION ALL SELECT doc_id, 'video-pipeline', 2 FROM ups WHERE kind = 'video/mp4'")
def _matches(spark, d):
    return P.match(uploads(spark, d), P.load(CONFIG), "on_upload").select("doc_id", "pipeline", "place")


_MASKED = r"regexp_replace(content, '\b([0-9]{2})[0-9]{2}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{2}([0-9]{2})\b', '\1***\2', 'g')"


@query("pipeline_runs", f"WITH {_UPLOADS}, f AS (SELECT *, regexp_matches(content, '\\b[0-9]{{4}}[-\\t\\n\\f\\r ]?[0-9]{{4}}[-\\t\\n\\f\\r ]?[0-9]{{4}}[-\\t\\n\\f\\r ]?[0-9]{{4}}\\b|\\b1[3-9][0-9]{{9}}\\b|\\b[0-9]{{15}}\\b|\\b[0-9]{{18}}\\b') AS dirty FROM ups) SELECT key, bucket, CASE WHEN kind = 'application/pdf' THEN 'completed' ELSE 'failed' END AS status, CASE WHEN kind = 'application/pdf' THEN 'completed,skipped,failed,completed,completed' WHEN starts_with(kind, 'image/') THEN 'completed,completed,failed,failed' ELSE 'completed,skipped,failed,failed' END AS steps, CASE WHEN kind = 'application/pdf' THEN 'extracted_from=pdf;pdf_converted=true;pii_redacted=true' WHEN starts_with(kind, 'image/') THEN 'pii_redacted=true;resized=true' ELSE 'pii_redacted=true' END AS metadata, CASE WHEN dirty THEN key || '.redacted' || CASE kind WHEN 'image/jpeg' THEN '.jpg' WHEN 'video/mp4' THEN '.mp4' WHEN 'text/plain' THEN '.txt' WHEN 'application/pdf' THEN '.pdf' WHEN 'application/json' THEN '.json' WHEN 'audio/mpeg' THEN '.mp3' ELSE '.webp' END ELSE '' END AS outputs FROM f")
def _runs(spark, d):
    made = P.execute(uploads(spark, d), next(p for p in P.load(CONFIG) if p.name == "redact"))
    pairs = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e.key, F.lit("="), e.value)))
    return made.select("key", "bucket", "status", F.array_join(F.transform("steps", lambda s: s.status), ",").alias("steps"), F.array_join(pairs, ";").alias("metadata"), F.array_join(F.transform("outputs", lambda o: o.key), ",").alias("outputs"))


@query("pipeline_metadata", f"WITH {_UPLOADS} SELECT key, CASE WHEN starts_with(kind, 'image/') THEN 'webp' ELSE '' END AS compression, CASE WHEN starts_with(kind, 'image/') THEN 'image' WHEN kind = 'video/mp4' THEN 'video' WHEN kind = 'audio/mpeg' THEN 'audio' WHEN kind = 'application/pdf' THEN 'pdf' ELSE '' END AS extracted FROM ups")
def _metadata(spark, d):
    made = P.execute(uploads(spark, d), next(p for p in P.load(CONFIG) if p.name == "image-pipeline"))
    get = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    return made.select("key", get("compression").alias("compression"), get("extracted_from").alias("extracted"))


@query("pipeline_vector_index", f"WITH {_UPLOADS} SELECT key, 'true' AS indexed, kind FROM ups WHERE kind IN ('text/plain', 'application/json')")
def _custom(spark, d):
    """A plugin of one's own, registered beside the others."""
    p = P.Pipeline("index", steps=[P.Step("index", "vector_index")])
    rows = P.indexable(uploads(spark, d)).select("key", "bucket", "content", "size", "content_type", "metadata")
    made = P.execute(rows, p, P.register("vector_index", P.vector_index))
    return made.select("key", F.col("metadata")["vector_indexed"].alias("indexed")).join(rows.select("key", F.col("metadata")["content_type"].alias("kind")), "key")


@query("output_paths", f"WITH {_UPLOADS} SELECT key, 'out/' || key || '-' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) || CASE kind WHEN 'image/jpeg' THEN '.jpg' WHEN 'video/mp4' THEN '.mp4' WHEN 'text/plain' THEN '.txt' WHEN 'application/pdf' THEN '.pdf' WHEN 'application/json' THEN '.json' WHEN 'audio/mpeg' THEN '.mp3' ELSE '.webp' END AS path FROM ups")
def _paths(spark, d):
    return uploads(spark, d).select("key", P.output_path("out/{key}-{uuid}", F.col("key"), F.col("content_type"), F.col("doc_id")).alias("path"))


@query("search_filter_strings", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'label=' || doc_id || ';source=' || source ELSE 'source=z' END AS filters FROM documents")
def _filter_strings(spark, d):
    n = F.col("doc_id")
    sent = F.when(n % 2 == 0, F.concat(F.lit("source=a&bad&source="), "source", F.lit("&x=y=z&label="), n)).otherwise(F.lit("source=z&=&&nothing"))
    made = table(spark, d, "documents").select("doc_id", text.parse_filter(sent).alias("m"))
    return made.select("doc_id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e.key, F.lit("="), e.value))), ";").alias("filters"))


@query("textual_types", f"WITH {_UPLOADS} SELECT doc_id, kind IN ('text/plain', 'application/json') AS textual, kind IN ('image/jpeg', 'image/webp', 'application/pdf') AS allowed FROM ups")
def _textual(spark, d):
    kind = F.col("content_type")
    return uploads(spark, d).select("doc_id", text.is_text(kind).alias("textual"), text.upload_allowed(kind, ("image/", "application/pdf")).alias("allowed"))


#: Parts that are put in front of keys, and whether the key is then valid.
KEYS = (("a/b", True), ("..", False), ("a/../", False), ("a..b/", True), ("%2e%2E/", False), ("x%2e./", False), ("x\t", False), ("x\x7f", True), ("é☃", True), ("y" * 1025, False))


@query("valid_keys", "SELECT doc_id, [" + ", ".join(str(v).lower() for _, v in KEYS) + f"][CAST(doc_id % {len(KEYS)} + 1 AS INTEGER)] AS valid FROM documents")
def _keys(spark, d):
    head = F.element_at(F.array(*[F.lit(k) for k, _ in KEYS]), (F.col("doc_id") % len(KEYS) + 1).cast("int"))
    sep = F.when(F.col("doc_id") % len(KEYS) == 1, F.lit("/")).otherwise(F.lit(""))
    return table(spark, d, "documents").select("doc_id", text.valid_key(F.concat(head, sep, F.col("lang"))).alias("valid"))


@query("key_texts", "SELECT doc_id, source || '/' || lang || '/' AS directory, CASE WHEN length(text) > 20 THEN substr(text, 1, 20) || '...' ELSE text END AS head, 'author' AS name FROM documents")
def _texts(spark, d):
    key = F.concat_ws("/", "source", "lang", "doc_id")
    return table(spark, d, "documents").select("doc_id", text.directory(key).alias("directory"), text.shorten(F.col("text"), 20).alias("head"), text.strip_prefix(F.lit("X-Amz-Meta-author"), "x-amz-meta-").alias("name"))


@query("image_bounds", "WITH i AS (SELECT p_partkey, p_size * 137 AS w, CAST(floor(p_retailprice * 5) AS BIGINT) AS h FROM part) SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'unsupported type' WHEN w * h > 25000000 THEN 'too many pixels' ELSE '' END AS error FROM i")
def _bounds(spark, d):
    i = images(spark, d)
    kind = F.when(F.col("p_partkey") % 4 == 3, "image/svg+xml").otherwise("image/png")
    return i.select("p_partkey", F.coalesce(P.image_error(kind, F.lit(1000), F.col("width"), F.col("height")), F.lit("")).alias("error"))


def images(spark: SparkSession, d: str) -> DataFrame:
    """Parts as images: width by size, height by price."""
    p = table(spark, d, "part")
    return p.select("p_partkey", F.concat(F.lit("i"), "p_partkey").alias("key"), (F.col("p_size") * 137).cast("int").alias("width"), F.floor(F.col("p_retailprice") * 5).cast("int").alias("height"))


@query("image_resizes", "WITH i AS (SELECT p_partkey, p_size * 137 AS w, CAST(floor(p_retailprice * 5) AS BIGINT) AS h FROM part) SELECT p_partkey, 300 AS w1, CAST(floor(300 / (CAST(w AS DOUBLE) / h)) AS INTEGER) AS h1, CAST(CASE WHEN CAST(w AS DOUBLE) / h > 400 / 300.0 THEN 400 ELSE floor(300 * (CAST(w AS DOUBLE) / h)) END AS INTEGER) AS w2, CAST(CASE WHEN CAST(w AS DOUBLE) / h > 400 / 300.0 THEN floor(400 / (CAST(w AS DOUBLE) / h)) ELSE 300 END AS INTEGER) AS h2 FROM i")
def _resizes(spark, d):
    w, h = F.col("width"), F.col("height")
    made = images(spark, d).select("p_partkey", P.resized(w, h, 300).alias("a"), P.resized(w, h, 400, 300).alias("b"))
    return made.select("p_partkey", F.col("a.width").alias("w1"), F.col("a.height").alias("h1"), F.col("b.width").alias("w2"), F.col("b.height").alias("h2"))


@query("thumbnail_rows", "WITH i AS (SELECT 'i' || p_partkey AS key, CAST(p_size * 137 AS DOUBLE) / floor(p_retailprice * 5) AS r FROM part), s(name, n) AS (VALUES ('small', 100), ('medium', 300), ('large', 800)) SELECT key || '_thumb_' || name AS key, name, CAST(CASE WHEN r > 1 THEN n ELSE floor(n * r) END AS INTEGER) AS width, CAST(CASE WHEN r > 1 THEN floor(n / r) ELSE n END AS INTEGER) AS height FROM i, s")
def _thumbnails(spark, d):
    return P.thumbnails(images(spark, d))


@query("blob_files")
def _blobs(spark, d):
    """The files of the tables' folder as blobs; their contents aren't read."""
    return P.read_blobs(spark, d, "*.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


@query("size_literals", "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN o_orderkey * 1024 WHEN 1 THEN o_orderkey * 1048576 WHEN 2 THEN o_orderkey * 1073741824 WHEN 3 THEN o_orderkey * 1099511627776 WHEN 4 THEN o_orderkey WHEN 5 THEN o_orderkey ELSE -1 END AS bytes FROM orders")
def _sizes(spark, d):
    n = F.col("o_orderkey")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("KB", " mb", "GB", "TB", "B", "", "XB")]), (n % 7 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(text.parse_size(F.concat(n.cast("string"), unit)), F.lit(-1)).alias("bytes"))
