"""Queries of the engine's own operators, by name, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import checksums, text
from .operators import tiering, vectors
from .plans import catalog, changes, contents, indexes, listings, policies, registry, upkeep  # noqa: F401
from .sources.tables import AS_OF, DUCK, access_events, objects, table
from .sources.tables import vectors as vector_table
from .streaming import levels, limiters

QUERIES = {name: catalog.spark_query(body) for name, body in catalog.SQL.items()} | registry.QUERIES
ORACLE_SQL = {name: catalog.duck_query(body) for name, body in catalog.SQL.items()} | registry.ORACLE_SQL
FLAGSHIP = "vec_cosine_topk"

_V, _O, _E = (f"{n} AS ({DUCK[n]})" for n in ("vectors", "objects", "access_events"))
#: The query vector of the SQL: vector 0.
_Q = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
_DUCK_SCORE = {"cosine": "list_cosine_similarity(\"values\", q)", "euclidean": "1 / (1 + list_distance(\"values\", q))", "dot": "list_inner_product(\"values\", q)"}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").first().embedding


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"))


for _m in ("cosine", "euclidean", "dot"):
    query(f"vec_{'l2' if _m == 'euclidean' else _m}_topk", f"WITH {_V} SELECT id, round({_DUCK_SCORE[_m]}, 6) AS score FROM vectors, {_Q} ORDER BY {_DUCK_SCORE[_m]} DESC, id LIMIT 10")(lambda spark, d, m=_m: _rounded(vectors.search(vector_table(spark, d), _first_vector(spark, d), 10, m)))


@query("vec_filtered_threshold", f"WITH {_V} SELECT id, round({_DUCK_SCORE['cosine']}, 6) AS score FROM vectors, {_Q} WHERE label = '3' AND {_DUCK_SCORE['cosine']} >= 0.0 ORDER BY {_DUCK_SCORE['cosine']} DESC, id LIMIT 20")
def _filtered(spark, d):
    return _rounded(vectors.search(vector_table(spark, d), _first_vector(spark, d), 20, filters={"label": "3"}, threshold=0.0))


_PART = "(SELECT id, {s} AS s FROM vectors, {q} WHERE created_at {op} TIMESTAMP '{t}' - INTERVAL 7 DAY ORDER BY s DESC, id LIMIT 15)"


@query("vec_hot_cold_merge", f"WITH {_V} SELECT id, round(s, 6) AS score FROM ({_PART.format(s=_DUCK_SCORE['cosine'], q=_Q, op='>', t=AS_OF)} UNION ALL {_PART.format(s=_DUCK_SCORE['cosine'], q=_Q, op='<=', t=AS_OF)}) ORDER BY s DESC, id LIMIT 15")
def _federated(spark, d):
    return _rounded(vectors.federated(vector_table(spark, d), _first_vector(spark, d), AS_OF, 15))


def _centroids(spark, d) -> list[tuple[int, list[float]]]:
    """The first vector of each of the ten labels."""
    rows = table(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c")).collect()
    return sorted((r.label, list(r.c)) for r in rows)


_C = "cents AS (SELECT label AS cluster, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS c FROM embeddings GROUP BY label)"
_ASSIGNED = f"{_V}, {_C}, placed AS (SELECT id, \"values\", arg_min(cluster, (list_distance(\"values\", c), cluster)) AS cluster, min(list_distance(\"values\", c)) AS distance FROM vectors, cents GROUP BY id, \"values\")"


@query("ivf_assign", f"WITH {_ASSIGNED} SELECT id, cluster, round(distance, 6) AS distance FROM placed")
def _assign(spark, d):
    return vectors.assign(vector_table(spark, d), _centroids(spark, d)).select("id", "cluster", F.round("distance", 6).alias("distance"))


@query("ivf_probe_topk", f"WITH {_ASSIGNED}, near AS (SELECT cluster FROM cents, {_Q} ORDER BY list_distance(c, q), cluster LIMIT 3) SELECT id, round({_DUCK_SCORE['euclidean']}, 6) AS score FROM placed, {_Q} WHERE cluster IN (SELECT cluster FROM near) ORDER BY {_DUCK_SCORE['euclidean']} DESC, id LIMIT 10")
def _probe(spark, d):
    return _rounded(vectors.probe(vector_table(spark, d), _centroids(spark, d), _first_vector(spark, d), 3, 10))


@query("list_common_prefixes", f"WITH {_O} SELECT bucket, substring(key, 1, position('/' IN key)) AS prefix, count(*) AS n FROM objects WHERE position('/' IN key) > 0 GROUP BY ALL")
def _prefixes(spark, d):
    o = objects(spark, d).select("bucket", text.common_prefix(F.col("key"), "", "/").alias("prefix"))
    return o.where("prefix IS NOT NULL").groupBy("bucket", "prefix").agg(F.count("*").alias("n"))


_DECAY = "exp(-ln(2.0) * epoch(TIMESTAMP '{t}' - access_time) / (7 * 86400))".format(t=AS_OF)
_FREQ = f"freq AS (SELECT object_key, least(100.0, sum({_DECAY}) / 10) AS frequency, max(access_time) AS last_access, count(*) AS accesses FROM (SELECT *, row_number() OVER (PARTITION BY object_key ORDER BY access_time DESC, event_id DESC) AS rn FROM access_events) WHERE rn <= 1000 GROUP BY object_key)"


@query("access_frequency", f"WITH {_E}, {_FREQ} SELECT object_key, round(frequency, 6) AS frequency, last_access, accesses FROM freq")
def _frequency(spark, d):
    f = tiering.access_frequency(access_events(spark, d), AS_OF)
    return f.select("object_key", F.round("frequency", 6).alias("frequency"), "last_access", "accesses")


def _keyed(spark, d) -> DataFrame:
    """Objects under the keys that events name."""
    return objects(spark, d).withColumn("key", F.col("doc_id").cast("string"))


_H = f"epoch(TIMESTAMP '{AS_OF}' - last_access) / 3600"


@query("tier_decisions", f"WITH {_O}, {_E}, {_FREQ}, scored AS (SELECT bucket, CAST(doc_id AS VARCHAR) AS key, storage_tier AS current_tier, round(greatest(0.0, least(100.0, 0.4 * frequency + 0.3 * CASE WHEN {_H} < 1 THEN 100.0 WHEN {_H} < 24 THEN 80.0 WHEN {_H} < 168 THEN 50.0 WHEN {_H} < 720 THEN 20.0 ELSE 0.0 END + 0.1 * 70.0 - 0.1 * 80.0)), 6) AS score FROM objects JOIN freq ON CAST(doc_id AS VARCHAR) = object_key), decided AS (SELECT *, CASE WHEN score > 80 THEN 0 WHEN score > 60 THEN 1 WHEN score > 20 THEN 2 ELSE 3 END AS target_tier FROM scored) SELECT bucket, key, current_tier, score, target_tier FROM decided WHERE current_tier <> target_tier")
def _decisions(spark, d):
    return tiering.decisions(_keyed(spark, d), access_events(spark, d), AS_OF)


@query("hotspots", f"WITH {_E}, n AS (SELECT *, count(*) OVER (PARTITION BY object_key ORDER BY epoch_us(access_time) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS c FROM access_events) SELECT object_key, max(c) AS most, max(access_time) AS detected_at FROM n WHERE c > 5 AND c > 10 GROUP BY object_key")
def _hotspots(spark, d):
    return tiering.hotspots(access_events(spark, d), minutes=1440)


def _pii_sql() -> str:
    c = "content"
    for n in (15, 18):
        c = rf"regexp_replace({c}, '\b([0-9]{{2}})[0-9]{{{n - 4}}}([0-9]{{2}})\b', '\1{'*' * (n - 4)}\2', 'g')"
    c = rf"regexp_replace({c}, '\b(1[3-9])[0-9]{{7}}([0-9]{{2}})\b', '\1*******\2', 'g')"
    s = r"[-\t\n\f\r ]"
    for x in ("", s):
        for y in ("", s):
            for z in ("", s):
                n = 12 + sum(map(bool, (x, y, z)))
                c = rf"regexp_replace({c}, '\b([0-9]{{2}})[0-9]{{2}}{x}[0-9]{{4}}{y}[0-9]{{4}}{z}[0-9]{{2}}([0-9]{{2}})\b', '\1{'*' * n}\2', 'g')"
    return f"WITH {_O} SELECT doc_id, md5({c}) AS masked FROM objects"


@query("pii_redact", _pii_sql())
def _pii(spark, d):
    return objects(spark, d).select("doc_id", F.md5(text.mask_pii(F.col("content")).cast("binary")).alias("masked"))


@query("checksums", f"WITH {_O} SELECT doc_id, sha256(content) AS sha256, md5(content) AS md5 FROM objects")
def _checksums(spark, d):
    c = F.col("content").cast("binary")
    return objects(spark, d).select("doc_id", checksums.checksum(c, "SHA256").alias("sha256"), checksums.checksum(c, "MD5").alias("md5"))


@query("checksums_crc")
def _crc(spark, d):
    c = F.col("content").cast("binary")
    return objects(spark, d).select("doc_id", checksums.crc32(c).alias("crc32"), checksums.crc32c(c).alias("crc32c"), checksums.crc64(c).alias("crc64"))


@query("byte_ranges", f"WITH {_O} SELECT doc_id, substring(content, 6, 15) AS part FROM objects WHERE size > 19 AND ascii(content) < 128 AND strlen(content) = length(content)")
def _ranges(spark, d):
    r = text.byte_range(F.lit("bytes=5-19"), F.col("size"))
    o = objects(spark, d).where((F.col("size") > 19) & (F.octet_length("content") == F.char_length("content")))
    return o.select("doc_id", F.substring("content", r.start.cast("int") + 1, (r.end - r.start).cast("int") + 1).alias("part"))


@query("valid_names", f"WITH {_O} SELECT DISTINCT bucket, regexp_matches(bucket, '^[a-z0-9][a-z0-9.-]{{1,61}}[a-z0-9]$') AND NOT starts_with(bucket, 'xn--') AS valid FROM objects")
def _valid(spark, d):
    return objects(spark, d).select("bucket", text.valid_bucket(F.col("bucket")).alias("valid")).distinct()


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), F.col("value").alias("bytes"), (F.col("event_type") == "error").cast("int").alias("failed"))


query("limit_token_bucket")(lambda spark, d: limiters.fold(_events(spark, d), lambda: limiters.TokenBucket(2e-5, 3)))
query("limit_bandwidth")(lambda spark, d: limiters.fold(_events(spark, d), lambda: limiters.TokenBucket(1e-3, 300), n="bytes"))
query("limit_sliding_window")(lambda spark, d: limiters.fold(_events(spark, d), lambda: limiters.SlidingWindow(86400, 8640, 3)))
query("login_lockout")(lambda spark, d: limiters.fold(_events(spark, d), lambda: limiters.Lockout(3, 86400, 43200), n="failed"))
query("circuit_breaker")(lambda spark, d: limiters.fold(_events(spark, d), lambda: limiters.Breaker(3, 0.1, 86400, 2), n="failed"))


def level_requests(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests: 20 addresses, buckets by props, purchases and sign-ups as uploads."""
    method = F.when(F.col("event_type") == "purchase", "PUT").when(F.col("event_type") == "signup", "POST").otherwise("GET")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.concat(F.lit("10.0.0."), F.col("user_id") % 20).alias("ip"), F.col("user_id").cast("string").alias("user"), F.get_json_object("props", "$.k").alias("bucket"), method.alias("method"), F.floor("value").alias("bytes"))


#: Limits that fit the events' pace of some hundreds a day.
LEVELS = levels.Limits(requests=300, ip_requests=18, user_rate=2e-5, user_burst=3, bucket_rate=5e-5, bucket_burst=4, upload_rate=1e-4, upload_burst=100, methods={"GET": (1e-5, 2)}, whitelist=("10.0.0.3",), window=86400, precision=8640)
query("limit_levels")(lambda spark, d: levels.decide(level_requests(spark, d), LEVELS))
query("limit_levels_totals")(lambda spark, d: levels.totals(levels.decide(level_requests(spark, d), LEVELS)))
