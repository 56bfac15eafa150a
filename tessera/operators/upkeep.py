"""Upkeep of a store: scrubbing, repair logs, replication, schedules, backups, lifecycle rules and encryption at rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checksums import checksum
from ..functions.text import common_prefix

#: Kinds of checksums.
KINDS = ("CRC32", "CRC32C", "CRC64", "SHA256", "MD5")


def normal_checksum(value: Column, kind: Column) -> Column:
    """A stored checksum in lower-case hex: hex in any case, or base64 (with its padding) of as many bytes as the kind has."""
    size = F.when(F.upper(kind) == "SHA256", 64).when(F.upper(kind) == "MD5", 32).when(F.upper(kind) == "CRC64", 16).otherwise(8)
    hexed = value.rlike("^[0-9A-Fa-f]+$") & (F.char_length(value) == size)
    return F.when(hexed, F.lower(value)).when(value.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.char_length(value) % 4 == 0), F.lower(F.hex(F.unbase64(value))))


def base64_checksum(data: Column, kind: str) -> Column:
    return F.base64(F.unhex(checksum(data, kind)))


def computed(data: Column, kind: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """The checksum of each row's own kind; only that one is computed. Null for an unknown kind."""
    out = F.lit(None).cast("string")
    for k in kinds:
        out = F.when(F.upper(kind) == k, checksum(data, k)).otherwise(out)
    return out


def put_outcome(data: Column, sent: Column, kind: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """ok, or BadDigest where the checksum sent with an object isn't that of its data (none sent: ok)."""
    return F.when(sent.isNull() | (sent == ""), "ok").when(computed(data, kind, kinds) == normal_checksum(sent, kind), "ok").otherwise("BadDigest")


def scrub(objects: DataFrame, tiers: tuple[int, ...] = (), kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """bucket, key, storage_tier, result (ok, corrupt, error) of objects (content, checksum, checksum_type) in some tiers (none
    named: all). An object without content, or with a checksum that can't be read, is an error; one without a checksum is ok."""
    rows = objects.where(F.col("storage_tier").isin(*tiers)) if tiers else objects
    stored, now = normal_checksum(F.col("checksum"), F.col("checksum_type")), computed(F.col("content").cast("binary"), F.col("checksum_type"), kinds)
    result = F.when(F.col("content").isNull(), "error").when(F.coalesce("checksum", F.lit("")) == "", "ok").when(stored.isNull() | now.isNull(), "error").when(stored == now, "ok").otherwise("corrupt")
    return rows.select("bucket", "key", "storage_tier", result.alias("result"))


def scrub_stats(results: DataFrame) -> DataFrame:
    return results.groupBy("storage_tier").agg(F.count("*").alias("checked"), F.count_if(F.col("result") == "corrupt").alias("corrupt"), F.count_if(F.col("result") == "error").alias("errors"))


def repairs(results: DataFrame, copies: DataFrame) -> DataFrame:
    """bucket, key, outcome of corrupt objects: repaired where another copy (bucket, key) is there, else lost."""
    return results.where(F.col("result") == "corrupt").select("bucket", "key").join(copies.select("bucket", "key", F.lit(True).alias("there")).dropDuplicates(["bucket", "key"]), ["bucket", "key"], "left").select("bucket", "key", F.when(F.col("there"), "repaired").otherwise("lost").alias("outcome"))


def replication_jobs(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, bucket, key, target of objects and the enabled rules (rule, bucket, prefix, target, enabled, priority) of their
    bucket whose prefix they have; rules meet only objects of their bucket."""
    held = rules.where("enabled").withColumnRenamed("bucket", "__bucket")
    return objects.join(held, (F.col("bucket") == F.col("__bucket")) & F.startswith(F.col("key"), F.col("prefix"))).select("rule", "bucket", "key", "target", "priority")


def replication_status(attempts: DataFrame, most: int = 3) -> DataFrame:
    """job, attempts, status from rows (job, attempt, ok): completed with the first success among the first `most` attempts,
    failed after that many, else pending."""
    seen = attempts.where(F.col("attempt") <= most).groupBy("job").agg(F.count("*").alias("attempts"), F.bool_or("ok").alias("ok"))
    return seen.select("job", "attempts", F.when(F.col("ok"), "completed").when(F.col("attempts") >= most, "failed").otherwise("pending").alias("status"))


def replication_wal(entries: DataFrame, done: DataFrame) -> DataFrame:
    """Entries (id, key, bucket, op, ...) with the CRC over key, bucket and op, and whether they are completed."""
    summed = entries.withColumn("checksum", F.crc32(F.concat("key", "bucket", "op").cast("binary")))
    return summed.join(done.select("id").distinct().withColumn("__done", F.lit(True)), "id", "left").withColumn("status", F.when(F.col("__done"), "completed").otherwise("pending")).drop("__done")


def resolve(source: DataFrame, target: DataFrame, mode: str = "last-write-wins") -> DataFrame:
    """bucket, key, version and origin of the copies that stand after a conflict of (bucket, key, version, modified_at):
    by the later write (the source's at equal times), by the source, or, with fail, only keys without a conflict."""
    key = ["bucket", "key"]
    s, t = (df.select(*key, F.struct("modified_at", "version").alias(n)) for df, n in ((source, "s"), (target, "t")))
    both = s.join(t, key, "full")
    if mode == "fail":
        both = both.where("s is null or t is null or s.version = t.version")
    elif mode not in ("last-write-wins", "source-wins"):
        raise ValueError(f"unknown mode {mode!r}")
    wins = F.col("t").isNull() | F.col("s").isNotNull() if mode != "last-write-wins" else F.col("t").isNull() | (F.col("s.modified_at") >= F.col("t.modified_at"))
    wins = F.coalesce(wins, F.lit(False))
    return both.select(*key, F.when(wins, F.col("s.version")).otherwise(F.col("t.version")).alias("version"), F.when(wins, "source").otherwise("target").alias("origin"))


def lag_ms(pending: DataFrame, as_of: Column) -> DataFrame:
    """Age of the oldest pending entry (bucket, created_at) of each bucket."""
    return pending.groupBy("bucket").agg(((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.min("created_at").cast("timestamp"))) / 1000).cast("long").alias("lag_ms"))


def task_status(results: DataFrame, tasks: DataFrame, last: int = 100) -> DataFrame:
    """task, enabled, runs, successes, failures, avg_duration, max_retries, success_rate (0 without runs), last_run, last_ok
    over each task's newest `last` results (task, id, started_at, duration, success, retries)."""
    from .tiering import last_n

    kept = last_n(results, last, "task", "started_at", "id")
    ok = F.count_if("success")
    newest = F.max(F.struct("started_at", "id", "success"))
    made = kept.groupBy("task").agg(F.count("*").alias("runs"), ok.alias("successes"), (F.count("*") - ok).alias("failures"), F.avg("duration").alias("avg_duration"), F.max("retries").alias("max_retries"), newest.alias("n"))
    rows = tasks.join(made, "task", "left")
    none = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    return rows.select("task", "enabled", none("runs", 0).alias("runs"), none("successes", 0).alias("successes"), none("failures", 0).alias("failures"), none("avg_duration", 0.0).alias("avg_duration"), none("max_retries", 0).alias("max_retries"), F.coalesce(F.col("successes") / F.col("runs"), F.lit(0.0)).alias("success_rate"), F.col("n.started_at").alias("last_run"), F.col("n.success").alias("last_ok"))


#: Default tasks: schedule, workers, retries, first and longest delay in seconds, multiplier (retries null: none).
SCHEDULES = (
    ("tiering_decision", "0 */6 * * *", 1, 3, 60, 600, 2.0),
    ("scrub_check", "0 2 * * 0", 4, 2, 300, 1800, 3.0),
    ("key_rotation", "0 3 1 * *", 1, 1, 600, 3600, 2.0),
    ("multipart_cleanup", "0 */1 * * *", 2, 1, 30, 300, 2.0),
    ("hot_index_eviction", "*/10 * * * *", 2, None, None, None, None),
    ("cold_index_compaction", "0 4 * * 0", 1, 1, 3600, 21600, 2.0),
    ("lifecycle_process", "0 5 * * *", 4, None, None, None, None),
    ("version_cleanup", "0 6 1 * *", 2, None, None, None, None),
)


def schedules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCHEDULES, "task string, schedule string, workers int, max_retries int, first_delay int, longest_delay int, multiplier double")


def backoff(attempt: Column, first: Column, longest: Column, multiplier: Column) -> Column:
    """Seconds before an attempt (0: none): the first delay times the multiplier for each attempt, never beyond the longest."""
    return F.when(attempt == 0, F.lit(0.0)).otherwise(F.least(first * F.pow(multiplier, attempt), longest.cast("double")))


def backups_to_keep(backups: DataFrame, as_of: Column, retention: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Backups whose age in whole days is at most the largest retention."""
    from ..functions.network import age_days

    return backups.where(age_days(F.col("created_at"), as_of) <= max(retention))


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Write every table under path: a backup."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def lifecycle(objects: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """bucket, key, action (expire, transition), target_tier of objects (bucket, key, storage_tier, created_at) under rules
    (bucket, prefix, expire_days, transition_days, transition_tier): expiry first, and a transition only to a colder tier.
    Of several rules the one that expires, else the coldest tier, holds."""
    from ..functions.network import age_days

    age = age_days(F.col("created_at"), as_of)
    held = rules.withColumnRenamed("bucket", "__bucket")
    met = objects.join(held, (F.col("bucket") == F.col("__bucket")) & F.startswith(F.col("key"), F.col("prefix")))
    expire = F.coalesce(age >= F.col("expire_days"), F.lit(False))
    colder = F.coalesce((age >= F.col("transition_days")) & (F.col("transition_tier") > F.col("storage_tier")), F.lit(False))
    due = met.select("bucket", "key", expire.alias("expire"), F.when(colder, F.col("transition_tier")).alias("tier")).where("expire or tier is not null")
    best = due.groupBy("bucket", "key").agg(F.bool_or("expire").alias("expire"), F.max("tier").alias("tier"))
    return best.select("bucket", "key", F.when(F.col("expire"), "expire").otherwise("transition").alias("action"), F.when(~F.col("expire"), F.col("tier")).alias("target_tier"))


def encrypt(data: Column, key: Column) -> Column:
    """struct(nonce, ciphertext, tag) under AES-GCM with a 256-bit key; a new nonce each time."""
    sealed = F.aes_encrypt(data, key, F.lit("GCM"))
    n = F.octet_length(sealed)
    return F.transform(F.array(sealed), lambda s: F.struct(F.substring(s, F.lit(1), F.lit(12)).alias("nonce"), F.substring(s, F.lit(13), n - 28).alias("ciphertext"), F.substring(s, n - 15, F.lit(16)).alias("tag")))[0]


def decrypt(sealed: Column, key: Column) -> Column:
    """The data of a struct(nonce, ciphertext, tag); null where key or data don't fit the tag."""
    return F.try_aes_decrypt(F.concat(sealed.nonce, sealed.ciphertext, sealed.tag), key, F.lit("GCM"))


def to_json_rows(rows: DataFrame) -> DataFrame:
    """value: each row as JSON, as an audit log has it."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def to_xml_rows(rows: DataFrame, tag: str) -> DataFrame:
    """value: each row as XML under a tag."""
    return rows.select(F.to_xml(F.struct(*rows.columns), {"rowTag": tag}).alias("value"))


def write_tiered(objects: DataFrame, path: str) -> None:
    """Blobs by tier: one folder a tier, so a read of one tier touches its files alone."""
    objects.write.mode("overwrite").partitionBy("storage_tier").parquet(path)


def write_log(lines: DataFrame, path: str, most: int = 1_000_000) -> None:
    """Lines (value) as text files of at most `most` lines."""
    lines.select("value").write.mode("append").option("maxRecordsPerFile", most).text(path)


def prefetch(hotspots: DataFrame, prefix: str = "", delimiter: str = "/") -> DataFrame:
    """What to load ahead of hotspots (bucket, object_key): their bucket with the folder, each once."""
    folder = F.coalesce(common_prefix(F.col("object_key"), prefix, delimiter), "object_key")
    return hotspots.select(F.concat_ws("/", "bucket", folder).alias("prefix")).distinct()


def set_enabled(tasks: DataFrame, names: tuple[str, ...], enabled: bool) -> DataFrame:
    """tasks (task, enabled) with some switched on or off."""
    return tasks.withColumn("enabled", F.when(F.col("task").isin(*names), F.lit(enabled)).otherwise(F.col("enabled")))


def query_stats(log: DataFrame) -> DataFrame:
    """Searches and their mean latency of each index, from a log (index, latency_ms)."""
    return log.groupBy("index").agg(F.count("*").alias("queries"), F.avg("latency_ms").alias("avg_latency_ms"))


def store_stats(objects: DataFrame, uploads: DataFrame, flushes: DataFrame) -> DataFrame:
    """objects, buckets, total_size, uploads and flushes of a store, in one row."""
    of = objects.agg(F.count("*").alias("objects"), F.count_distinct("bucket").alias("buckets"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"))
    return of.crossJoin(uploads.agg(F.count("*").alias("uploads"))).crossJoin(flushes.agg(F.count_distinct("bucket", "flush").alias("flushes")))  # one row each


def keys_by_bucket(keys: DataFrame) -> DataFrame:
    """total and a map of the keys in each bucket, in one row."""
    each = keys.groupBy("bucket").agg(F.count("*").alias("n"))  # a row a bucket
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "n")))).alias("by_bucket"))


def replication_totals(jobs: DataFrame) -> DataFrame:
    """total, completed, failed, pending and the bytes of completed jobs (status, size), in one row."""
    is_ = lambda s: F.col("status") == s
    return jobs.agg(F.count("*").alias("total"), *[F.count_if(is_(s)).alias(s) for s in ("completed", "failed", "pending")], F.coalesce(F.sum(F.when(is_("completed"), F.col("size"))), F.lit(0)).cast("long").alias("bytes"))


def delete_blobs(blobs: DataFrame, gone: DataFrame) -> DataFrame:
    """n and size of each tier after blobs (bucket, key) are gone."""
    left = blobs.join(gone.select("bucket", "key").distinct(), ["bucket", "key"], "left_anti")
    return left.groupBy("storage_tier").agg(F.count("*").alias("n"), F.greatest(F.lit(0), F.sum("size")).cast("long").alias("size"))


def credential(credentials: DataFrame, access_key: str, as_of: Column) -> DataFrame:
    """The temporary credential of a key, if it has not expired."""
    return credentials.where((F.col("access_key") == access_key) & (F.col("expires_at") >= as_of))
