"""Changes of keyed tables as plans: a change gives the new table, and what became of each request.

Creates and deletes are semi- and anti-joins on the key, so hot keys need no care; several requests for one key are told
apart by their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def create(table: DataFrame, new: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """The table with rows whose key it lacks, and key and outcome (created, exists) of each new row. Keys of new are unique."""
    fresh = new.join(table.select(*key).distinct(), list(key), "left_anti")
    outcome = new.select(*key).join(fresh.select(*key).withColumn("fresh", F.lit(True)), list(key), "left")
    return table.unionByName(fresh, allowMissingColumns=True), outcome.select(*key, F.when(F.col("fresh"), "created").otherwise("exists").alias("outcome"))


def upsert(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """Rows take the place of those of the table with their key. Keys of rows are unique."""
    return table.join(rows.select(*key), list(key), "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(table: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    return table.join(keys.select(*key).distinct(), list(key), "left_anti").select(*table.columns)


def attach(table: DataFrame, requests: DataFrame, existing: DataFrame, key: str, column: str, item: str) -> DataFrame:
    """The table with the requested items (key, item) added to the list `column`, once each, if they exist."""
    known = requests.join(existing.select(item).distinct(), item, "left_semi").groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("__new"))
    nothing = F.array().cast("array<string>")
    return table.join(known, key, "left").withColumn(column, F.array_union(F.coalesce(column, nothing), F.coalesce("__new", nothing))).select(*table.columns)


def detach(table: DataFrame, requests: DataFrame, key: str, column: str, item: str) -> DataFrame:
    """The table without the requested items in the list `column`; items it lacks change nothing."""
    gone = requests.groupBy(key).agg(F.collect_set(item).alias("__gone"))
    kept = F.when(F.col("__gone").isNull(), F.col(column)).otherwise(F.filter(column, lambda x: ~F.array_contains("__gone", x)))
    return table.join(gone, key, "left").withColumn(column, kept).select(*table.columns)


def put_objects(objects: DataFrame, puts: DataFrame) -> DataFrame:
    """Objects after puts (bucket, key, size, at, id): the newest put of a key takes the place of what was there."""
    newest = puts.groupBy("bucket", "key").agg(F.max_by("size", F.struct("at", "id")).alias("size"))
    return upsert(objects.select("bucket", "key", "size"), newest, "bucket", "key")


def counters(objects: DataFrame) -> DataFrame:
    """object_count and total_size of each bucket, recomputed from its objects."""
    return objects.groupBy("bucket").agg(F.count("*").alias("object_count"), F.sum("size").cast("long").alias("total_size"))


def admit(puts: DataFrame, quotas: DataFrame) -> DataFrame:
    """puts (bucket, key, size, at, id) with outcome: stored, or quota from the put on with which a bucket's objects or bytes
    (of new and replaced keys, in order) first go over its quota (max_objects, max_bytes; null or 0: none).

    A batch is one transaction a bucket: what follows the first violation is rolled back with it. The order forces one
    bucket's puts through one task; its running sums need no more than a row of state.
    """
    by_key = Window.partitionBy("bucket", "key").orderBy("at", "id")
    steps = puts.withColumn("old", F.lag("size").over(by_key)).withColumn("more", F.when(F.col("old").isNull(), 1).otherwise(0)).withColumn("grown", F.col("size") - F.coalesce("old", F.lit(0)))
    run = Window.partitionBy("bucket").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    summed = steps.withColumn("n", F.sum("more").over(run)).withColumn("bytes", F.sum("grown").over(run)).join(quotas, "bucket", "left")
    over = (F.coalesce(F.col("max_objects"), F.lit(0)) > 0) & (F.col("n") > F.col("max_objects")) | (F.coalesce(F.col("max_bytes"), F.lit(0)) > 0) & (F.col("bytes") > F.col("max_bytes"))
    failed = F.max(over.cast("int")).over(run)
    return summed.withColumn("failed", failed).select("id", "bucket", "key", "size", F.when(F.col("failed") == 1, "quota").otherwise("stored").alias("outcome"))


def delete_outcome(versioned: Column, locked_until: Column, as_of: Column, bypass: Column) -> Column:
    """What a delete does: locked (a retention that isn't bypassed), marker (in a versioned bucket), or deleted."""
    return F.when((locked_until > as_of) & ~bypass, "locked").when(versioned, "marker").otherwise("deleted")


def append_versions(versions: DataFrame, new: DataFrame) -> DataFrame:
    """Version rows with those added and is_latest told anew for the keys they touch."""
    every = versions.drop("is_latest").unionByName(new.drop("is_latest"), allowMissingColumns=True)
    newest = every.groupBy("bucket", "key").agg(F.max_by("version_id", F.struct("modified_at", "version_id")).alias("__last"))
    return every.join(newest, ["bucket", "key"]).withColumn("is_latest", F.col("version_id") == F.col("__last")).drop("__last")


def delete_buckets(buckets: DataFrame, objects: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    return delete(buckets, gone, "bucket"), delete(objects, gone, "bucket")


def new_bucket(name: Column, region: Column, acl: Column, owner: Column, default_region: str = "us-east-1") -> Column:
    """A bucket's row as it is made: blanks take the defaults."""
    blank = lambda c, d: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(d))
    return F.struct(name.alias("bucket"), blank(region, default_region).alias("region"), blank(acl, "private").alias("acl"), blank(owner, "admin").alias("owner"))


def upsert_parts(parts: DataFrame) -> DataFrame:
    """Parts (upload_id, part_number, at, id, ...) as sent: a number that is sent again replaces the earlier one."""
    row = F.struct(*[c for c in parts.columns if c not in ("upload_id", "part_number")])
    return parts.groupBy("upload_id", "part_number").agg(F.max_by(row, F.struct("at", "id")).alias("p")).select("upload_id", "part_number", "p.*")


def complete(uploads: DataFrame, parts: DataFrame, wanted: DataFrame | None = None, data: str | None = None) -> DataFrame:
    """upload_id, bucket, key, size, parts (numbers in order) and, with data, content: the parts put together in the order
    of their numbers. wanted (upload_id, part_number) picks parts; an upload without parts isn't completed."""
    if wanted is not None:
        parts = parts.join(wanted.select("upload_id", "part_number").distinct(), ["upload_id", "part_number"], "left_semi")
    fields = ["part_number", "size", *([F.col(data).alias("data")] if data else [])]
    gathered = parts.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("p"))  # an upload has 10,000 parts at most
    total = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["size"])
    made = gathered.select("upload_id", total.alias("size"), F.transform("p", lambda x: x.part_number).alias("parts"), *([F.array_join(F.transform("p", lambda x: x.data), "").alias("content")] if data else []))
    return uploads.select("upload_id", "bucket", "key").join(made, "upload_id")


def abort(uploads: DataFrame, parts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    return delete(uploads, gone, "upload_id"), delete(parts, gone, "upload_id")


def migrate(objects: DataFrame, decisions: DataFrame) -> DataFrame:
    """Objects with the tier that a decision (bucket, key, current_tier, target_tier) gives, if its current tier still holds."""
    moved = decisions.select("bucket", "key", F.col("current_tier").alias("__from"), F.col("target_tier").alias("__to")).dropDuplicates(["bucket", "key"])
    joined = objects.join(moved, ["bucket", "key"], "left")
    return joined.withColumn("storage_tier", F.when(F.col("__from") == F.col("storage_tier"), F.col("__to")).otherwise(F.col("storage_tier"))).select(*objects.columns)


def wal(entries: DataFrame, every: int = 100, per: str = "bucket", order: str = "id") -> DataFrame:
    """Entries (type, bucket, key, data, ...) with the CRC of their data and the flush they belong to."""
    w = Window.partitionBy(per).orderBy(order)
    return entries.withColumn("checksum", F.crc32(F.col("data").cast("binary"))).withColumn("flush", F.floor((F.row_number().over(w) - 1) / every))


def wal_intact(entries: DataFrame) -> Column:
    return F.crc32(F.col("data").cast("binary")) == F.col("checksum")
