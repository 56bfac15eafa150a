"""Listings: pages of keys, common prefixes, versions, uploads and parts, and what a read answers.

A page is a filter that reaches the scan, a distinct of what is listed, and a top-n of one entry more than the page holds.
Only those entries meet in one task. Order is that of the keys' bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import common_prefix


def latest(versions: DataFrame, *key: str, by: tuple[str, ...] = ("modified_at", "event_id")) -> DataFrame:
    """The newest row of each key, by a maximum that is combined before the shuffle (no window, so no key is gathered)."""
    row = F.struct(*[c for c in versions.columns if c not in key])
    newest = versions.groupBy(*key).agg(F.max_by(row, F.struct(*by)).alias("row"))
    return newest.select(*key, "row.*")


def visible(versions: DataFrame) -> DataFrame:
    """Objects as reads see them: the newest version of each key, unless it is a delete marker."""
    return latest(versions, "bucket", "key").where(~F.col("delete_marker"))


def list_objects(objects: DataFrame, bucket: str, prefix: str = "", max_keys: int = 1000) -> DataFrame:
    """The first max_keys objects under a prefix, which is taken as it is (no wildcards)."""
    return objects.where((F.col("bucket") == bucket) & F.col("key").startswith(prefix)).orderBy("key").limit(max_keys)


def list_page(objects: DataFrame, bucket: str, prefix: str = "", delimiter: str = "", after: str = "", max_keys: int = 1000) -> DataFrame:
    """One page of a listing: place, entry, kind ('content' or 'prefix'), size, truncated, next_token.

    Keys that have the delimiter behind the prefix are rolled up into distinct common prefixes. Entries behind `after`
    (start-after, a marker or the last page's token) are listed; truncated says whether more follow, next_token with
    which entry to go on (null on the last page).
    """
    rows = objects.where((F.col("bucket") == bucket) & F.col("key").startswith(prefix))
    if after:
        rows = rows.where(F.col("key") > after)
    rolled = common_prefix(F.col("key"), prefix, delimiter) if delimiter else F.lit(None).cast("string")
    named = rows.select(F.coalesce(rolled, "key").alias("entry"), F.when(rolled.isNull(), "content").otherwise("prefix").alias("kind"), F.when(rolled.isNull(), F.col("size")).alias("size"))
    listed = named.where(F.col("entry") > after).groupBy("entry", "kind").agg(F.max("size").alias("size")).orderBy("entry").limit(max_keys + 1)
    page = listed.agg(F.sort_array(F.collect_list(F.struct("entry", "kind", "size"))).alias("e"))
    more = F.size("e") > max_keys
    cut = page.select(F.slice("e", 1, max_keys).alias("e"), more.alias("truncated"), F.when(more, F.element_at("e", max_keys).entry).alias("next_token"))
    return cut.select(F.posexplode("e").alias("place", "x"), "truncated", "next_token").select("place", "x.entry", "x.kind", "x.size", "truncated", "next_token")


def list_versions(versions: DataFrame, bucket: str, prefix: str = "", max_keys: int = 1000) -> DataFrame:
    """Versions of the objects under a prefix by key and, within a key, by the text of the version's id."""
    return versions.where((F.col("bucket") == bucket) & F.col("key").startswith(prefix)).orderBy("key", "version_id").limit(max_keys)


def get_version(versions: DataFrame, bucket: str, key: str, version_id: str) -> DataFrame:
    return versions.where((F.col("bucket") == bucket) & (F.col("key") == key) & (F.col("version_id") == version_id))


def list_uploads(uploads: DataFrame, as_of: Column, max_uploads: int = 1000) -> DataFrame:
    """Each bucket's first uploads that haven't expired, in order of their ids, and whether the bucket has more."""
    w = Window.partitionBy("bucket").orderBy("upload_id")
    live = uploads.where(F.col("expires_at") > as_of).withColumn("place", F.row_number().over(w)).where(F.col("place") <= max_uploads + 1)
    more = live.groupBy("bucket").agg(F.max("place").alias("most")).select("bucket", (F.col("most") > max_uploads).alias("truncated"))
    return live.where(F.col("place") <= max_uploads).join(more, "bucket")


def list_parts(parts: DataFrame, marker: int = 0, max_parts: int = 1000) -> DataFrame:
    """Each upload's parts behind a marker in the order of their numbers, whether more follow, and the next marker."""
    w = Window.partitionBy("upload_id").orderBy("part_number")
    page = parts.where(F.col("part_number") > marker).withColumn("place", F.row_number().over(w)).where(F.col("place") <= max_parts + 1)
    ends = page.groupBy("upload_id").agg((F.max("place") > max_parts).alias("truncated"), F.max(F.when(F.col("place") <= max_parts, F.col("part_number"))).alias("last"))
    return page.where(F.col("place") <= max_parts).join(ends, "upload_id").select("upload_id", "part_number", "size", "truncated", F.when(F.col("truncated"), F.col("last")).alias("next_marker"))


def list_keys(keys: DataFrame, bucket: str, prefix: str = "", limit: int = 1000, offset: int = 0) -> DataFrame:
    """Rows offset to offset + limit by key, each with the number of all that match (counted on its own)."""
    found = keys.where((F.col("bucket") == bucket) & F.col("key").startswith(prefix))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("key").offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def conditional_read(etag: Column, modified: Column, if_none_match: Column, if_match: Column, if_modified_since: Column) -> Column:
    """Status of a read under its headers (null: not sent), the first that decides: 304, 412, 304, or 200."""
    return F.when(if_none_match == etag, 304).when(if_match != etag, 412).when(modified <= if_modified_since, 304).otherwise(200)


def location(region: Column) -> Column:
    """The default region is answered as empty."""
    return F.when(region == "us-east-1", "").otherwise(region)


def retention_headers(mode: Column, retain_until: Column, checksum: Column, kind: Column) -> Column:
    """Attributes of a read as a map; retention only if its mode is ENABLED, a checksum only if there is one."""
    locked = F.when(mode == "ENABLED", F.create_map(F.lit("retain-until"), F.date_format(retain_until, "yyyy-MM-dd'T'HH:mm:ss'Z'"))).otherwise(F.create_map().cast("map<string,string>"))
    summed = F.when(checksum != "", F.create_map(F.concat(F.lit("checksum-"), F.lower(kind)), checksum)).otherwise(F.create_map().cast("map<string,string>"))
    return F.map_concat(locked, summed)


LOG_FIELDS = ("timestamp", "remote_ip", "user_id", "operation", "bucket", "key", "status_code", "bytes_sent", "request_id")


def access_log_lines(requests: DataFrame) -> DataFrame:
    """value: one line a request, its nine fields parted by a space; empty fields stay empty, spaces in a key become %20."""
    text = [F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"), *[F.coalesce(F.replace(F.col(c).cast("string"), F.lit(" "), F.lit("%20")), F.lit("")) for c in LOG_FIELDS[1:]]]
    return requests.select(F.array_join(F.array(*text), " ").alias("value"))


def parse_access_log(lines: DataFrame) -> DataFrame:
    """The fields of access-log lines; lines that don't have nine are left out."""
    f = F.split("value", " ", 9)
    rows = lines.select(f.alias("f")).where(F.size("f") == len(LOG_FIELDS))
    get = lambda i: F.element_at("f", i + 1)
    kinds = {"status_code": "int", "bytes_sent": "long"}
    named = [F.try_to_timestamp(get(0), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp")]
    named += [F.replace(get(i), F.lit("%20"), F.lit(" ")).try_cast(kinds.get(c, "string")).alias(c) for i, c in enumerate(LOG_FIELDS) if i]
    return rows.select(*named)


def tail(history: DataFrame, n: int, *order: str) -> DataFrame:
    """The newest n rows, oldest first."""
    return history.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)
