"""Hotness, tiers and hotspots over access events; every operator takes the time it runs at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def age_s(time: str, as_of: str) -> Column:
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))) / 1e6


def last_n(events: DataFrame, n: int, key: str, *order: str) -> DataFrame:
    """The n newest rows of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return events.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def access_frequency(events: DataFrame, as_of: str, half_life_days: float = 7, last: int = 1000) -> DataFrame:
    """min(100, sum of exp(-ln 2 * age / half life) / 10) over the last accesses of each object, its newest and their count."""
    decayed = F.exp(-F.log(F.lit(2.0)) * age_s("access_time", as_of) / (half_life_days * 86400))
    return last_n(events, last, "object_key", "access_time", "event_id").groupBy("object_key").agg(F.least(F.lit(100.0), F.sum(decayed) / 10).alias("frequency"), F.max("access_time").alias("last_access"), F.count("*").alias("accesses"))


def recency(time: str, as_of: str) -> Column:
    h = age_s(time, as_of) / 3600
    return F.when(h < 1, 100.0).when(h < 24, 80.0).when(h < 168, 50.0).when(h < 720, 20.0).otherwise(0.0)


def size_score(size: str) -> Column:
    s = F.col(size)
    return F.when(s < 1 << 20, 80.0).when(s < 100 << 20, 60.0).when(s < 1 << 30, 40.0).otherwise(20.0)


def content_score(kind: str) -> Column:
    c = F.col(kind)
    return F.when(c.startswith("image/"), 80.0).when(c.startswith("video/"), 60.0).when(c.startswith("text/"), 70.0).otherwise(50.0)


def hotness(frequency: Column, recent: Column, content: Column, size: Column, priority: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 0.4 * frequency + 0.3 * recent + 0.1 * content - 0.1 * size + 0.1 * priority))


def tier(score: Column) -> Column:
    """0 hot, 1 warm, 2 cold, 3 archive."""
    return F.when(score > 80, 0).when(score > 60, 1).when(score > 20, 2).otherwise(3)


#: Names of the tiers, the hottest first.
TIERS = ("HOT", "WARM", "COLD", "ARCHIVE")


def scores(objects: DataFrame, events: DataFrame, as_of: str, pins: DataFrame | None = None) -> DataFrame:
    """bucket, key, current_tier, score, target_tier of accessed objects that aren't pinned: events are aggregated before
    they meet objects. pins (key, priority, fixed_tier) weigh objects or hold them where they are (null: neither)."""
    joined = objects.join(access_frequency(events, as_of), objects.key == F.col("object_key"))
    priority = F.lit(0.0)
    if pins is not None:
        joined = joined.join(pins.select("key", "priority", "fixed_tier"), "key", "left").where(~F.coalesce("fixed_tier", F.lit(False)))
        priority = F.coalesce(F.col("priority").cast("double"), F.lit(0.0))
    score = hotness(F.col("frequency"), recency("last_access", as_of), content_score("content_type"), size_score("size"), priority)
    return joined.select("bucket", "key", "last_access", F.col("storage_tier").alias("current_tier"), F.round(score, 6).alias("score")).withColumn("target_tier", tier(F.col("score")))


def decisions(objects: DataFrame, events: DataFrame, as_of: str, pins: DataFrame | None = None) -> DataFrame:
    """Objects whose tier should change."""
    return scores(objects, events, as_of, pins).where("current_tier <> target_tier").drop("last_access")


def name_of(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), number + 1)


def number_of(name: Column) -> Column:
    """The tier of a name; an unknown one is COLD."""
    out = F.when(F.upper(name) == TIERS[0], 0)
    for i, t in enumerate(TIERS[1:], 1):
        out = out.when(F.upper(name) == t, i)
    return out.otherwise(2)


def reason(score: Column, current: Column, target: Column) -> Column:
    """Why an object moves, with its score to two places."""
    return F.concat(F.lit("hotness score "), F.format_string("%.2f", score), F.lit(": "), name_of(current), F.lit(" to "), name_of(target))


def latest_first(decided: DataFrame, n: int) -> DataFrame:
    """The n decisions whose objects were accessed last."""
    return decided.orderBy(F.desc("last_access"), "key").limit(n)


def pin(pins: DataFrame, requests: DataFrame) -> DataFrame:
    """pins (key, priority, fixed_tier) after requests (key, fixed_tier) to hold or release objects; priorities stay."""
    asked = requests.select("key", F.col("fixed_tier").alias("__fixed"))
    return pins.join(asked, "key", "full").select("key", "priority", F.coalesce("__fixed", "fixed_tier").alias("fixed_tier"))


def hotspots(events: DataFrame, minutes: int = 10, baseline: int = 1, factor: int = 5, floor: int = 10) -> DataFrame:
    """Objects with more than baseline * factor and more than floor accesses in some trailing window."""
    at = F.unix_micros(F.col("access_time").cast("timestamp"))
    w = Window.partitionBy("object_key").orderBy("at").rangeBetween(-(minutes * 60_000_000 - 1), 0)
    counted = events.withColumn("at", at).withColumn("n", F.count("*").over(w))
    return counted.where((F.col("n") > baseline * factor) & (F.col("n") > floor)).groupBy("object_key").agg(F.max("n").alias("most"), F.max("access_time").alias("detected_at"))
