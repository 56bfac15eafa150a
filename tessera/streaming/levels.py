"""The limiter of several levels: whitelist, all requests, address, user, bucket, method and user, upload bytes.

A request stops at the first level that rejects it, and what earlier levels counted stays counted. So a level's
state rests only on the requests that earlier levels let through, and the levels run one after another, each dealt
by its own key, where one fold over all requests in order of time would be a single task.

The two window levels admit the first requests of a slot until the window is full. They need only the number of
requests in each slot: the ordered pass goes over slots, and the requests take their places by a window function.

Columns of rows: id long, ts timestamp, ip, user, bucket, method string, bytes long. Defined cases: requests of equal
time go in order of id; a null or empty user, bucket or method skips its level, as does the user "anonymous" its own;
a null ip counts as the empty one; null bytes are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .limiters import TokenBucket

_ROW = "id long, micros long, ip string, user string, bucket string, method string, bytes long, limit_type string"


@dataclass(frozen=True)
class Limits:
    """Requests a window (per second), tokens and bursts of each level; upload_rate 0 turns the last level off."""

    requests: int = 1000
    ip_requests: int = 100
    user_rate: float = 50
    user_burst: float = 50
    bucket_rate: float = 200
    bucket_burst: float = 200
    upload_rate: float = 52_428_800
    upload_burst: float = 104_857_600
    methods: dict[str, tuple[float, float]] = field(default_factory=dict)
    whitelist: tuple[str, ...] = ()
    window: float = 1.0
    precision: float = 0.1


def _windows(rows: DataFrame, level: str, key: Column, limit: int, limits: Limits) -> DataFrame:
    slot = F.floor(F.col("micros") / F.lit(round(limits.precision * 1e6)))
    width = round(limits.window / limits.precision)
    at = rows.withColumn("k", key).withColumn("slot", slot)
    live = F.col("limit_type").isNull()

    def rooms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, deque()
        for b in batches:
            out = []
            for k, s, n in zip(b["k"], b["slot"], b["n"], strict=True):
                if k != last:
                    last, held = k, deque()
                while held and held[0][0] <= s - width:
                    held.popleft()
                out.append(min(n, max(0, limit - sum(x for _, x in held))))
                held.append((s, out[-1]))
            yield pd.DataFrame({"k": b["k"], "slot": b["slot"], "room": out})

    counts = at.where(live).groupBy("k", "slot").agg(F.count("*").alias("n"))
    room = counts.repartition("k").sortWithinPartitions("k", "slot").mapInPandas(rooms, "k string, slot long, room long")
    # requests settled before are dealt by id, so that they load no group
    place = F.row_number().over(Window.partitionBy("k", "slot", F.when(~live, F.col("id"))).orderBy("micros", "id"))
    over = live & (F.col("place") > F.col("room"))
    return at.withColumn("place", place).join(room, ["k", "slot"], "left").select(*rows.columns[:-1], F.when(over, level).otherwise(F.col("limit_type")).alias("limit_type"))


def _tokens(rows: DataFrame, level: str, key: Column, make: Callable[[str], TokenBucket], cost: Column) -> DataFrame:
    """A null key skips the level. A key's requests stream in order past one bucket of tokens."""
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, machine = None, None
        for b in batches:
            kept = b["limit_type"].tolist()
            for i, (k, live, t, n, method) in enumerate(zip(b["k"], b["live"], b["micros"], b["cost"], b["method"], strict=True)):
                if live:
                    if machine is None or k != last:
                        last, machine = k, make(method)
                    if not machine.step(t / 1e6, n):
                        kept[i] = level
            yield b[columns].assign(limit_type=kept)

    at = rows.withColumn("k", key).withColumn("live", F.col("limit_type").isNull() & F.col("k").isNotNull()).withColumn("cost", cost.cast("double"))
    dealt = at.repartition(F.col("live"), F.when(F.col("live"), F.col("k")), F.when(~F.col("live"), F.col("id")))
    return dealt.sortWithinPartitions("k", "micros", "id").mapInPandas(run, _ROW)


def decide(requests: DataFrame, limits: Limits) -> DataFrame:
    """id, allowed, limit_type (the level that rejected, "whitelist", or empty), limit_key, retry_after of each request."""
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    ip = F.coalesce(F.col("ip").cast("string"), F.lit(""))
    listed = ip.isin(*limits.whitelist) if limits.whitelist else F.lit(False)
    rows = requests.select(F.col("id").cast("long").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), ip.alias("ip"), text("user").alias("user"), text("bucket").alias("bucket"), text("method").alias("method"), F.coalesce(F.col("bytes").cast("long"), F.lit(0)).alias("bytes"), F.when(listed, "whitelist").alias("limit_type"))
    rows = _windows(rows, "global", F.lit("global"), limits.requests, limits)
    rows = _windows(rows, "ip", F.col("ip"), limits.ip_requests, limits)
    one = F.lit(1)
    rows = _tokens(rows, "user", F.when(F.col("user") != "anonymous", F.col("user")), lambda _: TokenBucket(limits.user_rate, limits.user_burst), one)
    rows = _tokens(rows, "bucket", F.col("bucket"), lambda _: TokenBucket(limits.bucket_rate, limits.bucket_burst), one)
    user = F.coalesce("user", F.lit(""))
    if limits.methods:
        known = F.when(F.col("method").isin(*limits.methods), F.concat("method", F.lit(":"), user))
        rows = _tokens(rows, "api", known, lambda m: TokenBucket(*limits.methods[m]), one)
    if limits.upload_rate > 0:
        sent = F.when(F.col("method").isin("PUT", "POST") & (F.col("bytes") > 0), user)
        rows = _tokens(rows, "bandwidth", sent, lambda _: TokenBucket(limits.upload_rate, limits.upload_burst), F.col("bytes"))
    kind = F.col("limit_type")
    wait = F.when(kind == "bandwidth", F.floor(F.col("bytes") / F.lit(float(limits.upload_rate or 1))) + 1).when(kind.isNull() | (kind == "whitelist"), 0).otherwise(1)
    named = F.when(kind == "global", F.lit("global")).when(kind.isin("ip", "whitelist"), F.col("ip")).when(kind.isin("user", "bandwidth"), user).when(kind == "bucket", F.col("bucket")).when(kind == "api", F.col("method"))
    return rows.select("id", (kind.isNull() | (kind == "whitelist")).alias("allowed"), F.coalesce(kind, F.lit("")).alias("limit_type"), F.coalesce(named, F.lit("")).alias("limit_key"), wait.cast("long").alias("retry_after"))


def totals(decided: DataFrame) -> DataFrame:
    """The counters of a limiter: requests, those allowed and those each level rejected, in one row."""
    rejected = [F.coalesce(F.sum((F.col("limit_type") == x).cast("long")), F.lit(0)).alias(f"{x}_rejected") for x in ("global", "ip", "user", "bucket", "api", "bandwidth")]
    return decided.agg(F.count("*").alias("requests"), F.coalesce(F.sum(F.col("allowed").cast("long")), F.lit(0)).alias("allowed"), *rejected)
