"""Caches as ordered folds over a trace of requests, one trace a cache (key), and an adaptive limiter.

`replay` gives each request's outcome. What a cache holds depends on all that came before, so a cache's trace is one
sequence; many caches run side by side, with one state at a time in a task's memory.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .limiters import Breaker, TokenBucket


class LruCache:
    """Items by last use, at most max_bytes of them, each for ttl seconds from when it was put. A read that misses puts the
    item; a write puts it; an item too large for the cache empties it and is held alone."""

    def __init__(self, max_bytes: float = 30 << 30, ttl: float = 300) -> None:
        self.max_bytes, self.ttl, self.size, self.items = max_bytes, ttl, 0.0, OrderedDict()

    def drop(self, item: str) -> None:
        self.size -= self.items.pop(item)[0]

    def get(self, ts: float, item: str) -> bool:
        if item not in self.items:
            return False
        if ts - self.items[item][1] > self.ttl:
            self.drop(item)
            return False
        self.items.move_to_end(item)
        return True

    def put(self, ts: float, item: str, size: float) -> None:
        if item in self.items:
            self.drop(item)
        while self.items and self.size + size > self.max_bytes:
            self.drop(next(iter(self.items)))
        self.items[item] = (size, ts)
        self.size += size

    def step(self, ts: float, item: str, size: float, op: str) -> str:
        if op == "put":
            self.put(ts, item, size)
            return "put"
        if op == "delete":
            if item in self.items:
                self.drop(item)
            return "deleted"
        if self.get(ts, item):
            return "hit"
        self.put(ts, item, size)
        return "miss"


class OldestCache:
    """Results for ttl seconds, at most `most` of them; a put into a full cache evicts the one put first (even an expired
    one, and even to write over an item it has)."""

    def __init__(self, most: int = 10_000, ttl: float = 300) -> None:
        self.most, self.ttl, self.items = most, ttl, {}

    def step(self, ts: float, item: str, size: float, op: str) -> str:
        if op == "get" and item in self.items and ts - self.items[item] <= self.ttl:
            return "hit"
        if op == "delete":
            self.items.pop(item, None)
            return "deleted"
        if len(self.items) >= self.most:
            del self.items[min(self.items, key=self.items.get)]
        self.items.pop(item, None)
        self.items[item] = ts
        return "miss" if op == "get" else "put"


class TtlCache(OldestCache):
    """Items for ttl seconds, without a bound on their number."""

    def __init__(self, ttl: float = 300) -> None:
        super().__init__(1 << 62, ttl)


class Adaptive:
    """A breaker before a token bucket for each item: open, rejected or allowed. The breaker counts failures (size > 0 with
    op "fail") of what was allowed."""

    def __init__(self, rate: float, burst: float, breaker: Callable[[], Breaker] = Breaker) -> None:
        self.rate, self.burst, self.breaker, self.buckets = rate, burst, breaker(), {}

    def step(self, ts: float, item: str, size: float, op: str) -> str:
        b = self.breaker
        if b.state == "open" and ts - b.since < b.timeout:
            return "open"
        bucket = self.buckets.setdefault(item, TokenBucket(self.rate, self.burst))
        if not bucket.step(ts):
            return "rejected"
        b.step(ts, float(op == "fail"))
        return "allowed"


def replay(trace: DataFrame, make: Callable[[], object]) -> DataFrame:
    """key, id, outcome of each request of a trace (key, ts, id, item, size, op), in order of time and id within a key."""
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts")
    picked = trace.select(F.col("key").cast("string").alias("key"), at, F.col("id").cast("long").alias("id"), F.col("item").cast("string").alias("item"), F.col("size").cast("double").alias("size"), F.col("op").cast("string").alias("op"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, machine = None, None
        for b in batches:
            out = []
            for k, t, item, size, op in zip(b["key"], b["ts"], b["item"], b["size"], b["op"], strict=True):
                if machine is None or k != last:
                    last, machine = k, make()
                out.append(machine.step(t, item, size, op))
            yield pd.DataFrame({"key": b["key"], "id": b["id"], "outcome": out})

    return picked.repartition("key").sortWithinPartitions("key", "ts", "id").mapInPandas(run, "key string, id long, outcome string")


def hit_rate(outcomes: DataFrame) -> DataFrame:
    """hits, misses and their rate (0 without reads) of each cache."""
    hits, misses = F.count_if(F.col("outcome") == "hit"), F.count_if(F.col("outcome") == "miss")
    return outcomes.groupBy("key").agg(hits.alias("hits"), misses.alias("misses")).withColumn("hit_rate", F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(F.lit(0.0)))


class PerUser(TokenBucket):
    """A token bucket whose rate a user's own limit replaces until it expires."""

    def __init__(self, rate: float, burst: float, own: tuple[float, float] | None = None) -> None:
        super().__init__(rate, burst)
        self.default, self.own = rate, own

    def step(self, ts: float, n: float = 1) -> bool:
        self.rate = self.own[0] if self.own and ts < self.own[1] else self.default
        return super().step(ts, n)
