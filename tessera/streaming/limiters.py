"""Admission machines whose state depends on what they rejected: ordered folds for each key.

Each fold is a plain Python class with `step(ts, n)`; `fold` runs it in batch over sorted rows that stream by (a
key's rows are never collected), `stream` with the state of Structured Streaming.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TokenBucket:
    """Refills by rate a second up to burst; admits n if as many tokens are there."""

    def __init__(self, rate: float, burst: float) -> None:
        self.rate, self.burst, self.tokens, self.at = rate, burst, burst, None

    def step(self, ts: float, n: float = 1) -> bool:
        if self.at is not None:
            self.tokens = min(self.burst, self.tokens + max(0.0, ts - self.at) * self.rate)
        self.at = ts
        ok = self.tokens >= n
        self.tokens -= n if ok else 0
        return ok


class SlidingWindow:
    """At most `limit` admitted in the last `duration` seconds, counted in slots of `precision`; rejections don't count."""

    def __init__(self, duration: float, precision: float, limit: int) -> None:
        self.duration, self.precision, self.limit, self.slots = duration, precision, limit, deque()

    def step(self, ts: float, n: float = 1) -> bool:
        slot = ts // self.precision
        while self.slots and self.slots[0][0] <= slot - self.duration / self.precision:
            self.slots.popleft()
        if sum(c for _, c in self.slots) + n > self.limit:
            return False
        if self.slots and self.slots[-1][0] == slot:
            self.slots[-1][1] += n
        else:
            self.slots.append([slot, n])
        return True


class Lockout:
    """`fails` failures (n > 0) within `window` seconds block for `block` seconds; a success (n = 0) clears."""

    def __init__(self, fails: int = 5, window: float = 900, block: float = 900) -> None:
        self.fails, self.window, self.block, self.seen, self.until = fails, window, block, deque(), None

    def step(self, ts: float, n: float = 1) -> bool:
        if self.until is not None and ts < self.until:
            return False
        if not n:
            self.seen.clear()
            return True
        self.seen.append(ts)
        while self.seen[0] < ts - self.window:
            self.seen.popleft()
        if len(self.seen) >= self.fails:
            self.until = ts + self.block
            self.seen.clear()
        return True


class Breaker:
    """Closed until `most` failures (n > 0) make a share of `threshold`; open for `timeout`; half-open until `successes`."""

    def __init__(self, most: int = 3, threshold: float = 0.5, timeout: float = 60, successes: int = 3) -> None:
        self.most, self.threshold, self.timeout, self.need = most, threshold, timeout, successes
        self.state, self.bad, self.all, self.good, self.since = "closed", 0, 0, 0, 0.0

    def step(self, ts: float, n: float = 1) -> bool:
        if self.state == "open":
            if ts - self.since < self.timeout:
                return False
            self.state, self.good = "half-open", 0
        if self.state == "half-open":
            if n:
                self.state, self.since = "open", ts
            else:
                self.good += 1
                if self.good >= self.need:
                    self.state, self.bad, self.all = "closed", 0, 0
            return True
        self.all += 1
        self.bad += bool(n)
        if self.bad >= self.most and self.bad / self.all >= self.threshold:
            self.state, self.since = "open", ts
        return True


def fold(rows: DataFrame, make: Callable[[], object], key: str = "key", ts: str = "ts", n: str | None = None, tie: str = "id") -> DataFrame:
    """key, id, admitted of each row, in order of time within a key; one shuffle, one state at a time in memory."""
    at = (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("ts")
    picked = rows.select(F.col(key).cast("string").alias("key"), at, (F.col(n) if n else F.lit(1)).cast("double").alias("n"), F.col(tie).cast("long").alias("id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, machine = None, None
        for b in batches:
            out = []
            for k, t, m in zip(b["key"], b["ts"], b["n"], strict=True):
                if machine is None or k != last:
                    last, machine = k, make()
                out.append(machine.step(t, m))
            yield pd.DataFrame({"key": b["key"], "id": b["id"], "admitted": out})

    return picked.repartition("key").sortWithinPartitions("key", "ts", "id").mapInPandas(run, "key string, id long, admitted boolean")


def stream(rows: DataFrame, make: Callable[[], object]) -> DataFrame:
    """The same over a stream of (key, ts, n, id): rows of a batch in order of time, state kept between batches."""

    def run(key, frames, state):
        machine = pickle.loads(state.get[0]) if state.exists else make()
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        out = [machine.step(t.timestamp(), m) for t, m in zip(rows["ts"], rows["n"], strict=True)]
        state.update((pickle.dumps(machine),))
        yield pd.DataFrame({"key": key[0], "id": rows["id"], "admitted": out})

    return rows.groupBy("key").applyInPandasWithState(run, "key string, id long, admitted boolean", "machine binary", "append", "NoTimeout")
