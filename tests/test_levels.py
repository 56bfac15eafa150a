"""The limiter of several levels against one plain loop over all requests."""

import collections
import dataclasses

from tessera import queries
from tessera.streaming import levels
from tessera.streaming.limiters import SlidingWindow, TokenBucket

SCHEMA = "id long, ts timestamp, ip string, user string, bucket string, method string, bytes long, place long, k string"


def loop(rows, x):
    window = lambda n: SlidingWindow(x.window, x.precision, n)
    every, ips = window(x.requests), collections.defaultdict(lambda: window(x.ip_requests))
    users = collections.defaultdict(lambda: TokenBucket(x.user_rate, x.user_burst))
    buckets = collections.defaultdict(lambda: TokenBucket(x.bucket_rate, x.bucket_burst))
    sent = collections.defaultdict(lambda: TokenBucket(x.upload_rate, x.upload_burst))
    methods = {}
    out = {}
    for r in sorted(rows, key=lambda r: (r.ts, r.id)):
        t, ip, user, n = r.ts.timestamp(), r.ip or "", r.user or "", r.bytes or 0
        if ip in x.whitelist:
            out[r.id] = ("whitelist", ip, 0)
        elif not every.step(t):
            out[r.id] = ("global", "global", 1)
        elif not ips[ip].step(t):
            out[r.id] = ("ip", ip, 1)
        elif user not in ("", "anonymous") and not users[user].step(t):
            out[r.id] = ("user", user, 1)
        elif r.bucket and not buckets[r.bucket].step(t):
            out[r.id] = ("bucket", r.bucket, 1)
        elif r.method in x.methods and not methods.setdefault((r.method, user), TokenBucket(*x.methods[r.method])).step(t):
            out[r.id] = ("api", r.method, 1)
        elif n > 0 and x.upload_rate > 0 and r.method in ("PUT", "POST") and not sent[user].step(t, n):
            out[r.id] = ("bandwidth", user, int(n / x.upload_rate) + 1)
        else:
            out[r.id] = ("", "", 0)
    return out


def _check(df, limits):
    want = loop(df.collect(), limits)
    got = levels.decide(df, limits).collect()
    assert {r.id: (r.limit_type, r.limit_key, r.retry_after) for r in got} == want and len(got) == len(want)
    assert all(r.allowed == (r.limit_type in ("", "whitelist")) for r in got)
    return collections.Counter(x[0] for x in want.values())


def test_levels_on_events(spark, sf):
    limits = dataclasses.replace(queries.LEVELS, requests=25, ip_requests=4, bucket_rate=1e-6, bucket_burst=1)
    seen = _check(queries.level_requests(spark, sf), limits)
    assert set(seen) == {"", "whitelist", "global", "ip", "user", "bucket", "api", "bandwidth"}
    totals = levels.totals(levels.decide(queries.level_requests(spark, sf), limits)).first()
    assert totals.requests == sum(seen.values()) and totals.allowed == seen[""] + seen["whitelist"] and totals.api_rejected == seen["api"]


def test_levels_on_edge_cases(spark):
    import datetime

    at = [datetime.datetime(2024, 1, 1, 0, 0, i // 4) for i in range(40)]
    rows = [(i, t, [None, "a", "b"][i % 3], [None, "", "anonymous", "u"][i % 4], [None, "", "c"][i % 3], [None, "PUT", "GET", ""][i % 4 if i % 5 else 1], [None, 0, 7][i % 3], 1, "x") for i, t in enumerate(at)]
    limits = levels.Limits(requests=3, ip_requests=2, user_rate=0.3, user_burst=1, bucket_rate=0.2, bucket_burst=1, upload_rate=3, upload_burst=9)
    _check(spark.createDataFrame(rows, SCHEMA), limits)
    _check(spark.createDataFrame(rows, SCHEMA), dataclasses.replace(limits, upload_rate=0, whitelist=("a",)))
    none = spark.createDataFrame([], SCHEMA)
    assert levels.decide(none, limits).count() == 0 and levels.totals(levels.decide(none, limits)).first().requests == 0
