"""Rules of the operators that SQL doesn't hold: errors, orders of steps, states, files, streams."""

import collections
import datetime as dt
import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.functions import network, text
from tessera.operators import graph, images, listing, pipelines, policy, tables, tiering, upkeep, vectors
from tessera.sources.shared import shared_folder
from tessera.streaming import access, caches, limiters


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_filters_that_cannot_be_read(spark):
    for bad in ("size <", "size < x", "(size < 1", "colour = red", "key < 3", "size ~ 3", "size < 1KB extra"):
        with pytest.raises(pipelines.FilterError):
            pipelines.condition(bad)
    assert pipelines.parse_filter("a = 1 or b = 2 and c = 3") == ["or", ["a", "=", "1"], ["and", ["b", "=", "2"], ["c", "=", "3"]]]


def _object(spark, content="x 4111111111111234 y", kind="text/plain"):
    return spark.createDataFrame([("k/a", "b", content, len(content), kind, {"old": "1"})], "key string, bucket string, content string, size long, content_type string, metadata map<string,string>")


def test_steps_inline_fail_and_skip(spark):
    def shout(params):
        return pipelines.Result(F.lit(None).cast("string"), pipelines._map(by="shout", pii_redacted="late"), F.upper("content"), F.lit("text/html"))

    plugins = pipelines.register("shout", shout)
    run = lambda *steps: pipelines.execute(_object(spark), pipelines.Pipeline("p", steps=[pipelines.Step(**s) for s in steps]), plugins).first()
    r = run({"name": "a", "plugin": "encrypt_pii", "inline": True}, {"name": "b", "plugin": "shout", "output": "{dir}new-{uuid}"}, {"name": "c", "plugin": "nothing"})
    assert r.outputs[0].content == "X 41************34 Y" and r.outputs[0].key.startswith("k/new-") and r.outputs[0].key.endswith(".html")
    assert r.metadata == {"pii_redacted": "late", "by": "shout"} and [s.status for s in r.steps] == ["completed", "completed", "failed"] and r.status == "completed"
    r = run({"name": "a", "plugin": "pdf_to_text", "on_error": "fail"}, {"name": "b", "plugin": "shout"})
    assert (r.status, r.error, len(r.steps), r.metadata) == ("failed", "unsupported content", 1, {})
    r = run({"name": "a", "plugin": "pdf_to_text", "on_error": "skip"}, {"name": "b", "plugin": "image_resize"}, {"name": "c", "plugin": "shout"})
    assert [s.status for s in r.steps] == ["skipped", "failed", "completed"] and r.status == "completed"


def test_pipelines_come_by_priority(spark):
    made = pipelines.load(json.dumps({"pipelines": [{"name": "a", "filter": "size < 5"}, {"name": "b", "priority": 2, "steps": [{"name": "s", "plugin": "p", "tags": {}}]}, {"name": "c", "trigger": "on_get"}]}))
    assert [p.name for p in made] == ["b", "a", "c"]
    assert [r.pipeline for r in pipelines.match(_object(spark), made, "on_upload").collect()] == ["b"]
    assert pipelines.match(_object(spark), made, "on_delete").count() == 0


def test_pages_go_on_where_they_ended(spark):
    keys = ["a/1", "a/2", "b", "c/x/1", "c/x/2", "c/y", "d%e", "é/1"]
    rows = spark.createDataFrame([("k", x, 1) for x in keys], "bucket string, key string, size long")
    seen, token = [], ""
    while True:
        page = sorted(listing.list_page(rows, "k", "", "/", token, 2).collect())
        seen += [(r.entry, r.kind) for r in page]
        if not page or not page[0].truncated:
            break
        token = page[0].next_token
    assert seen == [("a/", "prefix"), ("b", "content"), ("c/", "prefix"), ("d%e", "content"), ("é/", "prefix")]
    assert [r.entry for r in listing.list_page(rows, "k", "c/", "/").collect()] == ["c/x/", "c/y"]
    assert listing.list_page(rows, "none").count() == 0 and [r.key for r in listing.list_objects(rows, "k", "d%").collect()] == ["d%e"]


def test_policies_of_any_spelling(spark):
    documents = [("a", '{"Statement": [{"Effect": "Deny", "not_action": ["s3:get"], "NotResource": "arn:x*"}]}'), ("b", "no json"), ("c", '{"statement": []}')]
    rows = policy.parse_policies(spark.createDataFrame(documents, "policy string, document string")).collect()
    assert [(r.policy, r.not_actions, r.not_resources, r.principals) for r in rows] == [("a", ["s3:get"], ["arn:x*"], None)]
    matches = lambda p, t: _one(spark, text.glob_match(F.lit(p), F.lit(t)))
    assert matches("a.b*", "a.bc") and not matches("a.b*", "aXbc") and matches("a?c", "a\nc") and not matches("a?c", "ac") and matches("(x)+*", "(x)+")


def test_conditions(spark):
    def holds(op, values, **context):
        rows = spark.createDataFrame([([(op, "k", values)], context)], "conditions array<struct<op: string, key: string, values: array<string>>>, context map<string,string>")
        return rows.select(policy.conditions_match(F.col("conditions"), F.col("context")).alias("x")).first().x

    assert holds("StringNotEquals", ["a"], k="b") and not holds("StringNotEquals", ["a"], other="b") and not holds("StringEquals", ["a"], k="")
    assert holds("DateGreaterThan", ["2024-01-01T00:00:00Z"], k="2024-01-01T01:00:00+01:00") and holds("DateLessThan", ["b"], k="a")
    assert holds("NotIpAddress", ["10.0.0.0/8"], k="11.0.0.1") and holds("Bool", ["TRUE"], k="true") and holds("Other", ["x"], k="x")


def test_table_changes(spark):
    t = spark.createDataFrame([("a", ["p", "q"]), ("b", None)], "name string, policies array<string>")
    asked = spark.createDataFrame([("a", "q"), ("b", "p"), ("b", "gone")], "name string, policy string")
    known = spark.createDataFrame([("p",), ("q",)], "policy string")
    assert {r.name: r.policies for r in tables.attach(t, asked, known, "name", "policies", "policy").collect()} == {"a": ["p", "q"], "b": ["p"]}
    assert {r.name: r.policies for r in tables.detach(t, asked, "name", "policies", "policy").collect()} == {"a": ["p"], "b": None}


def test_snapshot_and_restore(spark, sf):
    path = shared_folder(spark, "backup")
    nations = spark.read.parquet(f"{sf}/nation.parquet")
    upkeep.snapshot({"nation": nations}, path)
    assert sorted(upkeep.restore(spark, path, ("nation",))["nation"].collect()) == sorted(nations.collect())


def test_conflicts_that_fail(spark):
    at = dt.datetime(2024, 1, 1)
    copy = lambda rows: spark.createDataFrame([("b", k, v, at) for k, v in rows], "bucket string, key string, version string, modified_at timestamp")
    got = upkeep.resolve(copy([("x", "1"), ("y", "1")]), copy([("x", "1"), ("y", "2"), ("z", "3")]), "fail").collect()
    assert {(r.key, r.version) for r in got} == {("x", "1"), ("z", "3")}
    with pytest.raises(ValueError):
        upkeep.resolve(copy([]), copy([]), "newest")


def test_graph_recall(spark):
    """1,500 clustered vectors in several shards, two metrics, against the exact answer."""
    r = np.random.default_rng(0)
    x = r.normal(size=(30, 16))[r.integers(0, 30, 1500)] + 0.4 * r.normal(size=(1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, values array<double>")
    for metric in ("cosine", "euclidean"):
        found = graph.Graph.build(df, shared_folder(spark, "graph"), metric).search(df.where("id % 50 = 0"), 10).collect()
        got = collections.defaultdict(set)
        for row in found:
            got[row["query"]].add(row.id)
        rows = graph._rows(x, metric)
        hit = sum(len(got[q] & set(np.argsort(graph.distances(rows, rows[q], metric), kind="stable")[:10].tolist())) for q in range(0, 1500, 50))
        assert hit / 300 >= 0.9


def test_many_queries_stay_off_the_plan(spark, tmp_path):
    """2,000 queries in parts against all rows, exactly, with equal rows and a zero one; graph_recall of many queries is
    planned in parts as well (a plan with a branch a query took minutes and the driver's memory)."""
    r = np.random.default_rng(5)
    x = r.normal(size=(6000, 6))
    x[5990:] = x[:10] * 2  # equally near by cosine
    x[17] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, values array<double>").repartition(3)
    block, vectors.BLOCK = vectors.BLOCK, 40_000
    try:
        got = collections.defaultdict(list)
        for row in vectors.exact_neighbours(df, df.where("id % 3 = 0"), 7).collect():
            got[row["query"]].append((row.distance, row.id))
    finally:
        vectors.BLOCK = block
    u = graph._rows(x, "cosine")
    d = 1 - u @ u.T
    assert sorted(got) == list(range(0, 6000, 3))
    for q, rows in got.items():
        rows.sort()
        assert np.allclose([a for a, _ in rows], np.sort(d[q])[:7], atol=1e-12) and np.allclose([d[q, i] for _, i in rows], [a for a, _ in rows], atol=1e-12) and len({i for _, i in rows}) == 7
    n = 30_000
    spark.createDataFrame([(i, v.tolist(), i % 10) for i, v in enumerate(r.normal(size=(n, 6)).astype(np.float32))], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = queries.QUERIES["graph_recall"](spark, str(tmp_path))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 50_000
    assert [tuple(row) for row in df.collect()] == [(300, True)]


def test_links_are_the_nearest():
    """Links found by the least of groups against a full sort, with equal rows."""
    r = np.random.default_rng(6)
    x = r.normal(size=(700, 5))
    x[300:420] = x[7]
    for metric in ("cosine", "euclidean", "dot"):
        rows = graph._rows(x, metric)
        made = graph.link(rows, metric)
        for i in range(0, 700, 7):
            d = graph.distances(rows, rows[i], metric)
            d[i] = np.inf
            linked = made[i, : graph.M0]
            assert np.allclose(np.sort(d[linked[linked >= 0]])[: graph.M], np.sort(d)[: graph.M], atol=1e-6)


def test_trained_lists(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(20, 8))[r.integers(0, 20, 800)] * 3 + 0.2 * r.normal(size=(800, 8))
    df = spark.createDataFrame([(i, v.tolist(), {"g": str(i % 3)}) for i, v in enumerate(x)], "id long, values array<double>, metadata map<string,string>")
    index = vectors.IvfPq.build(df, shared_folder(spark, "ivf"), clusters=20, slices=4, entries=32, rounds=5)
    assert sum(r.n for r in index.sizes().collect()) == 800
    exact = {r.id for r in vectors.search(df, x[3].tolist(), 10, "euclidean").collect()}
    assert len(exact & {r.id for r in index.search(x[3].tolist(), 10, 6, rerank=True).collect()}) >= 9
    assert index.search(x[3].tolist(), 300, 1, {"g": "1"}).count() == 267
    with pytest.raises(ValueError):
        vectors.IvfPq.build(df, "unused", slices=3)


def test_lists_searched_exactly(spark):
    """The probed list holds k rows, but nearer ones stand in other lists; lists that can't hold any aren't read."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(1500, 4)), r.normal(size=(20, 4)) + 50])
    x[700:710] = x[40]  # equal rows go by id
    df = spark.createDataFrame([(i, v.tolist(), {"g": str(i % 3)}) for i, v in enumerate(x)], "id long, values array<double>, metadata map<string,string>")
    centers = np.concatenate([x[:8], x[-1:], x[:1]])  # one center twice
    index = vectors.IvfPq(spark, shared_folder(spark, "ivf"), centers, [x[:16, s : s + 1] for s in range(4)])
    index.add(df)
    probed = {i.id for i in index.lists().where("metadata['g'] = '1'").select("id", "cluster").collect() if i.cluster == vectors.near_clusters(list(enumerate(centers.tolist())), x[40].tolist(), 1)[0]}
    assert len(probed) >= 12
    for q in (x[40], x[1510], np.zeros(4)):
        for g in (None, {"g": "1"}):
            want = sorted((float(np.sqrt(((x[i] - q) ** 2).sum())), i) for i in range(len(x)) if g is None or i % 3 == 1)[:12]
            got = index.search(q.tolist(), 12, 1, g, exact=True).collect()
            assert [r.id for r in got] == [i for _, i in want]
            assert np.allclose([r.score for r in got], [1 / (1 + d) for d, _ in want])
    for q in (x[40], np.zeros(4)):
        low, nearest = index.bounds(q.tolist()), collections.defaultdict(lambda: np.inf)
        for row in index.lists().collect():
            nearest[row.cluster] = min(nearest[row.cluster], float(np.sqrt(((np.array(row["values"]) - q) ** 2).sum())))
        assert all(low[c] <= d for c, d in nearest.items()) and low[8] > 20
    few = index.search(x[40].tolist(), 12, 1, {"g": "1"}, rerank=True).collect()
    assert {r.id for r in few} <= probed


def test_assignment_to_many_centers_is_planned_fast(spark):
    import time

    r = np.random.default_rng(0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(5, 768)))], "id long, values array<double>")
    centers = list(enumerate(r.normal(size=(1024, 768)).tolist()))
    began = time.perf_counter()
    placed = vectors.assign(df, centers)
    assert time.perf_counter() - began < 2 and placed.count() == 5


def test_embedding_providers(spark):
    df = spark.createDataFrame([("ab",), ("ab",), ("é",)], "t string")
    assert df.select(vectors.provider("")(F.col("t")).alias("v")).first().v == vectors.embed_one("ab")
    made = df.select(vectors.provider("api", lambda ts: [[float(len(t))] for t in ts])(F.col("t")).alias("v")).collect()
    assert [r.v for r in made] == [[2.0], [2.0], [1.0]]
    for name in ("api", "clip"):
        with pytest.raises(ValueError):
            vectors.provider(name)


def _plain_lru(trace, most, ttl):
    """Outcomes by a list that is kept in order of use."""
    held, out = [], {}
    for ts, i, item, size, op in trace:
        there = next((h for h in held if h[0] == item), None)
        if op == "delete":
            held = [h for h in held if h[0] != item]
            out[i] = "deleted"
            continue
        if op == "get" and there and ts - there[2] <= ttl:
            held.remove(there)
            held.append(there)
            out[i] = "hit"
            continue
        held = [h for h in held if h[0] != item]
        while held and sum(h[1] for h in held) + size > most:
            held.pop(0)
        held.append((item, size, ts))
        out[i] = "miss" if op == "get" else "put"
    return out


def test_caches_against_lists(spark, sf):
    from tessera.plans.upkeep import trace

    rows = collections.defaultdict(list)
    for r in trace(spark, sf).collect():
        rows[r.key].append((r.ts.replace(tzinfo=dt.timezone.utc).timestamp(), r.id, r.item, r.size, r.op))
    want = {}
    for t in rows.values():
        want |= _plain_lru(sorted(t), 700, 86400 * 3)
    got = caches.replay(trace(spark, sf), lambda: caches.LruCache(700, 86400 * 3)).collect()
    assert {r.id: r.outcome for r in got} == want
    c = caches.OldestCache(2, 10)
    assert [c.step(t, i, 1, "get") for t, i in ((0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "a"), (20, "a"))] == ["miss", "miss", "hit", "miss", "miss", "miss"]


def test_limiters_against_plain_loops(spark, sf):
    """The registered folds against loops over the sorted events of each user."""
    rows = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/events.parquet").collect():
        rows[str(r.user_id)].append((r.ts.replace(tzinfo=dt.timezone.utc).timestamp(), r.event_id, r.value, r.event_type == "error"))
    bucket, window, lock, bytes_, breaker = {}, {}, {}, {}, {}
    for user, events in rows.items():
        events.sort(key=lambda e: e[:2])
        tokens, last, admitted, fails, until = 3.0, None, [], [], -1.0
        left, seen, opened, trial = 300.0, [], None, 0
        for ts, i, size, failed in events:
            left = left if last is None else min(300.0, left + (ts - last) * 1e-3)
            bytes_[i] = left >= size
            left -= size * bytes_[i]
            # closed while opened is null; open for a day; then two good ones close it, a bad one opens it again
            breaker[i] = opened is None or ts - opened >= 86400
            if breaker[i] and opened is not None:
                trial, opened = (0, ts) if failed else (trial + 1, opened)
                if trial == 2:
                    opened, trial, seen = None, 0, []
            elif breaker[i]:
                seen.append(failed)
                if sum(seen) >= 3 and sum(seen) >= 0.1 * len(seen):
                    opened, trial = ts, 0
            tokens = tokens if last is None else min(3.0, tokens + (ts - last) * 2e-5)
            last = ts
            bucket[i] = tokens >= 1
            tokens -= bucket[i]
            slot = ts // 8640
            window[i] = sum(1 for s in admitted if s > slot - 10) < 3
            if window[i]:
                admitted.append(slot)
            lock[i] = ts >= until
            if lock[i]:
                fails = [*fails, ts] if failed else []
                fails = [t for t in fails if t >= ts - 86400]
                if len(fails) >= 3:
                    until, fails = ts + 43200, []
    for name, want in (("limit_token_bucket", bucket), ("limit_sliding_window", window), ("login_lockout", lock), ("limit_bandwidth", bytes_), ("circuit_breaker", breaker)):
        assert {r.id: r.admitted for r in queries.QUERIES[name](spark, sf).collect()} == want, name


def test_stream_keeps_its_state_between_batches(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    schema = "key string, ts timestamp, n double, id long"
    batches = [[("a", at(0), 1.0, 1), ("a", at(1), 1.0, 2), ("b", at(0), 1.0, 3)], [("a", at(2), 1.0, 4), ("a", at(30), 1.0, 5), ("b", at(1), 1.0, 6)]]
    source = tmp_path / "in"
    source.mkdir()
    stream = limiters.stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), lambda: limiters.TokenBucket(0.1, 2))
    query = stream.writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"b{i}"))
            for f in (tmp_path / f"b{i}").glob("*.parquet"):
                f.rename(source / f"{i}-{f.name}")
            query.processAllAvailable()
        assert {r.id: r.admitted for r in spark.table("admitted").collect()} == {1: True, 2: True, 3: True, 4: False, 5: True, 6: True}
    finally:
        query.stop()


def test_tier_names_and_pins(spark):
    assert [_one(spark, tiering.number_of(F.lit(x))) for x in ("hot", "Warm", "ARCHIVE", "x")] == [0, 1, 3, 2]
    pins = spark.createDataFrame([("a", 5, True), ("b", 7, False)], "key string, priority int, fixed_tier boolean")
    asked = spark.createDataFrame([("a", False), ("c", True)], "key string, fixed_tier boolean")
    assert {tuple(r) for r in tiering.pin(pins, asked).collect()} == {("a", 5, False), ("b", 7, False), ("c", None, True)}


def test_times_and_addresses(spark):
    assert _one(spark, network.time_of(F.lit("2024-02-30T00:00:00Z"))) is None
    assert _one(spark, network.in_cidr(F.lit("999.1.1.1"), F.lit("0.0.0.0/0"))) is False
    assert _one(spark, network.in_cidr(F.lit("9.1.1.1"), F.lit("0.0.0.0/0"))) is True
    assert _one(spark, network.host_of(F.lit("HTTPS://u:p@Ex.Org:1/x"))) == "ex.org"


def test_sizes_beyond_64_bits(spark, tmp_path):
    """Sizes of 2**63 bytes and more are none; the others of the table stay."""
    read = lambda s: _one(spark, text.parse_size(F.lit(s)))
    assert read("8388607TB") == 8388607 << 40 and read("9007199254740991 kb") == 9007199254740991 << 10 and read("9223372036854775807") == 2**63 - 1
    assert [read(s) for s in ("8388608TB", "8589934592GB", "9223372036854775808", "-1KB")] == [None] * 4
    keys = [8388600, 8388614, 8388615, 8388616]  # remainders 3, 3, 4, 5
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.bytes for r in queries.QUERIES["size_literals"](spark, str(tmp_path)).collect()}
    assert [k % 7 for k in keys] == [3, 3, 4, 5] and got == {8388600: 8388600 << 40, 8388614: -1, 8388615: 8388615, 8388616: 8388616}


def test_ages_by_whole_seconds(spark, tmp_path):
    """A backup made within a second after the end of the retention counts as made at that second, as in the SQL."""
    end = dt.datetime(2024, 1, 16)
    times = [end + dt.timedelta(microseconds=m) for m in (-500_000, 0, 1, 500_000, 999_999, 1_000_000)] + [dt.datetime(1969, 12, 31, 23, 59, 58, 500_000)]
    con = duckdb.connect()
    con.execute("create table events (event_id bigint, ts timestamp)")
    con.executemany("insert into events values (?, ?)", list(enumerate(times)))
    con.execute(f"copy events to '{tmp_path}/events.parquet'")
    got = sorted(r.event_id for r in queries.QUERIES["backups_kept"](spark, str(tmp_path)).collect())
    assert got == sorted(i for (i,) in con.execute(queries.ORACLE_SQL["backups_kept"]).fetchall()) == [5]


def test_checksums_in_any_spelling(spark):
    data = F.lit("hello world").cast("binary")
    assert _one(spark, upkeep.base64_checksum(data, "crc32c")) == "yZRlqg=="
    for sent in ("c99465aa", "C99465AA", "yZRlqg=="):
        assert _one(spark, upkeep.put_outcome(data, F.lit(sent), F.lit("crc32c"), ("CRC32C",))) == "ok"
    assert _one(spark, upkeep.put_outcome(data, F.lit("yZRlqA=="), F.lit("CRC32C"), ("CRC32C",))) == "BadDigest"


def test_images(spark):
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 4):
        x = r.integers(0, 256, (13, 21, n), dtype=np.uint8)
        assert np.array_equal(images.decode_png(images.encode_png(x)), x)
    flat = np.full((40, 20, 3), 77, np.uint8)
    rows = [("a", images.encode_png(flat)), ("b", b"GIF89a" + bytes([5, 0, 9, 0])), ("c", b"no image"), ("d", None)]
    df = spark.createDataFrame(rows, "key string, content binary")
    assert {(i.key, i.format, i.width, i.height, i.color_model, i.has_alpha) for i in images.image_info(df).collect()} == {("a", "png", 20, 40, "rgb", False), ("b", "gif", 5, 9, "paletted", False), ("c", None, None, None, None, None), ("d", None, None, None, None, None)}
    made = {(m.key, m.name): m for m in images.pixels(df, {"small": (10, 10), "same": (0, 0)}).collect()}
    assert (made["a", "small"].width, made["a", "small"].height) == (5, 10) and np.all(images.decode_png(bytes(made["a", "small"].content)) == 77)
    assert made["a", "same"].height == 40 and made["b", "small"].error == "not a PNG image" and made["c", "same"].content is None
    # each filter of the format, against what the lines were made from
    x = r.integers(0, 256, (6, 5, 3), dtype=np.uint8).reshape(6, 15)
    for kind in range(5):
        above = np.zeros(15, int)
        for line in x.astype(int):
            left, corner = np.concatenate([np.zeros(3, int), line[:-3]]), np.concatenate([np.zeros(3, int), above[:-3]])
            p = left + above - corner
            near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
            sent = (line - {0: 0, 1: left, 2: above, 3: (left + above) // 2, 4: near}[kind]) % 256
            assert np.array_equal(images._unfilter(kind, sent.astype(np.uint8), above.astype(np.uint8), 3), line)
            above = line


def test_searches_are_bounded():
    assert vectors.request("q") == ("q", 20, 0.7) and vectors.request("q", "1000", "0.5") == ("q", 100, 0.5) and vectors.request("q", -1, "x") == ("q", 20, 0.7)
    for bad in ("", "x" * 10_001):
        with pytest.raises(ValueError):
            vectors.request(bad)


def test_untrained_lists_are_scanned(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0], {}) for i in range(30)], "id long, values array<double>, metadata map<string,string>")
    index = vectors.IvfPq(spark, shared_folder(spark, "ivf"))
    index.add(df.where("id < 20"))
    index.add(df.where("id >= 20"))
    assert [r.id for r in index.search([25.2, 0.0], 3).collect()] == [25, 26, 24]
    again = index.rebuild(shared_folder(spark, "ivf"), clusters=4, slices=2, entries=8, rounds=3)
    assert sum(r.n for r in again.sizes().collect()) == 30


def test_hotspots_of_a_stream(spark, tmp_path):
    at = lambda m, s=0: dt.datetime(2024, 1, 1, 0, m, s)
    schema = "object_key string, access_time timestamp"
    batches = [[("a", at(0, i)) for i in range(6)] + [("b", at(0, 0))], [("a", at(5, i)) for i in range(6)], [("a", at(16, i)) for i in range(4)]]
    source = tmp_path / "in"
    source.mkdir()
    stream = access.hotspots(spark.readStream.schema(schema).parquet(str(source)))
    query = stream.writeStream.format("memory").queryName("hot").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
            for f in (tmp_path / f"b{i}").glob("*.parquet"):
                f.rename(source / f"{i}-{f.name}")
            query.processAllAvailable()
        assert [(r.object_key, r.accesses) for r in spark.table("hot").collect()] == [("a", 12)]
    finally:
        query.stop()
