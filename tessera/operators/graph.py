"""Approximate search over a navigable graph, the reference's kind of default index, in shards.

Vectors are dealt into shards of at most SHARD rows by a hash of their ids. Within a shard every vector is linked to its M
nearest (found exactly, in blocks) and to those that have it among theirs, up to M0, the nearest first; a few far links
make the graph navigable. A shard is one row of a table. A search runs a beam over each shard, for many queries in step,
from the nearest of its entry points (every ENTRY-th row, compared in one product), and merges the shards' best: no shard
depends on another, so shards are searched, rebuilt and lost on their own. A task hands on k rows a query, however many
shards it searches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import _matrix, blocks, matches, merged, padded, unit

M, M0, FAR, ENTRY, SHARD, BEAM = 16, 32, 4, 4, 20_000, 50
#: Rows of its beam that a query expands at once; marks (a query and a row each) that searches in step hold.
STEP, MARKS = 32, 1 << 20
_SHARD = "shard int, ids binary, vectors binary, links binary"


def _rows(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as the metric compares them: by cosine they are scaled to 1 (zero vectors stay)."""
    return unit(x) if metric == "cosine" else x


def distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclidean":
        return np.sqrt(((x - q) ** 2).sum(axis=1))
    return (1 - x @ q) if metric == "cosine" else -(x @ q)


def link(x: np.ndarray, metric: str, seed: int = 0) -> np.ndarray:
    """Neighbours of each row, n by M0 + FAR, -1 where there are fewer."""
    n = len(x)
    near, far = min(M, n - 1), min(FAR, n - 1)
    out = np.full((n, M0 + FAR), -1, np.int32)
    if n < 2:
        return out
    x = _fast(x, metric)
    square = (x**2).sum(axis=1)
    first, gap = np.empty((n, near), np.int64), np.empty((n, near))
    groups = n // (8 * near)  # rows i, i + 8 * near, ... are a group; near groups have a row within the near-th least of their minima
    for i in range(0, n, 256):
        d = -(x[i : i + 256] @ x.T)
        if metric == "euclidean":
            d = square[i : i + 256, None] + square - 2 * -d  # alike from both ends
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        if groups > 1:
            least = d[:, : groups * 8 * near].reshape(len(d), groups, -1).min(axis=1)
            who, row = np.nonzero(d <= np.partition(least, near - 1, axis=1)[:, near - 1 : near])
            d, rows = padded(who, len(d), d[who, row], row)
        else:
            rows = np.broadcast_to(np.arange(n), d.shape)
        at = np.argpartition(d, near - 1, axis=1)[:, :near]
        first[i : i + 256], gap[i : i + 256] = np.take_along_axis(rows, at, axis=1), np.take_along_axis(d, at, axis=1)
    a = np.concatenate([np.repeat(np.arange(n), near), first.ravel()])
    b = np.concatenate([first.ravel(), np.repeat(np.arange(n), near)])
    d = np.tile(gap.ravel(), 2)
    order = np.lexsort((b, d, a))
    a, b = a[order], b[order]
    _, once = np.unique(a * n + b, return_index=True)
    once.sort()
    a, b = a[once], b[once]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out[a[place < M0], place[place < M0]] = b[place < M0]
    out[:, M0 : M0 + far] = np.random.default_rng(seed).integers(0, n, (n, far))
    return out


def _fast(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as links and beams compare them: those scaled to 1 fit single precision."""
    return x.astype(np.float32) if metric == "cosine" else x


def _each(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """The distance of each row of x from the same row of q."""
    if metric == "euclidean":
        return np.sqrt(((x - q) ** 2).sum(axis=-1))
    d = -np.einsum("...j,...j->...", x, q)
    return 1 + d if metric == "cosine" else d


def beams(x: np.ndarray, links: np.ndarray, q: np.ndarray, width: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Distances and rows of about the `width` nearest rows to each query, nearest first; inf and -1 where there are fewer.
    All queries go in step: each expands the nearest STEP rows of its beam that aren't expanded, until all are."""
    n, m = len(x), len(q)
    seen = np.full(m * n, -1, np.int32)
    best, row, fresh = np.full((m, width), np.inf, x.dtype), np.full((m, width), -1), np.zeros((m, width), bool)

    def offer(who: np.ndarray, new: np.ndarray) -> None:
        """Rows for queries, sorted by query: those not seen go into the beams."""
        key = who * n + new
        ok = np.flatnonzero(seen[key] < 0)
        key, at = key[ok], np.arange(len(ok), dtype=np.int32)
        seen[key] = at
        ok = ok[seen[key] == at]  # of equal ones the last
        who, new = who[ok], new[ok]
        d = _each(x[new], q[who], metric)
        ok = d < best[who, -1]
        who, new, d = who[ok], new[ok], d[ok]
        if not len(who):
            return
        own, place = np.unique(who, return_inverse=True)
        d, new = padded(place, len(own), d, new)
        d, new, f = np.hstack([best[own], d]), np.hstack([row[own], new]), np.hstack([fresh[own], new >= 0])
        order = np.argsort(d, axis=1, kind="stable")[:, :width]
        best[own], row[own], fresh[own] = (np.take_along_axis(c, order, axis=1) for c in (d, new, f))

    start = np.unique(np.linspace(0, n - 1, min(n, max(width, n // ENTRY))).astype(int))
    d = -(q @ x[start].T)
    if metric == "euclidean":
        d = (x[start] ** 2).sum(axis=1) + 2 * d
    some = min(width, len(start))
    offer(np.repeat(np.arange(m), some), start[np.argpartition(d, some - 1, axis=1)[:, :some].ravel()])
    active = np.arange(m)
    while len(active := active[fresh[active].any(axis=1)]):
        f = fresh[active]
        who, at = np.nonzero(f & (np.cumsum(f, axis=1) <= STEP))
        who = active[who]
        fresh[who, at] = False
        new = links[row[who, at]]
        there = new >= 0
        offer(np.repeat(who, there.sum(axis=1)), new[there].astype(np.int64))
    return best, row


class Graph:
    """A graph index in a folder."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "cosine") -> None:
        self.spark, self.path, self.metric = spark, path, metric

    @classmethod
    def build(cls, vectors: DataFrame, path: str, metric: str = "cosine") -> Graph:
        """Index vectors (id long, values); one shuffle by shard."""
        shards = max(1, -(-vectors.count() // SHARD))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for b in batches:
                numbers, ids, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))
                for s in np.unique(numbers):
                    held.setdefault(int(s), []).append((ids[numbers == s], x[numbers == s]))
            for s, parts in held.items():
                ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], _rows(x[order], metric)
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (ids.astype("<i8"), x.astype("<f8"), link(x, metric).astype("<i4"))]], names=["shard", "ids", "vectors", "links"])

        dealt = vectors.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "values").repartitionById(shards, F.col("shard"))
        dealt.mapInArrow(run, _SHARD).write.mode("overwrite").parquet(path)
        return cls(vectors.sparkSession, path, metric)

    def search(self, queries: DataFrame, k: int = 20, width: int = BEAM, vectors: DataFrame | None = None, filters: dict[str, str] | None = None) -> DataFrame:
        """query, id, distance of about the k nearest to each query (id, values): a beam of max(width, k) a shard. Filters
        over vectors (id, metadata) come behind the beam, so fewer than k may be left; without them none are lost."""
        index = self.spark.read.schema(_SHARD).parquet(self.path)
        if not filters:  # few tasks, so that each merges what its shards find
            index = index.coalesce(4 * self.spark.sparkContext.defaultParallelism)
        rows = None
        for ids, q in blocks(queries.select("id", "values")):
            sent = self.spark.sparkContext.broadcast((ids, _rows(q, self.metric)))
            found = index.mapInArrow(_searched(sent, k, max(width, k), self.metric, not filters), "query long, id long, distance double")
            rows = found if rows is None else rows.unionAll(found)
        if filters:
            rows = rows.join(vectors.where(matches(filters)).select("id"), "id", "left_semi")
        best = rows.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id"))), 1, k).alias("b"))  # k rows a task and query; with filters a beam a shard
        return best.select("query", F.explode("b").alias("b")).select("query", "b.id", "b.distance")


def _searched(sent, k: int, width: int, metric: str, merge: bool):
    """A beam over each shard for the queries sent: with merge the k nearest of a task's shards, else all that beams hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, q = sent.value
        out = lambda name, i, d: pa.RecordBatch.from_arrays([pa.array(name), pa.array(i), pa.array(d)], names=["query", "id", "distance"])
        top, who = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
        fast = _fast(q, metric)
        for b in batches:
            for r in range(len(b)):
                ids, x, links = (np.frombuffer(b.column(c)[r].as_buffer(), t) for c, t in ((1, "<i8"), (2, "<f8"), (3, "<i4")))
                x, links = x.reshape(len(ids), -1), links.reshape(len(ids), -1)
                near = _fast(x, metric)
                many = max(1, MARKS // len(ids))
                for i in range(0, len(q), many):
                    _, row = beams(near, links, fast[i : i + many], width, metric)
                    d = np.where(row >= 0, _each(x[row], q[i : i + many, None], metric), np.inf)
                    if merge:
                        top[i : i + many], who[i : i + many] = merged(np.hstack([top[i : i + many], d]), np.hstack([who[i : i + many], ids[row]]), k)
                    else:
                        name = np.broadcast_to(numbers[i : i + many, None], row.shape)
                        yield out(name[row >= 0], ids[row[row >= 0]], d[row >= 0])
        there = np.isfinite(top)
        yield out(np.broadcast_to(numbers[:, None], top.shape)[there], who[there], top[there])

    return run
