"""Vector search, exact and by inverted lists. Scores are doubles; ties go to the smaller id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 for unequal lengths."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths and for zero vectors."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    """The largest float for unequal lengths."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(total)).otherwise(F.lit(3.4028234663852886e38))


#: metric -> score of a pair of vectors, higher is nearer.
SCORES = {"cosine": cosine, "euclidean": lambda a, b: 1 / (1 + euclidean(a, b)), "dot": dot}


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def matches(filters: dict[str, str]) -> Column:
    """Every filtered key has the value; a missing key or map fails."""
    out = F.lit(True)
    for k, v in filters.items():
        out = out & F.coalesce(F.try_element_at("metadata", F.lit(k)) == v, F.lit(False))
    return out


#: Bytes of a search's text; results without a number, and at most; the least score without one.
MOST_QUERY, DEFAULT_K, MOST_K, DEFAULT_THRESHOLD = 10_000, 20, 100, 0.7


def request(text: str, top_k: str | int | None = None, threshold: str | float | None = None) -> tuple[str, int, float]:
    """A search's text, number of results (none or unreadable, or at most 0: 20; more than 100: 100) and least score."""
    if not text or len(text.encode()) > MOST_QUERY:
        raise ValueError(f"a search takes 1 to {MOST_QUERY} bytes of text")

    def read(value, kind, default):
        try:
            return kind(value)
        except (TypeError, ValueError):
            return default

    k = read(top_k, int, DEFAULT_K)
    return text, DEFAULT_K if k <= 0 else min(MOST_K, k), read(threshold, float, DEFAULT_THRESHOLD)


def search(vectors: DataFrame, query: list[float], k: int = 20, metric: str = "cosine", filters: dict[str, str] | None = None, threshold: float | None = None) -> DataFrame:
    """The k (1 to 100) nearest: filter, score, then a top-k that keeps k rows a task; no shuffle of the vectors."""
    k = max(1, min(100, k))
    scored = vectors.where(matches(filters or {})).select("id", SCORES.get(metric, cosine)(F.col("values"), literal(query)).alias("score"))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), "id").limit(k)


def hot_cold(vectors: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return vectors.withColumn("temperature", F.when(F.col("created_at") > F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)), "hot").otherwise("cold"))


def federated(vectors: DataFrame, query: list[float], as_of: str, k: int = 20, metric: str = "cosine") -> DataFrame:
    """Top-k of the hot and of the cold vectors, merged and cut again."""
    v = hot_cold(vectors, as_of)
    both = search(v.where("temperature = 'hot'"), query, k, metric).unionByName(search(v.where("temperature = 'cold'"), query, k, metric))
    return both.orderBy(F.desc("score"), "id").limit(k)


def _matrix(column) -> np.ndarray:
    """A column of equally long arrays as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to 1; zero rows stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


#: Bytes of queries that the driver and each task hold at once.
BLOCK = 64 << 20


def blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and values of queries (id, values) in parts of about BLOCK bytes, dealt by a hash of the ids; one at least."""
    n, width = queries.agg(F.count("*"), F.max(F.size("values"))).first()
    parts = max(1, -(-n * (width or 0) * 8 // BLOCK))
    for p in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).select("id", "values").toArrow().combine_chunks()
        x = [_matrix(c) for c in rows["values"].chunks if len(c)]
        yield rows["id"].to_numpy().astype(np.int64), np.concatenate(x) if x else np.zeros((0, 0))


def padded(who: np.ndarray, n: int, d: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """d and rows, sorted by who (0 to n - 1), as one line for each of n; inf and -1 behind."""
    many = np.bincount(who, minlength=n)
    at = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
    out, of = np.full((n, many.max(initial=0)), np.inf, d.dtype), np.full((n, many.max(initial=0)), -1)
    out[who, at], of[who, at] = d, rows
    return out, of


def merged(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least distances of each line and their ids; the smaller id goes first."""
    order = np.lexsort((ids, d), axis=1)[:, :k]
    return np.take_along_axis(d, order, axis=1), np.take_along_axis(ids, order, axis=1)


def exact_neighbours(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, id, distance (1 - cosine) of the k nearest rows (id, values) to each query (id, values). Every row is compared
    with every query: products in single precision leave out what is farther than the k-th found by more than
    their error, the others are worked out in doubles. A task hands on k rows a query."""
    rows = None
    for ids, q in blocks(queries):
        sent = vectors.sparkSession.sparkContext.broadcast((ids, unit(q)))
        few = vectors.select("id", "values").coalesce(4 * vectors.sparkSession.sparkContext.defaultParallelism)
        found = few.mapInArrow(_scanned(sent, k), "query long, id long, distance double")
        rows = found if rows is None else rows.unionAll(found)
    best = rows.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id"))), 1, k).alias("b"))  # k rows a task and query
    return best.select("query", F.explode("b").alias("b")).select("query", "b.id", "b.distance")


def _scanned(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, q = sent.value
        small, margin = q.astype(np.float32), np.float32(1e-6 + 2.4e-7 * q.shape[1])
        top, who = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
        for b in batches:
            ids, values = b.column(0).to_numpy(), unit(_matrix(b.column(1)))
            for j in range(0, len(b) if len(q) else 0, 4096):
                x = values[j : j + 4096]
                t = np.ascontiguousarray(x.astype(np.float32).T)
                for i in range(0, len(q), 512):
                    d = -(small[i : i + 512] @ t)
                    limit = top[i : i + 512, -1].astype(np.float32) - 1
                    if len(x) > k and not np.isfinite(limit).all():
                        limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
                    line, row = np.nonzero(d <= (limit + margin)[:, None])
                    if len(line):
                        own, place = np.unique(line, return_inverse=True)
                        d, of = padded(place, len(own), 1 - np.einsum("ij,ij->i", q[i + line], x[row]), ids[j + row])
                        top[i + own], who[i + own] = merged(np.hstack([top[i + own], d]), np.hstack([who[i + own], of]), k)
        there = np.isfinite(top)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(numbers[:, None], top.shape)[there]), pa.array(who[there]), pa.array(top[there])], names=["query", "id", "distance"])

    return run


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each row by L2 (the first of equally near ones) and its distance."""
    best = np.concatenate([(np.einsum("ij,ij->i", centers, centers) - 2 * x[i : i + 4096] @ centers.T).argmin(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])
    return best, np.sqrt(((x - centers[best]) ** 2).sum(axis=1))


def _with(vectors: DataFrame, schema: str, make) -> DataFrame:
    """vectors with columns made of `values` batch by batch; make gets the values' matrix and gives Arrow arrays."""
    names = vectors.columns
    at = names.index("values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = make(_matrix(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, *made.values()], names=[*names, *made])

    fields = T.StructType([*vectors.schema.fields, *T.StructType.fromDDL(schema).fields])
    return vectors.mapInArrow(run, fields)


def assign(vectors: DataFrame, centroids: list[tuple[int, list[float]]]) -> DataFrame:
    """Nearest centroid of each vector by L2; the first wins ties. The centroids are a model of fixed size (a matrix that
    is broadcast), so the plan doesn't grow with them and no vector is shuffled."""
    sent = vectors.sparkSession.sparkContext.broadcast((np.array([i for i, _ in centroids]), np.array([c for _, c in centroids], np.float64)))

    def make(x: np.ndarray) -> dict:
        numbers, centers = sent.value
        best, distance = nearest(x, centers) if len(x) else (np.zeros(0, np.int64), np.zeros(0))
        return {"cluster": pa.array(numbers[best], pa.int32()), "distance": pa.array(distance)}

    return _with(vectors, "cluster int, distance double", make)


def near_clusters(centroids: list[tuple[int, list[float]]], query: list[float], nprobe: int) -> list[int]:
    """The nprobe (at least one) clusters nearest to the query, the first of equally near ones first."""
    return [i for _, i in sorted((sum((x - y) ** 2 for x, y in zip(c, query, strict=True)), i) for i, c in centroids)[: max(1, nprobe)]]


def probe(vectors: DataFrame, centroids: list[tuple[int, list[float]]], query: list[float], nprobe: int = 10, k: int = 20) -> DataFrame:
    """Exact search within the nprobe clusters nearest to the query (at least one)."""
    listed = assign(vectors, centroids).where(F.col("cluster").isin(near_clusters(centroids, query, nprobe)))
    return search(listed, query, k, "euclidean")


def encode_pq(vectors: DataFrame, codebooks: list[list[list[float]]]) -> DataFrame:
    """codes: for each slice of the vector, the number of the nearest entry of its codebook; the first wins ties."""
    width = len(codebooks[0][0])
    sent = vectors.sparkSession.sparkContext.broadcast([np.array(b, np.float64) for b in codebooks])

    def make(x: np.ndarray) -> dict:
        books = sent.value
        if len(x) and x.shape[1] != width * len(books):
            raise ValueError(f"{x.shape[1]} dimensions aren't {len(books)} slices of {width}")
        codes = np.stack([nearest(x[:, s * width : (s + 1) * width], b)[0] for s, b in enumerate(books)], axis=1) if len(x) else np.zeros((0, len(books)), np.int64)
        return {"codes": pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32()))}

    return _with(vectors, "codes array<int>", make)


def lookup(codebooks: list[list[list[float]]], query: list[float]) -> list[list[float]]:
    """Squared distances of the query's slices to all entries of their codebooks."""
    width = len(codebooks[0][0])
    return [[sum((x - y) ** 2 for x, y in zip(c, query[s * width : (s + 1) * width], strict=True)) for c in book] for s, book in enumerate(codebooks)]


def adc(encoded: DataFrame, codebooks: list[list[list[float]]], query: list[float], k: int = 20) -> DataFrame:
    """Approximate search over codes: squared distances from one lookup table a query."""
    sent = encoded.sparkSession.sparkContext.broadcast(np.array(lookup(codebooks, query)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = _matrix(b.column(1)).astype(np.int64)
            total = sent.value[np.arange(codes.shape[1]), codes].sum(axis=1) if len(codes) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total)], names=["id", "distance"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "codes").mapInArrow(run, f"id {kind}, distance double").orderBy("distance", "id").limit(k)


def train(vectors: DataFrame, books: list[np.ndarray], rounds: int = 20) -> list[np.ndarray]:
    """Lloyd's rounds for the codebook of each slice at once, from given entries; an entry without vectors stays as it is.
    A task adds up its vectors by entry; only one sum an entry reaches the driver."""
    width = books[0].shape[1]
    for _ in range(rounds):
        sent = vectors.sparkSession.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            books = sent.value
            total = [np.zeros((len(b), width + 1)) for b in books]
            for batch in batches:
                x = _matrix(batch.column(0))
                for s, b in enumerate(books if len(x) else []):
                    part = x[:, s * width : (s + 1) * width]
                    own, _ = nearest(part, b)
                    np.add.at(total[s], own, np.column_stack([part, np.ones(len(part))]))
            for s, t in enumerate(total):
                at, pos = np.nonzero(t[:, -1:] * np.ones(width + 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s)), pa.array(at), pa.array(pos), pa.array(t[at, pos])], names=["s", "c", "pos", "x"])

        made = vectors.select("values").mapInArrow(sums, "s long, c long, pos long, x double").groupBy("s", "c", "pos").agg(F.sum("x").alias("x")).toArrow()
        new = [np.zeros((len(b), width + 1)) for b in books]
        for s, c, pos, x in zip(*(made[n].to_numpy() for n in ("s", "c", "pos", "x")), strict=True):
            new[s][c, pos] = x
        moved = [np.where(n[:, -1:] > 0, n[:, :-1] / np.maximum(n[:, -1:], 1), b) for n, b in zip(new, books, strict=True)]
        if all(np.array_equal(a, b) for a, b in zip(moved, books, strict=True)):
            break
        books = moved
    return books


def kmeans(vectors: DataFrame, centroids: list[list[float]], rounds: int = 20) -> list[list[float]]:
    """Lloyd's rounds from given centers; an empty cluster keeps its center."""
    return train(vectors, [np.array(centroids, np.float64)], rounds)[0].tolist()


def draw(vectors: DataFrame, n: int, seed: int = 0) -> np.ndarray:
    """n vectors drawn by a hash of their ids, alike for any partitioning: the start of a training."""
    rows = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).select("values").collect()
    return np.array([r["values"] for r in rows], np.float64)


class IvfPq:
    """Inverted lists of product-quantized vectors, stored by cluster, so that a search reads the lists it probes. Without
    centroids (before training) vectors are only stored, and a search scans them exactly."""

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray | None = None, books: list[np.ndarray] | None = None) -> None:
        self.spark, self.path, self.centroids, self.books = spark, path, centroids, books

    @classmethod
    def build(cls, vectors: DataFrame, path: str, clusters: int = 1024, slices: int = 64, entries: int = 256, rounds: int = 20) -> IvfPq:
        """Train on all vectors and store them with cluster and codes. The dimension has to be a multiple of slices."""
        first = draw(vectors, max(clusters, entries))
        if not len(first):
            raise ValueError("there are no vectors to train on")
        if first.shape[1] % slices:
            raise ValueError(f"{first.shape[1]} dimensions aren't {slices} equal slices")
        width = first.shape[1] // slices
        centroids = train(vectors, [first[:clusters]], rounds)[0]
        books = train(vectors, [first[:entries, s * width : (s + 1) * width] for s in range(slices)], rounds)
        index = cls(vectors.sparkSession, path, centroids, books)
        index.add(vectors)
        return index

    def add(self, vectors: DataFrame) -> None:
        """Store vectors under the trained centers; one shuffle by cluster keeps a list in few files, and large lists are split."""
        if self.centroids is None:
            vectors.withColumns({"codes": F.lit(None).cast("array<int>"), "cluster": F.lit(-1)}).write.mode("append").partitionBy("cluster").parquet(self.path)
            return
        numbered = [(i, c) for i, c in enumerate(self.centroids.tolist())]
        placed = encode_pq(assign(vectors, numbered).drop("distance"), [b.tolist() for b in self.books])
        salted = placed.repartition("cluster", F.pmod(F.xxhash64("id"), F.lit(8)))
        salted.write.mode("append").partitionBy("cluster").parquet(self.path)

    def rebuild(self, path: str, **sizes: int) -> IvfPq:
        """A new index under path, trained anew on the vectors of this one."""
        return IvfPq.build(self.lists().drop("cluster", "codes"), path, **sizes)

    def lists(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def sizes(self) -> DataFrame:
        return self.lists().groupBy("cluster").agg(F.count("*").alias("n"))

    def search(self, query: list[float], k: int = 20, nprobe: int = 10, filters: dict[str, str] | None = None, rerank: bool = False, exact: bool = False) -> DataFrame:
        """id, score (1 / (1 + distance)) of about the k nearest: filter, then distances from the lookup table over the
        probed lists; where they hold fewer than k rows, the other lists are scanned exactly. rerank gives the probed
        rows their exact distances. exact gives the k nearest of all rows: besides the probed lists, those are scanned that
        can hold a row as near as the k-th of the probed ones."""
        if self.centroids is None:
            return search(self.lists(), query, k, "euclidean", filters)
        probed = near_clusters(list(enumerate(self.centroids.tolist())), query, min(nprobe, len(self.centroids)))
        rows = self.lists().where(matches(filters or {})) if filters else self.lists()
        inside, outside = rows.where(F.col("cluster").isin(probed)), rows.where(~F.col("cluster").isin(probed))
        scan = lambda df: df.select("id", euclidean(F.col("values"), literal(query)).alias("distance"))
        if rerank or exact:
            found = scan(inside).orderBy("distance", "id").limit(k)
        else:
            found = adc(inside, [b.tolist() for b in self.books], query, k).select("id", F.sqrt("distance").alias("distance"))
        n, far = found.agg(F.count("*"), F.max("distance")).first()
        if n < k:
            found = found.unionByName(scan(outside))
        elif exact:
            reach = [int(i) for i in np.flatnonzero(self.bounds(query) <= far) if i not in probed]
            found = found.unionByName(scan(outside.where(F.col("cluster").isin(reach))).where(F.col("distance") <= far))
        return found.orderBy("distance", "id").limit(k).select("id", (1 / (1 + F.col("distance"))).alias("score"))

    def bounds(self, query: list[float]) -> np.ndarray:
        """The least distance from the query that a row of each list can have: a list's rows lie on its center's side of
        the plane halfway to any other center."""
        c, q = self.centroids, np.asarray(query, np.float64)
        square = ((c - q) ** 2).sum(axis=1)
        out = np.zeros(len(c))
        for i, center in enumerate(c):
            gap = np.sqrt(((c - center) ** 2).sum(axis=1))
            other = gap > 0
            out = np.maximum(out, np.where(other, (square - square[i]) / np.where(other, 2 * gap, 1), 0))
        return out * (1 - 1e-9) - 1e-9 * np.sqrt(square.max(initial=0))  # less than rounding can move a row across


def embed(text: Column, dim: int = 8) -> Column:
    """The deterministic test embedding: h = h*31 + code point + byte offset over 32 bits, then a linear generator."""
    m = 1 << 32
    step = lambda s, c: F.struct(F.pmod(s.h * 31 + F.ascii(c) + s.at, F.lit(m)).alias("h"), (s.at + F.octet_length(c)).alias("at"))
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("at"))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    multipliers, a, c = [], 1, 0
    for _ in range(dim):
        multipliers.append((a, c))
        a, c = a * 1103515245 % m, (c * 1103515245 + 12345) % m
    one = lambda h, a, c: (F.pmod(F.pmod(F.floor(h / 65536) * a, F.lit(65536)) * 65536 + (h % 65536) * a + c, F.lit(m)) % 1000) / 1000.0
    return once(F.aggregate(chars, start, step, lambda s: s.h), lambda h: F.array(*[one(h, a, c) for a, c in multipliers]))


def once(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def embed_one(text: str, dim: int = 8) -> list[float]:
    """The same embedding of one text, for a query."""
    h, at = 0, 0
    for c in text:
        h = (h * 31 + ord(c) + at) % (1 << 32)
        at += len(c.encode())
    out = []
    for _ in range(dim):
        out.append((h % 1000) / 1000.0)
        h = (h * 1103515245 + 12345) % (1 << 32)
    return out


def placeholder_embedding(text: Column, dim: int = 8) -> Column:
    """The hash-based stand-in for a model: dimension i hashes the text from seed i, v = (h % 10000 - 5000) / 10000, and all
    are divided by the sum of their squares."""
    m = 1 << 32
    step = lambda s, c: F.struct(F.pmod(s.h * 31 + F.ascii(c) + s.at, F.lit(m)).alias("h"), (s.at + F.octet_length(c)).alias("at"), F.pmod(s.p * 31, F.lit(m)).alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("at"), F.lit(1).cast("long").alias("p"))
    ends = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step)
    seeds = F.sequence(F.lit(0), F.lit(dim - 1))
    raw = once(ends, lambda e: F.transform(seeds, lambda i: (F.pmod(i * e.p + e.h, F.lit(m)) % 10000 - 5000) / 10000.0))  # seed i adds i * 31**n
    total = lambda r: F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x)
    return once(raw, lambda r: once(F.struct(r.alias("r"), total(r).alias("t")), lambda s: F.when(s.t > 0, F.transform(s.r, lambda x: x / s.t)).otherwise(s.r)))


def provider(name: str, call=None):
    """The embedding of a provider as a function of a text column: mock (also ""), onnx, or api and openai, which need a call
    (a function of texts that gives vectors) and run it on Arrow batches."""
    if name in ("", "mock"):
        return embed
    if name == "onnx":
        return placeholder_embedding
    if name in ("api", "openai"):
        if call is None:
            raise ValueError(f"{name} needs a call")
        return lambda text, dim=8: F.pandas_udf(lambda s: s.map(dict(zip(s.unique(), call(list(s.unique())), strict=True))), T.ArrayType(T.DoubleType()))(text)
    raise ValueError(f"unsupported embedding provider: {name}")


@F.pandas_udf(T.BinaryType())
def encode_vector(values: pd.Series) -> pd.Series:
    """Little-endian: the dimension as 32 bits, then the values as 32-bit floats."""
    return values.map(lambda v: None if v is None else np.uint32(len(v)).astype("<u4").tobytes() + np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decode_vector(data: pd.Series) -> pd.Series:
    """Null where the length isn't that of the dimension."""

    def one(b: bytes | None):
        if b is None or len(b) < 4 or len(b) != 4 + 4 * int(np.frombuffer(b[:4], "<u4")[0]):
            return None
        return np.frombuffer(b[4:], "<f4").astype(np.float64)

    return data.map(one)


def newest_vectors(vectors: DataFrame) -> DataFrame:
    """One vector for each object: that made last."""
    row = F.struct(*[c for c in vectors.columns if c not in ("bucket", "object_key")])
    return vectors.groupBy("bucket", "object_key").agg(F.max_by(row, F.struct("created_at", "id")).alias("v")).select("bucket", "object_key", "v.*")
