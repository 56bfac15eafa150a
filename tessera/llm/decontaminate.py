"""Benchmark decontamination by a positional inverted index that is split by document.

`build` stores the postings of all training words as a table of segments (about 2 MB of text each): a
segment holds its documents' ids and word counts, its sorted terms (64-bit word hashes), and for each term
the ascending word positions; one position is left free between documents, so nothing matches across them.
`search` sends the benchmark's word windows to the segments (in blocks of bounded size) and, in each,
begins with the rarest term's postings and intersects them with the others' lists shifted by the words'
offsets. Documents are never shuffled, so no term, passage or group of copies is gathered in one task.

Two different words share a hash with probability 2**-64; a false match takes that for every word of a window.

Defined cases: null or empty text has no words and no hits; items without words have no windows; an item of
fewer words than a window is one window; repeated rows and null ids are kept as rows; an item with a null id hits
words like any other and has no id to list; items that share an id are listed once; empty tables give no rows;
columns besides the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import raw, scratch, session, shared_dir, slices, staged, texts_of, without

SEGMENT_BYTES = 2 << 20
#: Text of benchmark items that is sent to the executors at once.
BLOCK_BYTES = 16 << 20
_SEGMENTS = "segment long, doc_ids binary, nulls binary, n_words binary, terms binary, first binary, postings binary"
_MATCHES = "doc_id long, item_id string, start long, size long"


def _postings(data: np.ndarray, offsets: np.ndarray) -> dict:
    w = words.split(data, offsets, "alnum", fold=True)
    h = w.hashes()
    position = np.arange(len(h)) + w.doc
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return {"n_words": np.diff(w.bounds).astype("<i4"), "terms": h[first], "first": np.append(first, len(h)).astype("<u4"), "postings": np.diff(position[order], prepend=0).astype("<i4")}


def build(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store the index of docs under path; returns its segments."""
    session(docs.sparkSession)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32  # unique once the table is written
        for b in batches:
            column = texts_of(b.column(1))
            data, offsets = raw(column)
            for i, j in slices(offsets, SEGMENT_BYTES):
                s = _postings(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                ids = b.column(0).slice(i, j - i)
                s |= {"doc_ids": ids.fill_null(0).to_numpy().astype("<i8"), "nulls": ids.is_null().to_numpy(zero_copy_only=False)}
                blobs = {c.split()[0]: pa.array([s[c.split()[0]].tobytes()], pa.binary()) for c in _SEGMENTS.split(", ")[1:]}
                yield pa.RecordBatch.from_pydict({"segment": pa.array([number], pa.int64())} | blobs)
                number += 1

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return staged(rows.mapInArrow(segments, _SEGMENTS), path)


class Segment:
    def __init__(self, row: dict) -> None:
        a = {k: np.frombuffer(row[k], t) for k, t in (("doc_ids", "<i8"), ("nulls", np.bool_), ("n_words", "<i4"), ("terms", "<u8"), ("first", "<u4"), ("postings", "<i4"))}
        self.doc_ids, self.nulls, self.n_words, self.terms = a["doc_ids"], a["nulls"], a["n_words"].astype(np.int64), a["terms"]
        self.first = a["first"].astype(np.int64)
        self.postings = np.cumsum(a["postings"], dtype=np.int64)
        #: Position of each document's first word.
        self.start = np.concatenate([[0], np.cumsum(self.n_words + 1)])
        self._keys = None

    @property
    def keys(self) -> np.ndarray:
        """Term and position of each posting as one number, ascending."""
        if self._keys is None:
            self._keys = (np.repeat(np.arange(len(self.terms)), np.diff(self.first)) << 32) | self.postings
        return self._keys

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, positions, "right") - 1


class Windows:
    """Word windows of benchmark items: indices into the sorted distinct terms, -1 behind a shorter window's end."""

    def __init__(self, items: list[tuple[str, str]], k: int) -> None:
        texts = texts_of(pa.array([t for _, t in items], pa.string()))
        data, offsets = raw(texts)
        w = words.split(data, offsets, "alnum", fold=True)
        h = w.hashes()
        self.items = [i for i, _ in items]
        at, size = [], []
        for i in range(len(items)):
            a, z = int(w.bounds[i]), int(w.bounds[i + 1])
            n = max(1, z - a - k + 1) if z > a else 0
            at.append(np.arange(a, a + n))
            size.append(np.full(n, min(k, z - a)))
        at, self.size = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (at, size))
        self.item = w.doc[at] if len(at) else np.zeros(0, np.int64)
        self.terms, index = np.unique(h, return_inverse=True)
        cells = at[:, None] + np.arange(k)
        inside = np.arange(k) < self.size[:, None]
        self.words = np.where(inside, index[np.minimum(cells, max(0, len(h) - 1))] if len(h) else 0, -1)


def phrases(s: Segment, q: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) of every exact occurrence of a window in the segment."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(s.terms) or not len(q.words):
        return none
    place = np.minimum(np.searchsorted(s.terms, q.terms), len(s.terms) - 1)
    there = np.append(s.terms[place] == q.terms, True)  # the last stands for -1
    live = np.flatnonzero(there[q.words].all(axis=1))
    if not len(live):
        return none
    w = q.words[live]
    term = np.append(place, 0)[w]
    count = np.where(w < 0, np.iinfo(np.int64).max, (s.first[1:] - s.first[:-1])[term])
    order = np.argsort(count, axis=1, kind="stable")  # rarest first, what is behind the end last
    rows = np.arange(len(live))
    rare = order[:, 0]
    n, begin = count[rows, rare], s.first[term[rows, rare]]
    row = np.repeat(rows, n)
    at = s.postings[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)] - rare[row]
    for j in range(1, w.shape[1]):
        keep = at >= 0
        row, at = row[keep], at[keep]
        if not len(row):
            return none
        off = order[row, j]
        wanted = (term[row, off] << 32) | (at + off)
        found = s.keys[np.minimum(np.searchsorted(s.keys, wanted), len(s.keys) - 1)] == wanted
        keep = found | (w[row, off] < 0)
        row, at = row[keep], at[keep]
    keep = at >= 0
    return live[row[keep]], at[keep]


def near(s: Segment, q: Windows, slop: int) -> list[tuple[int, int, int]]:
    """(window, first, last position) of the narrowest spans around each posting of a window's rarest term
    that hold all words of the window, in any order, in at most its size + slop words of one document."""
    out = []
    if not len(s.terms):
        return out
    place = np.minimum(np.searchsorted(s.terms, q.terms), len(s.terms) - 1)
    there = s.terms[place] == q.terms
    for i, cells in enumerate(q.words):
        distinct, need = np.unique(cells[cells >= 0], return_counts=True)
        if not len(distinct) or not there[distinct].all():
            continue
        lists = [s.postings[s.first[t] : s.first[t + 1]] for t in place[distinct]]
        width = int(q.size[i]) + slop
        for a in min(lists, key=len):
            d = int(s.document(np.array([a]))[0])
            lo, hi = max(int(s.start[d]), int(a) - width + 1), min(int(s.start[d + 1]) - 2, int(a) + width - 1)
            near_by = sorted((int(p), k) for k, x in enumerate(lists) for p in x[np.searchsorted(x, lo) : np.searchsorted(x, hi, "right")])
            best, left, have = None, 0, np.zeros(len(lists), int)
            for p, k in near_by:
                have[k] += 1
                while (have >= need).all():
                    first = near_by[left][0]
                    if first <= a <= p and p - first < width and (best is None or p - first < best[1] - best[0]):
                        best = (first, p)
                    have[near_by[left][1]] -= 1
                    left += 1
            if best and (i, *best) not in out[-3:]:
                out.append((i, *best))
    return out


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of about BLOCK_BYTES; only one block is on the driver at a time."""
    rows = items.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for b in range(n):
        yield [(r.k, r.t) for r in (rows if n == 1 else rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b)).collect()]


def search(index: DataFrame, items: DataFrame, size: int = 10, slop: int | None = None, key: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, start, size (in words) of each exact occurrence of an item's window, or, with slop,
    of each span that holds a window's words in any order within its size + slop words."""
    spark = index.sparkSession

    def one(block: list[tuple[str, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = Windows(sent.value, size)
            for row in _rows(batches):
                s = Segment(row)
                if slop is None:
                    win, at = phrases(s, q)
                    n = q.size[win]
                else:
                    win, at, last = np.array(near(s, q, slop), np.int64).reshape(-1, 3).T
                    n = last - at + 1
                if len(win):
                    d = s.document(at)
                    yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids[d], mask=s.nulls[d]), pa.array([q.items[i] for i in q.item[win]], pa.string()), pa.array(at - s.start[d]), pa.array(n)], names=["doc_id", "item_id", "start", "size"])

        return index.mapInArrow(matches, _MATCHES)

    out = spark.createDataFrame([], _MATCHES)
    for block in item_blocks(items, key, text):
        out = out.unionByName(one(block))
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(len(b)):
            yield b.slice(i, 1).to_pylist()[0]


def documents(index: DataFrame, items: DataFrame, size: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside exact occurrences of windows), items (sorted ids)."""
    spark = index.sparkSession
    schema = "doc_id long, segment long, row int, n_words long, spans array<struct<a:long,z:long>>, items array<string>"
    kind = pa.schema([("doc_id", pa.int64()), ("segment", pa.int64()), ("row", pa.int32()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def one(block: list[tuple[str | None, str]], hits_only: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = Windows(sent.value, size)
            for row in _rows(batches):
                s = Segment(row)
                win, at = phrases(s, q)
                if hits_only and not len(win):
                    continue
                hit = words.covered(at, q.size[win], int(s.start[-1]) + 1)
                edges = np.flatnonzero(np.diff(hit, prepend=False))
                a, z = edges[::2], edges[1::2]
                spans = [[] for _ in s.doc_ids]
                for d, x, y in zip(s.document(a), a, z, strict=True):
                    spans[d].append({"a": int(x - s.start[d]), "z": int(y - s.start[d])})
                found = [set() for _ in s.doc_ids]
                for d, i in set(zip(s.document(at).tolist(), q.item[win].tolist(), strict=True)):
                    if q.items[i] is not None:
                        found[d].add(q.items[i])
                n = len(s.doc_ids)
                out = pa.RecordBatch.from_arrays([pa.array(s.doc_ids, mask=s.nulls), pa.array(np.full(n, row["segment"])), pa.array(np.arange(n, dtype=np.int32)), pa.array(s.n_words), pa.array(spans, kind.field("spans").type), pa.array([sorted(x) for x in found], kind.field("items").type)], schema=kind)
                yield out.filter(pa.array([bool(x) for x in spans])) if hits_only else out

        return index.mapInArrow(run, schema)

    blocks = item_blocks(items, key, text)
    every = one(next(blocks, []), False)
    width = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.z - s.a)
    second = next(blocks, None)
    if second is None:
        return every.select("doc_id", "n_words", width.alias("n_hit"), "items")
    while second is not None:  # the first block's rows are all documents', later blocks' those with hits
        every = every.unionByName(one(second, True))
        second = next(blocks, None)
    joined = every.groupBy("segment", "row").agg(F.min("doc_id").alias("doc_id"), F.min("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    union = F.aggregate("s", start, lambda x, s: F.struct((x.n + F.greatest(F.lit(0).cast("long"), s.z - F.greatest(s.a, x.end))).alias("n"), F.greatest(x.end, s.z).alias("end")), lambda x: x.n)
    return joined.select("doc_id", "n_words", union.alias("n_hit"), "items")


def keep_uncontaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """docs without those that hold a window of an item; null ids stay."""
    spark = session(docs.sparkSession)
    with scratch(spark):
        found = documents(build(docs, shared_dir(spark, "postings")), items, size).where("n_hit > 0 and doc_id is not null")
        return without(docs, found.select("doc_id"), "contaminated")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    session(spark)
    index = build(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark, "postings"))
    found = documents(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
