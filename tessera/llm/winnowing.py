"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; of every `window` consecutive ones the smallest is chosen, the
rightmost among equals; chosen hashes are kept with their positions. Two texts that share k + window - 1
code points in a row share a chosen hash there. A text shorter than a k-gram is one gram, one with fewer
grams than a window is one window, an empty text has no fingerprint hashes.

Defined cases: null text is empty; two empty fingerprints have likeness 1, an empty and another 0; equal texts
have equal fingerprints; rows are ordered by doc_id (descending, null last), then a hash of the text; the row after the
last is the first, so a single row follows itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import session, tasks_for, texts_of
from .words import mix, powers

U64 = np.uint64
K, WINDOW = 16, 16
_POSITION = U64((1 << 28) - 1)
_LOWEST = -(1 << 63)
#: Grams that are windowed at once; a position within has to fit into _POSITION.
BLOCK = 1 << 27


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, by position."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U64)
    n = len(c)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    k = min(k, n)
    up, down = powers(n + 1)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum((c + U64(1)) * U64(0x9FB21C651E98DF25) * up[:n], out=sums[1:])
    h = mix((sums[k:] - sums[:-k]) * down[: n - k + 1] + U64(k))
    if len(h) > BLOCK:  # windows of one block after another; blocks overlap by a window less one
        parts = [i + _chosen(h[i : i + BLOCK + window - 1], window) for i in range(0, len(h) - window + 1, BLOCK)]
        at = np.unique(np.concatenate(parts))
    else:
        at = _chosen(h, window)
    return h[at], at


def _chosen(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of each window, the rightmost among equals."""
    # position in the low bits, counted down: among equal hashes the rightmost is the smallest
    key = (h & ~_POSITION) | (_POSITION - np.arange(len(h), dtype=U64))
    if len(key) <= window:
        least = key.min(keepdims=True)
    else:
        least, have = key, 1
        while have < window:
            step = min(have, window - have)
            least, have = np.minimum(least[:-step], least[step:]), have + step
    at = (_POSITION - (least & _POSITION)).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    """32 hex digits that equal fingerprints share."""
    return hashlib.blake2b(hashes.tobytes() + positions.astype("<i8").tobytes(), digest_size=16).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted arrays of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    c = np.concatenate([a, b])
    c.sort(kind="stable")
    both = int((c[1:] == c[:-1]).sum())
    return both / (len(c) - both)


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes array<long> (the bits of unsigned hashes), positions array<long> of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [winnow(t, k, window) for t in texts_of(b.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.view(np.int64) for h, _ in made], pa.list_(pa.int64())), pa.array([p for _, p in made], pa.list_(pa.int64()))], names=["doc_id", "hashes", "positions"])

    return _rows(docs).mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


def _rows(docs: DataFrame) -> DataFrame:
    session(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


class Ranges:
    """Ranges of (doc_id, hash of text), ascending; an id that many rows share (or that is null) is split by the hash."""

    def __init__(self, quantiles: list[int]) -> None:
        self.ids, self.many = np.unique(np.array(quantiles, np.int64), return_counts=True)
        self.before = np.concatenate([[0], np.cumsum(self.many)])

    def __len__(self) -> int:
        return int(self.before[-1]) + 1

    def of(self, key: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        left, right = np.searchsorted(self.ids, key), np.searchsorted(self.ids, key, "right")
        many = np.where(right > left, np.append(self.many, 0)[left], 0)
        place = (hashes.view(U64) ^ U64(1 << 63)) / 2.0**64  # of the hash among all, from 0 to 1
        return self.before[left] + np.minimum(many, (place * (many + 1)).astype(np.int64))


def beside_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) dealt by ranges of doc_id, in descending order, each range (pid) ending with a copy (extra = 1) of
    the row that follows its last one.

    One shuffle of the texts. Ranges come from quantiles of doc_id and are dealt by number; only a range's largest key
    reaches the driver.
    """
    spark = docs.sparkSession
    rows, n = _rows(docs), tasks_for(spark)
    keyed = rows.withColumn("k", F.coalesce("doc_id", F.lit(_LOWEST).cast("long"))).withColumn("h", F.xxhash64("text"))
    ranges = Ranges(rows.select(F.coalesce("doc_id", F.lit(_LOWEST).cast("long")).alias("k")).agg(F.percentile_approx("k", [i / n for i in range(1, n)])).first()[0] or [] if n > 1 else [])

    @F.pandas_udf("long")
    def range_of(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(ranges.of(k.to_numpy(), h.to_numpy()), dtype="int64")

    tops = sorted((r.pid, r.top.k, r.top.h) for r in keyed.select(range_of("k", "h").alias("pid"), "k", "h").groupBy("pid").agg(F.max(F.struct("k", "h")).alias("top")).collect())
    full, ids, hashes = (np.array(x, np.int64) for x in (zip(*tops, strict=True) if tops else ([], [], [])))
    target = np.roll(full, -1)

    @F.pandas_udf("long")
    def also_to(k: pd.Series, h: pd.Series) -> pd.Series:
        at = np.searchsorted(full, ranges.of(k.to_numpy(), h.to_numpy()))
        return pd.Series(np.where((ids[at] == k.to_numpy()) & (hashes[at] == h.to_numpy()), target[at], -1), dtype="int64")

    places = F.array(F.struct(range_of("k", "h").alias("pid"), F.lit(0).alias("extra")), F.struct(also_to("k", "h").alias("pid"), F.lit(1).alias("extra")))
    marked = keyed.withColumn("places", places).select("doc_id", "text", "h", F.explode(F.filter("places", lambda p: p.pid >= 0)).alias("p"))
    dealt = marked.select("doc_id", "text", "p.pid", "p.extra", "h").repartitionById(len(ranges), F.col("pid").cast("int"))
    return dealt.sortWithinPartitions("pid", "extra", F.col("doc_id").desc_nulls_last(), F.desc("h"), "text")


def compare_with_next(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Per row: its fingerprint, that of its text with the last half replaced from the next row's, and likenesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last = None  # (pid, doc_id, text, hashes, positions, sorted distinct hashes) that waits for the row after it
        closed = None
        for b in batches:
            out = []
            for doc_id, text, pid, extra in zip(b.column(0).to_pylist(), texts_of(b.column(1)).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if extra and closed == pid:
                    continue
                h, at = winnow(text, k, window)
                now = (pid, doc_id, text, h, at, np.unique(h))
                if last is not None:
                    _, d, t, lh, lat, ls = last
                    half = len(t) // 2
                    edited = t[: len(t) - half] + text[:half]
                    eh, eat = winnow(edited, k, window)
                    out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), digest(lh, lat), digest(eh, eat), likeness(ls, np.unique(eh)), likeness(ls, now[5])))
                last = None if extra else now
                if extra:
                    closed = pid
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(list(zip(*out)) or [[]] * 7, kinds, strict=True)], names=names)

    return beside_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
