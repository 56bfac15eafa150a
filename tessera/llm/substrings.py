"""Substring dedup over a log-structured fingerprint index.

A window is `size` consecutive words. Every window is represented by a fingerprint: the smallest hash among
its runs of `gram` words (mixed once more, since minima crowd at the low end), so neighbouring windows share one and an
index holds about a fifth as many fingerprints as there are windows. The index is a log of batches. Each has

* units: about 4 MB of documents in doc_id order (the texts, for verification), and
* a run: the units' distinct fingerprints, sorted, immutable, dealt into buckets by hash range.

`append` merge-joins a batch's run with the earlier runs bucket by bucket; the units (new or old) that share
fingerprints then verify: their windows over shared fingerprints are compared by two independent 64-bit
hashes of the word sequence (128 bits), again bucket by bucket; the first unit in log order that has a window
keeps it. Answers travel as one bit for each fingerprint or window of a unit, not as rows. When more than
`fanout` runs stand in the log, they are compacted into one.

A task sends one row a bucket, with the entries of all its units (in parts of PART_ENTRIES entries), so a passage that every
unit has costs its bucket one entry a unit and no more rows than there are tasks. Every bucket has its own task: buckets
are told apart by partition number, not by hash, and none meets another by chance. Each phase is a table in the shared
folder, so lost executors cost their tasks only.

Batches have to come in ascending doc_id order. Defined cases: null or empty text has no words; null doc_ids
stand before all others; rows with one doc_id are one document as far as "smaller doc_id" goes; an empty
batch gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import raw, remove, scratch, session, shared_dir, slices, staged, tasks_for, texts_of

U64 = np.uint64
UNIT_BYTES = 4 << 20
RUN_ROW = 1 << 20
#: Entries of units that a task gathers before it sends them.
PART_ENTRIES = 4 << 20
_UNITS = "unit long, n_rows int, doc_ids binary, nulls binary, offsets binary, text binary"
_RUN = "bucket int, units binary, hashes binary, owner binary"
_PROOF = "bucket int, units binary, sizes binary, digests binary"
_BITS = "unit long, bucket int, bits binary"


def _bucket_edges(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each of 2**bits hash ranges begins."""
    tops = np.arange(1 << bits, dtype=U64) << U64(64 - bits) if bits else np.zeros(1, U64)
    return np.append(np.searchsorted(sorted_hashes, tops), len(sorted_hashes))


def _row(schema: str, **values) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(values[c.split()[0]], kinds[c.split()[1]]) for c in schema.split(", ")], names=[c.split()[0] for c in schema.split(", ")])


_SPREAD = U64(0xA0761D6478BD642F)


class Unit:
    """Documents of a unit and their windows."""

    def __init__(self, row: dict, size: int, gram: int) -> None:
        self.size, self.gram = size, gram
        self.offsets = np.frombuffer(row["offsets"], "<i8")
        self.data = np.frombuffer(row["text"], np.uint8)
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.nulls = np.frombuffer(row["nulls"], np.bool_)
        #: 0, 1, ... by doc_id; rows with one doc_id share a number.
        self.rank = np.cumsum(np.concatenate([[False], (self.doc_ids[1:] != self.doc_ids[:-1]) | (self.nulls[1:] != self.nulls[:-1])]))
        parts = []
        for i, j in slices(self.offsets):
            w = words.split(self.data[self.offsets[i] : self.offsets[j]], self.offsets[i : j + 1], "space")
            parts.append((w.starts + self.offsets[i], w.ends + self.offsets[i], w.doc + i, w.hashes(0), w.hashes(1)))
        self.starts, self.ends, self.doc, self.h1, self.h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.at = np.flatnonzero(self.doc[size - 1 :] == self.doc[: max(0, len(self.doc) - size + 1)]) if len(self.doc) >= size else np.zeros(0, np.int64)

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct fingerprints, sorted, and the place of each window's among them."""
        if not len(self.at):
            return np.zeros(0, U64), np.zeros(0, np.int64)
        g = words.rolled(self.h1, self.gram)
        n = self.size - self.gram + 1
        least = g[: len(g) - n + 1].copy()
        for j in range(1, n):
            np.minimum(least, g[j : len(g) - n + 1 + j], out=least)
        return np.unique(words.mix(least[self.at] ^ _SPREAD), return_inverse=True)

    def digests(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit digests of the windows numbered `which`, in two halves."""
        a, b = words.rolled(self.h1, self.size, 0), words.rolled(self.h2, self.size, 1)
        return a[self.at[which]], b[self.at[which]]


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index for each distinct pair, in order of the pairs, and each element's place among them."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(a) else np.zeros(0, bool)
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(len(b)):
            yield b.slice(i, 1).to_pylist()[0]


def _mask(answers: list[dict] | None, edges: np.ndarray) -> np.ndarray:
    """Bits that came back for each bucket, as one mask over the unit's sorted keys."""
    out = np.zeros(edges[-1], bool)
    for a in answers or []:
        i, j = edges[a["bucket"]], edges[a["bucket"] + 1]
        out[i:j] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=j - i).astype(bool)
    return out


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each bucket of a partition (as dealt by number, one has its own; fewer partitions may hold several)."""
    held: dict[int, list[dict]] = {}
    for row in _unit_rows(batches):
        held.setdefault(row["bucket"], []).append(row)
    yield from sorted(held.items())


class SubstringLog:
    """The index in a shared folder; see the module's text."""

    def __init__(self, spark: SparkSession, path: str, size: int = 50, gram: int = 5, fanout: int = 4, buckets: int | None = None) -> None:
        if gram > size:
            raise ValueError("gram must not exceed size")
        self.spark, self.path, self.size, self.gram, self.fanout = session(spark), path, size, gram, fanout
        self.bits = max(1, (buckets or tasks_for(spark)) - 1).bit_length()
        self.batches, self.runs, self.made = 0, [], 0

    def _table(self, name: str) -> str:
        self.made += 1
        return f"{self.path}/{name}-{self.made:04d}"

    def _units(self, docs: DataFrame, n: int) -> DataFrame:
        base = self.batches << 44

        def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = base + (TaskContext.get().partitionId() << 20)
            ids, texts = pa.array([], pa.int64()), pa.array([], pa.large_string())

            def out(i: int, j: int) -> pa.RecordBatch:
                nonlocal number
                data, offsets = raw(texts)
                number += 1
                return _row(_UNITS, unit=[number], n_rows=[j - i], doc_ids=[ids.slice(i, j - i).fill_null(0).to_numpy().astype("<i8").tobytes()], nulls=[ids.slice(i, j - i).is_null().to_numpy(zero_copy_only=False).tobytes()], offsets=[(offsets[i : j + 1] - offsets[i]).astype("<i8").tobytes()], text=[data[offsets[i] : offsets[j]].tobytes()])

            for b in batches:
                ids, texts = pa.concat_arrays([ids, b.column(0)]), pa.concat_arrays([texts, texts_of(b.column(1))])
                _, offsets = raw(texts)
                key = ids.fill_null(0).to_numpy()
                null = ids.is_null().to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero((key[1:] != key[:-1]) | (null[1:] != null[:-1])) + 1
                i = 0
                while offsets[-1] - offsets[i] > UNIT_BYTES:
                    fit = cuts[(cuts > i) & (offsets[cuts] - offsets[i] <= UNIT_BYTES)]
                    later = cuts[cuts > i]
                    if not len(later):
                        break
                    j = int(fit[-1]) if len(fit) else int(later[0])
                    yield out(i, j)
                    i = j
                ids, texts = ids.slice(i), texts.slice(i)
            if len(ids):
                yield out(0, len(ids))

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return staged(rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(units, _UNITS), self._table("units"), long_rows=True)

    def _run(self, units: DataFrame) -> DataFrame:
        size, gram, bits = self.size, self.gram, self.bits

        def rows(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            h, owner = np.concatenate([f for _, f in held]), np.repeat(np.arange(len(held), dtype="<u4"), [len(f) for _, f in held])
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            e, own = _bucket_edges(h, bits), np.array([u for u, _ in held], "<i8").tobytes()
            full = np.flatnonzero(e[1:] > e[:-1])
            return _row(_RUN, bucket=full.tolist(), units=[own] * len(full), hashes=[h[e[k] : e[k + 1]].tobytes() for k in full], owner=[owner[e[k] : e[k + 1]].tobytes() for k in full])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size_held = [], 0
            for row in _unit_rows(batches):
                held.append((row["unit"], Unit(row, size, gram).fingerprints()[0]))
                size_held += len(held[-1][1])
                if size_held > PART_ENTRIES:
                    yield rows(held)
                    held, size_held = [], 0
            if held:
                yield rows(held)

        return staged(units.mapInArrow(run, _RUN), self._table("run"))

    def _shared(self, new_from: int) -> DataFrame:
        """For each unit and bucket, which fingerprints another unit has too; at least one of them is new."""
        runs = self.runs[0]
        for r in self.runs[1:]:
            runs = runs.unionByName(r)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, rows in _by_bucket(batches):
                h, u = _entries(rows)
                order = np.lexsort((u, h))
                h, u = h[order], u[order]
                first = np.concatenate([[True], h[1:] != h[:-1]])
                group = np.cumsum(first) - 1
                shared = ((np.bincount(group) > 1) & (np.bincount(group, u >= new_from) > 0))[group]
                if not shared.any():
                    continue
                by = np.argsort(u, kind="stable")  # within a unit, still by hash
                cut = np.concatenate([[0], np.flatnonzero(np.diff(u[by])) + 1, [len(u)]])
                parts = [(int(u[by[i]]), shared[by[i:j]]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                parts = [p for p in parts if p[1].any()]
                yield _row(_BITS, unit=[p[0] for p in parts], bucket=[bucket] * len(parts), bits=[np.packbits(p[1]).tobytes() for p in parts])

        return staged(self._dealt(runs).mapInArrow(merge, _BITS), self._table("shared"))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartitionById(1 << self.bits, F.col("bucket"))

    def _first(self, units: DataFrame, shared: DataFrame) -> DataFrame:
        """For each unit and bucket, which of its windows over shared fingerprints an earlier unit has."""
        size, gram, bits = self.size, self.gram, self.bits

        def rows(held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            edges = [_bucket_edges(a, bits) for _, a, _ in held]
            out: dict[str, list] = {"bucket": [], "units": [], "sizes": [], "digests": []}
            for k in range(1 << bits):
                parts = [(u, a[e[k] : e[k + 1]], b[e[k] : e[k + 1]]) for (u, a, b), e in zip(held, edges, strict=True) if e[k] < e[k + 1]]
                if parts:
                    out["bucket"].append(k)
                    out["units"].append(np.array([p[0] for p in parts], "<i8").tobytes())
                    out["sizes"].append(np.array([len(p[1]) for p in parts], "<i8").tobytes())
                    out["digests"].append(np.stack([np.concatenate([p[i] for p in parts]) for i in (1, 2)]).tobytes())
            return _row(_PROOF, **out)

        def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size_held = [], 0
            for row in _unit_rows(batches):
                _, a, b, one, _ = _selected(Unit(row, size, gram), row["shared"], bits)
                held.append((row["unit"], a[one], b[one]))
                size_held += len(one)
                if size_held > PART_ENTRIES:
                    yield rows(held)
                    held, size_held = [], 0
            if held:
                yield rows(held)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, made in _by_bucket(batches):
                d = [np.frombuffer(r["digests"], "<u8").reshape(2, -1) for r in made]
                units, sizes = (np.concatenate([np.frombuffer(r[c], "<i8") for r in made]) for c in ("units", "sizes"))
                a, b, u = np.concatenate([x[0] for x in d]), np.concatenate([x[1] for x in d]), np.repeat(units, sizes)
                order = np.lexsort((u, b, a))
                a, b = a[order], b[order]
                later = np.empty(len(a), bool)
                later[order] = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])  # the first in log order keeps it
                cut = np.concatenate([[0], np.cumsum(sizes)])
                out = [(int(x), later[i:j]) for x, i, j in zip(units, cut[:-1], cut[1:], strict=True) if later[i:j].any()]
                yield _row(_BITS, unit=[x[0] for x in out], bucket=[bucket] * len(out), bits=[np.packbits(x[1]).tobytes() for x in out])

        made = units.join(_gathered(shared, "shared"), "unit").mapInArrow(proofs, _PROOF)
        return staged(self._dealt(made).mapInArrow(merge, _BITS), self._table("later"))

    def append(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """Add a batch; returns doc_id, text, n_words, n_removed, kept (words left, joined by one space) of its rows.
        After the last batch the runs are removed once they have been read: the log takes no more."""
        self.batches += 1
        new_from = self.batches << 44
        new = self._units(docs, tasks_for(self.spark))
        units = getattr(self, "units", None)
        self.units = new if units is None else units.unionByName(new)
        self.runs.append(self._run(new))
        shared = self._shared(new_from)
        if last:
            self._remove_runs()
        later = self._first(self.units, shared)
        size, gram, bits = self.size, self.gram, self.bits

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _unit_rows(batches):
                yield from _apply(Unit(row, size, gram), row["shared"], row["later"], bits)

        if len(self.runs) > self.fanout:
            self.compact()
        joined = new.join(_gathered(shared, "shared"), "unit", "left").join(_gathered(later, "later"), "unit", "left")
        return joined.mapInArrow(apply, "doc_id long, text string, n_words long, n_removed long, kept string")

    def _remove_runs(self) -> None:
        for f in {x.rsplit("/", 1)[0] for r in self.runs for x in r.inputFiles()}:
            remove(self.spark, f)
        self.runs = []

    def compact(self) -> None:
        """Merge all runs into one, whose rows hold at most RUN_ROW sorted fingerprints and the units that have them."""
        runs = self.runs[0]
        for r in self.runs[1:]:
            runs = runs.unionByName(r)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, rows in _by_bucket(batches):
                h, u = _entries(rows)
                order = np.lexsort((u, h))
                h, u = h[order], u[order]
                for i in range(0, len(h), RUN_ROW):
                    names, owner = np.unique(u[i : i + RUN_ROW], return_inverse=True)
                    yield _row(_RUN, bucket=[bucket], units=[names.astype("<i8").tobytes()], hashes=[h[i : i + RUN_ROW].tobytes()], owner=[owner.astype("<u4").tobytes()])

        merged = staged(self._dealt(runs).mapInArrow(merge, _RUN), self._table("run"))
        self._remove_runs()
        self.runs = [merged]


def _entries(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of run rows, and the unit of each."""
    h, u = [], []
    for r in rows:
        x, names = np.frombuffer(r["hashes"], "<u8"), np.frombuffer(r["units"], "<i8")
        h.append(x)
        u.append(names[np.frombuffer(r["owner"], "<u4")] if r["owner"] else np.full(len(x), names[0]))
    return np.concatenate(h), np.concatenate(u)


def _gathered(bits: DataFrame, name: str) -> DataFrame:
    """One row a unit: its buckets' bits (about a byte for 8 of the unit's keys). Joined by hash, as units' texts are rows of
    megabytes, which a merge would sort."""
    return bits.groupBy("unit").agg(F.collect_list(F.struct("bucket", "bits")).alias(name)).hint("shuffle_hash")


def _selected(u: Unit, shared: list[dict] | None, bits: int):
    """Windows over shared fingerprints, their digests, one of each distinct digest in order, and places."""
    f, place = u.fingerprints()
    which = np.flatnonzero(_mask(shared, _bucket_edges(f, bits))[place]) if len(f) else np.zeros(0, np.int64)
    a, b = u.digests(which)
    return (which, a, b, *_distinct(a, b))


def _apply(u: Unit, shared: list[dict] | None, later: list[dict] | None, bits: int) -> Iterator[pa.RecordBatch]:
    dup = np.zeros(len(u.at), bool)
    if len(u.at):
        a, b = u.digests(np.arange(len(u.at)))
        one, place = _distinct(a, b)
        dup = u.rank[u.doc[u.at]] > u.rank[u.doc[u.at[one]]][place]  # an earlier document of this unit has it
        if later:
            which, a, b, one, place = _selected(u, shared, bits)
            dup[which] |= _mask(later, _bucket_edges(a[one], bits))[place]
    gone = words.covered(u.at[dup], u.size, len(u.starts))
    n = np.bincount(u.doc, minlength=len(u.doc_ids))
    removed = np.bincount(u.doc[gone], minlength=len(u.doc_ids))
    # kept words and the byte behind each, which is a separator or another document's first byte
    data = np.append(u.data, np.uint8(0x20))
    keep = np.zeros(len(data) + 1, np.int8)
    s, e = u.starts[~gone], u.ends[~gone]
    np.add.at(keep, s, 1)
    np.add.at(keep, e, -1)
    mask = np.cumsum(keep[:-1]) > 0
    tail = u.offsets[1:][u.doc[~gone]]
    inner = e[e < tail]
    mask[inner] = True
    data[inner] = 0x20
    sizes = np.concatenate([[0], np.cumsum(mask)])[u.offsets]
    out = data[mask].tobytes()
    text = u.data.tobytes()
    kept = [out[i:j].removesuffix(b" ").decode() for i, j in zip(sizes[:-1], sizes[1:], strict=True)]
    whole = [text[i:j].decode() for i, j in zip(u.offsets[:-1], u.offsets[1:], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(u.doc_ids, pa.int64(), mask=u.nulls), pa.array(whole, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "text", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, size: int = 50, gram: int = 5, batches: int = 1) -> DataFrame:
    """All of docs against itself, appended to a new log in `batches` ranges of doc_id."""
    spark = session(docs.sparkSession)
    log = SubstringLog(spark, shared_dir(spark, "substrings"), size, gram)
    if batches == 1:
        return log.append(docs, last=True)
    at = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / batches for k in range(1, batches)])).first()[0] or []
    edges, out, low = sorted(set(at)), None, None
    for high in [*edges, None]:
        part = docs
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where((F.col("doc_id") <= high) | (F.col("doc_id").isNull() if low is None else F.lit(False)))
        elif low is None:
            part = docs
        made = log.append(part, last=high is None)
        out, low = made if out is None else out.unionByName(made), high
    return out


def remove_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """docs without the words of repeated passages; a text that loses words has its others joined by one space.

    Rows with a null doc_id keep their text. Rows that share a doc_id are one document for "smaller doc_id", and each
    loses what its own text repeats: results are joined by doc_id and the text's digest.
    """
    key = [F.col("doc_id").cast("long").alias("__id"), F.md5(F.col("text").cast("string").cast("binary")).alias("__text")]
    with scratch(docs.sparkSession):
        found = dedup(docs, size).where("n_removed > 0 and doc_id is not null").select(*key, F.col("kept").alias("__kept"))
        changed = staged(found.dropDuplicates(["__id", "__text"]), shared_dir(docs.sparkSession, "passages-out", keep=True))
    joined = docs.select("*", *key).join(changed, ["__id", "__text"], "left").withColumn("text", F.coalesce("__kept", "text"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("__kept").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=13, gram=5, batches=2)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
