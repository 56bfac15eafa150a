"""MinHash near-dedup with an LSH forest.

A document's set is its distinct word shingles. Documents with one set form a class and go on as its smallest
doc_id. Links are found in two ways, the first fast and by chance, the second exact, so that together every pair
at the threshold is linked:

* Every class has MinHash labels for several trees; a tree's order sorts classes by their label sequence, and a
  class's candidates are its neighbours in that order: those with whom it shares a longest common prefix of LEAST
  labels or more, among the next REACH in the order, that agree in most of 64 one-byte labels of other trees. Next
  neighbours in the first EARLY trees are confirmed first; from then on only pairs between different known components
  are candidates, so a group of n near copies takes about n confirmations. What reach and labels miss here costs no link.
* Then every class is joined with the others by its rarest shingles. All sets are sorted by one order, by a table of
  counts and then by hash (any table gives the same links). Two sets of a and b shingles at the threshold t share at least
  o = ceil(t * (a + b) / (1 + t)), so the first that they share has at most a - o shingles before it in one set and
  b - o in the other. Only pairs of different components that share a shingle at such places are confirmed. In a group of
  edited copies the shingles of their edits come first and those that all have come last, so copies that aren't near
  enough meet at no such place, and the pairs don't grow with the square of the group.

Candidates are confirmed on full sets of 64-bit shingle hashes. A shingle's list of more than LIST classes is dealt as a
grid of blocks of it, so a task holds two blocks at most.

Orders are dealt by ranges that include the doc_id, so a region of any size is split; neighbours that a range's
end parts are compared in a second pass over the ends alone.

Defined cases: null or empty text, and text without words, has an empty set and links with nothing; a text
with fewer words than a shingle has its whole word sequence as one shingle; rows that share a doc_id are one
document, whose set is that of its row with the smallest digest of the set (n_shingles is each row's own); rows with a
null doc_id are kept and take part in no link (component_id null); an empty table
gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import raw, remove, scratch, session, shared_dir, slices, staged, tasks_for, texts_of, without
from .components import components

U64 = np.uint64
#: Trees, labels of each, least common prefix, neighbours looked at, one-byte labels of the check that have to agree.
TREES, DEPTH, LEAST, REACH, AGREE = 16, 8, 3, 8, 46
#: One-byte labels of the check, taken from the eight trees after a row's own.
CHECK = 64
#: Trees whose next neighbours are confirmed first.
EARLY = 4
#: Slots of the table of counts, and of each row that holds a part of it.
SLOTS, SLOT_ROW = 1 << 20, 1 << 16
#: Rows and pairs that the join by rare shingles takes at once; entries of a shingle's list from which it is split.
POSTINGS, PAIRS, LIST = 1 << 16, 1 << 20, 1 << 16
_ORDER = "tree int, hi long, lo long, id long, part long, sig binary"


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of rows, sorted within each row, and where each row's begin."""
    w = words.split(data, offsets, "space", fold=True)
    h, n = w.hashes(), len(offsets) - 1
    at = w.windows(k)
    g, doc = words.rolled(h, k)[at] if len(at) else np.zeros(0, U64), w.doc[at]
    count = np.diff(w.bounds)
    for i in np.flatnonzero((count > 0) & (count < k)):
        whole = words.rolled(h[w.bounds[i] : w.bounds[i + 1]], int(count[i])) ^ U64(count[i])
        g, doc = np.append(g, whole), np.append(doc, i)
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])]) if len(g) else np.zeros(0, bool)
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(n + 1))


def _label_keys(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(1000))
    return r.integers(0, 1 << 63, n, dtype=U64), r.integers(0, 1 << 63, n, dtype=U64) * U64(2) + U64(1)


def labels(g: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """n MinHash labels of 16 bits for each non-empty row."""
    xor, times = _label_keys(n)
    out, buffer = np.empty((len(bounds) - 1, n), U64), np.empty_like(g)
    for t in range(n):
        np.bitwise_xor(g, xor[t], out=buffer)
        np.multiply(buffer, times[t], out=buffer)
        out[:, t] = np.minimum.reduceat(buffer, bounds[:-1])
    return (words.mix(out) >> U64(48)).astype(">u2")


def _digests(g: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits of each row's set, none of an empty one's."""
    out, full = [b""] * (len(bounds) - 1), np.flatnonzero(np.diff(bounds))
    if len(full):
        at = bounds[:-1][full]
        x, y = np.add.reduceat(words.mix(g), at), np.add.reduceat(words.mix(g ^ U64(0x5851F42D4C957F2D)), at)
        for r, d in enumerate(full):
            out[d] = x[r].tobytes() + y[r].tobytes()
    return out


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, same (128 bits that equal sets share), labels of each row with a doc_id; and each task's
    table of how often it saw shingles (255 at most), in rows without a doc_id: n_shingles is their place, same the counts."""
    fields = ["doc_id", "n_shingles", "same", "labels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int64)
        for b in batches:
            data, offsets = raw(texts_of(b.column(1)))
            for i, j in slices(offsets):
                g, bounds = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1], k)
                seen += np.bincount(_slot(g), minlength=SLOTS)
                n = np.diff(bounds)
                same, marks = _digests(g, bounds), [b""] * (j - i)
                full = np.flatnonzero(n)
                if len(full):
                    m = labels(g, np.append(bounds[:-1][full], len(g)), TREES * DEPTH)
                    for r, d in enumerate(full):
                        marks[d] = m[r].tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(same, pa.binary()), pa.array(marks, pa.binary())], names=fields)
        if seen.any():
            rows = np.minimum(seen, 255).astype(np.uint8).reshape(-1, SLOT_ROW)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), pa.array(np.arange(len(rows))), pa.array([x.tobytes() for x in rows], pa.binary()), pa.nulls(len(rows), pa.binary())], names=fields)

    return _rows(docs).where("doc_id is not null").mapInArrow(run, "doc_id long, n_shingles long, same binary, labels binary")


def _slot(g: np.ndarray) -> np.ndarray:
    return (words.mix(g) >> U64(44)).astype(np.int64)


def counts(drawn: DataFrame) -> np.ndarray:
    """The sum of the tasks' tables."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(x.as_buffer(), np.uint8).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["place", "counts"])

    parts = drawn.where("doc_id is null").select("n_shingles", "same").repartition(SLOTS // SLOT_ROW, "n_shingles")
    out = np.zeros((SLOTS // SLOT_ROW, SLOT_ROW), np.uint32)
    for r in parts.mapInArrow(add, "place long, counts binary").collect():
        out[r.place] = np.frombuffer(r.counts, np.uint32)
    return out.ravel()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all trees for classes (id, labels, part). hi holds a tree's first four labels, lo four more."""
    place = np.array([48, 32, 16, 0])
    for b in batches:
        n = len(b)
        m = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u2").reshape(n, TREES, DEPTH).astype(np.int64)
        low = (m & 0xFF).astype(np.uint8)
        for t in range(TREES):
            sig = [x.tobytes() for x in low[:, (t + 1 + np.arange(8)) % TREES].reshape(n, CHECK)]
            hi, lo = (m[:, t, :4] << place).sum(axis=1), (m[:, t, 4:] << place).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(hi), pa.array(lo), b.column(0), b.column(2), pa.array(sig, pa.binary())], names=["tree", "hi", "lo", "id", "part", "sig"])


def _neighbours(ends: bool, first: bool):
    """Candidate pairs of rows sorted by (tree, hi, lo, id). Rows out: pairs (a, b) of different parts and, with ends, the
    rows at the range's two ends for the second pass. With first, only next neighbours in EARLY trees are pairs."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("part", pa.int64()), ("sig", pa.binary())])

    def out(a, b=None, rows=None):
        n = len(a)
        none = [pa.nulls(n, f.type) for f in schema]
        cols = [pa.array(a, pa.int64()), none[1] if b is None else pa.array(b), *none[2:]]
        if rows is not None:
            cols[2:] = [rows.column(c) for c in ("tree", "hi", "lo", "part", "sig")]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, old, first_done = None, 0, 0
        for b in batches:
            t = pa.Table.from_batches([b.select(["tree", "hi", "lo", "id", "part", "sig"])])
            if ends and first_done < REACH + 1:
                head = t.slice(0, REACH + 1 - first_done)
                first_done += len(head)
                yield out(head["id"].to_numpy(), rows=head)
            if held is not None:
                t = pa.concat_tables([held, t])
            t = t.combine_chunks()
            tree, hi, ids, part = (t[c].to_numpy() for c in ("tree", "hi", "id", "part"))
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(ids), -1)
            same = hi >> (16 * (4 - LEAST))
            for s in range(1, min(1 if first else REACH, len(ids) - 1) + 1):
                i = np.flatnonzero((tree[s:] == tree[:-s]) & (same[s:] == same[:-s]) & (part[s:] != part[:-s]))
                i = i[i + s >= old]
                if first:
                    i = i[tree[i] < EARLY]
                i = i[(sig[i] == sig[i + s]).sum(axis=1) >= AGREE]
                if len(i):
                    x, y = ids[i], ids[i + s]
                    yield out(np.minimum(x, y), np.maximum(x, y))
            held = t.slice(max(0, len(t) - REACH - 1))
            old = len(held)
        if ends and held is not None:
            yield out(held["id"].to_numpy(), rows=held)

    return run, "a long, b long, tree int, hi long, lo long, part long, sig binary"


def candidates(orders: DataFrame, path: str, name: str, first: bool = False) -> DataFrame:
    """Pairs (a, b) of one forest."""
    spark = orders.sparkSession
    run, schema = _neighbours(True, first)
    dealt = orders.repartitionByRange(tasks_for(spark), "tree", "hi", "lo", "id").sortWithinPartitions("tree", "hi", "lo", "id")
    made = staged(dealt.mapInArrow(run, schema), f"{path}/neighbours-{name}")
    run, _ = _neighbours(False, first)
    at_ends = made.where("tree is not null").select("tree", "hi", "lo", F.col("a").alias("id"), "part", "sig").distinct()  # 2 * (REACH + 1) rows a range
    second = at_ends.coalesce(1).sortWithinPartitions("tree", "hi", "lo", "id").mapInArrow(run, schema)
    return made.where("tree is null").unionAll(second).select("a", "b")


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    return (percent * n + 99) // 100


def rarest(docs: DataFrame, table: np.ndarray, k: int, percent: int) -> DataFrame:
    """id, n_shingles, rare (those of a document's shingles one of which any near set has, the rarest first)."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = raw(texts_of(b.column(1)))
            for i, j in slices(offsets):
                g, bounds = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1], k)
                n = np.diff(bounds)
                g = g[np.lexsort((sent.value[_slot(g)], np.repeat(np.arange(j - i), n)))]  # stable: ties stay by hash
                ends = bounds[:-1] + np.minimum(n, n - _least(n, percent) + 1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array([g[x:y].tobytes() for x, y in zip(bounds[:-1], ends, strict=True)], pa.binary())], names=["id", "n_shingles", "rare"])

    return _rows(docs).where("doc_id is not null").mapInArrow(run, "id long, n_shingles long, rare binary").where("n_shingles > 0")


def _both(n, m, percent: int):
    """Shingles that sets of n and m share at least, if they are near."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each rare shingle of classes (id, part, n_shingles, rare); place holds n_shingles and the shingle's place."""
    for b in batches:
        times = np.array([len(x.as_buffer()) // 8 for x in b.column(3)], np.int64)
        h = np.frombuffer(b"".join(b.column(3).to_pylist()), "<i8")
        at = np.arange(len(h)) - np.repeat(np.cumsum(times) - times, times)
        ids, part, n = (np.repeat(b.column(c).to_numpy(), times) for c in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids), pa.array(part), pa.array((n << 32) | at)], names=["h", "id", "part", "place"])


def _shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b.column(0).to_pylist()), "<i8"))], names=["h"])


def _sharing(percent: int):
    """Pairs (a, b) of different parts that meet at a near pair's first shared shingle, from rows sorted by (h, cell, role,
    part). Roles: 0 and 1 are the two sides of a cell of a split list, 2 is both."""

    def pairs(h, cell, role, ids, part, place) -> Iterator[pa.RecordBatch]:
        size, n, at = len(h), place >> 32, place & 0xFFFFFFFF
        ends = lambda new: (np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], size))
        new_cell = np.concatenate([[True], (h[1:] != h[:-1]) | (cell[1:] != cell[:-1])])
        new_part = new_cell | np.concatenate([[True], (role[1:] != role[:-1]) | (part[1:] != part[:-1])])
        (top, end), (run, run_end) = ends(new_cell), ends(new_part)
        top, end = (np.repeat(x, end - top) for x in (top, end))
        run, run_end = (np.repeat(x, run_end - run) for x in (run, run_end))
        split = role < 2
        if split.any():  # the right side are the cell's rows of role 1, none of which is passed over
            right = end - np.add.reduceat((role == 1).astype(np.int64), np.unique(top))[np.searchsorted(np.unique(top), top)]
            top, run, run_end = np.where(split, right, top), np.where(split, right, run), np.where(split, right, run_end)
        before, many = run - top, run - top + end - run_end
        # the smaller set of a near pair, or one of two equal ones, has the shingle among these
        left = np.flatnonzero((role != 1) & (many > 0) & (at <= n - _both(n, n, percent)))
        many = many[left]
        total, i = np.concatenate([[0], np.cumsum(many)]), 0
        while i < len(left):
            j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, "right")) - 1)
            x = np.repeat(left[i:j], many[i:j])
            step = np.arange(len(x)) - np.repeat(total[i:j] - total[i], many[i:j])
            y = np.where(step < before[x], top[x] + step, run_end[x] + step - before[x])
            ok = ((n[x] < n[y]) | ((n[x] == n[y]) & (ids[x] < ids[y]))) & (100 * n[x] >= percent * n[y]) & (part[x] != part[y])
            x, y = x[ok], y[ok]
            both = _both(n[x], n[y], percent)
            ok = (at[x] <= n[x] - both) & (at[y] <= n[y] - both)
            a, b = ids[x[ok]], ids[y[ok]]
            if len(a):
                once = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in once.T], names=["a", "b"])
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, limit = [], 0, POSTINGS
        for b in batches:
            held.append([c.to_numpy() for c in b.columns])
            size += len(b)
            if size < limit:
                continue
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last cell may go on
            if cut:
                yield from pairs(*[c[:cut] for c in cols])
            held, size = [[c[cut:] for c in cols]], size - cut
            limit = max(POSTINGS, 2 * size)
        if held:
            yield from pairs(*[np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def sharing(rare: DataFrame, parted: DataFrame, percent: int, path: str) -> DataFrame:
    """Pairs (a, b) of classes (id, part) of different parts that meet at a rare shingle as near pairs have to. The shingles
    with long lists are a table first, so that Spark knows its size and postings are shuffled once."""
    rows = rare.join(parted.select("id", "part"), "id").select("id", "part", "n_shingles", "rare").mapInArrow(_spread, "h long, id long, part long, place long")
    every = rare.select("rare").mapInArrow(_shingles_of, "h long")
    long = staged(every.groupBy("h").count().where(F.col("count") > LIST).select("h", F.ceil(F.col("count") / LIST).cast("int").alias("blocks")), path)
    short = rows.join(long, "h", "left_anti").repartition(tasks_for(rare.sparkSession), "h").sortWithinPartitions("h", "part")
    short = short.select("h", F.lit(0).alias("cell"), F.lit(2).alias("role"), "id", "part", "place")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = lambda f: F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), f)
    sides = F.concat(other(lambda j: F.struct((own * F.col("blocks") + j).alias("cell"), F.lit(0).alias("role"))), other(lambda i: F.struct((i * F.col("blocks") + own).alias("cell"), F.lit(1).alias("role"))))
    placed = rows.join(long, "h").withColumn("c", F.explode(sides)).select("h", "c.cell", "c.role", "id", "part", "place")
    split = placed.repartition(tasks_for(rare.sparkSession), "h", "cell").sortWithinPartitions("h", "cell", "role", "part")
    found = [df.mapInArrow(_sharing(percent), "a long, b long") for df in (short, split)]
    return found[0].unionAll(found[1]).distinct()


def sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id, hashes (sorted, 64 bits each) of the documents with the given ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = raw(texts_of(b.column(1)))
            for i, j in slices(offsets):
                g, bounds = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1], k)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(_digests(g, bounds), pa.binary()), pa.array([g[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["id", "same", "hashes"])

    needed = _rows(docs).join(ids.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi")  # alike at every size
    return needed.mapInArrow(run, "id long, same binary, hashes binary").groupBy("id").agg(F.min(F.struct("same", "hashes")).alias("m")).select("id", "m.hashes")


def confirm(pairs: DataFrame, hashes: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            kept = []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    kept.append(False)
                    continue
                z = np.sort(np.concatenate([x, y]), kind="stable")
                both = int((z[1:] == z[:-1]).sum())
                kept.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    x, y = hashes.select(F.col("id").alias("a"), F.col("hashes").alias("x")), hashes.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row; see the module's text."""
    spark = session(docs.sparkSession)
    path = shared_dir(spark, "near-dups")
    sketched = staged(sketch(docs, k), f"{path}/sketch")
    drawn = sketched.where("doc_id is not null")
    repeated = staged(drawn.groupBy("doc_id").agg(F.min("same").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), f"{path}/repeated")
    if not repeated.isEmpty():  # one set a document
        drawn = staged(drawn.join(repeated, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("first", "same").alias("same"), F.when(F.col("first").isNull() | (F.col("first") == F.col("same")), F.col("labels")).alias("labels")), f"{path}/drawn")
    grouped = drawn.where("labels is not null and same <> x''").groupBy("same").agg(F.min(F.struct("doc_id", "labels")).alias("m"))
    classes = staged(grouped.select("same", F.col("m.doc_id").alias("id"), F.col("m.labels").alias("labels")), f"{path}/classes")
    one_row = classes.select("id", "labels")

    def parted(known: DataFrame, *columns: str) -> DataFrame:
        return one_row.join(known.withColumnRenamed("node", "id"), "id", "left").select("id", *columns, F.coalesce("component", "id").alias("part"))

    # next neighbours in a few trees are confirmed first, so that groups of near copies are one part afterwards
    orders = staged(one_row.withColumn("part", F.col("id")).mapInArrow(_orders, _ORDER), f"{path}/orders-first")
    tested = _made(candidates(orders, path, "first", first=True), path, "first")
    hashes = staged(sets(docs, _ends(tested), k), f"{path}/sets-first")
    links = staged(confirm(tested, hashes, percent), f"{path}/links-first")
    known = components(links, f"{path}/first")
    # then all trees, between different parts
    orders = staged(parted(known, "labels").mapInArrow(_orders, _ORDER), f"{path}/orders-all")
    pairs = staged(_made(candidates(orders, path, "all"), path, "all").join(tested, ["a", "b"], "left_anti"), f"{path}/pairs-all")
    hashes = _more_sets(docs, pairs, hashes, k, f"{path}/sets-all")
    tested = tested.unionAll(pairs)
    links = links.unionAll(staged(confirm(pairs, hashes, percent), f"{path}/links-all"))
    known = components(links, f"{path}/all")
    # then all pairs of different parts that share enough of their rarest shingles: exact
    rare = staged(rarest(docs, counts(sketched), k, percent), f"{path}/rare")
    pairs = staged(sharing(rare, parted(known), percent, f"{path}/long").join(tested, ["a", "b"], "left_anti"), f"{path}/pairs-rare")
    remove(spark, f"{path}/rare")
    hashes = _more_sets(docs, pairs, hashes, k, f"{path}/sets-rare")
    made = staged(confirm(pairs, hashes, percent), f"{path}/links-rare")
    if not made.isEmpty():
        known = components(links.unionAll(made), f"{path}/rare-components")
    of_set = classes.select("same", F.col("id").alias("class"))
    drawn = drawn.select("doc_id", "n_shingles", "same")
    rows = drawn.where("same <> x''").join(of_set, "same", "left").join(known.withColumnRenamed("node", "class"), "class", "left")
    rows = rows.select("doc_id", "n_shingles", F.coalesce("component", "class", "doc_id").alias("component_id"))
    rows = rows.unionAll(drawn.where("same = x''").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    no_id = _rows(docs).where("doc_id is null").mapInArrow(_count_only(k), "doc_id long, n_shingles long, component_id long")
    return rows.unionAll(no_id).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _made(found: DataFrame, path: str, name: str) -> DataFrame:
    """The distinct pairs found as a table; the orders and neighbours they were made from are removed."""
    out = staged(found.distinct(), f"{path}/candidates-{name}")
    remove(found.sparkSession, f"{path}/neighbours-{name}")
    remove(found.sparkSession, f"{path}/orders-{name}")
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()


def _more_sets(docs: DataFrame, pairs: DataFrame, hashes: DataFrame, k: int, path: str) -> DataFrame:
    """hashes with the sets that pairs need besides."""
    return hashes.unionAll(staged(sets(docs, _ends(pairs).join(hashes.select("id"), "id", "left_anti"), k), path))


def _count_only(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = raw(texts_of(b.column(1)))
            _, bounds = shingles(data[offsets[0] : offsets[-1]], offsets, k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds).astype(np.int64)), pa.nulls(len(b), pa.int64())], names=["doc_id", "n_shingles", "component_id"])

    return run


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group: that with the smallest doc_id, in one row (of several the first one as JSON);
    null ids stay."""
    spark = session(docs.sparkSession)
    repeated = staged(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), shared_dir(spark, "repeated"))
    if not repeated.isEmpty():
        row = F.struct(*[F.col(c) for c in docs.columns])
        once = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
        docs = staged(docs.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once), shared_dir(spark, "one-row", keep=True))
    with scratch(spark):
        return without(docs, groups(docs, k, percent).where("not kept").select("doc_id"), "near-dups-out")


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=80)
