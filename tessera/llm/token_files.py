"""Token-id files: flat unsigned integers with 64-bit document offsets, laid out for memory maps.

A part holds documents with neighbouring doc_ids. `part-NNNNN-*.tok` is, little-endian throughout:

    8 bytes  magic "TESTOK01"
    3 x u64  width of an id in bytes (2 or 4), documents, ids
    u64      documents whose doc_id is null (they stand first)
    i64[n]   doc_ids (0 where null), ascending
    u64[n+1] offsets of the documents' first ids within the part
    ids      u16[m] or u32[m]

Parts are ordered by doc_id; an id's place in the whole corpus is its place in the part plus the part's
base, the prefix sum of the earlier parts' ids. Only part sizes (one row a part) ever reach the driver.

Defined cases: null or empty text has only the end id; rows with one doc_id stand together, ordered by
text; null doc_ids come first; an empty table gives no parts; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import Chunks
from .common import session, shared_dir, staged, tasks_for, texts_of

MAGIC = b"TESTOK01"
_HEAD = struct.Struct("<8s4Q")
#: Unicode White_Space, as the byte-level rule's \s has it.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Breaks a text where the byte-level rule always breaks: before the space that leads a run of other characters, and around runs of white space.
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: White space other than the space and the line feed; characters that mark chunks in the cache.
_RARE = re.compile("[\x00\x01\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

_MARKS = frozenset(".,!?;:")

_encoders: dict[str, ByteLevelEncoder] = {}


class ByteLevelEncoder:
    """Ids of whole texts as the tokenizers library gives them, each distinct chunk being encoded once a worker."""

    def __init__(self, path: str, keep: int = 800_000) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        added = {t.content: i for i, t in self.lib.get_added_tokens_decoder().items()}
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.strings = list(added)
        self.kind = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache = Chunks(keep)
        self.special, self.marks = set(added), {}
        #: Ids whose bytes begin with a space, if nothing else in the vocabulary can part or join chunks at one.
        self.leads = None
        if self.lib.normalizer is None and not any(" " in t for t in added):
            self.leads = np.zeros(max(self.lib.get_vocab(True).values(), default=0) + 1, bool)
            self.leads[[i for t, i in self.lib.get_vocab(False).items() if t[:1] == "\u0120"]] = True

    def chunks(self, text: str) -> list[str]:
        """The cache's keys for a text: \x01 and a chunk; in texts with single spaces and line feeds only, a word
        stands for itself after a space, \x00 and a word for the first one, \n and a word for a line's first."""
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or any(s in text for s in self.strings) or _RARE.search(text):
            parts = self.added.split(text) if self.added else [text]
            return ["\x01" + c for p in parts for c in ([p] if p in self.special else _CHUNK.findall(p))]
        words = text.replace("\n", " \n").split(" ")
        words[0] = "\x00" + words[0]
        return words

    @staticmethod
    def chunk(key: str) -> str:
        return key[1:] if key[:1] in ("\x00", "\x01") else key if key[:1] == "\n" else " " + key

    def encode(self, texts: list[str], end: int | None) -> list[bytes]:
        """The ids of each text as bytes of self.kind, with `end` appended."""
        tail = b"" if end is None else np.array([end], self.kind).tobytes()
        return [b"".join(x) + tail for x in self.cache.look([self.chunks(t) for t in texts], self.learn)]

    def learn(self, new: list[str]) -> None:
        """A word of Latin letters with one mark behind it has the word's ids, then the mark's: the rule parts them."""
        cache, old, ends, words = self.cache, self.cache.old, [], set()
        for c in new:
            word = c[:-1]
            if c[-1:] in _MARKS and word.isalpha() and max(word) < "\u0250":
                ends.append((c, word))
                if word not in cache:
                    if (v := old.get(word)) is not None:
                        cache[word] = v
                    else:
                        words.add(word)
            else:
                words.add(c)
        if ends and not self.marks:
            self.marks = {m: np.array(self.lib.encode(m, add_special_tokens=False).ids, self.kind).tobytes() for m in _MARKS}
        self.learn_chunks(list(words))
        for c, word in ends:
            cache[c] = cache[word] + self.marks[c[-1]]

    def learn_chunks(self, new: list[str]) -> None:
        """Many chunks go to the library as one text. Words behind a space need nothing between them: the rule parts a text
        before a single space, so each one's ids begin with the only id that begins with a space."""
        if self.leads is None:
            return self.learn_marked(new)
        plain, other = [], []
        for c in new:
            (plain if c and c[0] not in "\x00\x01\n" else other).append(c)
        width = self.kind.itemsize
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            ids = np.array(self.lib.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            starts = np.flatnonzero(self.leads[ids])
            if len(starts) != len(part) or starts[0]:
                other += part
                continue
            data, ends = ids.tobytes(), [*(starts * width).tolist(), len(ids) * width]
            self.cache.update(zip(part, [data[x:y] for x, y in zip(ends, ends[1:])], strict=True))  # noqa: B905
        self.learn_marked(other)

    def learn_marked(self, new: list[str]) -> None:
        """The same with a special string between chunks of any kind: such strings part a text."""
        chunk, width = self.chunk, self.kind.itemsize
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            texts = list(map(chunk, part))
            if self.special.isdisjoint(texts) and self.special:
                mark = min(self.special)
                ids = np.array(self.lib.encode_batch_fast([mark.join(texts)], add_special_tokens=False)[0].ids, self.kind)
                ends = [*np.flatnonzero(ids == self.lib.token_to_id(mark)).tolist(), len(ids)]
                data, at = ids.tobytes(), 0
                for c, end in zip(part, ends, strict=True):
                    self.cache[c] = data[at * width : end * width]
                    at = end + 1
            else:
                for c, e in zip(part, self.lib.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                    self.cache[c] = np.array(e.ids, self.kind).tobytes()


def encoder(path: str) -> ByteLevelEncoder:
    if path not in _encoders:
        _encoders[path] = ByteLevelEncoder(path)
    return _encoders[path]


def _filesystem(path: str):
    """pyarrow's file system for a shared folder, and the path on it."""
    from pyarrow import fs

    u = urlparse(path)
    if u.scheme in ("", "file"):
        return fs.LocalFileSystem(), u.path
    return fs.FileSystem.from_uri(path)


def write_part(folder: str, part: int, doc_ids: np.ndarray, n_null: int, lengths: np.ndarray, bodies: list[bytes], kind: np.dtype) -> str:
    """Write one part under a name of its own (a task that runs twice leaves a file nobody lists) and return the name."""
    files, root = _filesystem(folder)
    files.create_dir(root)
    name = f"part-{part:05d}-{uuid.uuid4().hex[:12]}.tok"
    offsets = np.zeros(len(lengths) + 1, "<u8")
    np.cumsum(lengths, out=offsets[1:])
    with files.open_output_stream(f"{root}/{name}") as f:
        f.write(_HEAD.pack(MAGIC, kind.itemsize, len(doc_ids), int(offsets[-1]), n_null))
        f.write(doc_ids.astype("<i8").tobytes())
        f.write(offsets.tobytes())
        for b in bodies:
            f.write(b)
    return name


class Part:
    """A part's arrays: views of a memory map where the folder is a mounted one."""

    def __init__(self, folder: str, name: str) -> None:
        files, root = _filesystem(folder)
        path = f"{root}/{name}"
        from pyarrow import fs

        data = np.memmap(path, np.uint8, "r") if isinstance(files, fs.LocalFileSystem) else np.frombuffer(files.open_input_file(path).read(), np.uint8)
        magic, width, n, m, self.n_null = _HEAD.unpack(data[: _HEAD.size].tobytes())
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        at = _HEAD.size
        self.doc_ids = data[at : at + 8 * n].view("<i8")
        self.offsets = data[at + 8 * n : at + 16 * n + 8].view("<u8")
        self.ids = data[at + 16 * n + 8 : at + 16 * n + 8 + width * m].view(f"<u{width}")


def write(docs: DataFrame, tokenizer: str, folder: str, end: int | None = 0, text: str = "text", part_bytes: int = 64 << 20) -> DataFrame:
    """Encode docs into token files in folder; returns the manifest: part, name, n_docs, n_ids, base.

    One shuffle: texts are dealt by ranges of doc_id, so parts come in order. A task starts another part
    whenever it holds part_bytes of ids, so its memory doesn't depend on the size of its range.
    """
    spark = session(docs.sparkSession)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, count = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, lengths, bodies, held, nulls = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, lengths, bodies, held, count, nulls
            n = np.concatenate(lengths)
            name = write_part(folder, task, np.concatenate(ids), nulls, n, bodies, enc.kind)
            row = pa.RecordBatch.from_pydict({"task": [task], "seq": [count], "name": [name], "n_docs": [len(n)], "n_ids": [int(n.sum())]}, schema=out)
            ids, lengths, bodies, held, nulls, count = [], [], [], 0, 0, count + 1
            return row

        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.slice(i, 1000)
                keys = part.column(0)
                made = enc.encode(texts_of(part.column(1)).to_pylist(), end)
                nulls += keys.null_count
                ids.append(keys.fill_null(0).to_numpy())
                lengths.append(np.array([len(x) // enc.kind.itemsize for x in made], np.int64))
                bodies += made
                held += sum(map(len, made))
                if held >= part_bytes:
                    yield flush()
        if lengths:
            yield flush()

    out = pa.schema([("task", pa.int64()), ("seq", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt = rows.repartitionByRange(tasks_for(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    made = staged(dealt.mapInArrow(parts, "task long, seq long, name string, n_docs long, n_ids long"), f"{folder}/_parts")
    base, rows_out = 0, []
    for r in sorted(made.collect(), key=lambda r: (r.task, r.seq)):  # one row a part
        rows_out.append((len(rows_out), r.name, r.n_docs, r.n_ids, base))
        base += r.n_ids
    manifest = spark.createDataFrame(rows_out, "part long, name string, n_docs long, n_ids long, base long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in a folder of token files, from the files."""
    manifest = spark.read.parquet(f"{folder}/_manifest")
    n = max(1, min(manifest.count(), tasks_for(spark)))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                p = Part(folder, row["name"])
                for i in range(0, len(p.doc_ids), 4096):
                    j = min(i + 4096, len(p.doc_ids))
                    o = p.offsets[i : j + 1].astype(np.int64)
                    crc = [zlib.crc32(p.ids[o[k] : o[k + 1]].astype("<u4").tobytes()) for k in range(j - i)]
                    keys = pa.array(p.doc_ids[i:j], pa.int64(), mask=np.arange(i, j) < p.n_null)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(o[:-1] + row["base"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("name", "base").repartition(n).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    session(spark)
    folder = shared_dir(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), folder, end=0)
    return read(spark, folder)
