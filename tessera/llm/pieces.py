"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text's symbols are its characters; an agenda holds adjacent pairs whose join is a piece, ordered by
score, then from the left; the best live pair is joined until none is left. Characters without a piece
fall back to byte pieces (or to the unknown piece). No piece of such a vocabulary has a space mark behind
another character, so the agenda runs on chunks (space marks, then what follows up to the next mark or line feed), each
once a worker; results of each Arrow batch's new chunks are held against the sentencepiece library, and a
difference stops the job. Vocabularies that join across space marks are refused at loading.

Defined cases: null text is empty; empty text has no ids and decodes to ""; rows keep their doc_id, null
and repeated ones too; an empty table gives no rows; other columns are kept by the operator.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import Chunks
from .common import session, texts_of

_MARK = "▁"
_CHUNK = re.compile(f"{_MARK}+[^{_MARK}]*|[^{_MARK}]+")
_models: dict[str, PieceModel] = {}


class PieceModel:
    """A merge-type model: encode_chunk by agenda, decode by pieces, library() the checker."""

    def __init__(self, path: str, keep: int = 350_000) -> None:
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        if any(_MARK in pieces[i].lstrip(_MARK) for i in plain):
            raise ValueError("a piece of this vocabulary joins across a space")
        if lib.encode("a  b", out_type=str) != lib.encode("a" + _MARK * 2 + "b", out_type=str) or lib.decode(lib.encode(" a  b ")) != " a  b ":
            raise ValueError("only vocabularies with the identity normalizer, a leading space mark and kept spaces are taken")
        self.id = {pieces[i]: i for i in plain}
        self.rank = {pieces[i]: -lib.get_score(i) for i in plain}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = lib.is_byte(self.bytes[0])
        self.unknown = lib.unk_id()
        self.surface = {i: p.replace(_MARK, " ") for p, i in self.id.items()} | {i: "" for i in range(n) if lib.is_control(i)}
        self.byte_of = {i: b for b, i in enumerate(self.bytes)} if self.fallback else {}
        self.lines = not any("\n" in p for p in self.id)  # then nothing is joined over a line feed
        self.cache = Chunks(keep)

    def encode_chunk(self, chunk: str) -> list[int]:
        ids = self.id
        if (whole := ids.get(chunk)) is not None and len(chunk) == 1:
            return [whole]
        rank, symbols, n = self.rank, list(chunk), len(chunk)
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            r = rank.get(chunk[i : i + 2])
            if r is not None:
                agenda.append((r, i, i + 1, 2))
        heapq.heapify(agenda)
        push, pop = heapq.heappush, heapq.heappop
        while agenda:
            _, i, j, size = pop(agenda)
            a = symbols[i]
            if a is None:
                continue
            b = symbols[j]
            if b is None or len(a) + len(b) != size:  # one of them has been joined meanwhile
                continue
            symbols[i] = ab = a + b
            symbols[j] = None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                r = rank.get(ab + symbols[k])
                if r is not None:
                    push(agenda, (r, i, k, size + len(symbols[k])))
            k = left[i]
            if k >= 0:
                r = rank.get(symbols[k] + ab)
                if r is not None:
                    push(agenda, (r, k, i, size + len(symbols[k])))
        out, unknown = [], False
        for s in symbols:
            if s is None:
                continue
            i = ids.get(s)
            if i is not None:
                out.append(i)
                unknown = False
            elif self.fallback:
                out += [self.bytes[b] for b in s.encode("utf-8", "replace")]
            else:
                if not unknown:
                    out.append(self.unknown)
                unknown = True
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the leading space mark goes; bytes that are no UTF-8 become U+FFFD each."""
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            out.append(self.surface.get(i, " ⁇ "))
        if run:
            out.append(_utf8(run))
        s = "".join(out)
        return s[1:] if s[:1] == " " else s

    def chunks(self, text: str) -> list[str]:
        """The cache's keys for a text. In texts without repeated or leading spaces, a word stands for itself behind
        a mark, and a line feed with a word for a line's first; otherwise \x01 stands before a chunk."""
        if "  " in text or text[:1] == " " or _MARK in text or "\x01" in text or not self.lines:
            return ["\x01" + c for c in _CHUNK.findall(_MARK + text.replace(" ", _MARK))] if text else []
        return text.replace("\n", " \n").split(" ") if text else []

    @staticmethod
    def chunk(key: str) -> str:
        return key[1:] if key[:1] == "\x01" else key if key[:1] == "\n" else _MARK + key

    def learn(self, new: list[str]) -> None:
        """Encode new chunks and hold all of them against the library."""
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            chunks = [self.chunk(c) for c in part]
            # the library puts a mark before every text: a chunk's own, or one that a line feed parts from the rest
            expected = self.lib.encode([c[1:] if c[0] == _MARK else c for c in chunks], num_threads=1)
            for key, c, e in zip(part, chunks, expected, strict=True):
                ids = self.encode_chunk(c)
                if (ids if c[0] == _MARK else [self.id[_MARK], *ids]) != e and c != _MARK:
                    raise AssertionError(f"the library encodes {c!r} as {e}, the agenda as {ids}")
                decimals, decoded = ",".join(map(str, ids)), (" " if c[0] == _MARK else "") + self.decode(ids)
                # most chunks decode to themselves, so the cache holds the others' texts only
                self.cache[key] = decimals if decoded == c.replace(_MARK, " ") else (decimals, decoded)

    def decoded(self, key: str, value: str | tuple[str, str]) -> str:
        return self.chunk(key).replace(_MARK, " ") if isinstance(value, str) else value[1]


def _utf8(run: bytearray) -> str:
    out, i = [], 0
    while i < len(run):
        size = 1 if run[i] < 0x80 else 2 if 0xC2 <= run[i] < 0xE0 else 3 if 0xE0 <= run[i] < 0xF0 else 4
        try:
            out.append(bytes(run[i : i + size]).decode())
            i += size
        except UnicodeDecodeError:
            out.append("�")
            i += 1
    return "".join(out)


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _joined(m: PieceModel, texts: list[str]) -> Iterator[tuple[str, str]]:
    """Ids (as decimal text with commas) and decoded text of each text."""
    many = [m.chunks(t) for t in texts]
    for text, keys, found in zip(texts, many, m.cache.look(many, m.learn), strict=True):
        try:
            ids, decoded = ",".join(found), text.replace(_MARK, " ")
        except TypeError:  # some chunk has a text of its own; a text's first mark is no part of it
            ids, decoded = ",".join([f if isinstance(f, str) else f[0] for f in found]), "".join(map(m.decoded, keys, found))[1:]
        yield ids, decoded


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of piece ids (array of int); no shuffle."""
    return _with(docs, path, text, ids, T.ArrayType(T.IntegerType(), False), lambda m, texts: _lists([s for s, _ in _joined(m, texts)]))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text of a column of piece ids; null ids decode to an empty text."""
    return _with(docs, path, ids, text, T.StringType(), lambda m, many: pa.array([m.decode(x or []) for x in many], pa.string()))


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of piece ids, and the text as decoded from them (null stays null); one pass, no shuffle."""
    session(docs.sparkSession)
    kept = [c for c in docs.columns if c != ids]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                found = list(_joined(m, texts_of(part.column(at)).to_pylist()))
                columns, null = list(part.columns), part.column(at).is_null().to_pylist()
                columns[at] = pa.array([None if x else d for (_, d), x in zip(found, null, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, _lists([s for s, _ in found])], names=[*part.schema.names, ids])

    return docs.select(*kept).mapInArrow(run, schema)


def _lists(decimals: list[str]) -> pa.Array:
    """Lists of ids from decimal texts with commas."""
    values = [np.fromstring(s, np.int32, sep=",") if s else np.zeros(0, np.int32) for s in decimals]
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32)))


def _with(docs: DataFrame, path: str, source: str, target: str, kind: T.DataType, f) -> DataFrame:
    session(docs.sparkSession)
    kept = [c for c in docs.columns if c != target]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(target, kind)])
    at = kept.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                c = part.column(at)
                values = c.to_pylist() if pa.types.is_list(c.type) or pa.types.is_large_list(c.type) else texts_of(c).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns, f(m, values)], names=[*part.schema.names, target])

    return docs.select(*kept).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    session(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                n, ids, texts = [], [], []
                for s, d in _joined(m, texts_of(part.column(1)).to_pylist()):
                    n.append(s.count(",") + 1 if s else 0)
                    ids.append(hashlib.sha256(s.encode()).hexdigest())
                    texts.append(hashlib.sha256(d.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(session(spark).read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
