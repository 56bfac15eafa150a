"""Token counts by a two-tier lookup on the map side.

A first pass finds frequent pre-tokens: each task keeps a bounded count summary, the summaries (one row a
task) are merged in a tree, and the `frequent` commonest with their token counts are broadcast as a
compact hash table (at most `frequent` entries, whatever the corpus). The second pass adds up looked-up
counts; a miss is encoded once and kept in the worker's bounded cache. Pre-tokens of texts are never shuffled (what is merged
is one bounded summary a task), and the table only saves work: counts don't depend on what is in it.

A pre-token here is what stands between white space once the vocabulary's own normalizer has run. The
vocabulary's rule drops white space and never joins across it, so counts of pre-tokens add up to the text's.

Defined cases: null text counts as empty (0 bytes, 0 tokens); rows keep their doc_id whatever it is, null
and repeated ones too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import Chunks
from .common import raw, session, texts_of

#: Entries of the broadcast table; of a task's summary; of a summary before it is cut back.
FREQUENT, SUMMARY, LOOSE = 20_000, 20_000, 200_000

#: Characters that the library's normalizer has to see; on others (Latin letters without marks of their own, ASCII white
#: space) lower() and split() give what it gives.
_EXOTIC = re.compile("[^\t-\r -~\xa1-\u012f\u0131-\u024f]")

_counters: dict[str, Counter_] = {}


class Counter_:
    """Tokens of texts under a tokenizers file whose pre-tokens don't join over white space."""

    def __init__(self, path: str, keep: int = 500_000) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        if self.lib.normalizer is None or self.lib.normalizer.normalize_str("A\t B\u0065\u0301") != "a b\u00e9":
            raise ValueError("only vocabularies that compose, lower-case and fold white space are counted by pre-token")
        self.strings = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, sorted(self.strings, key=len, reverse=True)))) if self.strings else None
        self.cache = Chunks(keep)

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many special strings it has."""
        norm = self.lib.normalizer.normalize_str
        if any(s in text for s in self.strings):
            parts = self.added.split(text)
            return [c for p in parts for c in norm(p).split(" ") if c], len(parts) - 1
        if not _EXOTIC.search(text):
            return text.lower().split(), 0
        return [c for c in norm(text).split(" ") if c], 0

    def count(self, texts: list[str], frequent: dict[str, int]) -> list[int]:
        many = [self.pretokens(t) for t in texts]
        found = self.cache.look([cs for cs, _ in many], self.learn, frequent)
        return [n + sum(f) for (_, n), f in zip(many, found, strict=True)]

    def learn(self, new: list[str]) -> None:
        """Many pre-tokens go to the library as one text, with a special string between them if the vocabulary has one."""
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            if self.strings:
                mark = self.strings[0]
                ids = np.array(self.lib.encode_batch_fast([mark.join(part)], add_special_tokens=False)[0].ids)
                ends = np.append(np.flatnonzero(ids == self.lib.token_to_id(mark)), len(ids))
                self.cache.update(zip(part, (np.diff(ends, prepend=-1) - 1).tolist(), strict=True))
            else:
                self.cache.update(zip(part, [len(e.ids) for e in self.lib.encode_batch_fast(part, add_special_tokens=False)], strict=True))


def counter(path: str) -> Counter_:
    if path not in _counters:
        _counters[path] = Counter_(path)
    return _counters[path]


def _pack(c: Counter) -> bytes:
    return zlib.compress(json.dumps(c.most_common(SUMMARY)).encode())


def frequent_pretokens(docs: DataFrame, tokenizer: str, text: str = "text", most: int = FREQUENT) -> dict[str, int]:
    """Token counts of about the `most` commonest pre-tokens of all texts."""
    spark = docs.sparkSession

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, total = counter(tokenizer), Counter()
        for b in batches:
            for t in texts_of(b.column(0)).to_pylist():
                total.update(lib.pretokens(t)[0])
            if len(total) > LOOSE:
                total = Counter(dict(total.most_common(LOOSE // 2)))
        if total:
            yield pa.RecordBatch.from_pydict({"summary": pa.array([_pack(total)], pa.binary())})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for b in batches:
            for s in b.column(0).to_pylist():
                total.update(dict(json.loads(zlib.decompress(s))))
            if len(total) > LOOSE:
                total = Counter(dict(total.most_common(LOOSE // 2)))
        if total:
            yield pa.RecordBatch.from_pydict({"summary": pa.array([_pack(total)], pa.binary())})

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(summaries, "summary binary")
    n = max(1, rows.rdd.getNumPartitions())
    while n > 1:
        n = -(-n // 16)
        rows = rows.repartition(n).mapInArrow(merged, "summary binary")
    total = Counter()
    for r in rows.collect():  # one bounded row
        total.update(dict(json.loads(zlib.decompress(r.summary))))
    chosen = [c for c, _ in total.most_common(most)]
    lib = counter(tokenizer).lib
    return {c: len(e.ids) for c, e in zip(chosen, lib.encode_batch_fast(chosen, add_special_tokens=False), strict=True)}


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs."""
    spark = session(docs.sparkSession)
    table = spark.sparkContext.broadcast(frequent_pretokens(docs, tokenizer, text))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = counter(tokenizer)
        for b in batches:
            t = texts_of(b.column(1))
            n = np.array(lib.count(t.to_pylist(), table.value), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(raw(t)[1])), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(counts, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    session(spark)
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
