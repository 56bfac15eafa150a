"""A corpus pipeline: language ID, near-dedup, substring dedup, decontamination, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents; the last adds the ids, and its text is the decoded one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import session, shared_dir, staged
from tessera.llm.decontaminate import keep_uncontaminated
from tessera.llm.languages import keep_identified
from tessera.llm.near_dups import keep_first
from tessera.llm.pieces import encode_decode
from tessera.llm.substrings import remove_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return keep_identified(docs)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return keep_first(docs, k=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 or more words that an earlier document has."""
    return remove_repeats(docs, size=50)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and the text decoded from them."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", language), ("near_dups", near_dups), ("substrings", substrings), ("benchmark", benchmark), ("pieces", pieces)]

#: Languages and the vocabulary's merges are beyond SQL; tests/llm holds the texts and ids of run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), shared_dir(spark, f"pipeline-{name}"))
    return docs
