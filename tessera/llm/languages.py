"""Language identification by Bayesian fusion of evidence.

log P(language | all) = host prior + `TEMPER` * text likelihood + P(declared | language) + P(suffix | language).

* Text: hashed byte trigrams of lower-cased words under one multinomial a language, fitted on at most
  FIT_ROWS distinct labelled texts a language, and a background (`und`) of all byte trigrams alike.
* Host prior: counts of text-only decisions by host, smoothed towards those of its suffix, and these towards
  all rows', by grouped aggregation over all rows (Dirichlet weight HOST_WEIGHT at each level).
* Declared language and address suffix: counts against text-only decisions over all rows, smoothed.

A row is rejected (kept = false) only if its best language is `und`: text that no language explains better than
the background. Only small rows (no texts) are shuffled for the host join; a host with a third of all rows is
aggregated before the shuffle and its join is split by adaptive execution.

Defined cases: null or empty text, or no host, declared language or suffix, is no evidence from that source; a text
without letters is `und`; rows keep their key, null and repeated ones too; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .chunks import drop_all
from .common import raw, scratch, session, shared_dir, slices, staged, texts_of, without

#: Texts a language is fitted on at most, and how many times as many are drawn.
FIT_ROWS, DRAWN = 1000, 4
TABLE = 1 << 16
TEMPER, HOST_WEIGHT, UND = 0.25, 20.0, "und"
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[0x41:0x5B] += 0x20
_LETTER = np.ones(256, bool)
_LETTER[:0x41] = False
_LETTER[0x5B:0x61] = False
_LETTER[0x7B:0x80] = False


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each row's trigrams of letters, with the word's edges as spaces, and each one's row."""
    drop_all()
    o = offsets - offsets[0]
    n = int(o[-1])
    b = np.where(_LETTER[data[:n]], _FOLD[data[:n]], 0x20).astype(np.uint32)
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = np.empty(n, np.uint32), np.empty(n, np.uint32)
    left[0] = right[-1] = 0x20
    left[1:], right[:-1] = b[:-1], b[1:]
    full = o[1:] > o[:-1]
    left[o[:-1][full]] = 0x20
    right[o[1:][full] - 1] = 0x20
    at = np.flatnonzero(b != 0x20)
    code = (left[at] << np.uint32(16)) | (b[at] << np.uint32(8)) | right[at]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), np.searchsorted(o[1:], at, "right")


def fit(labelled: DataFrame, text: str = "text", language: str = "lang", fit_rows: int = FIT_ROWS) -> dict:
    """Languages (every one that is declared) and their log trigram probabilities (TABLE numbers a language), from at most
    fit_rows distinct texts a language. Two passes over the rows, whatever the number of languages."""
    own = labelled.where(F.col(language).isNotNull() & (F.col(language) != "")).select(F.col(language).alias("own"), F.col(text).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    # the smallest hashes of each language, so that copies of a text count once. A count by sketch bounds them first to
    # about DRAWN times what is needed, so that a language's texts are few, whatever its share of the rows
    counts = own.groupBy("own").agg(F.approx_count_distinct("hash").alias("n")).collect()  # a row a language
    bounds = [(r.own, min((1 << 63) - 1, -(1 << 63) + (1 << 64) * DRAWN * fit_rows // max(1, r.n))) for r in counts]
    top = labelled.sparkSession.createDataFrame(bounds, "own string, top long")
    drawn = staged(own.join(F.broadcast(top), "own").where("hash <= top").select("own", "hash", "text").distinct(), shared_dir(labelled.sparkSession, "languages-drawn"))
    place = F.row_number().over(Window.partitionBy("own").orderBy("hash"))
    cuts = drawn.select("own", "hash").distinct().withColumn("place", place).where(F.col("place") <= fit_rows).groupBy("own").agg(F.max("hash").alias("cut")).collect()
    languages = sorted(r.own for r in cuts)
    number, cut = {x: i for i, x in enumerate(languages)}, {r.own: r.cut for r in cuts}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            names, column = np.array(b.column(0).to_pylist()), texts_of(b.column(1))
            for x in set(names.tolist()):
                data, offsets = raw(column.filter(pa.array(names == x)))
                for i, j in slices(offsets):
                    g, _ = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                    total[x] = total.get(x, 0) + np.bincount(g, minlength=TABLE)
        for x, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at), pa.array(t[at])], names=["own", "gram", "n"])

    seen = np.zeros((len(languages), TABLE))
    if languages:
        limit = labelled.sparkSession.createDataFrame([(x, cut[x]) for x in languages], "own string, cut long")  # a row a language
        rows = drawn.join(F.broadcast(limit), "own").where("hash <= cut").select("own", "text")
        counted = rows.mapInArrow(count, "own string, gram long, n long").groupBy("own", "gram").agg(F.sum("n").alias("n")).toArrow()
        np.add.at(seen, (np.array([number[x] for x in counted["own"].to_pylist()], np.int64), counted["gram"].to_numpy()), counted["n"].to_numpy())
    log = np.log((seen + 0.05) / (seen.sum(axis=1, keepdims=True) + 0.05 * TABLE))
    return {"languages": [*languages, UND], "log": np.vstack([log, np.full((1, TABLE), -np.log(TABLE))]).astype(np.float32)}


def likelihoods(rows: DataFrame, model: dict) -> DataFrame:
    """rows (key, text, declared, host, suffix) with the text replaced by `text_log` (array<double>, one a language) and
    its best language `by_text` (null without letters)."""
    spark = session(rows.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, log = sent.value["languages"], sent.value["log"]
        for b in batches:
            data, offsets = raw(texts_of(b.column(1)))
            for i, j in slices(offsets):
                g, doc = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                n = np.bincount(doc, minlength=j - i)
                total = np.stack([np.bincount(doc, t[g], minlength=j - i) for t in log], axis=1)
                best = total.argmax(axis=1)
                own = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), own.column(3), own.column(4), pa.array(list(total), pa.list_(pa.float64())), pa.array([names[k] if m else None for k, m in zip(best, n, strict=True)], pa.string()), pa.array(n)], names=["key", "declared", "host", "suffix", "text_log", "by_text", "n_grams"])

    picked = rows.select(F.col("key").cast("long").alias("key"), *[F.col(c).cast("string").alias(c) for c in ("text", "declared", "host", "suffix")])
    return picked.mapInArrow(run, "key long, declared string, host string, suffix string, text_log array<double>, by_text string, n_grams long")


def identify(rows: DataFrame, model: dict) -> DataFrame:
    """key, lang, confidence, kept of rows (key, text, declared, host, suffix; any but key may be null)."""
    spark = session(rows.sparkSession)
    names = model["languages"]
    seen = staged(likelihoods(rows, model), shared_dir(spark, "languages"))
    counted = lambda: [F.sum(F.col("by_text").eqNullSafe(x).cast("double")).alias(f"n_{i}") for i, x in enumerate(names)]
    every = F.array(*[F.col(f"n_{i}") for i in range(len(names))])
    top = seen.agg(*counted()).select(F.coalesce(every, F.array(*[F.lit(0.0)] * len(names))).alias("n")).first().n
    top = np.array([x or 0.0 for x in top])
    base = (top + 1) / (top.sum() + len(names))

    def share(counts: Column, prior: Column) -> Column:
        """Counts smoothed towards a prior: an array of probabilities."""
        n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, prior, lambda c, p: (c + HOST_WEIGHT * p) / (n + HOST_WEIGHT))

    prior = F.array(*[F.lit(float(x)) for x in base])
    by_suffix = seen.where("suffix is not null").groupBy("suffix").agg(*counted()).select("suffix", every.alias("suffix_counts"))
    by_host = seen.where("host is not null").groupBy("host", "suffix").agg(*counted()).select("host", F.col("suffix").alias("s"), every.alias("host_counts"))
    upper = by_host.join(by_suffix.withColumnRenamed("suffix", "s2"), F.col("s") == F.col("s2"), "left")
    hosts = upper.select("host", "s", F.transform(share(F.col("host_counts"), F.when(F.col("suffix_counts").isNotNull(), share(F.col("suffix_counts"), prior)).otherwise(prior)), F.ln).alias("host_log"))

    def evidence(column: str, alias: str) -> DataFrame:
        """log P(value | language), smoothed by one row a value and language."""
        counts = seen.where(F.col(column).isNotNull()).groupBy(column).agg(*counted())
        each = [F.log((F.col(f"n_{i}") + 1) / F.lit(float(top[i] + 50))) for i in range(len(names))]
        return counts.select(F.col(column).alias(f"{alias}_value"), F.array(*each).alias(alias))

    joined = seen.join(hosts, (seen.host == hosts.host) & seen.suffix.eqNullSafe(hosts.s), "left").drop(hosts.host)
    for column, alias in (("declared", "declared_log"), ("suffix", "suffix_log")):
        joined = joined.join(evidence(column, alias), F.col(column) == F.col(f"{alias}_value"), "left")
    nothing = F.array(*[F.lit(0.0)] * len(names))
    parts = [F.coalesce("host_log", F.transform(prior, F.ln)), F.transform("text_log", lambda x: x * TEMPER), F.coalesce("declared_log", nothing), F.coalesce("suffix_log", nothing)]
    total = parts[0]
    for p in parts[1:]:
        total = F.zip_with(total, p, lambda a, b: a + b)
    scored = joined.select("key", "n_grams", total.alias("total")).withColumn("most", F.array_max("total"))
    best = F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position("total", F.col("most")).cast("int"))
    sure = 1 / F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most")))
    out = scored.select("key", F.when(F.col("n_grams") == 0, F.lit(UND)).otherwise(best).alias("lang"), F.when(F.col("n_grams") == 0, F.lit(1.0)).otherwise(sure).alias("confidence"))
    return out.withColumn("kept", F.col("lang") != UND)


def page_rows(pages: DataFrame) -> DataFrame:
    """key, text, declared, host, suffix of raw web pages (page_id, url, html)."""
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    blank = lambda c: F.when(c != "", c)
    return pages.select(F.col("page_id").alias("key"), body.alias("text"), blank(declared).alias("declared"), blank(host).alias("host"), blank(F.regexp_extract(host, r"\.([a-z]{2,})$", 1)).alias("suffix"))


def document_rows(docs: DataFrame) -> DataFrame:
    """key, text, declared, host, suffix of documents (doc_id, text, lang, source)."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return docs.select(F.col("doc_id").alias("key"), "text", blank("lang").alias("declared"), blank("source").alias("host"), F.lit(None).cast("string").alias("suffix"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those whose language can't be told; an id goes only if all its rows do, a null id stays."""
    with scratch(docs.sparkSession):
        found = identify(document_rows(docs), fit(docs))
        judged = found.where("key is not null").groupBy("key").agg(F.max("kept").alias("kept"))
        return without(docs, judged.where("not kept").select(F.col("key").alias("doc_id")), "languages-out")


def op10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return identify(document_rows(docs), fit(docs)).withColumnRenamed("key", "doc_id")


def op10_page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return identify(page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet")), fit(docs)).withColumnRenamed("key", "page_id")
