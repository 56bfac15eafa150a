"""Toxicity by weak supervision.

Voters are lexicons (stated seed lists in four languages; lexicons of words and word beginnings drawn from labelled
training rows) and patterns. Labels enter in two places only: lexicons that vote on one fold of the labelled rows are drawn
from the other folds (so no row's label makes its own votes), and the share of toxic rows is taken as known.

A generative label model then sees votes alone. It starts from the voters' agreement and estimates by EM each voter's
rates of voting on either class (its accuracy) and the voters' correlations within a class; a voter that doesn't vote
abstains, silence of all lexicons is evidence of its own, and a vote counts 1 / (1 + its correlations with the other voters
of that row). Its posteriors, and not the labels, are what a linear classifier over words, word beginnings and patterns is
trained on; the classifier scores every text.

Fitting takes at most `fit_rows` labelled rows (documented bound; 12,000), the first by hash of doc_id, and of these at most
VOCABULARY words and beginnings, those in most rows; scoring covers all rows. Labels of held-out rows (crc32 of doc_id as
text, modulo 5, is 0) never enter; lang, source, labels and doc_id are no features.

Defined cases: null text is empty; an empty text scores the classifier's base rate; rows keep their doc_id, null
(held out) and repeated ones too; labels of one doc_id that clash count as toxic; without labelled rows of both classes
every score is 0.5 less a rounding; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import raw, session, shared_dir, slices, staged, texts_of

U64 = np.uint64
FIT_ROWS = 12_000
#: Words and beginnings that fitting looks at, and the fewest rows that must have one.
VOCABULARY, RARE = 1 << 17, 4
BUCKETS = 1 << 18
#: Lexicons that are drawn (a word, or all words with one beginning, each), and folds of the rows that they are drawn across.
LEXICONS, FOLDS = 120, 5
#: The least log ratio of a lexicon's word; the least |log ratio| * sqrt(rows) of a classifier's word.
TELLING, FEATURE = 2.0, 6.0
#: Small lists of insults.
SEEDS = {
    "en insult": ["idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "fool"],
    "en contempt": ["loser", "losers", "pathetic", "worthless", "clown", "failure"],
    "en disgust": ["scum", "trash", "garbage", "disgusting", "filthy", "vermin"],
    "en threat": ["kill", "die", "destroy", "hurt"],
    "de": ["idiot", "idioten", "dumm", "dummkopf", "trottel", "abschaum", "arschloch", "wertlos"],
    "fr": ["idiot", "idiote", "imbécile", "crétin", "abruti", "connard", "salaud", "ordure"],
    "es": ["idiota", "imbécil", "estúpido", "estúpida", "basura", "escoria", "cabrón", "inútil"],
}
PATTERNS = ("shouting", "exclaiming", "repeating", "symbols")
_PREFIXES = (4, 5, 6, 7, 8)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word and word-beginning hashes of each row (sorted), where each row's begin, and pattern votes."""
    w = words.split(data, offsets, "alnum", fold=True)
    n = len(offsets) - 1
    parts, docs = [w.hashes()], [w.doc]
    length = w.ends - w.starts
    for p in _PREFIXES:
        long = length > p
        cut = words.Words(w.data, w.starts[long], w.starts[long] + p, w.doc[long], w.bounds, True)
        parts.append(words.mix(cut.hashes() ^ U64(p)))
        docs.append(w.doc[long])
    g, d = np.concatenate(parts), np.concatenate(docs)
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]) if len(g) else np.zeros(0, bool)
    g, d = g[new], d[new]
    b, o = w.data, offsets - offsets[0]
    total = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[o])
    upper = total((b >= 0x41) & (b <= 0x5A))
    lower = total((b >= 0x61) & (b <= 0x7A))
    size = np.maximum(1, np.diff(o))
    same = np.concatenate([[0, 0], (b[2:] == b[1:-1]) & (b[1:-1] == b[:-2]) & (b[2:] > 0x20)])[: len(b)] if len(b) > 2 else np.zeros(len(b))
    votes = np.stack([upper > lower, total(b == 0x21) * 40 > size, total(same) * 20 > size, total(np.isin(b, [0x23, 0x24, 0x25, 0x26, 0x2A])) * 20 > size], axis=1)
    return g, np.searchsorted(d, np.arange(n + 1)), votes


def hash_words(texts: list[str], mark: int = 0) -> np.ndarray:
    data, offsets = raw(texts_of(pa.array(texts, pa.string())))
    return words.split(data, offsets, "alnum", fold=True).hashes()


def fit_label_model(votes: np.ndarray, balance: float, rounds: int = 25) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 for each row of 0/1 votes (0: abstains), by EM from the voters' agreement alone.

    balance: share of class 1, known. rate[c, j]: how often voter j votes on class c; the last voter is silence, which
    votes where no other does. correlation: what is left of it between two voters within the classes.
    """
    many = votes.sum(axis=1)
    v = np.column_stack([votes, many == 0]).astype(float)
    q = np.where(many >= 2, 0.95, np.where(many == 1, 0.7, 0.02))
    model: dict = {}
    for _ in range(rounds):
        weight = np.stack([1 - q, q])
        rate = (weight @ v + 0.5) / (weight.sum(axis=1, keepdims=True) + 1.0)
        rest = v - (1 - q)[:, None] * rate[0] - q[:, None] * rate[1]
        cov = rest.T @ rest / max(1, len(v))
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.clip(cov / sd[:, None] / sd, 0, 1)
        np.fill_diagonal(corr, 0)
        corr[corr < 0.05] = 0
        z = (v * np.log(rate[1] / rate[0]) / (1 + v @ corr)).sum(axis=1)
        low, high = -60.0, 60.0  # the offset at which the posteriors' mean is the balance
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if _sigmoid(z + mid).mean() < balance else (low, mid)
        new, moved = _sigmoid(z + low), 0.0
        moved, q = np.abs(new - q).max(), new
        model = {"rate": rate, "correlation": corr, "offset": low}
        if moved < 1e-4:
            break
    return q, model


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _ratio(bad: np.ndarray, good: np.ndarray, n_bad: float, n_good: float) -> np.ndarray:
    return np.log((bad + 0.25) / (n_bad + 0.5)) - np.log((good + 0.25) / (n_good + 0.5))


def draw_lexicons(doc: np.ndarray, word: np.ndarray, y: np.ndarray, among: np.ndarray, size: int) -> list[int]:
    """At most LEXICONS of `size` words and beginnings that tell toxic rows (y) from others among some; (doc, word): these
    rows' distinct ones.

    The next word is the most telling one among toxic rows, each counted less for every word it has already."""
    bad, good = np.bincount(word[y[doc]], minlength=size), np.bincount(word[~y[doc]], minlength=size)
    ratio = _ratio(bad, good, (y & among).sum(), (~y & among).sum())
    able = (bad >= 3) & (ratio > TELLING)
    of = y[doc] & able[word]
    doc, word, had, drawn = doc[of], word[of], np.zeros(len(y)), []
    while len(drawn) < LEXICONS:
        gain = np.where(able, ratio * np.sqrt(np.bincount(word, 1 / (1 + had[doc]), minlength=size)), 0)
        j = int(gain.argmax()) if size else 0
        if not size or gain[j] <= 2:
            break
        drawn.append(j)
        able[j] = False
        had[doc[word == j]] += 1
    return drawn


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """The scorer: bucket weights, pattern weights and bias (of fixed size), and the label model for inspection."""
    spark = session(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null and pmod(crc32(cast(doc_id as string)), 5) <> 0")
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    folded = chosen.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = raw(texts_of(b.column(2)))
            for i, j in slices(offsets):
                g, at, votes = features(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                own = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([g[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array([r.tobytes() for r in votes], pa.binary())], names=["toxic", "fold", "words", "votes"])

    # at most fit_rows small rows: their ids are broadcast
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(folded), "doc_id")
    rows = staged(joined.select("toxic", "fold", "text").mapInArrow(run, "toxic int, fold int, words binary, votes binary"), shared_dir(spark, "toxic-rows"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n = np.unique(np.frombuffer(b"".join(b.column(2).to_pylist()), "<i8"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    counted = rows.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= RARE)
    vocabulary = np.sort(counted.orderBy(F.desc("n"), "h").limit(VOCABULARY).select("h").toArrow()["h"].to_numpy().view(U64))
    sent = spark.sparkContext.broadcast(vocabulary)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            found = []
            for w in b.column(2).to_pylist():
                w = np.frombuffer(w, "<u8")
                place = np.searchsorted(known, w)
                found.append(place[np.append(known, U64(0))[place] == w].astype("<i4").tobytes() if len(known) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary()), b.column(3)], names=["toxic", "fold", "words", "votes"])

    seen = rows.mapInArrow(pick, "toxic int, fold int, words binary, votes binary").toArrow()
    y, fold = seen["toxic"].to_numpy() > 0, seen["fold"].to_numpy()
    if not len(y) or y.all() or not y.any():
        return {"weights": np.zeros(BUCKETS, np.float32), "patterns": np.zeros(len(PATTERNS)), "bias": -1e-6, "label_model": {}}
    sets = [np.frombuffer(x, "<i4") for x in seen["words"].to_pylist()]
    patterns = np.stack([np.frombuffer(x, np.bool_) for x in seen["votes"].to_pylist()])
    word, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    weights, pattern_weights, bias, keep, model = learn(doc, word, y, fold, patterns, vocabulary)
    table = np.zeros(BUCKETS, np.float32)
    np.add.at(table, (vocabulary[keep] % U64(BUCKETS)).astype(np.int64), weights)
    return {"weights": table, "patterns": pattern_weights, "bias": float(bias), "label_model": model}


def learn(doc: np.ndarray, word: np.ndarray, y: np.ndarray, fold: np.ndarray, patterns: np.ndarray, vocabulary: np.ndarray):
    """Weights, pattern weights, bias, the words that have weights, and the label model, of rows' distinct words."""
    n, size = len(y), len(vocabulary)
    votes = np.zeros((n, LEXICONS + len(SEEDS)), bool)
    for f in np.unique(fold):
        own = (fold != f)[doc]
        for k, member in enumerate(draw_lexicons(doc[own], word[own], y, fold != f, size)):
            votes[doc[~own & (word == member)], k] = True
    for k, seeds in enumerate(SEEDS.values()):
        members = np.flatnonzero(np.isin(vocabulary, hash_words(seeds)))
        votes[doc[np.isin(word, members)], LEXICONS + k] = True
    posterior, model = fit_label_model(np.column_stack([votes, patterns]), y.mean())
    bad = np.bincount(word, posterior[doc], minlength=size)
    rows = np.bincount(word, minlength=size)
    ratio = _ratio(bad, rows - bad, posterior.sum(), n - posterior.sum())
    weight = np.abs(ratio) * np.sqrt(rows)
    keep = np.flatnonzero((weight > FEATURE) & ((ratio > 0) | (rows - bad > 40)))
    keep = keep[np.argsort(-weight[keep], kind="stable")][:20_000]
    column = np.full(size, -1)
    column[keep] = np.arange(len(keep))
    weights, pattern_weights, bias = _logistic(doc, column[word], len(keep), patterns, posterior)
    return weights, pattern_weights, bias, keep, model | {"posterior": posterior, "votes": votes}


def _logistic(doc: np.ndarray, column: np.ndarray, width: int, patterns: np.ndarray, soft: np.ndarray, rounds: int = 300, ridge: float = 2e-4):
    """Weights of words (present or not), of patterns, and the bias, by gradient descent with momentum on soft labels."""
    seen = column >= 0
    doc, column, n = doc[seen], column[seen], len(soft)
    w, p, b = np.zeros(width), np.zeros(patterns.shape[1]), 0.0
    vw, vp, vb = np.zeros(width), np.zeros(patterns.shape[1]), 0.0
    x = patterns.astype(float)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(column, minlength=width)) / n)  # rarer words take larger steps
    for _ in range(rounds):
        z = b + np.bincount(doc, w[column], minlength=n) + x @ p
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft) / n
        vw = 0.9 * vw - 0.3 * (scale * np.bincount(column, g[doc], minlength=width) + ridge * w)
        vp, vb = 0.9 * vp - 0.3 * (x.T @ g + ridge * p), 0.9 * vb - 0.3 * g.sum()
        w, p, b = w + vw, p + vp, b + vb
    return w, p, b


def score(docs: DataFrame, scorer: dict) -> DataFrame:
    """doc_id, score (0 to 1) of each row; no shuffle; the scorer is about 1 MB whatever it was fitted on."""
    spark = session(docs.sparkSession)
    sent = spark.sparkContext.broadcast({k: scorer[k] for k in ("weights", "patterns", "bias")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        for b in batches:
            data, offsets = raw(texts_of(b.column(1)))
            for i, j in slices(offsets):
                g, at, votes = features(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                total = np.concatenate([[0.0], np.cumsum(s["weights"][(g % U64(BUCKETS)).astype(np.int64)], dtype=np.float64)])
                z = s["bias"] + total[at[1:]] - total[at[:-1]] + votes @ s["patterns"]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session(spark).read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
