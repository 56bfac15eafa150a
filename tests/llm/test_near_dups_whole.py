"""Links that a search bounded by neighbours or labels loses; k is 4, the threshold 0.8."""

import numpy as np

from tessera.llm import near_dups


def _edited(words, n, mark):
    """words with n of them replaced, far enough apart to change four shingles each."""
    out = list(words)
    for i, at in enumerate(np.linspace(4, len(words) - 5, n).astype(int)):
        out[at] = f"{mark}x{i}"
    return out


def _component(spark, texts):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r.component_id for r in near_dups.groups(docs, 4).collect()}


def test_bridges_of_large_groups(spark):
    """An original, 3,000 copies at 0.92 to it and 60 at 0.8 to it, but below 0.8 to each other and to the copies."""
    base = [f"w{i}" for i in range(300)]
    r, texts = np.random.default_rng(5), [base]
    for c, n in enumerate([3] * 3000 + [8] * 60):
        t = list(base)
        for at in r.choice(np.arange(4, 296, 4), n, replace=False):
            t[at] = f"c{c}p{at}"
        texts.append(t)
    assert set(_component(spark, texts).values()) == {0}


def _template(spark, shared, n, pairs, words=100):
    """n documents; the first ones have a copy with two other words."""
    texts = [[f"t{i}" for i in range(shared)] + [f"d{d}w{i}" for i in range(words - shared)] for d in range(n)]
    texts += [_edited(texts[p], 2, f"p{p}") for p in range(pairs)]
    assert _component(spark, texts) == {i: i - n if i >= n else i for i in range(len(texts))}


def test_dense_region_without_agreeing_neighbours(spark):
    """Documents of one template at 0.6 to each other: their next neighbours fail the check on labels."""
    _template(spark, 76, 12000, 3000)


def test_dense_region_beyond_every_reach(spark):
    """At 0.7 to each other a region is wider than any reach even when many labels are asked for; the copies are at 0.8."""
    _template(spark, 62, 2500, 2500, words=75)


def test_pairs_at_the_threshold(spark):
    """72 shingles, 64 of them shared: exactly 0.8."""
    texts = [[f"d{d}w{i}" for i in range(75)] for d in range(6000)]
    texts += [_edited(t, 2, f"e{d}") for d, t in enumerate(texts)]
    got = _component(spark, texts)
    assert got == {i: i % 6000 for i in range(12000)}
