"""Fitting on distinct texts, for every declared language."""

import numpy as np

from tessera.llm import languages


def test_copies_count_once_and_no_language_is_left_out(spark):
    names = [f"l{i:02}" for i in range(66)]
    rows = [(f"{chr(97 + i % 26)}{chr(97 + i // 26)}zo", x) for i, x in enumerate(names)]
    others = [(f"word{chr(97 + i)}", names[0]) for i in range(20)]
    docs = spark.createDataFrame([*rows, *others], "text string, lang string").coalesce(1)
    once = languages.fit(docs, fit_rows=5)
    assert once["languages"] == [names[0], *names[1:], languages.UND]
    first = docs.where(languages.F.col("lang") == names[0]).orderBy(languages.F.xxhash64("text")).limit(1)
    copies = spark.createDataFrame(first.collect() * 50, docs.schema)
    again = languages.fit(docs.where(languages.F.col("lang") == names[0]).unionAll(copies).coalesce(1), fit_rows=5)
    assert np.array_equal(again["log"][0], once["log"][0])
