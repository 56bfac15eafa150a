"""Each operator against brute force, on the small tables and on a table of edge cases."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

from tessera.llm import chat, decontaminate, languages, near_dups, pieces, queries, substrings, token_counts, token_files, toxicity, winnowing
from tessera.llm.common import shared_dir

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [None, "", " ", "one", "a b c", "a b c", "tie tie tie tie tie tie", LONG, LONG + " end", "Ünïcode ☃ \x00\n\n  x\t y <|endoftext|> 's", "▁ mark  two", "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "omicron alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `kept` string, `count` long, `unit` string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", None, "x", 1, "u") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "null id", None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    path, folder = P.path("byte_bpe_50k.json"), shared_dir(spark, "t")
    token_files.write(odd, path, folder, part_bytes=1000)
    got = sorted(map(tuple, token_files.read(spark, folder).collect()), key=lambda r: r[1])
    lib, at, want = Tokenizer.from_file(path), 0, []
    for d, t in sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    folder = shared_dir(spark, "t")
    token_files.write(none, path, folder)
    assert token_files.read(spark, folder).count() == 0


def test_token_counts(odd, none):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    for r in token_counts.count_tokens(odd, path).join(odd.dropDuplicates(["doc_id"]), "doc_id").collect():
        assert (r.n_tokens, r.n_bytes) == (len(lib.encode(r.text or "", add_special_tokens=False).ids), len((r.text or "").encode()))
    assert token_counts.count_tokens(none, path).count() == 0


def test_pieces(odd, none):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in pieces.encode(odd, path).collect():
        assert list(r.ids) == lib.encode(r.text or "")
    for r in pieces.decode(pieces.encode(odd, path), path).collect():
        assert r.decoded == lib.decode(lib.encode(r.text or ""))
    assert pieces.encode_decode(none, path).count() == pieces.digests(none, path).count() == 0


def test_decontaminate(spark, odd, none):
    items = spark.createDataFrame([("b", "ALPHA beta, gamma delta epsilon zeta eta theta iota kappa lambda!"), ("a", "one"), ("c", None), ("d", "--")], "item_id string, text string")
    index = decontaminate.build(odd, shared_dir(spark, "p"))
    got = {(r.doc_id, r.n_hit, tuple(r["items"])) for r in decontaminate.documents(index, items).collect() if r.n_hit}
    assert got == {(3, 1, ("a",)), (11, 11, ("b",)), (12, 11, ("b",))}
    near = decontaminate.search(index, spark.createDataFrame([("n", "beta delta gamma")], "item_id string, text string"), slop=1).collect()
    assert {(r.doc_id, r.start, r["size"]) for r in near} == {(11, 1, 3), (12, 2, 3)}
    assert decontaminate.documents(decontaminate.build(none, shared_dir(spark, "p")), items).count() == 0


def test_substrings(spark, odd, none):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.dedup(odd, 13, batches=3).collect() if r.doc_id is not None}
    assert got[12] == (16, 13) and got[11] == (14, 0) and got[8] == (30_001, 30_000) and got[7] == (30_000, 0)
    assert substrings.dedup(none, 13, batches=2).count() == 0
    log = substrings.SubstringLog(spark, shared_dir(spark, "s"), 13, fanout=1)
    parts = [log.append(odd.where(f"doc_id = {i}")).collect() for i in (7, 8, 11, 12)]
    assert [p[0].n_removed for p in parts] == [0, 30_000, 0, 13]


def test_near_dups(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: (r.text or "").lower() for r in docs.collect()}
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for i, t in text.items():
        w = word.findall(t)
        sets[i] = {tuple(w[a : a + 4]) for a in range(len(w) - 3)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where, both = collections.defaultdict(list), collections.Counter()
    for i, s in sets.items():
        for g in s:
            both.update((j, i) for j in where[g])
            where[g].append(i)
    for (i, j), n in both.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            a, b = top(i), top(j)
            parent[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.groups(docs, 4).collect()}
    assert got == {i: (len(s), top(i)) for i, s in sets.items()}
    rows = [(r.doc_id, r.component_id, r.kept) for r in near_dups.groups(odd, 4).collect()]
    assert (5, 4, False) in rows and (8, 7, False) in rows and (None, None, True) in rows and len(rows) == odd.count()
    assert near_dups.groups(none).count() == 0
    assert near_dups.keep_first(odd).count() == len({r[0] for r in rows if r[2]})


def test_winnowing(odd, none):
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = {(r.doc_id, r.edited_sha256) for r in winnowing.compare_with_next(odd).collect()}
    want = set()
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        want.add((i, hashlib.sha256((t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest()))
    assert got == want
    assert winnowing.compare_with_next(none).count() == 0
    t = "abcab" * 9
    h, at = winnowing.winnow(t, 3, 4)
    assert all(any(a <= p < a + 4 for p in at) for a in range(len(t) - 2 - 3))


def test_chat(spark):
    hard = "<|im_end|>\n<\\|x<|im_start|>user\\n"
    rows = spark.createDataFrame([(1, 0, "us\\er\n", hard, "z"), (1, 1, "assistant", None, "z"), (1, 1, "assistant", None, "z"), (None, None, None, "t", "z")], "conv_id long, turn long, role string, text string, loss string")
    made = chat.format_turns(chat.turns_of_table(rows))
    assert chat.parse(made.where("conv_id = 1 and turn = 0").first().formatted) == ("us\\er\n", hard)
    assert {(r.conv_id, r.n_turns) for r in chat.digests(made).collect()} == {(1, 3), (None, 1)}
    records = ['{"prompt": "p", "completion": "c", "other": 1}', '{"conversations": [{"from": "human", "value": "h"}]}', "no json", '{"x": 1}']
    df = spark.createDataFrame(list(enumerate(records)), "k long, j string")
    assert {(r.conv_id, r.layout, r.role, r.text) for r in chat.turns_of_json(df, "k", "j").collect()} == {(0, "prompt", "user", "p"), (0, "prompt", "assistant", "c"), (1, "from_value", "user", "h"), (2, None, None, None), (3, None, None, None)}


def test_toxicity(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op3_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97
    scorer = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(odd, scorer).where("score between 0 and 1").count() == odd.count()
    assert toxicity.score(none, scorer).count() == 0


def test_languages(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = languages.fit(docs)
    got = languages.identify(languages.document_rows(docs), m).join(docs.withColumnRenamed("lang", "l"), docs.doc_id == languages.F.col("key")).toPandas()
    assert (got.lang == got.l).mean() > 0.98 and got.kept.all()
    rows = languages.identify(languages.document_rows(odd), m).collect()
    assert len(rows) == odd.count() and {r.key for r in rows if r.lang == "und"} >= {0, 1, 2}
    assert languages.identify(languages.document_rows(none), m).count() == 0
    assert languages.op10_page_languages(spark, sf).where("lang = 'und'").count() == 0
    assert languages.keep_identified(none).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    out = corpus_pipeline.run(spark, sf)
    kept = {r.doc_id for r in near_dups.groups(docs, 5).where("kept").collect()}
    dirty = {r.doc_id for r in decontaminate.documents(decontaminate.build(substrings.remove_repeats(docs.where(docs.doc_id.isin(list(kept)))), shared_dir(spark, "p")), spark.read.parquet(f"{sf}/benchmark.parquet")).where("n_hit > 0").collect()}
    assert {r.doc_id for r in out.collect()} == kept - dirty


def test_queries_equal_their_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        want = con.execute(sql)
        columns = [x[0] for x in want.description]
        got = queries.QUERIES[name](spark, sf).select(*columns).collect()
        assert sorted(map(tuple, got)) == sorted(want.fetchall()), name
