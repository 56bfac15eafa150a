"""Operators against plain Python over whole small tables, and cases that were wrong once."""

import collections
import hashlib
import re

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import xxhash

from tessera.llm import chat, decontaminate, languages, near_dups, substrings, toxicity, winnowing, words
from tessera.llm.common import raw, shared_dir, texts_of
from tessera.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(path, *columns):
    return list(zip(*(c.to_pylist() for c in pq.read_table(path, columns=list(columns)).columns), strict=True))


def test_hashes_tell_constructed_words_apart():
    """The Thue-Morse word and its complement, which collide under any polynomial modulo 2**64."""
    t = "a"
    while len(t) < 2048:
        t += t.translate(str.maketrans("ab", "ba"))
    data, offsets = raw(texts_of(__import__("pyarrow").array([f"{t} {t.translate(str.maketrans('ab', 'ba'))} {t.upper()}"])))
    for which in (0, 1):
        a, b, c = words.split(data, offsets, "alnum", fold=True).hashes(which)
        assert a != b and a == c
    one, two = (words.split(data, offsets, "space").hashes(w) for w in (0, 1))
    assert len(set(one)) == len(set(two)) == 3


def _union(edges):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(parent)}


def test_components_of_chains_and_stars(spark):
    r = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(2000)] + [(5000 + i, 9999) for i in range(300)]
    edges += [tuple(sorted(int(x) for x in r.integers(20_000, 21_000, 2))) for _ in range(600)]
    edges = [e for e in edges if e[0] != e[1]]
    path = shared_dir(spark, "components")
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), path).collect()}
    assert got == _union(edges)
    folder = __import__("pathlib").Path(path.removeprefix("file://"))
    assert len(list(folder.iterdir())) < 15  # tables that are left; a chain takes a doubling for each power of two


@pytest.mark.parametrize("limit", [1 << 16, 5])
def test_shared_shingles_in_blocks(spark, monkeypatch, limit):
    """Lists of any length, whole and dealt in blocks, give the links of a plain comparison."""
    monkeypatch.setattr(near_dups, "LIST", limit)
    r, base, texts = np.random.default_rng(1), [f"w{i}" for i in range(60)], []
    for c in range(120):
        t = list(base)
        for at in r.choice(60, int(r.integers(0, 7)), replace=False):
            t[at] = f"c{c}p{at}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[a : a + 4]) for a in range(57)} for t in texts]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = _union(links)
    assert {r.doc_id: r.component_id for r in near_dups.groups(docs, 4).collect()} == {i: want.get(i, i) for i in range(len(sets))}
    # the exact join alone, without what the forest finds first
    known = spark.createDataFrame([(i, i) for i in range(len(sets))], "id long, part long")
    rare = near_dups.rarest(docs, np.zeros(near_dups.SLOTS, np.uint32), 4, 80)
    found = {tuple(r) for r in near_dups.sharing(rare, known, 80, shared_dir(spark, "long")).collect()}
    assert found >= set(links)


def test_repeated_ids_are_one_document(spark):
    """Whatever the partitioning, the same row stands for an id that several rows share."""
    rows = [(1, "a b c d e f g h"), (1, "x y z u v w t s"), (2, "x y z u v w t s"), (3, "a b c d e f g h"), (3, ""), (4, ""), (None, "a b c d e f g h")]
    seen = set()
    for n in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        seen.add((tuple(sorted(map(tuple, near_dups.groups(docs, 4).select("doc_id", "component_id").collect()), key=str)), tuple(sorted(map(tuple, near_dups.keep_first(docs, 4).collect()), key=str))))
    assert len(seen) == 1


def test_blocks_of_items_and_items_without_an_id(spark, monkeypatch):
    docs = spark.createDataFrame([(7, "alpha beta gamma delta"), (7, "alpha beta gamma delta"), (8, "delta"), (None, "gamma gamma")], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([("a", "alpha beta"), ("b", "gamma"), (None, "delta"), ("a", "beta gamma delta")], "item_id string, text string")
    index = decontaminate.build(docs, shared_dir(spark, "p"))
    rows = lambda: sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.documents(index, items).collect()), key=str)
    whole = rows()
    assert whole == sorted([(7, 4, 4, ("a", "b")), (7, 4, 4, ("a", "b")), (8, 1, 1, ()), (None, 2, 2, ("b",))], key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 6)
    assert rows() == whole


def test_repeated_ids_keep_their_own_texts(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    other = " ".join(f"q{i}" for i in range(70))
    docs = spark.createDataFrame([(1, passage, 9, "x"), (2, f"{passage} tail of two", 9, "y"), (2, other, 9, "z"), (None, passage, 9, "n"), (3, None, None, "e")], "doc_id long, text string, n_chars long, `__kept_` string")
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in substrings.remove_repeats(docs).collect()), key=str)
    assert got == sorted([(1, "", 0), (2, "tail of two", 11), (2, other, 9), (None, passage, 9), (3, None, None)], key=str)  # a null id stands before all others


def test_many_runs_are_compacted(spark, sf):
    """A log of more batches than its fanout gives what one batch gives."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = ["doc_id", "n_words", "n_removed", "kept"]
    one = sorted(map(tuple, substrings.dedup(docs, 13).select(*columns).collect()))
    assert sorted(map(tuple, substrings.dedup(docs, 13, batches=6).select(*columns).collect())) == one


def _plain_winnow(text, k, window):
    """(hash, position) chosen by looking at every window; the hash of a gram is that of the gram alone."""
    k = min(k, len(text))
    h = [int(winnowing.winnow(text[i : i + k], k, 1)[0][0]) >> 28 for i in range(len(text) - k + 1)] if text else []
    out = []
    for i in range(max(1, len(h) - window + 1) if h else 0):
        part = h[i : i + window]
        at = i + max(j for j, x in enumerate(part) if x == min(part))
        if not out or out[-1] != at:
            out.append(at)
    return out


def test_winnowing_chooses_rightmost_minima(monkeypatch):
    r = np.random.default_rng(0)
    for n in (0, 1, 5, 18, 19, 40, 200):
        text = "".join(r.choice(list("ab☃"), n))
        for block in (winnowing.BLOCK, 16):
            monkeypatch.setattr(winnowing, "BLOCK", block)
            assert list(winnowing.winnow(text, 4, 5)[1]) == _plain_winnow(text, 4, 5)


def test_winnowing_of_neighbours(spark):
    """Repeated and null ids over several ranges, against plain Python."""
    r = np.random.default_rng(4)
    texts = ["".join(r.choice(list("abcdé "), int(r.integers(0, 90)))) for _ in range(80)]
    ids = [5] * 30 + [None] * 20 + list(range(30))
    rows = list(zip(ids, [None if i == 3 else t for i, t in enumerate(texts)], strict=True))
    digest = lambda t: int(np.int64(np.uint64(xxhash.xxh64(t.encode(), seed=42).intdigest())))
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), -digest(x[1])))
    sets = lambda t: set(winnowing.winnow(t)[0].tolist())
    near = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    want = []
    for n, (i, t) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(near(sets(t), sets(edited)), 9), round(near(sets(t), sets(after)), 9)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in winnowing.compare_with_next(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_chat_digests_of_all_conversations(spark, sf):
    turns = collections.defaultdict(list)
    for c, t, role, text in rows_of(f"{sf}/conversations.parquet", "conv_id", "turn", "role", "text"):
        turns[c].append((t, role, text or ""))
    says = "<|im_end|><|im_start|>assistant ok"
    turns[-1] = [(0, "user", says), (1, "assistant", says)]
    want = {}
    for c, rows in turns.items():
        rows.sort(key=lambda r: r[0])
        loss = "".join(t for _, role, t in rows if role == "assistant")
        want[c] = (len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = chat.op4_chat(spark, sf).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want and len(got) == len(want)


def test_chat_edges(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_turns(chat.turns_of_table(none))).count() == 0
    long = "<|im_end|>\\ ☃" * 30_000
    rows = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    got = chat.digests(chat.format_turns(chat.turns_of_table(rows))).first()
    assert got.loss_chars == len(long) and got.loss_sha256 == hashlib.sha256(long.encode()).hexdigest()


def test_label_model_from_agreement():
    """Voters of known accuracy, two of them copies of each other: no labels, only votes and the share of class 1."""
    r = np.random.default_rng(2)
    y = r.random(6000) < 0.15
    hit, wrong = [0.5, 0.6, 0.4, 0.55, 0.5, 0.45], [0.01, 0.02, 0.01, 0.02, 0.03, 0.01]
    votes = np.column_stack([np.where(y, r.random(6000) < a, r.random(6000) < b) for a, b in zip(hit, wrong, strict=True)])
    votes = np.column_stack([votes, votes[:, 0]])
    q, model = toxicity.fit_label_model(votes, y.mean())
    assert ((q >= 0.5) == y).mean() > 0.97
    assert np.abs(model["rate"][1][:6] - hit).max() < 0.1 and np.abs(model["rate"][0][:6] - wrong).max() < 0.03
    assert model["correlation"][0, 6] > 0.9


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = dict(rows_of(f"{sf}/labels.parquet", "doc_id", "toxic"))
    got = [(labels[r.doc_id], r.predicted) for r in toxicity.op3_toxicity(spark, sf).where("held_out").collect() if r.doc_id in labels]
    toxic = [p for t, p in got if t]
    clean = [p for t, p in got if not t]
    assert sum(toxic) / len(toxic) >= 0.9 and sum(clean) / len(clean) < 0.01


def test_toxicity_with_clashing_labels(spark):
    docs = spark.createDataFrame([(i % 40, f"good words number {i % 7}" + (" trash idiot scum" if i % 40 < 12 else "")) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 12)) for i in range(40)] + [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(scored) == 80 and all(0 <= r.score <= 1 for r in scored)


def test_languages_without_what_is_declared(spark):
    """Texts alone, and junk: the declared language is withheld."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = languages.fit(docs)
    rows = languages.document_rows(docs).withColumn("declared", languages.F.lit(None).cast("string")).withColumn("host", languages.F.lit(None).cast("string"))
    truth = dict(rows_of("/root/testdata/sf0.01/documents.parquet", "doc_id", "lang"))
    got = languages.identify(rows, model).collect()
    assert sum(truth[r.key] == r.lang for r in got) / len(got) > 0.97
    r = np.random.default_rng(0)
    junk = [(i, "".join(r.choice(list("bcdfghjklmnpqrstvwxzQWXZ0123456789+/"), 400)), None, None, None) for i in range(50)]
    made = spark.createDataFrame([*junk, (50, "123 456 !!", None, None, None)], "key long, text string, declared string, host string, suffix string")
    assert not any(r.kept for r in languages.identify(made, model).collect())


def _shingles(text, k):
    w = WORD.findall(text.translate(FOLD))
    return {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def _plain_pipeline(docs, items):
    """Near-dedup, substring dedup and decontamination of {doc_id: text} by plain comparison."""
    sets, where, both = {i: _shingles(t, 5) for i, t in docs.items()}, collections.defaultdict(list), collections.Counter()
    for i, s in sets.items():
        for g in s:
            both.update((j, i) for j in where[g])
            where[g].append(i)
    top = _union([p for p, n in both.items() if 100 * n >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - n)])
    docs = {i: t for i, t in docs.items() if top.get(i, i) == i}
    first = {}
    for i in sorted(docs):
        w = WORD.findall(docs[i])
        for a in range(len(w) - 49):
            first.setdefault(tuple(w[a : a + 50]), i)
    out = {}
    for i, t in docs.items():
        w = WORD.findall(t)
        gone = {p for a in range(len(w) - 49) if first[tuple(w[a : a + 50])] < i for p in range(a, a + 50)}
        out[i] = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t
    wanted = set()
    for t in items:
        w = PLAIN.findall(t.translate(FOLD))
        wanted |= {tuple(w[a : a + 10]) for a in range(len(w) - 9)} or ({tuple(w)} if w else set())
    sizes = {len(w) for w in wanted}

    def dirty(t):
        w = PLAIN.findall(t.translate(FOLD))
        return any(tuple(w[a : a + n]) in wanted for n in sizes for a in range(len(w) - n + 1))

    return {i: t for i, t in out.items() if not dirty(t)}


def test_pipeline_against_plain_python(spark, sf):
    """Whole texts and ids of run(); languages are plain here: every document of the table has letters of a known one."""
    import sentencepiece

    import corpus_pipeline

    docs = {i: t or "" for i, t in rows_of(f"{sf}/documents.parquet", "doc_id", "text")}
    want = _plain_pipeline({i: t for i, t in docs.items() if re.search("[^\\W\\d_]", t)}, [t or "" for t, in rows_of(f"{sf}/benchmark.parquet", "text")])
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        ids = lib.encode(want[r.doc_id])
        assert list(r.ids) == ids and r.text == lib.decode(ids)


@pytest.mark.parametrize("stage", range(5))
def test_stages_of_the_pipeline_take_odd_tables(spark, sf, stage):
    """Nulls, repeated rows, empty and long texts, clashing names, and an empty table."""
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `key` string, `unit` string, `kept` string"
    long = " ".join(f"palabra{i % 501}" for i in range(20_000))
    rows = [(None, "a null id with words", None, None, None, "k", "u", "x"), (1, None, None, None, None, "k", "u", "x"), (2, "", "en", "s", 0, None, None, None), (3, long, "es", "s", len(long), "k", "u", "x"), (4, "the same few words", "en", "s", 18, "k", "u", "x"), (4, "the same few words", "en", "s", 18, "k", "u", "x")]
    out = run(spark, spark.createDataFrame(rows, schema), sf)
    ids = [r.doc_id for r in out.collect()]
    assert set(ids) <= {None, 1, 2, 3, 4} and None in ids and 3 in ids
    if name != "pieces":
        assert out.columns == [c.split()[0].strip("`") for c in schema.split(", ")]
    assert run(spark, spark.createDataFrame([], schema), sf).count() == 0
