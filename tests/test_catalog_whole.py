"""Catalog queries over all rows, against plain Python."""

import hashlib

import pyarrow.parquet as pq

from tessera import queries


def _columns(sf, name, *columns):
    return zip(*(c.to_pylist() for c in pq.read_table(f"{sf}/{name}.parquet", columns=list(columns)).columns), strict=True)


def test_every_object_and_part(spark, sf):
    parts = set(_columns(sf, "lineitem", "l_orderkey", "l_linenumber"))
    assert {(r.upload_id, r.part_number) for r in queries.QUERIES["list_parts_all"](spark, sf).collect()} == {p for p in parts if p[1] > 2}
    placed = queries.QUERIES["list_parts_text_order_all"](spark, sf).collect()
    assert {(r.upload_id, r.part_number) for r in placed} == parts and len(placed) == len(parts)
    texts = dict(_columns(sf, "documents", "doc_id", "text"))
    assert len({r.arn for r in queries.QUERIES["arn_all"](spark, sf).collect()}) == len(texts)


def test_whole_texts_are_indexed(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long = spark.createDataFrame([(10**9, "é" * 800_000), (10**9 + 1, " \n")], "doc_id long, text string")
    docs.unionByName(long, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text_md5 for r in queries.QUERIES["auto_index_texts"](spark, str(tmp_path)).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text").collect()}
    assert 10**9 in got
    for i, x in got.items():
        assert x == hashlib.md5(texts[i].encode()[: 1 << 20]).hexdigest()
    assert 10**9 + 1 not in got
