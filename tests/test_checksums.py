"""CRCs of whole contents, against the loop over single bytes and zlib."""

import zlib

import pandas as pd
import pyarrow.parquet as pq

from tessera import queries
from tessera.functions.checksums import CHUNK, Crc, crc, crc_table

KINDS = ((0x82F63B78, 32), (0xC96C5795D7870F42, 64))


def test_rows_of_every_length():
    rows = [bytes((i * 7 + n) % 256 for i in range(n)) for n in [*range(20), CHUNK - 1, CHUNK, CHUNK + 1, 3 * CHUNK, 5000]]
    for polynomial, width in KINDS:
        want = [f"{crc(x, crc_table(polynomial), (1 << width) - 1):0{width // 4}x}" for x in rows]
        assert list(Crc(polynomial, width).hex(pd.Series([*rows, None], dtype=object))) == [*want, None]


def test_checksums_of_contents(spark, sf):
    text = dict(zip(*(c.to_pylist() for c in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).columns), strict=True))
    got = queries.QUERIES["checksums_crc"](spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        x = text[r.doc_id].encode()
        assert r.crc32 == f"{zlib.crc32(x):08x}"
        assert [r.crc32c, r.crc64] == [f"{crc(x, crc_table(p), (1 << w) - 1):0{w // 4}x}" for p, w in KINDS]
