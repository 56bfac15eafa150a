import glob
import os

import duckdb
import pytest

from tessera import queries
from tessera.functions.checksums import crc, crc_table
from tessera.streaming.limiters import Breaker, Lockout, SlidingWindow, TokenBucket


def _rows(df):
    return sorted(tuple("%.6f" % x if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert _rows(queries.QUERIES[name](spark, sf).toPandas()) == _rows(con.execute(queries.ORACLE_SQL[name]).df())


def test_crc_known_answers():
    assert f"{crc(b'123456789', crc_table(0x82F63B78), 0xFFFFFFFF):08x}" == "e3069283"
    assert f"{crc(b'123456789', crc_table(0xC96C5795D7870F42), (1 << 64) - 1):016x}" == "995dc9bbdf1939fa"


def test_machines():
    bucket = TokenBucket(1000, 5000)
    assert [bucket.step(0, n) for n in (3000, 1000, 2000)] == [True, True, False]
    window = SlidingWindow(1, 0.1, 5)
    assert [window.step(0.01 * i) for i in range(6)] == [True] * 5 + [False]
    lock = Lockout(5, 900, 900)
    assert [lock.step(i, 1) for i in range(6)] == [True] * 5 + [False]
    b = Breaker(3, 0.5, 0.1, 3)
    for i in range(3):
        b.step(0.0, 1)
    assert b.state == "open" and not b.step(0.05, 0) and b.step(0.15, 0) and b.state == "half-open"
