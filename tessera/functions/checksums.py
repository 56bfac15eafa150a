"""Checksums: CRC32, SHA-256 and MD5 are Spark's own; CRC32C and CRC64 are table-driven over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def crc_table(polynomial: int) -> list[int]:
    """The table of a reflected polynomial."""
    out = []
    for b in range(256):
        for _ in range(8):
            b = (b >> 1) ^ (polynomial if b & 1 else 0)
        out.append(b)
    return out


def crc(data: bytes, table: list[int], ones: int) -> int:
    c = ones
    for b in data:
        c = table[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ ones


#: Bytes of a chunk; all chunks of some rows are taken at once, column by column. Bytes of rows that are.
CHUNK, GROUP = 256, 4 << 20


class Crc:
    """CRCs of many rows of bytes at once; the width is 32 or 64 bits and the register starts and ends with all ones."""

    def __init__(self, polynomial: int, width: int):
        self.digits, self.size = width // 4, width // 8
        self.ones = np.uint64((1 << width) - 1)
        self.table = np.array(crc_table(polynomial), np.uint64)
        # what CHUNK zero bytes make of a register, by each of its bytes
        c = np.arange(256, dtype=np.uint64) << (np.arange(self.size, dtype=np.uint64)[:, None] * np.uint64(8))
        for _ in range(CHUNK):
            c = self._step(c, np.uint64(0))
        self.zeros = c

    def _step(self, c: np.ndarray, byte) -> np.ndarray:
        return self.table[(c ^ byte) & np.uint64(0xFF)] ^ (c >> np.uint64(8))

    def rows(self, rows: list[bytes]) -> np.ndarray:
        """Rows stand behind zero bytes, which leave a register of zero as it is; the ones it starts with are in the first bytes."""
        out = np.zeros(len(rows), np.uint64)
        short = [i for i, x in enumerate(rows) if len(x) < self.size]
        for i in short:
            out[i] = crc(rows[i], self.table.tolist(), int(self.ones))
        long = sorted((i for i, x in enumerate(rows) if len(x) >= self.size), key=lambda i: -len(rows[i]))
        if not long:
            return out
        many = np.array([-(-len(rows[i]) // CHUNK) for i in long])
        first = np.cumsum(many) - many
        data = np.zeros(int(many.sum()) * CHUNK, np.uint8)
        for i, end in zip(long, (first + many) * CHUNK, strict=True):
            at = end - len(rows[i])
            data[at:end] = np.frombuffer(rows[i], np.uint8)
            data[at : at + self.size] ^= 0xFF
        columns = np.ascontiguousarray(data.reshape(-1, CHUNK).T)
        parts = np.zeros(columns.shape[1], np.uint64)
        for column in columns:
            parts = self._step(parts, column)
        c = parts[first]
        for k in range(1, int(many[0])):  # the longest rows are first
            n = int(np.searchsorted(-many, -k))
            moved = np.zeros(n, np.uint64)
            for b in range(self.size):
                moved ^= self.zeros[b][(c[:n] >> np.uint64(8 * b)) & np.uint64(0xFF)]
            c[:n] = moved ^ parts[first[:n] + k]
        out[long] = c ^ self.ones
        return out

    def hex(self, data: pd.Series) -> pd.Series:
        """Lower-case hex of each value, null for null."""
        out, held, size = [], [], 0
        values = list(data)
        for i, x in enumerate(values):
            held.append(b"" if x is None else bytes(x))
            size += len(held[-1])
            if size >= GROUP or i == len(values) - 1:
                out.extend(self.rows(held).tolist())
                held, size = [], 0
        return pd.Series([None if x is None else f"{c:0{self.digits}x}" for x, c in zip(values, out, strict=True)], index=data.index, dtype=object)


_CRC32C, _CRC64 = Crc(0x82F63B78, 32), Crc(0xC96C5795D7870F42, 64)


@F.pandas_udf(T.StringType())
def crc32c(data: pd.Series) -> pd.Series:
    return _CRC32C.hex(data)


@F.pandas_udf(T.StringType())
def crc64(data: pd.Series) -> pd.Series:
    return _CRC64.hex(data)


def crc32(data: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.crc32(data)), 8, "0"))


def checksum(data: Column, kind: str) -> Column:
    """Hex checksum of binary data by kind (case doesn't matter)."""
    made = {"crc32": crc32, "crc32c": crc32c, "crc64": crc64, "sha256": lambda c: F.sha2(c, 256), "md5": F.md5}
    return made[kind.lower()](data)


def verify(data: Column, expected: Column, kind: str) -> Column:
    return checksum(data, kind) == F.lower(expected)
