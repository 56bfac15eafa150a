"""What the operators of this package share: the shared folder, staged tables and Arrow text access."""

from __future__ import annotations

import atexit
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import reachable

#: Rows an Arrow batch to Python holds at most, so that batches of long texts stay small.
ARROW_ROWS = 1000
#: Bytes of a row group in tables of long rows.
LONG_ROWS_BYTES = 4 << 20
#: Bytes of text the NumPy kernels take at once.
SLICE_BYTES = 1 << 20


def session(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and let Spark drop a query's shuffle files when the query ends."""
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(ARROW_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


class _Scratch(threading.local):
    """Folders made in each open scratch block of a thread, the innermost last."""

    def __init__(self) -> None:
        self.blocks: list[list[str]] = []


_scratch = _Scratch()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the shared folders made inside it, but for those made with keep: what leaves the block
    must rest on kept tables alone."""
    _scratch.blocks.append([])
    try:
        yield
    finally:
        for path in _scratch.blocks.pop():
            remove(spark, path)


def shared_dir(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Only a local session may lack that setting (as in tests); it gets a folder in the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    path = f"{root.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    atexit.register(_quietly_remove, spark, path)
    if _scratch.blocks and not keep:
        _scratch.blocks[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _quietly_remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended before the interpreter
        pass


def staged(df: DataFrame, path: str, long_rows: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a lost executor costs no more than its tasks.

    long_rows: for rows of megabytes. Parquet looks at the size of a page or row group only every 100 rows, and a reader
    holds a row group's page and batch, so these get a row group for each few rows.
    """
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if long_rows:
        writer = writer.option("parquet.page.size.row.check.min", "1").option("parquet.block.size", str(LONG_ROWS_BYTES))
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """docs without the rows whose doc_id is in gone. The ids become a table first: Spark broadcasts it if its size
    is below the session's threshold, and joins by shuffle beyond."""
    ids = staged(gone.select("doc_id").distinct(), shared_dir(docs.sparkSession, name, keep=True))
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


def tasks_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts_of(column: pa.Array) -> pa.Array:
    """The column as large strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of a column of large strings or binaries."""
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), o


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `size` bytes each; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def binaries(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())
