"""Helpers shared by the corpus operators: shared storage, bounded slices of Arrow text columns."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import drop_table, materialize, read_shared, shared_dir, write_shared
from .pretokens import release

__all__ = ["bounded_batches", "drop_table", "map_arrow", "materialize", "read_shared", "read_table", "shared_dir", "slices", "spread", "text_buffers", "write_shared"]

#: Bytes of text that a numpy kernel works on at once; bounds a Python worker's memory.
SLICE_BYTES = 1 << 19


#: Tasks that read files at most.
MAX_READERS = 50_000
#: Bytes of one Arrow batch between the JVM and a Python worker; both sides hold one or two.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Make the session's Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@functools.cache
def _trim():
    """The C library's call that returns freed memory to the system; nothing where there is none."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in small batches; a task gives unused memory back when it ends."""
    bounded_batches(df.sparkSession)

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release()
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return df.mapInArrow(tidy, schema)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column as numpy arrays; nulls count as empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, off, data = column.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges (i, j) of rows whose texts together hold at most limit bytes, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(files: DataFrame) -> DataFrame:
    """A written table of files, dealt out so that each task reads one or few of them."""
    return files.repartition(max(1, min(files.count(), MAX_READERS)))
