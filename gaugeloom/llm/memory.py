"""Memory of Python workers, which outlive their tasks."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES, BATCH_BYTES = 2 << 20, 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches that go to Python hold BATCH_BYTES at most, unless the session asks for fewer: executors buffer several of them off their heap."""
    if int(spark.conf.get(_BATCH, str(BATCH_BYTES + 1)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)


def slices(batch: pa.RecordBatch, column: int, rows: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` rows and `size` bytes of the text in `column`, or of one row that is longer."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + size, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def give_back() -> None:
    """Returns what this process has freed to the system, so that it is there for the JVM and the next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow that gives memory back when its partition is done."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped
