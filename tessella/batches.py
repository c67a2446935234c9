"""How texts are handed to workers and leave them: batches that both sides can hold, and memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of whole texts that go to a worker at once.
BATCH_ROWS = 2000
#: Bytes of texts of any length that go to a worker at once, where an operator asks for such a bound.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand texts to workers in batches of at most BATCH_ROWS rows from now on in this session: both sides hold a batch in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def short_batches(spark: SparkSession) -> None:
    """`small_batches` of at most BATCH_BYTES, or one row: rows that grow don't let batches grow with them."""
    small_batches(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def release_memory() -> None:
    """Give memory that was freed in this worker back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`f`, after which its worker holds nothing: workers are kept for later tasks, of other stages too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release_memory()

    return run
