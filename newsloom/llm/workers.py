"""What a task leaves in its Python worker, which lives on in later stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Most bytes of an Arrow batch. Spark's own bound lets 64 MB of texts into one, held several times on its way.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MAX_BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches have 4 MB at most, unless its user has set a bound."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, MAX_BATCH_BYTES)


def released(run: Callable[[Iterator], Iterator], forget: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow; the worker gives memory back when its batches, and all that ``run`` held, are gone."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if forget:
            forget()
        give_back()

    return task


def give_back() -> None:
    """Return free memory to the system: Arrow's, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
