"""What keeps the memory of Python workers small, whatever the input."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Text goes to the Python workers in batches of at most 4 MB (or one longer text), unless the session says less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = re.match(r"\d+", spark.conf.get(name) or "")
    if not given or int(given[0]) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system, which a reused worker would keep for its next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(task: Task) -> Task:
    """``task``, after which its worker holds no more memory than before, and some 32 MB of batches later neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[pa.RecordBatch]:
            seen = 0
            for batch in batches:
                yield batch
                seen += batch.nbytes
                if seen > 32 << 20:
                    seen = 0
                    give_back()

        try:
            yield from task(counted())
        finally:
            give_back()

    return run
