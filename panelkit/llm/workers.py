"""Memory that Python workers keep between tasks."""

from __future__ import annotations

import ctypes
import functools
import sys

import pyarrow as pa
from pyspark.sql import SparkSession

from .textarrays import forget_powers

#: Rows of a batch of texts. Tasks cut batches into blocks of bytes, so longer ones only take memory, in the executor's
#: process (its buffers double as they grow) as well as in the worker.
ROWS = 500


def short_batches(spark: SparkSession) -> None:
    """From here on, batches that this session sends to workers have ROWS rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS:
        spark.conf.set(name, str(ROWS))


def forget_words() -> None:
    """Drop the words that tokenizing tasks of this worker remember: workers are reused, and other tasks need the memory."""
    for module in ("token_counts", "packing"):
        loaded = sys.modules.get(f"{__package__}.{module}")
        if loaded is not None:
            loaded.forget()


def give_back() -> None:
    """Return freed memory to the machine, where the allocators of Arrow and of the C library would keep it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def tidy(task):
    """A task over batches that starts without what other tasks left in its worker, and leaves nothing itself: an
    executor keeps as many idle workers as it ever needed at once."""

    @functools.wraps(task)
    def run(batches):
        forget_words()
        forget_powers()
        give_back()
        yield from task(batches)
        forget_powers()
        give_back()

    return run
