"""What a Python worker keeps between tasks: one object of one operator, and no other's."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Hashable, Iterator

from pyspark.sql import SparkSession

#: Bytes that go to Python at once.
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_DEFAULT_BYTES = "67108864b"
_HELD: dict[Hashable, object] = {}


def resident(key: Hashable, make: Callable[[], object]) -> object:
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def trim() -> None:
    """Give freed memory back to the system: workers live on, and share an executor's memory with the JVM."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator], keep: bool = False) -> Callable[[Iterator], Iterator]:
    """A task's function that begins without what other operators left (unless ``keep``), and trims when done."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        if not keep:
            _HELD.clear()
        trim()
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def text_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches in this session, from here on, unless it has a size of its own: long texts are bounded by bytes."""
    if spark.conf.get(_BYTES) == _DEFAULT_BYTES:
        spark.conf.set(_BYTES, f"{BATCH_BYTES}b")
