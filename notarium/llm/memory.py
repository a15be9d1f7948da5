"""Python workers that hand freed memory back.

Spark keeps workers between tasks, and the C library keeps what it freed; on an executor with
little memory beside the JVM, what earlier tasks freed then counts against later ones.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

# Option numbers of the GNU C library's mallopt.
_TRIM_THRESHOLD, _MMAP_THRESHOLD, _ARENA_MAX = -1, -3, -8


def _library():
    try:
        found = ctypes.CDLL("libc.so.6")
        return found if hasattr(found, "malloc_trim") else None
    except OSError:
        return None


def hold_little() -> None:
    """Large arrays come from the system and go back to it when they are freed."""
    pa.set_memory_pool(pa.system_memory_pool())
    if (c := _library()) is not None:
        c.mallopt(_MMAP_THRESHOLD, 8 << 20)
        c.mallopt(_TRIM_THRESHOLD, 64 << 20)
        c.mallopt(_ARENA_MAX, 2)


def small_batches(spark: SparkSession) -> None:
    """Rows of long texts go to Python a few at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def give_back() -> None:
    if (c := _library()) is not None:
        c.malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """For a function over the batches of a task."""
    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_little()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def one_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function over one group's table that hands freed memory back."""
    def wrapped(table: pa.Table) -> pa.Table:
        hold_little()
        out = run(table)
        give_back()
        return out

    return wrapped


def two_groups(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        hold_little()
        out = run(left, right)
        give_back()
        return out

    return wrapped
