"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of rows that a task's Python process is handed at a time, or a single row.
BATCH_BYTES = 4_000_000

_MEMORY: dict[Any, Any] = {}


def give_back() -> None:
    """Return to the system what this process has freed but still holds."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: Any) -> DataFrame:
    """``df.mapInArrow(run, schema)`` on batches of at most ``BATCH_BYTES``, which by default are of 10,000 rows, however long.

    Python processes serve many tasks and operators one after the other, so a task that ends also gives back what it freed.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def process_memory(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python process keeps between tasks: the value of one key at a time, made when the key is new.

    Workers serve many operators one after the other; what an earlier one remembered is given up for the next.
    """
    if key not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[key] = make()
    return _MEMORY[key]


def slices(batches: Iterable[pa.RecordBatch], column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice holds at most ``max_bytes`` of the text column, or a single row.

    Every row is passed on; only the amount of text that is worked on at a time is bounded.
    """
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(sizes):
            if i > start and size + n > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)


def free_name(columns: list[str], name: str) -> str:
    """``name``, or it with underscores before it until no column has that name (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
