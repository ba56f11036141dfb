"""Batches in bounded memory, and joins in which no frequent key meets in one task."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch between Spark and a Python worker, where the session has no bound of its own below it.
BATCH_BYTES = 8 << 20
#: Keys that may count as frequent, at most: those that hold over one in HOT_KEYS of all rows.
HOT_KEYS = 10_000


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Arrow batches of ``size`` bytes at most (a longer row is a batch of its own), unless the session has a bound already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(size))


@functools.lru_cache(1)
def _trim():
    """glibc's function that gives free memory back; nothing where there is none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Free memory goes back to the system. Python workers outlive their tasks, and several of them share an executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def text_batches(column: pa.Array, size: int = 400_000) -> Iterator[list[str | None]]:
    """The texts of an Arrow column in order, in lists of about ``size`` bytes; a longer text is a list of its own. Only one list
    is a Python object at a time, and after the last one free memory is given back."""
    length = pc.binary_length(column).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(length):
        total += n + 100
        if total >= size:
            yield column.slice(start, i + 1 - start).to_pylist()
            start, total = i + 1, 0
    if start < len(length):
        yield column.slice(start).to_pylist()
    release()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each row begins and ends in them. Nothing is copied."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), at


def words_of(column: pa.Array, kind: type = np.uint64) -> list[np.ndarray]:
    """Each row of a binary column as numbers, without a copy."""
    data, at = raw(column)
    return [data[i:j].view(kind) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def join_hot(rows: DataFrame, table: DataFrame, on: str, total: int, n: str = "n", hot_keys: int = HOT_KEYS) -> DataFrame:
    """``rows`` joined to a table with one row a key, whose column ``n`` says how many of the ``total`` rows have the key.

    Keys with more than one in ``hot_keys`` of all rows are broadcast: there are ``hot_keys`` of them at most, whatever the input.
    All others are joined by a shuffle in which no key is frequent. ``n`` isn't part of the result; null keys find nothing.
    """
    least = max(64, total // hot_keys)
    hot, cold = F.broadcast(table.where(F.col(n) > least).drop(n)), table.where(F.col(n) <= least).drop(n)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(cold, on))
