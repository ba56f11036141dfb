"""Ordered folds of a group's rows that never hold the group: sorted within partitions, then read as a stream."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, where the session has no bound of its own.
BATCH_BYTES = 8 << 20


class _Digest:
    def __init__(self) -> None:
        self.state = hashlib.sha256()

    def add(self, text: str) -> None:
        self.state.update(text.encode("utf-8", "surrogatepass"))

    def result(self) -> str:
        return self.state.hexdigest()


class _Text:
    def __init__(self) -> None:
        self.parts: list[str] = []

    def add(self, text: str) -> None:
        self.parts.append(text)

    def result(self) -> str:
        return "".join(self.parts)


def joined_in_order(rows: DataFrame, key: str, order: list[Column], text: Column, separator: str, digest: bool = False) -> DataFrame:
    """(key, n, value): the texts of each key, in order, with ``separator`` between; or, with ``digest``, the lowercase hex SHA-256 of that,
    for which no more than a batch of a key's rows is in memory, however many there are.

    Rows with a null text are left out; a key without others has no row. Ties of ``order`` go by text; a null key is a key. A key's
    rows are one task's stream, as both results depend on their whole order.
    """
    spark = rows.sparkSession
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if bound not in spark.conf.getAll:
        spark.conf.set(bound, str(BATCH_BYTES))
    names = [f"o{i}" for i in range(len(order))]
    placed = rows.select(F.col(key).alias("k"), *[c.alias(n) for c, n in zip(order, names)], text.alias("t")).where("t IS NOT NULL")
    placed = placed.repartition("k").sortWithinPartitions("k", *names, "t").select("k", "t")
    kind = _Digest if digest else _Text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, fold, done = None, 0, None, []
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                if fold is None or k != at:
                    if fold is not None:
                        done.append((at, n, fold.result()))
                    at, n, fold = k, 0, kind()
                fold.add(t.as_py() if n == 0 else separator + t.as_py())
                n += 1
            if done:
                yield _batch(done, batch.column(0).type)
                done = []
        if fold is not None:
            yield _batch([(at, n, fold.result())], at.type)

    return placed.mapInArrow(run, f"k {placed.schema['k'].dataType.simpleString()}, n bigint, value string").withColumnRenamed("k", key)


def _batch(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    keys, counts, values = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in keys], kind), pa.array(counts, pa.int64()), pa.array(values, pa.string())], ["k", "n", "value"])
