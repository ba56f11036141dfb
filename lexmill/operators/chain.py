"""Chains of filter stages: the first stage that rejects a record ends its evaluation.

Each stage is a column of its own over inputs that are null for the records that an earlier one rejected. Expressions are not
evaluated for those, and a Python stage is given only the others' rows, so a dear stage costs what the cheap ones before it let through; all
stages together are one pass over the records.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

RESULT = "struct<passed: boolean, score: double, reason: string, needs_review: boolean>"
ALIVE = "alive"


@dataclass(frozen=True)
class Stage:
    """``judge`` turns columns by the names in ``reads`` (and, if it takes one named ``alive``, whether the record is still judged) into a
    struct with passed and any of score, reason, needs_review."""

    name: str
    reads: tuple[str, ...]
    judge: Callable[..., Column]
    knows_alive: bool = field(default=False)


def lazily(function: Callable[..., dict | None], kind: str = RESULT):
    """A judge out of a Python function of a record's values. It is called only for records that are alive; others get null."""

    def judge(alive: Column, **columns: Column) -> Column:
        names = list(columns)

        @arrow_udf(kind)
        def run(mask: pa.Array, *arrays: pa.Array) -> pa.Array:
            keep = pc.fill_null(mask, False)
            places = pc.indices_nonzero(keep).to_pylist()
            rows: list = [None] * len(mask)
            for place, record in zip(places, zip(*(a.filter(keep).to_pylist() for a in arrays))):
                rows[place] = function(**dict(zip(names, record)))
            return pa.array(rows, _RESULT if kind == RESULT else None)

        return run.asNondeterministic()(alive, *columns.values())

    return judge


_RESULT = pa.struct([("passed", pa.bool_()), ("score", pa.float64()), ("reason", pa.string()), ("needs_review", pa.bool_())])


def _shaped(value: Column, names: list[str]) -> Column:
    of = lambda n, kind, none: F.coalesce(value[n], F.lit(none)).cast(kind).alias(n) if n in names else F.lit(none).cast(kind).alias(n)
    return F.struct(of("passed", "boolean", False), of("score", "double", 0.0), of("reason", "string", None), of("needs_review", "boolean", False))


def evaluate(records: DataFrame, stages: list[Stage], out: str = "verdict") -> DataFrame:
    """``records`` with ``out``: struct<passed, score, reason, stage, needs_review>, the result of the stage that rejected the record or else of
    the last one. A review flag that any stage raised stays with a record that passes. No stage passes everything. A stage that says
    nothing about a record (null, or passed null) rejects it. Names of columns that ``records`` has are not touched, but for ``out``."""
    if not stages:
        return records.withColumn(out, F.struct(F.lit(True).alias("passed"), F.lit(0.0).alias("score"), F.lit("no filter stages configured").alias("reason"), F.lit("chain").alias("stage"), F.lit(False).alias("needs_review")))
    rows, alive, made = records, F.lit(True), []
    for i, s in enumerate(stages):
        seen = f"__stage{i}_alive"
        rows = rows.withColumn(seen, alive)
        inputs = {c: F.when(F.col(seen), F.col(c)) for c in s.reads}
        value = s.judge(**({ALIVE: F.col(seen)} if s.knows_alive else {}), **inputs)
        rows = rows.withColumn(f"__stage{i}_said", value)
        names = rows.schema[f"__stage{i}_said"].dataType.names
        rows = rows.withColumn(f"__stage{i}", F.when(F.col(seen), _shaped(F.col(f"__stage{i}_said"), names))).drop(f"__stage{i}_said")
        made += [seen, f"__stage{i}"]
        alive = F.col(seen) & F.col(f"__stage{i}.passed")
    result, flagged = F.lit(None), F.lit(False)
    for i, s in enumerate(stages):
        flagged = flagged | F.coalesce(F.col(f"__stage{i}.needs_review"), F.lit(False))
        value = F.col(f"__stage{i}")
        review = F.when(value["passed"], flagged).otherwise(value["needs_review"])
        whole = F.struct(value["passed"].alias("passed"), value["score"].alias("score"), value["reason"].alias("reason"), F.lit(s.name).alias("stage"), review.alias("needs_review"))
        result = whole if i == 0 else F.when(F.col(f"__stage{i}_alive"), whole).otherwise(result)
    return rows.withColumn(out, result).drop(*made)
