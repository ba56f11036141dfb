"""The discovery walk as a table: spans of a listing that its source can answer, planned from one histogram of the listing.

A walk is sequential, as the width of a span follows from the counts before it, so the time line is cut into stretches and each is
walked on its own. A stretch's counts by second come from one aggregation; every count that the walk asks for is a
difference of their prefix sums, so no span costs a job, and a second with any number of records is one row.
"""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.sources.discovery import SECOND, Planner

EPOCH = dt.datetime(1970, 1, 1)
SPANS = "stretch bigint, place int, first timestamp_ntz, last timestamp_ntz, found bigint"


def seconds(moment: Column) -> Column:
    """Whole seconds since 1970 of a UTC time; sources resolve their bounds to the second."""
    return F.timestamp_diff("SECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.date_trunc("SECOND", moment.cast("timestamp_ntz")).cast("timestamp_ntz"))


def _epoch(moment: dt.datetime) -> int:
    return (moment - EPOCH) // SECOND


def stretch_of(moment: Column, since: dt.datetime, stretch: dt.timedelta) -> Column:
    return F.floor((seconds(moment) - _epoch(since)) / (stretch // SECOND))


def walk(listed: DataFrame, planner: Planner, since: dt.datetime, until: dt.datetime, column: str = "modified_at", stretch: dt.timedelta = dt.timedelta(days=31)) -> DataFrame:
    """(stretch, place, first, last, found): the spans of ``planner`` over each stretch from ``since`` to ``until`` (UTC, without zone), in order
    of stretch and place, empty ones as well. The spans of all stretches cover the time line once.

    A listing's rows count one each; those without a time, or outside the bounds, are in no span. An empty listing has spans
    with nothing found. A stretch's walk holds its distinct seconds, 43 MB at most for 31 days.
    """
    length = stretch // SECOND
    begin, end = _epoch(since), _epoch(until)
    count = max(0, math.ceil((end - begin + planner.closed) / length))
    second = seconds(F.col(column))
    inside = listed.select(second.alias("second")).where(F.col("second").between(begin, end if planner.closed else end - 1))
    sums = inside.withColumn("stretch", F.floor((F.col("second") - begin) / length)).groupBy("stretch", "second").agg(F.count("*").alias("n"))
    every = listed.sparkSession.range(count).select(F.col("id").alias("stretch"), F.lit(begin).cast("long").alias("second"), F.lit(0).cast("long").alias("n"))

    def plan(table: pa.Table) -> pa.Table:
        k = table.column("stretch")[0].as_py()
        at = table.column("second").to_numpy()
        order = np.argsort(at, kind="stable")
        at, before = at[order], np.concatenate([[0], np.cumsum(table.column("n").to_numpy()[order])])
        upto = "right" if planner.closed else "left"

        def found(first: dt.datetime, last: dt.datetime) -> int:
            return int(before[np.searchsorted(at, _epoch(last), upto)] - before[np.searchsorted(at, _epoch(first), "left")])

        start = since + k * stretch
        stop = min(start + stretch - (SECOND if planner.closed else dt.timedelta()), until)
        spans = list(planner.spans(found, start, stop))
        columns = [[k] * len(spans), range(len(spans)), *([s[i] for s in spans] for i in range(3))]
        kinds = (pa.int64(), pa.int32(), pa.timestamp("us"), pa.timestamp("us"), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["stretch", "place", "first", "last", "found"])

    return sums.unionByName(every).groupBy("stretch").applyInArrow(plan, SPANS)


def in_spans(listed: DataFrame, spans: DataFrame, planner: Planner, since: dt.datetime, stretch: dt.timedelta, column: str = "modified_at", key: str = "source_id") -> DataFrame:
    """``listed`` with the stretch and place of the span that holds each row; rows in no span are left out. The starts of spans are sorted
    among the rows of their stretch, and each row takes the last one before it: no row meets any span but its own."""
    from pyspark.sql import Window

    rows = listed.withColumns({"stretch": stretch_of(F.col(column), since, stretch), "__at": seconds(F.col(column))})
    starts = spans.select("stretch", F.col("place").alias("__place"), seconds(F.col("first")).alias("__at"), seconds(F.col("last")).alias("__last"))
    both = rows.unionByName(starts, allowMissingColumns=True)
    order = Window.partitionBy("stretch").orderBy("__at", F.col("__place").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__place").isNotNull(), F.struct("__place", "__last")), ignorenulls=True).over(order)
    held = both.withColumn("__span", last).where(F.col("__place").isNull() & (F.col("__at") <= F.col("__span.__last") if planner.closed else F.col("__at") < F.col("__span.__last")))
    return held.select(*listed.columns, "stretch", F.col("__span.__place").alias("place"))
