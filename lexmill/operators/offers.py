"""What a source lists: one row per record, pages by key, counts of a window, order of discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped(listed: DataFrame, key: str = "source_id") -> DataFrame:
    """A source may list a record several times: its last change, first date and one title (the least, so that it is the same each time)."""
    return listed.groupBy(key).agg(F.max("modified_at").alias("modified_at"), F.min("dated").alias("dated"), F.min("title").alias("title"))


def page_after(listed: DataFrame, last: str | None, size: int, key: str = "source_id") -> DataFrame:
    """The next page by key. Unlike an offset over an order that may change, it can lose no row."""
    rest = listed if last is None else listed.where(F.col(key) > last)
    return rest.orderBy(key).limit(size)


def in_window(listed: DataFrame, start: Column, stop: Column, key: str = "source_id") -> DataFrame:
    """Distinct records of a half-open window."""
    return listed.where((F.col("modified_at") >= start) & (F.col("modified_at") < stop)).agg(F.count_distinct(key).alias("n"))


def in_order(offers: DataFrame, key: str = "source_id") -> DataFrame:
    """Oldest change first; what has none comes first of all."""
    return offers.orderBy(F.asc_nulls_first("modified_at"), key)
