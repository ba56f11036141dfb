"""Constraints as queries: Spark tables have none, so each one is a query whose rows are its violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill import schemas


def duplicates(table: DataFrame, key: list[str]) -> DataFrame:
    """Keys without a null that stand in several rows."""
    some = table.dropna(subset=key)
    return some.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(table: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows that refer to no parent; a null refers to nothing and is no violation."""
    known = parents.select(F.col(key).alias("__key"))
    some = table.where(F.col(column).isNotNull())
    return some.join(known, some[column] == known["__key"], "left_anti")


def failing(table: DataFrame, check: Column) -> DataFrame:
    """Rows for which a check is false; unknown passes."""
    return table.where(~F.coalesce(check, F.lit(True)))


def violations(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every declared constraint over the given tables, by its name."""
    out = {}
    for name, table in tables.items():
        if name in schemas.KEYS:
            out[f"unique {name}"] = duplicates(table, schemas.KEYS[name])
        for column, (parent, key) in schemas.REFERENCES.get(name, {}).items():
            if parent in tables:
                out[f"reference {name}.{column}"] = orphans(table, column, tables[parent], key)
        for (owner, column), values in schemas.VALUES.items():
            if owner == name:
                out[f"values {name}.{column}"] = failing(table, F.col(column).isin(*values))
    return out
