"""All queries of the engine by name, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.plans import ingest, listing, matching, records, search, shown, sources, streams  # noqa: F401  each module registers its queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(search.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(search.ORACLES)
