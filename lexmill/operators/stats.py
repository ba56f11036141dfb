"""Statistics and facets over published cases, and the runs that fed them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_jurisdiction(jurisdictions: DataFrame, cases: DataFrame) -> DataFrame:
    """Count and latest decision for every jurisdiction, also those without a published case: the condition on cases is in the
    join. Cases are aggregated before the join, so what is shuffled has a row per code and task."""
    counted = cases.where("is_published").groupBy("jurisdiction_code").agg(F.count("id").alias("n"), F.max("decision_date").alias("latest"))
    joined = jurisdictions.join(counted, jurisdictions["code"] == counted["jurisdiction_code"], "left")
    return joined.select("code", "name", "map_feature_id", F.coalesce("n", F.lit(0)).alias("case_count"), F.col("latest").alias("latest_decision")).orderBy("code")


def band(count: Column) -> Column:
    """Shading of a map by 1, 10 and 100."""
    n = F.coalesce(count, F.lit(0))
    return F.when(n >= 100, "high").when(n >= 10, "medium").when(n >= 1, "low").otherwise("none")


def map_features(features: DataFrame, stats: DataFrame) -> DataFrame:
    """Every feature of a map with its count, band and phrase."""
    known = stats.select(F.col("map_feature_id").alias("__feature"), "case_count")
    joined = features.join(known, features["map_feature_id"] == known["__feature"], "left")
    n = F.coalesce("case_count", F.lit(0))
    phrase = F.when(n == 0, "no cases").when(n == 1, "1 case").otherwise(F.concat(F.format_number(n, 0), F.lit(" cases")))
    return joined.select("map_feature_id", n.alias("case_count"), band(n).alias("band"), phrase.alias("phrase"))


def with_published(dimension: DataFrame, cases: DataFrame, on: str, case_column: str) -> DataFrame:
    """Rows of a dimension that some published case refers to."""
    used = cases.where("is_published").select(F.col(case_column).alias("__used"))
    return dimension.join(used, dimension[on] == used["__used"], "left_semi")


def distinct_values(cases: DataFrame, column: str) -> DataFrame:
    return cases.where(F.col("is_published") & F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().orderBy("value")


def date_bounds(cases: DataFrame) -> DataFrame:
    return cases.where("is_published").agg(F.min("decision_date").alias("earliest"), F.max("decision_date").alias("latest"))


def latest_successful(runs: DataFrame) -> DataFrame:
    """Successful runs that ended last in their jurisdiction; runs that tie are all returned."""
    good = runs.where("status = 'success' AND finished_at IS NOT NULL")
    last = good.groupBy("jurisdiction_code").agg(F.max("finished_at").alias("finished_at"))
    return good.join(last, ["jurisdiction_code", "finished_at"], "left_semi")
