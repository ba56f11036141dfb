"""Queries of listed records and of what is shown, each with its oracle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.streams import joined_in_order
from lexmill.operators import display, offers
from lexmill.plans.search import query
from lexmill.sources import tables as t

_LISTED = "listed AS (SELECT 'PART:' || lpad(l_partkey::VARCHAR, 8, '0') AS source_id, l_shipdate::DATE AS modified_at, o_orderdate::DATE AS dated, l_returnflag || l_linestatus AS title FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_returnflag", "l_linestatus")
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return rows.select(F.concat(F.lit("PART:"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("source_id"), F.col("l_shipdate").cast("date").alias("modified_at"), F.col("o_orderdate").cast("date").alias("dated"), F.concat("l_returnflag", "l_linestatus").alias("title"))


@query(f", {_LISTED} SELECT source_id, max(modified_at) AS modified_at, min(dated) AS dated, min(title) AS title FROM listed GROUP BY 1", dates=("modified_at", "dated"))
def discovery_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers.grouped(_listed(spark, sf_dir))


@query(f", {_LISTED}, g AS (SELECT source_id, max(modified_at) AS modified_at FROM listed GROUP BY 1) SELECT source_id, modified_at FROM g WHERE source_id > 'PART:00000050' ORDER BY source_id LIMIT 100", dates=("modified_at",))
def discovery_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers.page_after(offers.grouped(_listed(spark, sf_dir)), "PART:00000050", 100).select("source_id", "modified_at")


@query(f", {_LISTED} SELECT count(DISTINCT source_id) AS n FROM listed WHERE modified_at >= date '1996-01-01' AND modified_at < date '1997-01-01'")
def discovery_window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers.in_window(_listed(spark, sf_dir), F.lit(dt.date(1996, 1, 1)), F.lit(dt.date(1997, 1, 1)))


@query("""SELECT c_custkey::VARCHAR AS code, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE greatest(floor(c_acctbal), -1) END::BIGINT AS case_count, 'm' || c_custkey % 3 AS map_feature_id FROM customer
WHERE c_custkey % 9 <> 0 AND c_acctbal >= 0 AND c_custkey % 3 <> 2 UNION ALL SELECT c_custkey::VARCHAR, floor(c_acctbal)::BIGINT, c_custkey::VARCHAR FROM customer WHERE c_custkey % 9 <> 0 AND c_acctbal >= 0 AND c_custkey % 3 = 2""")
def coerced_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    raw = t.table(spark, sf_dir, "customer").select(
        n.cast("string").alias("code"), F.when(n % 9 == 0, "many").otherwise(F.col("c_acctbal").cast("string")).alias("case_count"), F.when(n % 3 != 2, F.concat(F.lit("m"), n % 3)).alias("map_feature_id")
    )
    return display.counts(raw)


@query("""SELECT conv_id AS case_id, string_agg(turn::VARCHAR, ',' ORDER BY kind, role <> 'user', role, turn) AS reading FROM (
  SELECT *, CASE turn % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 6 END AS kind FROM conversations WHERE trim(coalesce(text, '')) <> '') GROUP BY 1""")
def reader_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("turn") % 3 == 0, "opinion").when(F.col("turn") % 3 == 1, "judgment").otherwise("appendix")
    docs = t.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("id"), F.col("role").alias("language"), "text", kind.alias("doc_type"))
    ranked = display.reading_order(docs, F.lit("user"))
    return joined_in_order(ranked, "case_id", [F.col("rank")], F.col("id").cast("string"), ",").select("case_id", F.col("value").alias("reading"))
