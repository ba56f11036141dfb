"""The domain tables as deterministic projections of the Parquet inputs, and the same in DuckDB's SQL for the oracles.

Nothing here knows how the tables are used; another corpus replaces this module alone. Wide text stays in ``case_documents``,
so that queries over ``cases`` never read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the adapter: code, name, map feature. XX has no cases.
JURISDICTIONS = [("DE", "Germany", "m-de"), ("EN", "England", "m-en"), ("ES", "Spain", "m-es"), ("FR", "France", "m-fr"), ("XX", "Nowhere", "m-xx")]
DOMAINS = ["public", "private", "criminal"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jurisdictions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(JURISDICTIONS, "code string, name string, map_feature_id string")


CASE_COLUMNS = [
    "doc_id AS id", "upper(lang) AS jurisdiction_code", "concat('DOC:', doc_id) AS source_id", "cast(substring(source, 4) AS int) AS court_id",
    "substring(text, 1, 80) AS title", "substring(text, 1, 400) AS abstract",
    "CASE WHEN doc_id % 17 <> 0 THEN date_add(date'2015-01-01', cast((doc_id * 37) % 3650 AS int)) END AS decision_date",
    "lang AS language", "CASE doc_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'private' WHEN 2 THEN 'criminal' END AS law_domain",
    "concat('topic-', doc_id % 5) AS topic_slug", "doc_id % 11 <> 0 AS is_published", "cast(1 + doc_id % 3 AS int) AS revision",
    "date_add(date'2024-01-01', cast(doc_id % 365 AS int)) AS first_seen_on", "md5(coalesce(text, '')) AS content_hash",
]


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*CASE_COLUMNS)


def case_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("language"), F.col("text").alias("full_text"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per labelled case."""
    return table(spark, sf_dir, "labels").selectExpr(
        "doc_id AS id", "doc_id AS case_id", "CASE WHEN doc_id % 6 = 0 THEN 'withdrawn' WHEN toxic = 1 OR quality = 1 THEN 'decided' ELSE 'pending' END AS status",
        "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE cast(doc_id % 13 AS double) / 2 END AS score", "date_add(date'2024-03-01', cast(doc_id % 90 AS int)) AS flagged_on",
        "CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'confirmed' END AS decision", "CASE WHEN toxic = 1 OR quality = 1 THEN cast(1 + doc_id % 2 AS int) END AS decided_revision",
        "concat('list-', doc_id % 3) AS list_version",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest runs: events; an error is a failed run."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "concat('J', user_id % 40) AS jurisdiction_code", "cast(ts AS timestamp_ntz) AS finished_at",
        "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' ELSE 'success' END AS status", "value",
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate stream: events in order; user_id is the record, value makes its hash."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS pos", "concat('J', user_id % 40) AS jurisdiction_code", "concat('REC:', user_id) AS source_id", "cast(ts AS timestamp_ntz) AS modified_at",
        "event_type", "value", "props", "event_type = 'error' AS failed", "CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 5 <> 0 THEN concat('h', user_id % 7) END AS content_hash",
    )


#: The same projections for DuckDB, as common table expressions.
ORACLE = """
jurisdiction(code, name, map_feature_id) AS (VALUES ('DE', 'Germany', 'm-de'), ('EN', 'England', 'm-en'), ('ES', 'Spain', 'm-es'), ('FR', 'France', 'm-fr'), ('XX', 'Nowhere', 'm-xx')),
cases AS (
  SELECT doc_id AS id, upper(lang) AS jurisdiction_code, 'DOC:' || doc_id AS source_id, substring(source, 4)::INT AS court_id, substring(text, 1, 80) AS title, substring(text, 1, 400) AS abstract,
    CASE WHEN doc_id % 17 <> 0 THEN (date '2015-01-01' + ((doc_id * 37) % 3650)::INT)::DATE END AS decision_date, lang AS language,
    CASE doc_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'private' WHEN 2 THEN 'criminal' END AS law_domain, 'topic-' || doc_id % 5 AS topic_slug, doc_id % 11 <> 0 AS is_published,
    (1 + doc_id % 3)::INT AS revision, (date '2024-01-01' + (doc_id % 365)::INT)::DATE AS first_seen_on, md5(coalesce(text, '')) AS content_hash FROM documents
),
case_documents AS (SELECT doc_id AS case_id, lang AS language, text AS full_text FROM documents),
reviews AS (
  SELECT doc_id AS id, doc_id AS case_id, CASE WHEN doc_id % 6 = 0 THEN 'withdrawn' WHEN toxic = 1 OR quality = 1 THEN 'decided' ELSE 'pending' END AS status,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 13)::DOUBLE / 2 END AS score, (date '2024-03-01' + (doc_id % 90)::INT)::DATE AS flagged_on,
    CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'confirmed' END AS decision, CASE WHEN toxic = 1 OR quality = 1 THEN (1 + doc_id % 2)::INT END AS decided_revision, 'list-' || doc_id % 3 AS list_version FROM labels
),
runs AS (
  SELECT event_id AS id, 'J' || user_id % 40 AS jurisdiction_code, ts AS finished_at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' ELSE 'success' END AS status, value FROM events
),
candidates AS (
  SELECT event_id AS pos, 'J' || user_id % 40 AS jurisdiction_code, 'REC:' || user_id AS source_id, ts AS modified_at, event_type, value, props, event_type = 'error' AS failed,
    CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 5 <> 0 THEN 'h' || user_id % 7 END AS content_hash FROM events
)
"""


def oracle(sql: str) -> str:
    """An oracle over the domain tables."""
    return f"WITH RECURSIVE {ORACLE} {sql}" if not sql.lstrip().startswith(",") else f"WITH RECURSIVE {ORACLE}{sql}"
