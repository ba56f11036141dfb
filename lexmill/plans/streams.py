"""Queries of the streaming loops, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import runs
from lexmill.plans.search import query
from lexmill.session import scratch_path
from lexmill.sources import tables as t
from lexmill.streaming.ingest import Ingest, isolated
from lexmill.streaming.mirror import Mirror

FILES, LIMIT = 3, 100


def _files(spark: SparkSession, rows: DataFrame, order: str, files: int = FILES) -> DataFrame:
    """``rows`` as a stream of ``files`` micro-batches, in order."""
    where = scratch_path(spark, "offers")
    least, most = rows.agg(F.min(order), F.max(order)).first()
    step = ((most or 0) - (least or 0)) // files + 1
    for i in range(files):
        low = (least or 0) + i * step
        rows.where((F.col(order) >= low) & (F.col(order) < low + step)).coalesce(1).write.mode("append").parquet(where)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(where)


def _price(props: str, number: int) -> int:
    """A record's own work, which fails on some: every seventh's payload is broken."""
    if number % 7 == 0:
        raise ValueError(f"record {number} cannot be read")
    return len(props)


def _ingested(spark: SparkSession, sf_dir: str) -> Ingest:
    """The events in three batches; a record whose payload cannot be read is a dead letter, and nothing else of its batch."""
    events = t.table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "cast(ts AS timestamp) AS ts", "value", "props")

    def prepare(batch: DataFrame) -> DataFrame:
        read = batch.withColumn("r", isolated(_price, "int", F.col("props"), F.col("event_id")))
        return read.selectExpr(
            "concat('J', user_id % 40) AS jurisdiction_code", "concat('REC:', user_id) AS source_id", "event_id AS pos", "ts AS modified_at",
            "concat('h', cast(floor(value) AS int) % 7) AS content_hash", "concat('offer ', event_id) AS title", "r.error AS error",
        )

    ingest = Ingest(spark, scratch_path(spark, "ingest"), prepare, 16)
    ingest.run(_files(spark, events, "event_id"))
    return ingest


_LAST = """ FROM (SELECT jurisdiction_code, source_id, pos, floor(value)::INT % 7 AS h, row_number() OVER (PARTITION BY jurisdiction_code, source_id ORDER BY pos DESC) AS k FROM candidates WHERE {}) WHERE k = 1"""


@query(f"SELECT jurisdiction_code, source_id, 'h' || h AS content_hash{_LAST.format('NOT failed')}")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates as a stream, merged into a snapshot; what it holds at the end."""
    rows = spark.readStream.schema(t.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    offers = rows.selectExpr(
        "concat('J', user_id % 40) AS jurisdiction_code", "concat('REC:', user_id) AS source_id", "event_id AS pos", "cast(ts AS timestamp) AS modified_at",
        "concat('h', cast(floor(value) AS int) % 7) AS content_hash", "concat('offer ', event_id) AS title", "event_type = 'error' AS failed",
    )
    ingest = Ingest(spark, scratch_path(spark, "ingest"))
    ingest.run(offers)
    return ingest.snapshot().select("jurisdiction_code", "source_id", "content_hash")


@query(f"SELECT jurisdiction_code, source_id, 'h' || h AS content_hash, 'offer ' || pos AS title FROM (SELECT jurisdiction_code, source_id, max(pos) AS pos FROM candidates WHERE pos % 7 <> 0 GROUP BY 1, 2) JOIN (SELECT pos AS p, floor(value)::INT % 7 AS h FROM candidates) ON p = pos".replace("'offer ' || pos AS title", "pos"))
def stream_ingest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in several batches of records that are read one by one, some of which cannot be."""
    return _ingested(spark, sf_dir).table.read().select("jurisdiction_code", "source_id", "content_hash", "pos")


@query("SELECT jurisdiction_code, source_id, pos, 'ValueError: record ' || pos || ' cannot be read' AS error FROM candidates WHERE pos % 7 = 0")
def ingest_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).dead_letters().select("jurisdiction_code", "source_id", "pos", "error")


@query(""", k AS (SELECT jurisdiction_code, source_id, max(pos) FILTER (pos % 7 = 0) AS bad, max(pos) FILTER (pos % 7 <> 0) AS good FROM candidates GROUP BY 1, 2) SELECT jurisdiction_code, source_id, bad AS pos FROM k WHERE bad IS NOT NULL AND (good IS NULL OR good < bad)""")
def ingest_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose last offer failed."""
    return _ingested(spark, sf_dir).retries().select("jurisdiction_code", "source_id", "pos")


@query(""", f AS (SELECT jurisdiction_code, min(pos) AS first FROM candidates WHERE pos % 7 = 0 GROUP BY 1)
SELECT c.jurisdiction_code, max(modified_at)::VARCHAR AS last_modified_seen, arg_max(source_id, pos) AS last_source_id, count(*) AS committed
FROM candidates c LEFT JOIN f ON f.jurisdiction_code = c.jurisdiction_code WHERE first IS NULL OR pos < first GROUP BY 1""")
def ingest_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each jurisdiction got before its first failure, after all batches."""
    return _ingested(spark, sf_dir).checkpoint().withColumn("last_modified_seen", F.col("last_modified_seen").cast("string"))


# ---- the mirror -----------------------------------------------------------------------------------------------------

_URLS = """, page AS (SELECT page_id AS pos, CASE WHEN page_id % 11 = 0 THEN '.hidden' || page_id WHEN page_id % 13 = 0 THEN 'SAME' ELSE 'p/' || page_id END AS identifier, strlen(coalesce(html, '')) AS size FROM pages),
first AS (SELECT min(pos) AS pos, identifier, arg_min(size, pos) AS size FROM page GROUP BY identifier),
judged AS (SELECT *, CASE WHEN pos % 17 = 4 THEN 'timeout' WHEN identifier LIKE '.%' THEN 'name' END AS kind FROM first),
placed AS (SELECT *, sum(CASE WHEN kind IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS k FROM judged)"""


def _mirrored(spark: SparkSession, sf_dir: str) -> Mirror:
    """The pages mirrored in two runs, the first of which stops at a limit."""
    n = F.col("page_id")
    identifier = F.when(n % 11 == 0, F.concat(F.lit(".hidden"), n)).when(n % 13 == 0, "SAME").otherwise(F.concat(F.lit("p/"), n))
    failed = F.when(n % 17 == 4, F.concat(F.lit("timeout: page "), n))
    pages = t.table(spark, sf_dir, "pages").select(
        identifier.alias("identifier"), n.alias("pos"), F.timestamp_seconds(n).alias("modified_at"), F.coalesce("html", F.lit("")).alias("payload"), F.to_json(F.struct(identifier.alias("identifier"))).alias("metadata"), failed.alias("error")
    )
    offers = _files(spark, pages, "pos")
    store = Mirror(spark, scratch_path(spark, "mirror"))
    store.run(offers, LIMIT)
    store.run(offers)
    return store


@query(f"{_URLS} SELECT identifier, pos, CASE WHEN kind IS NOT NULL THEN kind ELSE 'written' END AS outcome, CASE WHEN k - CASE WHEN kind IS NULL THEN 1 ELSE 0 END < {LIMIT} THEN 1 ELSE 2 END AS run FROM placed")
def mirror_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every candidate, and in which run."""
    store = _mirrored(spark, sf_dir)
    written = store.cases().select("identifier", "pos", F.lit("written").alias("outcome"), "run")
    return written.unionByName(store.failures().select("identifier", "pos", F.col("kind").alias("outcome"), "run"))


@query(f"""{_URLS}, r AS (SELECT *, CASE WHEN k - CASE WHEN kind IS NULL THEN 1 ELSE 0 END < {LIMIT} THEN 1 ELSE 2 END AS run FROM placed)
SELECT run, count_if(kind IS NULL)::BIGINT AS written, count_if(kind IS NOT NULL)::BIGINT AS failed, (SELECT count(*) FROM r x WHERE x.kind IS NOT NULL AND x.run <= r.run) > 0 AS held FROM r GROUP BY run""")
def mirror_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run wrote, and that the first failure holds the checkpoint back."""
    return _mirrored(spark, sf_dir).ledger().groupBy("run").agg(F.sum("written").alias("written"), F.sum("failed").alias("failed"), F.bool_or("held").alias("held"))


@query("""SELECT kind, count(*) AS n, string_agg(identifier, ',' ORDER BY k) FILTER (k <= 20) AS sample FROM (
  SELECT event_type AS kind, user_id::VARCHAR AS identifier, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) GROUP BY kind""")
def failure_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failure log in short: how many by kind, and the first twenty of each."""
    log = t.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("identifier"))
    return runs.failure_sample(log).select("kind", "n", F.array_join("sample", ",").alias("sample"))
