"""Queries of asking sources: walks of a listing, the pages of planned spans, versions of documents; each with its oracle.

Recorded answers are written from the given tables, so the source that is asked says what the tables hold.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.plans.search import query
from lexmill.session import scratch_path
from lexmill.sources import decisions as d
from lexmill.sources import fetch, walk
from lexmill.sources import tables as t
from lexmill.sources.discovery import SECOND, Planner, Retries

SINCE, UNTIL, STRETCH = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31), dt.timedelta(days=5)
CLOSED = Planner(100, dt.timedelta(days=1), SECOND, dt.timedelta(days=10))
HALF_OPEN = Planner(199, dt.timedelta(hours=12), dt.timedelta(hours=1), closed=False)
PAGE_SIZE, TRIES, LANES = 40, 3, 3

#: A walk as a recursion: every step counts one span, then cuts it, or goes on to the next. Times are microseconds since ``SINCE``.
_WALK = """
listed AS (SELECT event_id, event_type, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 AS s, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS updated, ts FROM events),
rules(walk, most, width, least, longest, closed, upto) AS (VALUES
  ('closed', 100, 86400000000, 1000000, 864000000000, TRUE, 30 * 86400000000 - 1000000), ('half_open', 199, 43200000000, 3600000000, NULL, FALSE, 30 * 86400000000)),
stretches AS (SELECT r.*, k AS stretch, k * 432000000000 AS start, least(k * 432000000000 + 432000000000 - CASE WHEN closed THEN 1000000 ELSE 0 END, upto) AS finish FROM rules r, range(6) x(k)),
probes AS (
  SELECT walk, stretch, 0 AS place, start AS a, least(start + width, finish) AS b, (SELECT count(*) FROM listed WHERE s >= start // 1000000 AND (s < least(start + width, finish) // 1000000 OR closed AND s = least(start + width, finish) // 1000000)) AS n,
    most, width, least, longest, closed, finish FROM stretches
  UNION ALL
  SELECT walk, stretch, place, a, b, (SELECT count(*) FROM listed WHERE s >= a // 1000000 AND (s < b // 1000000 OR closed AND s = b // 1000000)), most, width, least, longest, closed, finish FROM (
    SELECT walk, stretch, CASE WHEN cut THEN place ELSE place + 1 END AS place, CASE WHEN cut THEN a ELSE b + gap END AS a, CASE WHEN cut THEN a + greatest((b - a) // 2, least) ELSE least(b + gap + next, finish) END AS b,
      most, next AS width, least, longest, closed, finish, cut, b + gap AS on_
    FROM (SELECT *, n > most AND b - a > least AS cut, CASE WHEN closed THEN 1000000 ELSE 0 END AS gap,
      CASE WHEN longest IS NULL THEN width WHEN 4 * n <= most THEN least(2 * greatest(b - a, 1000000), longest) WHEN 4 * n >= 3 * most THEN greatest(greatest(b - a, 1000000) // 2, least) ELSE greatest(b - a, 1000000) END AS next FROM probes)
    WHERE cut OR b + gap < finish OR closed AND b + gap = finish)
), spans AS (SELECT walk, stretch, place, a, b, n AS found FROM probes WHERE NOT (n > most AND b - a > least))"""


def _spans(spark: SparkSession, sf_dir: str, planner: Planner) -> DataFrame:
    until = UNTIL - SECOND if planner.closed else UNTIL
    return walk.walk(t.table(spark, sf_dir, "events").select("ts"), planner, SINCE, until, "ts", STRETCH)


@query(f""", {_WALK} SELECT walk, stretch::BIGINT AS stretch, place::INT AS place, strftime(TIMESTAMP '2024-01-01' + to_microseconds(a), '%Y-%m-%d %H:%M:%S') AS first, strftime(TIMESTAMP '2024-01-01' + to_microseconds(b), '%Y-%m-%d %H:%M:%S') AS last, found FROM spans""")
def discovery_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of walk over the events: closed spans whose width follows the counts, and half-open ones of a fixed width."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    shown = lambda name, p: _spans(spark, sf_dir, p).select(F.lit(name).alias("walk"), "stretch", "place", day("first"), day("last"), "found")
    return shown("closed", CLOSED).unionByName(shown("half_open", HALF_OPEN))


def _recorded(events: DataFrame, spans: DataFrame) -> DataFrame:
    """The feed's answers for every page of the spans: some fail for good, some at first."""
    moment = F.date_format("ts", fetch.SPARK_STAMP)
    held = walk.in_spans(events, spans, CLOSED, SINCE, STRETCH, "ts")
    n = F.row_number().over(Window.partitionBy("stretch", "place").orderBy("ts", "event_id")) - 1
    entry = F.concat(F.lit("<entry><id>"), "event_id", F.lit("</id><title>"), "event_type", F.lit("</title><updated>"), moment, F.lit('</updated><link href="x/'), "event_id", F.lit('"/></entry>'))
    paged = held.withColumn("n", n).select("stretch", "place", F.floor(F.col("n") / PAGE_SIZE).cast("int").alias("page"), "n", entry.alias("entry"))
    pages = paged.groupBy("stretch", "place", "page").agg(F.array_sort(F.collect_list(F.struct("n", "entry"))).alias("entries"))
    body = F.concat(F.lit("<feed><subtitle>"), "found", F.lit(" found</subtitle>"), F.array_join("entries.entry", ""), F.lit("</feed>"))
    stamp = lambda c: F.date_format(c, fetch.SPARK_STAMP)
    told = pages.join(spans, ["stretch", "place"]).select("stretch", fetch.page_address(stamp("first"), stamp("last"), F.col("page") * PAGE_SIZE, PAGE_SIZE).alias("address"), body.alias("body"), (F.col("stretch") + 7 * F.col("place") + 3 * F.col("page")).alias("k"))
    answer = lambda attempt, status, wish=None, body=None: F.struct(F.lit(attempt).alias("attempt"), F.lit(status).alias("status"), F.lit(wish).cast("double").alias("retry_after"), (F.col("body") if body else F.lit(None).cast("string")).alias("body"))
    given = F.when(F.col("k") % 11 == 5, F.array(answer(0, 500))).when(F.col("k") % 11 == 3, F.array(answer(0, 404))).when(F.col("k") % 4 == 1, F.array(answer(0, 503, 2.0), answer(1, 200, body=True))).otherwise(F.array(answer(0, 200, body=True)))
    return told.select("stretch", "address", F.inline(given))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    where, answers = scratch_path(spark, "spans"), scratch_path(spark, "answers")
    _spans(spark, sf_dir, CLOSED).write.partitionBy("stretch").parquet(where)
    spans = spark.read.schema(walk.SPANS).parquet(where)
    _recorded(t.table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), spans).write.partitionBy("stretch").parquet(answers)
    fetch.register(spark)
    options = {"spans": where, "answers": answers, "stretches": 6, "lanes": LANES, "per_second": 1e6, "page_size": PAGE_SIZE, "tries": TRIES, "sleep": "false"}
    return spark.read.format("walk_source").options(**{k: str(v) for k, v in options.items()}).load()


_PAGES = f"""{_WALK}, held AS (
  SELECT stretch, place, row_number() OVER (PARTITION BY stretch, place ORDER BY ts, event_id) - 1 AS n, event_id, updated FROM spans JOIN listed ON walk = 'closed' AND s BETWEEN a // 1000000 AND b // 1000000
), paged AS (SELECT *, n // {PAGE_SIZE} AS page, (stretch + 7 * place + 3 * (n // {PAGE_SIZE})) AS k FROM held),
answered AS (
  SELECT stretch, place, page, n % {PAGE_SIZE} AS position, event_id::VARCHAR AS source_id, updated AS modified_at, CASE WHEN k % 4 = 1 THEN 2 ELSE 1 END AS requests, NULL::VARCHAR AS error FROM paged WHERE k % 11 NOT IN (3, 5)
  UNION ALL
  SELECT DISTINCT stretch, place, page, NULL, NULL, NULL, CASE WHEN k % 11 = 5 THEN {TRIES + 1} ELSE 1 END, CASE WHEN k % 11 = 5 THEN 'broken: 500' ELSE 'missing: 404' END FROM paged WHERE k % 11 IN (3, 5))"""


@query(f", {_PAGES} SELECT stretch::BIGINT AS stretch, place::INT AS place, page::INT AS page, position::INT AS position, source_id, modified_at, requests::INT AS requests, error FROM answered")
def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of a source's feed, asked for span by span and page by page, with what could not be had."""
    return _pages(spark, sf_dir).select("stretch", "place", "page", "position", "source_id", "modified_at", "requests", "error")


@query(f""", {_PAGES}, bad AS (SELECT min((stretch, place, page)) AS f FROM answered WHERE error IS NOT NULL)
SELECT max(modified_at) AS last_modified_seen, count(*) AS committed FROM answered, bad WHERE error IS NULL AND (f IS NULL OR (stretch, place, page) < f)""")
def walk_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the walk may be taken as done: nothing after the first page that could not be had."""
    rows = _pages(spark, sf_dir).withColumn("at", F.struct("stretch", "place", "page"))
    bad = rows.where("error IS NOT NULL").agg(F.min("at").alias("bad"))
    done = rows.where("error IS NULL").join(F.broadcast(bad), F.col("bad").isNull() | (F.col("at") < F.col("bad")))  # one row
    return done.agg(F.max("modified_at").alias("last_modified_seen"), F.count("*").alias("committed"))


_ANSWER = {"ENG": "CASE o_orderkey % 3 WHEN 0 THEN 200 WHEN 1 THEN 500 ELSE 404 END", "FRA": "CASE WHEN o_orderkey % 5 = 0 THEN 500 ELSE 200 END", "DEU": "CASE o_orderkey % 7 WHEN 0 THEN 503 WHEN 1 THEN 410 ELSE 200 END"}


@query(f""", o AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS eng, o_orderkey % 4 = 1 AS fra, {', '.join(f'{sql} AS s_{name.lower()}' for name, sql in _ANSWER.items())} FROM orders),
a AS (SELECT *, CASE WHEN eng AND s_eng = 200 THEN 'ENG' WHEN fra AND s_fra = 200 THEN 'FRA' WHEN s_deu = 200 THEN 'DEU' END AS language,
  concat_ws(', ', CASE WHEN eng AND s_eng = 500 THEN 'ENG' END, CASE WHEN fra AND s_fra = 500 THEN 'FRA' END, CASE WHEN s_deu = 503 THEN 'DEU' END) AS broken FROM o)
SELECT o_orderkey::VARCHAR AS source_id, language, CASE language WHEN 'ENG' THEN 'preferred' WHEN 'FRA' THEN 'procedural' WHEN 'DEU' THEN 'only_available' END AS selected_as,
  CASE language WHEN 'ENG' THEN 'xhtml' WHEN 'FRA' THEN 'html' WHEN 'DEU' THEN 'text' END AS format, language || ' of ' || o_orderkey AS payload, CASE WHEN language IS NULL AND broken <> '' THEN 'every language version failed: ' || broken END AS error,
  (CASE WHEN language IS NULL THEN CASE WHEN eng THEN CASE s_eng WHEN 500 THEN 4 ELSE 1 END ELSE 0 END + CASE WHEN fra THEN CASE s_fra WHEN 500 THEN 4 ELSE 2 END ELSE 0 END + CASE s_deu WHEN 503 THEN 4 ELSE 1 END
    WHEN language = 'FRA' THEN 2 ELSE 1 END)::INT AS requests FROM a""")
def document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language plans of all orders' documents carried out against recorded answers: what was fetched, or why nothing was."""
    n = "o_orderkey"
    status = {k: F.expr(v) for k, v in _ANSWER.items()}
    record = lambda language, status, kind: F.struct(F.concat(F.lit("doc/"), n).alias("address"), F.lit(language).alias("language"), status.cast("int").alias("status"), F.lit(1.5).alias("retry_after"), F.lit(kind).alias("content_type"), F.concat(F.lit(f"{language} of "), n).alias("body"))
    recorded = F.array(record("ENG", status["ENG"], "application/xhtml+xml"), record("FRA", F.when(F.expr(f"{n} % 5 = 0"), 500).otherwise(429), None), record("FRA", status["FRA"], "text/html; charset=utf-8"), record("DEU", status["DEU"], None))
    have = F.when(F.expr(f"{n} % 2 = 0"), F.array(*map(F.lit, ("DEU", "ENG", "FRA")))).otherwise(F.array(F.lit("DEU"), F.lit("FRA")))
    own = F.when(F.expr(f"{n} % 4 = 1"), "FRA").otherwise("ENG")
    plans = t.table(spark, sf_dir, "orders").select(F.col(n).cast("string").alias("source_id"), F.concat(F.lit("doc/"), n).alias("address"), d.language_plan(have, own).alias("plan"), recorded.alias("recorded"))
    return fetch.versions(plans, retries=Retries(TRIES)).select("source_id", "language", "selected_as", "format", "payload", "error", "requests")
