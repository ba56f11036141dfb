"""Queries of deduplication, upserts, reviews, runs, digests and retention, each with its oracle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.hashing import fingerprint, pseudonym
from lexmill.operators import merge, notify, reviews, runs
from lexmill.plans.search import query
from lexmill.sources import tables as t

_REVIEW = "SELECT id, case_id, status, score, flagged_on, decision, list_version FROM reviews"
_REVIEW_COLUMNS = ["id", "case_id", "status", "score", "flagged_on", "decision", "list_version"]


def _queue(sort: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reviews.queue(t.reviews(spark, sf_dir), t.cases(spark, sf_dir), sort, **options).select(_REVIEW_COLUMNS)

    run.__name__ = f"review_queue_{sort}"
    return run


query(f"{_REVIEW} WHERE status = 'pending'", dates=("flagged_on",))(_queue("flagged_desc"))
query(f"{_REVIEW} WHERE status IN ('pending', 'decided') AND list_version = 'list-1'", dates=("flagged_on",))(_queue("flagged_asc", statuses=("pending", "decided"), list_version="list-1"))
query(f"{_REVIEW} r WHERE EXISTS (SELECT 1 FROM cases c WHERE c.id = r.case_id AND c.jurisdiction_code IN ('DE', 'ES'))", dates=("flagged_on",))(_queue("score_asc", statuses=(), jurisdictions=("DE", "ES")))
query(f"{_REVIEW}", dates=("flagged_on",))(_queue("score_desc", statuses=()))


@query("""SELECT r.id, r.status, r.decision, coalesce(r.decided_revision, 0) AS decided_revision, c.revision, coalesce(r.decision IS NOT NULL AND r.decided_revision = c.revision, false) AS decision_is_current
FROM reviews r JOIN cases c ON c.id = r.case_id""")
def review_item_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.currency(t.reviews(spark, sf_dir), t.cases(spark, sf_dir)).select("id", "status", "decision", F.coalesce("decided_revision", F.lit(0)).alias("decided_revision"), "revision", "decision_is_current")


@query(""", o AS (
  SELECT c.id, CASE WHEN r.id IS NULL OR c.id % 6 = 5 THEN NULL ELSE r.status END AS status, r.decision, c.is_published, c.id % 4 < 2 AS needs_review, c.id % 8 = 0 AS suppressed,
    'h' || c.id % 3 AS flagged_hash, 'h' || c.id % 5 AS content_hash FROM cases c LEFT JOIN reviews r ON r.case_id = c.id
), f AS (
  SELECT *, needs_review AND (status IS NULL OR flagged_hash IS DISTINCT FROM content_hash) AS flags, coalesce(decision = 'rejected', false) AND status IS NOT NULL AS rejects FROM o
)
SELECT id, CASE WHEN flags THEN 'pending' WHEN NOT needs_review AND status = 'pending' AND decision IS NULL THEN 'withdrawn' ELSE status END AS new_status,
  CASE WHEN flags THEN content_hash ELSE flagged_hash END AS new_flagged_hash,
  CASE WHEN rejects THEN false WHEN status IS NOT NULL AND suppressed THEN true ELSE is_published END AS new_published,
  CASE WHEN rejects THEN is_published OR suppressed WHEN status IS NOT NULL AND suppressed THEN false ELSE suppressed END AS new_suppressed FROM f""")
def review_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case's review after a new verdict."""
    r = t.reviews(spark, sf_dir).select(F.col("case_id").alias("id"), F.col("status").alias("old"), "decision")
    rows = t.cases(spark, sf_dir).join(r, "id", "left")
    old = rows.select(
        "id", F.when(F.col("id") % 6 != 5, F.col("old")).alias("status"), "decision", "is_published", (F.col("id") % 4 < 2).alias("needs_review"), (F.col("id") % 8 == 0).alias("suppressed"),
        F.concat(F.lit("h"), F.col("id") % 3).alias("flagged_hash"), F.concat(F.lit("h"), F.col("id") % 5).alias("content_hash"),
    )
    return reviews.transition(old).select("id", "new_status", "new_flagged_hash", "new_published", "new_suppressed")


@query(""", d AS (SELECT event_id AS decision_id, user_id AS review_id, ts AS decided_at, CASE event_type WHEN 'error' THEN 'rejected' ELSE 'confirmed' END AS decision FROM events WHERE event_type IN ('error', 'purchase')),
l AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY decided_at DESC, decision_id DESC) AS k FROM d)
SELECT r.id, CASE WHEN l.review_id IS NOT NULL THEN 'decided' ELSE r.status END AS status, coalesce(l.decision, r.decision) AS decision, coalesce(l.decision, r.decision) IS DISTINCT FROM 'rejected' AS stays_published
FROM reviews r LEFT JOIN l ON l.review_id = r.id AND l.k = 1""")
def decision_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = t.table(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')").select(
        F.col("event_id").alias("decision_id"), F.col("user_id").alias("review_id"), F.col("ts").alias("decided_at"),
        F.when(F.col("event_type") == "error", "rejected").otherwise("confirmed").alias("decision"), F.lit("editor").alias("decided_by"), F.lit(1).alias("case_revision"),
    )
    standing, _ = reviews.record_decisions(t.reviews(spark, sf_dir), made)
    return standing.select("id", "status", "decision", (~F.col("decision").eqNullSafe("rejected")).alias("stays_published"))


_SNAPSHOT = """snapshot AS (
  SELECT DISTINCT jurisdiction_code, source_id, 'h' || (substring(source_id, 5)::BIGINT % 7) AS content_hash FROM candidates WHERE substring(source_id, 5)::BIGINT % 3 <> 0
)"""


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = t.candidates(spark, sf_dir).select("jurisdiction_code", "source_id").distinct()
    n = F.substring("source_id", 5, 20).cast("long")
    return keys.where(n % 3 != 0).withColumn("content_hash", F.concat(F.lit("h"), (n % 7).cast("string")))


def _decision(prefetch: bool) -> str:
    guard = "AND c.content_hash <> ''" if prefetch else ""
    return f""", {_SNAPSHOT} SELECT c.pos, CASE WHEN s.source_id IS NULL THEN 'insert' WHEN c.content_hash = s.content_hash {guard} THEN 'skip' ELSE 'update' END AS action
FROM candidates c LEFT JOIN snapshot s ON s.jurisdiction_code = c.jurisdiction_code AND s.source_id = c.source_id"""


@query(_decision(True))
def dedup_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.decide(t.candidates(spark, sf_dir), _snapshot(spark, sf_dir), True).select("pos", "action")


@query(_decision(False))
def dedup_postfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.decide(t.candidates(spark, sf_dir), _snapshot(spark, sf_dir), False).select("pos", "action")


_PARTS = ["jurisdiction_code", "source_id", "title", "abstract", "decision_date", "language", "law_domain"]


@query("SELECT id, sha256(" + " || ".join(f"coalesce({p}::VARCHAR, chr(0)) || chr(31)" for p in _PARTS) + ") AS fingerprint FROM cases")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.cases(spark, sf_dir).select("id", fingerprint(*[F.col(p) for p in _PARTS]).alias("fingerprint"))


@query(f""", {_SNAPSHOT}, o AS (
  SELECT jurisdiction_code, source_id, arg_max(content_hash, pos) AS _x, max(pos) AS pos FROM candidates GROUP BY 1, 2
), n AS (SELECT o.jurisdiction_code, o.source_id, 'h' || (floor(c.value)::INT % 7) AS content_hash, 'offer ' || o.pos AS title FROM o JOIN candidates c ON c.pos = o.pos)
SELECT coalesce(s.jurisdiction_code, n.jurisdiction_code) AS jurisdiction_code, coalesce(s.source_id, n.source_id) AS source_id,
  CASE WHEN n.source_id IS NULL OR s.content_hash = n.content_hash THEN s.content_hash ELSE n.content_hash END AS content_hash,
  CASE WHEN n.source_id IS NULL OR s.content_hash = n.content_hash THEN 'stored' ELSE n.title END AS title,
  CASE WHEN s.source_id IS NULL THEN 1 WHEN n.source_id IS NULL OR s.content_hash = n.content_hash THEN 4 ELSE 5 END::INT AS revision,
  CASE WHEN s.source_id IS NULL THEN '2026-01-01' ELSE '2025-01-01' END AS first_seen, CASE WHEN n.source_id IS NULL THEN '2025-01-01' ELSE '2026-01-01' END AS last_seen
FROM snapshot s FULL JOIN n ON s.jurisdiction_code = n.jurisdiction_code AND s.source_id = n.source_id""")
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last offer of every record merged into the stored snapshot."""
    last = merge.last_of_each(t.candidates(spark, sf_dir).select(*merge.KEY, "pos", "value"), ["pos"])
    offers = last.select(*merge.KEY, F.concat(F.lit("h"), F.floor("value").cast("int") % 7).alias("content_hash"), F.concat(F.lit("offer "), "pos").alias("title"))
    then, now = F.lit("2025-01-01").cast("timestamp"), F.lit("2026-01-01").cast("timestamp")
    old = _snapshot(spark, sf_dir).select(*merge.KEY, "content_hash", F.lit("stored").alias("title"), F.lit(4).alias("revision"), then.alias("first_seen_at"), then.alias("last_seen_at"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return merge.upsert(old, offers, now).select(*merge.KEY, "content_hash", "title", "revision", day("first_seen_at").alias("first_seen"), day("last_seen_at").alias("last_seen"))


@query("""SELECT case_id, target, citation_type, position FROM (
  SELECT l_orderkey AS case_id, 'P' || l_partkey AS target, l_returnflag AS citation_type, l_linenumber AS position, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_returnflag ORDER BY l_linenumber) AS k FROM lineitem) WHERE k = 1""")
def citation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = t.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("P"), "l_partkey").alias("target"), F.col("l_returnflag").alias("citation_type"), F.col("l_linenumber").alias("position"))
    return merge.distinct_citations(edges)


@query("""SELECT 'P' || l_partkey AS target, count(DISTINCT (l_orderkey, l_returnflag)) AS cited_by FROM lineitem GROUP BY 1""")
def citation_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct citations each target has (an extension over the stored edges)."""
    return citation_dedupe(spark, sf_dir).groupBy("target").agg(F.count("*").alias("cited_by"))


@query(""", f AS (SELECT jurisdiction_code, min(pos) AS first FROM candidates WHERE pos % 50 = 49 GROUP BY 1)
SELECT c.jurisdiction_code, max(modified_at)::VARCHAR AS last_modified_seen, arg_max(source_id, pos) AS last_source_id, count(*) AS committed
FROM candidates c LEFT JOIN f ON f.jurisdiction_code = c.jurisdiction_code WHERE first IS NULL OR pos < first GROUP BY 1""")
def checkpoint_holdback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.candidates(spark, sf_dir).withColumn("failed", F.col("pos") % 50 == 49)
    return runs.held_back(rows, "jurisdiction_code").withColumn("last_modified_seen", F.col("last_modified_seen").cast("string"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "skipped").when(F.col("event_type") == "view", "rejected").when(F.col("event_type") == "signup", "inserted").otherwise("updated")
    return t.candidates(spark, sf_dir).withColumn("outcome", outcome)


_COUNTERS = """SELECT jurisdiction_code, count(*) AS discovered, count_if(event_type = 'click')::BIGINT AS skipped, count_if(event_type = 'view')::BIGINT AS rejected, count_if(event_type = 'signup')::BIGINT AS inserted,
count_if(event_type = 'purchase')::BIGINT AS updated, count_if(event_type = 'error')::BIGINT AS error FROM candidates GROUP BY 1"""


@query(_COUNTERS)
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.counters(_outcomes(spark, sf_dir), "jurisdiction_code")


@query(f""", c AS ({_COUNTERS}), s AS (SELECT jurisdiction_code, CASE WHEN inserted = 0 THEN 'failed' WHEN discovered % 5 = 0 THEN 'interrupted' WHEN error > 0 THEN 'partial' ELSE 'success' END AS status FROM c)
SELECT jurisdiction_code, status, CASE status WHEN 'failed' THEN 1 WHEN 'interrupted' THEN 130 WHEN 'partial' THEN 3 ELSE 0 END AS exit_code FROM s""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = runs.counters(_outcomes(spark, sf_dir), "jurisdiction_code")
    rated = counted.select("jurisdiction_code", runs.status(F.col("inserted") == 0, F.col("discovered") % 5 == 0, F.col("error")).alias("status"))
    return rated.withColumn("exit_code", runs.exit_code(F.col("status")))


@query("SELECT 'kind-' || json_extract_string(props, '$.k') AS kind, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = t.table(spark, sf_dir, "events").where("event_type = 'error'").select(F.concat(F.lit("kind-"), F.get_json_object("props", "$.k")).alias("kind"))
    return runs.failure_kinds(failures)


@query(""", g AS (SELECT source_id, max(pos) FILTER (NOT failed) AS ok FROM candidates GROUP BY 1)
SELECT c.source_id, count(*) AS failures FROM candidates c JOIN g ON g.source_id = c.source_id WHERE failed AND (ok IS NULL OR pos > ok) GROUP BY 1 HAVING count(*) >= 2""")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.quarantined(t.candidates(spark, sf_dir), 2)


_SUBSCRIBERS = """subscribers AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 4 THEN lower(replace(c_name, '#', '.')) || '@example.com' END AS email, CASE c_custkey % 5 WHEN 4 THEN 'unsubscribed' WHEN 3 THEN 'pending' ELSE 'confirmed' END AS status,
    CASE WHEN c_custkey % 5 = 4 THEN md5(c_name) END AS email_digest, (date '2024-01-01' + (c_custkey % 300)::INT)::DATE AS created_at, CASE WHEN c_custkey % 5 < 3 THEN (date '2024-01-05' + (c_custkey % 300)::INT)::DATE END AS confirmed_at,
    CASE WHEN c_custkey % 5 = 4 THEN (date '2024-02-01' + (c_custkey % 300)::INT)::DATE END AS unsubscribed_at, CASE WHEN c_custkey % 3 = 0 THEN (date '2024-06-01' + (c_custkey % 30)::INT)::DATE END AS last_digest_at, (c_custkey % 4)::INT AS digest_count FROM customer
)"""


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda base, m: f"date_add(date'{base}', cast(c_custkey % {m} AS int))"
    return t.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "CASE WHEN c_custkey % 5 <> 4 THEN concat(lower(replace(c_name, '#', '.')), '@example.com') END AS email",
        "CASE c_custkey % 5 WHEN 4 THEN 'unsubscribed' WHEN 3 THEN 'pending' ELSE 'confirmed' END AS status", "CASE WHEN c_custkey % 5 = 4 THEN md5(c_name) END AS email_digest",
        f"{day('2024-01-01', 300)} AS created_at", f"CASE WHEN c_custkey % 5 < 3 THEN {day('2024-01-05', 300)} END AS confirmed_at", f"CASE WHEN c_custkey % 5 = 4 THEN {day('2024-02-01', 300)} END AS unsubscribed_at",
        f"CASE WHEN c_custkey % 3 = 0 THEN {day('2024-06-01', 30)} END AS last_digest_at", "cast(c_custkey % 4 AS int) AS digest_count",
    )


@query("""SELECT id, source_id, first_seen_on, (SELECT count(*) FROM cases WHERE is_published AND first_seen_on >= date '2024-05-01' AND first_seen_on < date '2024-06-01') AS total FROM cases
WHERE is_published AND first_seen_on >= date '2024-05-01' AND first_seen_on < date '2024-06-01' ORDER BY first_seen_on DESC, id DESC LIMIT 50""", dates=("first_seen_on",))
def digest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    total, newest = notify.window(t.cases(spark, sf_dir), dt.date(2024, 5, 1), dt.date(2024, 6, 1), 50)
    return newest.withColumn("total", total.scalar()).select("id", "source_id", "first_seen_on", "total")


@query(f", {_SUBSCRIBERS} SELECT id, email, digest_count FROM subscribers WHERE status = 'confirmed' AND (last_digest_at IS NULL OR last_digest_at < date '2024-06-15')")
def digest_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notify.recipients(subscribers(spark, sf_dir), F.lit(dt.date(2024, 6, 15))).select("id", "email", "digest_count")


@query(f", {_SUBSCRIBERS} SELECT id, CASE WHEN s THEN date '2024-06-15' ELSE last_digest_at END AS last_digest_at, digest_count + s::INT AS digest_count FROM (SELECT *, status = 'confirmed' AND (last_digest_at IS NULL OR last_digest_at < date '2024-06-15') AND id % 2 = 0 AS s FROM subscribers)", dates=("last_digest_at",))
def digest_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    until = F.lit(dt.date(2024, 6, 15))
    rows = subscribers(spark, sf_dir)
    return notify.stamp(rows, notify.recipients(rows, until).where("id % 2 = 0"), until).select("id", "last_digest_at", "digest_count")


@query("""SELECT r.id, r.case_id, r.flagged_on FROM reviews r WHERE status = 'pending' AND flagged_on >= (SELECT min(flagged_on) + 10 FROM reviews)""", dates=("flagged_on",))
def admin_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending reviews flagged since ten days after the first."""
    rows = t.reviews(spark, sf_dir)
    since = rows.agg(F.date_add(F.min("flagged_on"), 10).alias("since"))
    return rows.where((F.col("status") == "pending") & (F.col("flagged_on") >= since.scalar())).select("id", "case_id", "flagged_on")


@query(f""", {_SUBSCRIBERS} SELECT id, status, CASE WHEN status = 'unsubscribed' AND unsubscribed_at < date '2024-06-01' THEN NULL ELSE email_digest END AS email_digest FROM subscribers
WHERE NOT (status = 'pending' AND confirmed_at IS NULL AND created_at < date '2024-04-01')""")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notify.purge(subscribers(spark, sf_dir), F.lit(dt.date(2024, 6, 1)), F.lit(dt.date(2024, 4, 1))).select("id", "status", "email_digest")


@query(f", {_SUBSCRIBERS} SELECT status, count(*) AS n, sum(digest_count)::BIGINT AS digests, sum(last_digest_at - created_at)::BIGINT AS days FROM subscribers GROUP BY 1")
def subscriber_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notify.statistics(subscribers(spark, sf_dir))


@query()
def address_pseudonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed digests of addresses; held against the standard library's HMAC in tests."""
    return subscribers(spark, sf_dir).where("email IS NOT NULL").select("id", pseudonym(b"pepper", F.col("email"), "subscriber.v1").alias("digest"))


@query(f""", {_SUBSCRIBERS}, q AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE status END AS status, CASE WHEN id % 2 = 0 THEN TIMESTAMP '2026-01-01 11:30:00' ELSE TIMESTAMP '2026-01-01 09:00:00' END AS notice_sent_at FROM subscribers)
SELECT id, CASE WHEN status IS NULL THEN 'created' WHEN status = 'unsubscribed' THEN 'suppressed' WHEN id % 2 = 0 THEN 'throttled' WHEN status = 'pending' THEN 'resent' ELSE 'reminded' END AS action FROM q""")
def subscription_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = lambda s: F.lit(s).cast("timestamp")
    asked = subscribers(spark, sf_dir).select("id", F.when(F.col("id") % 7 != 0, F.col("status")).alias("status"), F.when(F.col("id") % 2 == 0, stamp("2026-01-01 11:30:00")).otherwise(stamp("2026-01-01 09:00:00")).alias("notice_sent_at"))
    return notify.subscribe(asked, stamp("2026-01-01 12:00:00")).select("id", "action")
