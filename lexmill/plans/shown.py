"""Queries of what is exported, displayed and looked up, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import hashing
from lexmill.functions.text import collapse
from lexmill.operators import display, export, merge, mirror, notify, offers
from lexmill.plans import ingest
from lexmill.plans import search as s
from lexmill.plans.search import query
from lexmill.sources import markup
from lexmill.sources import tables as t

KEY = b"pepper"


def _hmac_sql(message: str, key: bytes = KEY) -> str:
    """Hex HMAC-SHA256 of a text in DuckDB's SQL."""
    inner, outer = hashing._pads(key)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


@query("""SELECT place, source_id FROM (SELECT source_id, row_number() OVER (ORDER BY modified_at NULLS FIRST, source_id) AS place FROM (
  SELECT source_id, max(CASE WHEN user_id % 9 <> 0 THEN modified_at END) AS modified_at FROM (SELECT *, substring(source_id, 5)::BIGINT AS user_id FROM candidates) GROUP BY 1)) WHERE place <= 300""")
def discovery_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 candidates in the order in which they are processed; those without a time come first."""
    n = F.substring("source_id", 5, 20).cast("long")
    last = t.candidates(spark, sf_dir).groupBy("source_id").agg(F.max(F.when(n % 9 != 0, F.col("modified_at"))).alias("modified_at"))
    ids = offers.in_order(last).limit(300).agg(F.collect_list("source_id").alias("ids"))
    return ids.select(F.posexplode("ids").alias("p", "source_id")).select((F.col("p") + 1).cast("long").alias("place"), "source_id")


_RECORD = ", ".join(
    {"jurisdiction_name": "j.name AS jurisdiction_name", "court_name": "k.name AS court_name", "case_numbers": "'A' || c.id || ' B' || (c.id % 7) AS case_numbers"}.get(f)
    or (f"{s._FURTHER[f].replace('id %', 'c.id %').replace('|| id', '|| c.id')} AS {f}" if f in s._FURTHER else f"c.{f}::VARCHAR AS {f}" if f == "decision_date" else f"c.{f}")
    for f in export.COLUMNS
)


@query(f"SELECT {_RECORD} {s._SUMMARY_FROM} WHERE c.is_published")
def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 21 columns of an export of the published cases."""
    return export.records(s._whole(spark, sf_dir).where("is_published"), t.jurisdictions(spark), s._courts(spark, sf_dir))


@query("SELECT 0 AS position, 'metadata' AS record_type, 'DE' AS name FROM range(1) UNION ALL SELECT 1, 'case', 'DOC:' || id FROM cases WHERE is_published AND jurisdiction_code = 'DE'")
def export_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export as JSON lines, read again: the record of its filters, then a record for each case."""
    flat = s._flat(spark, sf_dir).where("jurisdiction_code = 'DE'")
    lines = export.json_lines(flat, F.struct(F.lit("DE").alias("jurisdiction")))
    of = lambda path: F.get_json_object("line", path)
    return lines.select("position", of("$.record_type").alias("record_type"), F.coalesce(of("$.filters.jurisdiction"), of("$.source_id")).alias("name"))


@query("""SELECT min(finished_at)::VARCHAR AS started_at, count(*) AS runs, sum(floor(value))::BIGINT AS bytes, (SELECT string_agg(id::VARCHAR, ',' ORDER BY finished_at, id) FROM (SELECT * FROM runs ORDER BY finished_at DESC, id DESC LIMIT 50)) AS last_runs FROM runs""")
def mirror_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.runs(spark, sf_dir).select("id", "finished_at", F.floor("value").cast("long").alias("bytes"))
    last = F.array_join(F.transform("history", lambda x: x["id"].cast("string")), ",")
    return mirror.manifest(rows).select(F.col("started_at").cast("string").alias("started_at"), "runs", "bytes", last.alias("last_runs"))


@query(f""", {ingest._SUBSCRIBERS}, r AS (SELECT id, CASE WHEN email IS NOT NULL THEN email END AS email, status, CASE WHEN status = 'unsubscribed' THEN {_hmac_sql("'subscriber.v1:gone' || id || '@example.com'")} END AS email_digest FROM subscribers)
SELECT c_custkey AS ask, CASE WHEN c_custkey % 7 <> 6 THEN c_custkey END AS id, CASE WHEN c_custkey % 7 <> 6 THEN r.status END AS status, CASE WHEN c_custkey % 7 = 6 THEN NULL WHEN r.status = 'unsubscribed' THEN 'digest' ELSE 'email' END AS found_by
FROM customer JOIN r ON r.id = c_custkey""")
def subscriber_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer asks by an address: those who have gone are found by its digest, some are unknown."""
    rows = ingest.subscribers(spark, sf_dir)
    gone = F.concat(F.lit("gone"), "id", F.lit("@example.com"))
    known = rows.select("id", "email", "status", F.when(F.col("status") == "unsubscribed", hashing.pseudonym(KEY, gone, "subscriber.v1")).alias("email_digest"), F.lit(None).cast("string").alias("token_seed"))
    mail = F.when(F.col("id") % 7 == 6, F.concat(F.lit("stranger"), "id")).otherwise(F.upper(F.coalesce("email", gone)))
    return notify.lookup(rows.select(F.col("id").alias("ask"), F.concat(F.lit(" "), mail).alias("email"), F.lit(None).cast("string").alias("token_seed")), known, KEY, "subscriber.v1")


@query(f"SELECT c_custkey AS id, {_hmac_sql("'subscriber.v1:' || lower(c_name)")} AS digest FROM customer")
def name_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed digests by built-in hash functions."""
    return t.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), hashing.pseudonym(KEY, F.col("c_name"), "subscriber.v1").alias("digest"))


_TOKEN = f"rtrim(replace(replace(base64(unhex({_hmac_sql("'v1:confirm:s' || c_custkey")})), '+', '-'), '/', '_'), '=')"


@query(f"SELECT c_custkey AS id, 's' || c_custkey || '.' || {_TOKEN} AS token, CASE WHEN c_custkey % 3 = 0 THEN 's' || c_custkey END AS seed FROM customer")
def subscription_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, and what is read back from them: a token that was changed, or made for something else, gives nothing."""
    made = t.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), hashing.token(KEY, F.concat(F.lit("s"), "c_custkey"), "confirm", "v1").alias("token"))
    other = hashing.token(KEY, F.concat(F.lit("s"), "id"), "leave", "v1")
    shown = F.when(F.col("id") % 3 == 0, F.col("token")).when(F.col("id") % 3 == 1, F.concat("token", F.lit("x"))).otherwise(other)
    return made.select("id", "token", hashing.verify_token(KEY, shown, "confirm", "v1").alias("seed"))


_UNICODE_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"SELECT doc_id AS id, md5(trim(regexp_replace(coalesce(text, ''), '{_UNICODE_SPACE}', ' ', 'g'), ' ')) AS collapsed_md5 FROM documents")
def collapsed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text on one line."""
    return t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(collapse(F.coalesce("text", F.lit("")))).alias("collapsed_md5"))


@query("SELECT pos, sha256('portal' || chr(31) || source_id || chr(31) || coalesce(content_hash, chr(0)) || chr(31)) AS revision FROM candidates")
def revision_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listed revision is known by."""
    return t.candidates(spark, sf_dir).select("pos", markup.revision_hash(F.lit("portal"), F.col("source_id"), F.col("content_hash")).alias("revision"))


_LINE = "regexp_replace(coalesce(title, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')"


@query(f"""SELECT id, CASE WHEN length(trim({_LINE}, ' ')) > 40 THEN rtrim(substring(trim({_LINE}, ' '), 1, 39), ' ') || '…' ELSE trim({_LINE}, ' ') END AS line, strftime(decision_date, '%-d %B %Y') AS decided,
CASE WHEN id % 7 > id % 3 THEN (id % 3) || ' of ' || (id % 7) || ' new cases are listed.' ELSE (id % 7) || ' new ' || CASE WHEN id % 7 = 1 THEN 'case' ELSE 'cases' END || '.' END AS note FROM cases""")
def digest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a digest shows each case, and what it says of those that it leaves out."""
    n = F.col("id")
    return t.cases(spark, sf_dir).select("id", notify.truncated(F.coalesce("title", F.lit("")), 40).alias("line"), display.short_date(F.col("decision_date")).alias("decided"), notify.overflow_note(n % 3, n % 7).alias("note"))


@query(f""", {ingest._SNAPSHOT} SELECT c.pos, CASE WHEN s.source_id IS NULL THEN 'insert' WHEN c.content_hash = s.content_hash AND c.content_hash <> '' THEN 'skip' ELSE 'update' END AS action,
CASE WHEN s.source_id IS NOT NULL THEN length(s.source_id) END::INT AS stored_revision, CASE WHEN s.source_id IS NOT NULL THEN '2025-01-01' END AS stored_last_seen
FROM candidates c LEFT JOIN snapshot s ON s.jurisdiction_code = c.jurisdiction_code AND s.source_id = c.source_id""")
def dedup_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is decided on each candidate, with what is stored of its record."""
    stored = ingest._snapshot(spark, sf_dir).withColumns({"revision": F.length("source_id"), "last_seen_at": F.lit("2025-01-01").cast("timestamp")})
    return merge.decide(t.candidates(spark, sf_dir), stored, True).select("pos", "action", "stored_revision", F.date_format("stored_last_seen_at", "yyyy-MM-dd").alias("stored_last_seen"))


_RUNS = """, r AS (SELECT jurisdiction_code AS id, count(*) AS discovered, count_if(event_type = 'click') AS skipped, count_if(event_type IN ('signup', 'purchase'))::BIGINT AS written, count_if(event_type = 'error') AS failed, min(modified_at) AS started_at FROM candidates GROUP BY 1)"""


@query(f"""{_RUNS} SELECT id, strftime(started_at, '%G-W%V_%Y%m%dT%H%M%SZ') AS name, CASE WHEN discovered % 5 = 0 THEN 'FAILED after ' WHEN discovered % 5 = 1 THEN 'INTERRUPTED after ' ELSE '' END
|| CASE WHEN written = 0 THEN CASE WHEN discovered % 5 < 2 THEN 'nothing new' ELSE 'Nothing new' END ELSE format('{{:,}}', written) || ' new case' || CASE WHEN written = 1 THEN '' ELSE 's' END END || CASE WHEN failed > 0 THEN format(', {{:,}} failed', failed) ELSE '' END
|| CASE WHEN discovered % 5 = 0 THEN ': the source is gone' WHEN discovered % 5 = 1 THEN '. Nothing is lost; the next run resumes.' ELSE '.' END AS verdict, (SELECT count(*) FROM candidates c WHERE c.jurisdiction_code = r.id AND event_type = 'error') > 0 AS tells_failures FROM r""")
def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each jurisdiction's run: its name, its first sentence and whether it has a section of failures."""
    rows = t.candidates(spark, sf_dir)
    n = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    runs_ = rows.groupBy(F.col("jurisdiction_code").alias("id")).agg(F.count("*").alias("discovered"), n("click").alias("skipped"), n("signup", "purchase").alias("written"), n("error").alias("failed"), F.min("modified_at").cast("timestamp").alias("started_at"), F.max("modified_at").cast("timestamp").alias("finished_at"))
    status = F.when(F.col("discovered") % 5 == 0, "failed").when(F.col("discovered") % 5 == 1, "interrupted").otherwise("partial")
    runs_ = runs_.withColumns({"jurisdiction_code": F.col("id"), "status": status, "bytes": F.col("written") * 1000, "before": F.lit(None).cast("string"), "after": F.lit("x"), "error": F.lit("the source is gone")})
    failures = rows.where("failed").select(F.col("jurisdiction_code").alias("run"), "pos", F.col("source_id").alias("identifier"), F.lit("Timeout").alias("kind"), F.lit("late").alias("reason"))
    return export.run_reports(runs_, failures).select("id", "name", F.split("text", "\n")[3].alias("verdict"), F.contains("text", F.lit("\nFailures\n--------\n")).alias("tells_failures"))
