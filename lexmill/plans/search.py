"""Queries of search, facets, statistics, details and exports, each with its oracle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.streams import joined_in_order
from lexmill.functions.text import clean, paragraphs, word_count
from lexmill.operators import detail, export, mirror, search, stats
from lexmill.operators.search import Criteria
from lexmill.sources import tables as t

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    """Register a query under its name, with the oracle over the domain tables. ``dates`` are given as ISO text."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in dates})
        if sql:
            as_text = ", ".join(f"{c}::VARCHAR AS {c}" for c in dates)
            ORACLES[f.__name__] = f"SELECT * REPLACE ({as_text}) FROM ({t.oracle(sql)})" if dates else t.oracle(sql)
        return f

    return add


_SUMMARY = ["id", "source_id", "jurisdiction_code", "title", "decision_date"]
_SELECT = "SELECT id, source_id, jurisdiction_code, title, decision_date"
TERM = "licensed"


def _found(spark: SparkSession, sf_dir: str, c: Criteria, full_text: bool = False) -> DataFrame:
    return search.matching(t.cases(spark, sf_dir), c, t.case_documents(spark, sf_dir) if full_text else None)


@query(f"{_SELECT} FROM cases WHERE is_published ORDER BY decision_date DESC NULLS LAST, id DESC LIMIT 20", dates=("decision_date",))
def case_search_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Criteria()
    return search.page(_found(spark, sf_dir, c), c).select(_SUMMARY)


@query(f"{_SELECT} FROM cases WHERE is_published ORDER BY decision_date ASC NULLS LAST, id ASC LIMIT 20 OFFSET 20", dates=("decision_date",))
def case_search_date_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Criteria(sort="date_asc")
    return search.page(_found(spark, sf_dir, c), c, 2).select(_SUMMARY)


@query(f"""{_SELECT} FROM cases WHERE is_published AND (contains(lower(title), 'stupid') OR contains(lower(abstract), 'stupid') OR contains(lower(source_id), 'stupid'))
ORDER BY CASE WHEN contains(lower(title), 'stupid') THEN 0 WHEN contains(lower(abstract), 'stupid') THEN 1 ELSE 2 END, decision_date DESC NULLS LAST, id DESC LIMIT 20""", dates=("decision_date",))
def case_search_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Criteria(term="stupid", sort="relevance")
    return search.page(_found(spark, sf_dir, c), c).select(_SUMMARY)


@query(f"{_SELECT} FROM cases WHERE is_published AND (abstract ILIKE '%\\%\\%%' ESCAPE '\\' OR title ILIKE '%\\%\\%%' ESCAPE '\\')", dates=("decision_date",))
def case_search_text_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, Criteria(term="%%")).select(_SUMMARY)


@query(f"""{_SELECT} FROM cases c WHERE is_published AND (contains(lower(title), '{TERM}') OR contains(lower(abstract), '{TERM}') OR contains(lower(source_id), '{TERM}')
OR EXISTS (SELECT 1 FROM case_documents d WHERE d.case_id = c.id AND contains(lower(full_text), '{TERM}')))""", dates=("decision_date",))
def case_search_exists_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, Criteria(term=TERM), full_text=True).select(_SUMMARY)


@query(f"""{_SELECT} FROM cases WHERE is_published AND jurisdiction_code IN ('DE', 'EN', 'ES', 'FR') AND law_domain = 'private'
AND decision_date BETWEEN date '2016-01-01' AND date '2022-12-31' AND court_id = 5""", dates=("decision_date",))
def case_search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Criteria(jurisdictions=("DE", "EN", "ES", "FR"), law_domain="private", court_id=5, decided_from=dt.date(2016, 1, 1), decided_until=dt.date(2022, 12, 31))
    return _found(spark, sf_dir, c).select(_SUMMARY)


@query(f"{_SELECT} FROM cases WHERE topic_slug = 'topic-3'", dates=("decision_date",))
def case_topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, Criteria(topic="topic-3", include_unpublished=True)).select(_SUMMARY)


@query("SELECT count(*) AS n FROM cases WHERE is_published AND language = 'de'")
def case_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, Criteria(language="de")).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS total, 2::BIGINT AS page, 20::BIGINT AS page_size, greatest(1, ceil(count(*) / 20))::BIGINT AS page_count,
2 < greatest(1, ceil(count(*) / 20)) AS has_next FROM cases WHERE is_published AND jurisdiction_code = 'FR'""")
def case_page_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.envelope(_found(spark, sf_dir, Criteria(jurisdictions=("FR",))), 2, 20)


@query(f"{_SELECT} FROM cases WHERE is_published ORDER BY decision_date DESC NULLS LAST, id DESC LIMIT 50", dates=("decision_date",))
def latest_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.latest(t.cases(spark, sf_dir), 50).select(_SUMMARY)


@query(f"{_SELECT} FROM cases WHERE is_published AND id > 100 ORDER BY id LIMIT 50", dates=("decision_date",))
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.after(_found(spark, sf_dir, Criteria()), 100, 50).select(_SUMMARY)


_ORDERS = {
    "date_desc": "decision_date DESC NULLS LAST, id DESC", "date_asc": "decision_date ASC NULLS LAST, id ASC",
    "relevance": "CASE WHEN contains(lower(title), 'the') THEN 0 WHEN contains(lower(abstract), 'the') THEN 1 ELSE 2 END, decision_date DESC NULLS LAST, id DESC",
}
_CURSOR = " UNION ALL ".join(f"""SELECT '{sort}' AS sort, (place - 1) // {{size}} AS page, (place - 1) % {{size}} AS place, id FROM (
  SELECT id, row_number() OVER (ORDER BY {by}) AS place FROM cases WHERE is_published AND jurisdiction_code = 'DE' {"AND (contains(lower(title), 'the') OR contains(lower(abstract), 'the') OR contains(lower(source_id), 'the'))" if sort == 'relevance' else ''}) WHERE place <= 4 * {{size}}""" for sort, by in _ORDERS.items())  # fmt: skip


@query(_CURSOR.format(size=30))
def case_cursor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four pages of each order, each page asked for by the cursor of the one before."""
    out = None
    for sort in _ORDERS:
        c = Criteria(term="the" if sort == "relevance" else None, jurisdictions=("DE",), sort=sort)
        found, cursor = _found(spark, sf_dir, c), None
        for number in range(4):
            rows = search.page_after(found, c, cursor, 30)
            ids = rows.agg(F.collect_list("id").alias("ids"))
            listed = ids.select(F.lit(sort).alias("sort"), F.lit(number).cast("long").alias("page"), F.posexplode("ids").alias("place", "id")).withColumn("place", F.col("place").cast("long"))
            out = listed if out is None else out.unionByName(listed)
            if (cursor := search.cursor_of(rows, c)) is None:
                break
    return out


_STATS = """SELECT code, name, map_feature_id, count(c.id) AS case_count, max(c.decision_date) AS latest_decision
FROM jurisdiction j LEFT JOIN cases c ON c.jurisdiction_code = j.code AND c.is_published GROUP BY ALL"""


@query(_STATS, dates=("latest_decision",))
def jurisdiction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.per_jurisdiction(t.jurisdictions(spark), t.cases(spark, sf_dir))


@query(f""", s AS ({_STATS}), f AS (SELECT map_feature_id FROM jurisdiction UNION ALL VALUES ('m-none'))
SELECT f.map_feature_id, coalesce(case_count, 0) AS case_count,
CASE WHEN coalesce(case_count, 0) >= 100 THEN 'high' WHEN coalesce(case_count, 0) >= 10 THEN 'medium' WHEN coalesce(case_count, 0) >= 1 THEN 'low' ELSE 'none' END AS band,
CASE WHEN coalesce(case_count, 0) = 0 THEN 'no cases' WHEN case_count = 1 THEN '1 case' ELSE format('{{:,}}', case_count) || ' cases' END AS phrase
FROM f LEFT JOIN s ON s.map_feature_id = f.map_feature_id""")
def stats_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = t.jurisdictions(spark).select("map_feature_id").unionAll(spark.createDataFrame([("m-none",)], "map_feature_id string"))
    return stats.map_features(features, stats.per_jurisdiction(t.jurisdictions(spark), t.cases(spark, sf_dir)))


@query("""SELECT n_nationkey AS code, n_name AS name, count(o.o_orderkey) AS case_count, max(o.o_orderdate)::DATE AS latest_decision FROM nation
LEFT JOIN (SELECT c_nationkey, o_orderkey, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P') o ON c_nationkey = n_nationkey GROUP BY ALL""", dates=("latest_decision",))
def volume_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statistics over the large fact table: orders of customers by nation."""
    orders = t.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    by_customer = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("day").alias("latest"))
    customers = t.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    by_nation = by_customer.join(customers, by_customer["o_custkey"] == customers["c_custkey"]).groupBy("c_nationkey").agg(F.sum("n").alias("n"), F.max("latest").alias("latest"))
    nations = t.table(spark, sf_dir, "nation")
    joined = nations.join(by_nation, nations["n_nationkey"] == by_nation["c_nationkey"], "left")
    return joined.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.coalesce("n", F.lit(0)).alias("case_count"), F.col("latest").alias("latest_decision"))


@query("SELECT code, name, map_feature_id FROM jurisdiction WHERE code IN (SELECT jurisdiction_code FROM cases WHERE is_published)")
def facet_jurisdictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.with_published(t.jurisdictions(spark), t.cases(spark, sf_dir), "code", "jurisdiction_code")


@query("SELECT DISTINCT court_id AS value FROM cases WHERE is_published AND court_id IS NOT NULL")
def facet_courts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distinct_values(t.cases(spark, sf_dir), "court_id")


@query("SELECT DISTINCT language AS value FROM cases WHERE is_published AND language IS NOT NULL")
def facet_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distinct_values(t.cases(spark, sf_dir), "language")


@query("SELECT min(decision_date) AS earliest, max(decision_date) AS latest FROM cases WHERE is_published", dates=("earliest", "latest"))
def facet_date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.date_bounds(t.cases(spark, sf_dir))


@query("""SELECT r.id, r.jurisdiction_code, r.finished_at::VARCHAR AS finished_at FROM runs r
JOIN (SELECT jurisdiction_code, max(finished_at) AS m FROM runs WHERE status = 'success' GROUP BY 1) x ON x.jurisdiction_code = r.jurisdiction_code AND x.m = r.finished_at
WHERE r.status = 'success'""")
def latest_successful_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latest_successful(t.runs(spark, sf_dir)).select("id", "jurisdiction_code", F.col("finished_at").cast("string").alias("finished_at"))


@query("""SELECT c.id, c.source_id, j.name AS jurisdiction, c.title, c.decision_date, c.revision, c.is_published, r.status AS review_status
FROM cases c LEFT JOIN jurisdiction j ON j.code = c.jurisdiction_code LEFT JOIN reviews r ON r.case_id = c.id""", dates=("decision_date",))
def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = t.jurisdictions(spark).select(F.col("code").alias("jurisdiction_code"), F.col("name").alias("jurisdiction"))
    review = t.reviews(spark, sf_dir).select(F.col("case_id").alias("id"), F.col("status").alias("review_status"))
    rows = t.cases(spark, sf_dir).join(names, "jurisdiction_code", "left").join(review, "id", "left")
    return rows.select("id", "source_id", "jurisdiction", "title", "decision_date", "revision", "is_published", "review_status")


#: The further fields of a case, and the child tables, as projections of the given tables: the same SQL for both engines but for casts.
_FURTHER = {
    "source_system": "'portal'", "publication_date": "CASE WHEN id % 6 <> 0 THEN '2024-02-0' || (1 + id % 9) END", "case_numbers": "'A' || id || '|B' || (id % 7)", "law_subfield": "CASE WHEN id % 4 <> 3 THEN 'branch-' || (id % 3) END",
    "procedure_type": "CASE WHEN id % 5 = 0 THEN 'appeal' END", "outcome": "CASE WHEN id % 9 = 0 THEN 'dismissed' END", "source_url": "'https://x.example/' || id", "filing_date": "CASE WHEN id % 8 = 0 THEN '2023-12-31' END",
    "first_seen_at": "'2024-01-01'", "last_seen_at": "'2024-03-0' || (1 + id % 9)", "updated_at": "'2024-02-02'",
}
_COURTS = "SELECT DISTINCT n_nationkey AS id, 'Court ' || n_name AS name FROM nation WHERE n_nationkey % 6 <> 5"
_LISTS = {
    "documents": ("conversations", "conv_id", {"id": "turn", "language": "role", "doc_type": "CASE turn % 3 WHEN 0 THEN 'opinion' WHEN 1 THEN 'judgment' ELSE 'other' END", "format": "'xml'", "full_text": "text", "source_url": "NULL", "byte_size": "octet_length(text)", "retrieved_at": "'2024-01-01'"}),
    "parties": ("orders", "o_custkey", {"ordinal": "o_orderkey", "id": "o_orderkey", "name": "'P' || (o_orderkey % 100)", "role": "o_orderstatus", "party_type": "NULL"}),
    "topics": ("part", "p_partkey", {"slug": "'topic-' || p_size", "label": "p_brand", "confidence": "p_size", "assigned_by": "'rule'"}),
    "keyword_matches": ("labels", "doc_id", {"id": "doc_id", "term_id": "'t' || (doc_id % 40)", "term": "'term ' || (doc_id % 40)", "list_version": "'v1'", "field": "CASE WHEN quality = 1 THEN 'title' ELSE 'abstract' END", "weight_applied": "1 + toxic", "match_count": "1 + doc_id % 3", "snippet": "NULL"}),
    "citations": ("lineitem", "l_orderkey", {"position": "l_linenumber", "target_identifier": "'P' || l_partkey", "target_scheme": "'ecli'", "citation_type": "l_returnflag", "target_title": "NULL", "target_url": "NULL"}),
}


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    further = {k: f"split({v}, '[|]')" if k == "case_numbers" else v for k, v in _FURTHER.items()}
    return t.cases(spark, sf_dir).selectExpr("*", *[f"{v} AS {k}" for k, v in further.items()])


def _courts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "nation").where("n_nationkey % 6 <> 5").selectExpr("n_nationkey AS id", "'Court ' || n_name AS name").distinct()


_SUMMARY_SQL = ", ".join({"jurisdiction_name": "j.name AS jurisdiction_name", "court_name": "k.name AS court_name"}.get(f) or (f"{_FURTHER[f]} AS {f}" if f in _FURTHER else f"c.{f}::VARCHAR AS {f}" if f == "decision_date" else f"c.{f}") for f in detail.SUMMARY).replace("id %", "c.id %").replace("|| id", "|| c.id")
_SUMMARY_FROM = f"FROM cases c LEFT JOIN jurisdiction j ON j.code = c.jurisdiction_code LEFT JOIN ({_COURTS}) k ON k.id = c.court_id"


@query(f"SELECT {_SUMMARY_SQL} {_SUMMARY_FROM}")
def case_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 18 fields of every case."""
    rows = detail.summary(_whole(spark, sf_dir), t.jurisdictions(spark), _courts(spark, sf_dir))
    return rows.withColumns({"case_numbers": F.array_join("case_numbers", "|"), "decision_date": F.col("decision_date").cast("string")})


def _list_sql(name: str) -> str:
    table, key, fields = _LISTS[name]
    row = " || '/' || ".join(f"coalesce(({v})::VARCHAR, '-')" for v in fields.values()).replace("octet_length(text)", "strlen(text)")
    first = next(iter(fields.values()))
    return f"LEFT JOIN (SELECT {key} AS k, count(*) AS n_{name}, md5(string_agg({row}, chr(10) ORDER BY {first}, {row})) AS {name} FROM {table} GROUP BY 1) x_{name} ON x_{name}.k = c.id"


@query(f"""SELECT c.id, j.name AS jurisdiction_name, k.name AS court_name, c.title, c.revision, {_FURTHER['last_seen_at']} AS last_seen_at, {', '.join(f'coalesce(n_{name}, 0) AS n_{name}, {name}' for name in _LISTS)}
{_SUMMARY_FROM} {' '.join(map(_list_sql, _LISTS))}""".replace("(1 + id % 9)", "(1 + c.id % 9)"))
def case_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case with its five child lists, each as its length and a digest of its rows in order."""
    tables = {name: t.table(spark, sf_dir, table).selectExpr(f"{key} AS case_id", *[f"cast({v} AS string) AS {f}" if v == "NULL" else f"{v} AS {f}" for f, v in fields.items()]) for name, (table, key, fields) in _LISTS.items()}
    rows = detail.detail(_whole(spark, sf_dir), t.jurisdictions(spark), _courts(spark, sf_dir), **tables)
    line = lambda name: lambda x: F.concat_ws("/", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in detail.CHILDREN[name]])
    lists = [c for name in _LISTS for c in (F.size(name).cast("long").alias(f"n_{name}"), F.when(F.size(name) > 0, F.md5(F.array_join(F.transform(name, line(name)), "\n"))).alias(name))]
    return rows.select("id", "jurisdiction_name", "court_name", "title", "revision", "last_seen_at", *lists)


@query("""SELECT conv_id AS id, count(*) AS n_documents, string_agg(DISTINCT role, ',' ORDER BY role) AS languages, count_if(role = 'assistant')::BIGINT AS n_own
FROM conversations GROUP BY conv_id""")
def case_detail_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child documents of each case, folded into one row."""
    children = t.table(spark, sf_dir, "conversations")
    return children.groupBy(F.col("conv_id").alias("id")).agg(
        F.count("*").alias("n_documents"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("languages"), F.count_if(F.col("role") == "assistant").alias("n_own")
    )


@query("""SELECT conv_id AS id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY (role <> 'user')::INT, role, turn)) AS text_sha256
FROM conversations WHERE text IS NOT NULL AND regexp_matches(text, '[^ ]') GROUP BY conv_id""")
def joined_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a case as one text: the primary language first, then by language and position. Blank ones are left out."""
    some = t.table(spark, sf_dir, "conversations").where("text IS NOT NULL AND text RLIKE '[^ ]'").withColumnRenamed("conv_id", "id")
    order = [F.col("role") != "user", F.col("role"), F.col("turn")]
    return joined_in_order(some, "id", order, F.col("text"), "\n\n", digest=True).select("id", F.col("value").alias("text_sha256"))


_EXPORT = """SELECT c.id, c.source_id, c.jurisdiction_code, j.name AS jurisdiction, c.title, strftime(c.decision_date, '%Y-%m-%d') AS decision_date, c.language, c.law_domain
FROM cases c LEFT JOIN jurisdiction j ON j.code = c.jurisdiction_code WHERE c.is_published"""


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.rows(t.cases(spark, sf_dir).where("is_published"), t.jurisdictions(spark))


@query(_EXPORT)
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir)


def _cell(c: str) -> str:
    return f"CASE WHEN substring(coalesce({c}::VARCHAR, ''), 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || {c}::VARCHAR ELSE coalesce({c}::VARCHAR, '') END AS {c}"


@query(f", e AS ({_EXPORT}) SELECT {', '.join(_cell(c) for c in ('id', 'source_id', 'jurisdiction_code', 'jurisdiction', 'title', 'decision_date', 'language', 'law_domain'))} FROM e")
def export_csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.csv_rows(_flat(spark, sf_dir))


@query("""SELECT page_id, CASE WHEN length(n) > 100 THEN NULL WHEN n LIKE '.%' OR n LIKE '%.' OR n = '' THEN NULL ELSE n END AS name,
CASE WHEN n = '' THEN 'blank' WHEN length(n) > 100 THEN 'too long' WHEN n LIKE '.%' THEN 'hidden' WHEN n LIKE '%.' THEN 'trailing dot' END AS error
FROM (SELECT page_id, regexp_replace(trim(url), '[^A-Za-z0-9()._-]', '_', 'g') AS n FROM pages)""")
def mirror_folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "pages").select("page_id", mirror.folder_name(F.col("url")).alias("f")).select("page_id", "f.name", "f.error")


@query("""SELECT doc_id AS identifier FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def mirror_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without a complete entry; an entry is complete if its metadata names it."""
    held = t.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("identifier"), F.when(F.col("quality") == 1, F.col("doc_id")).alias("metadata_identifier"))
    return mirror.missing(t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("identifier")), held)


_COUNTED = r"""SELECT doc_id AS id, CASE WHEN w = '' THEN 0 ELSE len(regexp_split_to_array(w, '[ \t\n\r\f\v]+')) END::BIGINT AS words,
coalesce(len(list_filter(CASE WHEN regexp_matches(text, '\n[ \t]*\n') THEN regexp_split_to_array(text, '\n[ \t]*\n[ \t\n\r\f\v]*') ELSE string_split(text, chr(10)) END, lambda p: trim(p, ' ') <> '')), 0)::BIGINT AS paragraphs
FROM (SELECT doc_id, text, regexp_replace(coalesce(text, ''), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS w FROM documents)"""


@query(_COUNTED)
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and paragraphs of all documents, those with blank lines included."""
    counts = (word_count(F.col("text")).alias("words"), F.coalesce(F.size(paragraphs(F.col("text"))), F.lit(0)).cast("long").alias("paragraphs"))
    return t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), *counts)


@query(_COUNTED)
def word_counts_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same; it had no SQL once and is held against brute force in tests, too."""
    return word_counts(spark, sf_dir)


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(coalesce(html, ''), '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B-\x1F\x7F-\x{9F}\x{202A}-\x{202E}\x{2066}-\x{2069}]', '', 'g')) AS clean_md5 FROM pages""")
def case_labels_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as they may be shown: without control characters and direction overrides."""
    return t.table(spark, sf_dir, "pages").select("page_id", F.md5(clean(F.coalesce("html", F.lit("")))).alias("clean_md5"))
