"""Queries from payload to record: payloads are written from the domain tables, read again by the library, and held against the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import display, export, merge, mirror, reviews, runs, search, stats
from lexmill.plans.search import query
from lexmill.sources import decisions as d
from lexmill.sources import markup
from lexmill.sources import tables as t

_PLAIN = "regexp_replace(coalesce({}, ''), '[^A-Za-z]+', ' ')"
_CASES = f"SELECT id, decision_date, trim({_PLAIN.format('title')}) AS title, trim({_PLAIN.format('abstract')}) AS abstract FROM cases"
_SQL_CASES = _CASES.replace("'[^A-Za-z]+', ' ')", "'[^A-Za-z]+', ' ', 'g')")


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision's payload for every case; every thirteenth cannot be read."""
    t.cases(spark, sf_dir).createOrReplaceTempView("lexmill_cases")
    rows = spark.sql(_CASES.replace("FROM cases", "FROM lexmill_cases"))
    n = "id"
    payload = f"""concat('<open xmlns:dcterms="d" xmlns:psi="p" xmlns:ecli="e" xmlns:bwb="b"><RDF><Description>',
      '<dcterms:identifier>ECLI:NL:C', {n} % 20, ':', 2000 + {n} % 25, ':', {n}, '</dcterms:identifier><dcterms:date>', coalesce(cast(decision_date AS string), 'soon'), '</dcterms:date>',
      '<dcterms:issued>2024-01-02T10:00:00</dcterms:issued><dcterms:creator psi:resourceIdentifier="court/', {n} % 20, '">Court ', {n} % 20, '</dcterms:creator>',
      CASE {n} % 3 WHEN 0 THEN '' WHEN 1 THEN concat('<dcterms:subject>Strafrecht; Tak ', {n} % 4, '</dcterms:subject>') ELSE '<dcterms:subject>Iets</dcterms:subject><dcterms:subject>Civiel recht</dcterms:subject>' END,
      '<psi:zaaknummer>A', {n}, '</psi:zaaknummer><psi:zaaknummer> B', {n} % 7, '\\n</psi:zaaknummer><psi:procedure>Hoger beroep</psi:procedure><dcterms:language>nl</dcterms:language>',
      '<dcterms:references ecli:resourceIdentifier="ECLI:NL:C1:2001:', {n} % 50, '">x</dcterms:references><dcterms:references>none</dcterms:references><dcterms:relation bwb:resourceIdentifier="BWBR', {n} % 9, '">y</dcterms:relation>',
      '</Description><Description><dcterms:identifier>http://x/', {n}, '</dcterms:identifier><dcterms:title>', title, '</dcterms:title></Description></RDF>',
      CASE WHEN {n} % 4 = 0 THEN concat('<inhoudsindicatie><para>', abstract, '</para></inhoudsindicatie>') ELSE '' END,
      CASE WHEN {n} % 5 = 0 THEN '' WHEN {n} % 5 < 3 THEN concat('<uitspraak><title>Kop</title><para>', abstract, '</para></uitspraak>') ELSE concat('<conclusie lang="fr"><para>', abstract, '</para></conclusie>') END,
      CASE WHEN {n} % 13 = 0 THEN '<open>' ELSE '</open>' END)"""
    return rows.selectExpr("concat('DOC:', id) AS source_id", "cast(null AS string) AS title", "cast(null AS string) AS source_url", f"{payload} AS payload")


def _vocabulary(spark: SparkSession) -> DataFrame:
    kinds = ("Rechtbank", "Gerechtshof", "TypeRvS", "Onbekend")
    entries = "".join(f"<Instantie><Naam>Named {i}</Naam><Identifier>court/{i}</Identifier><Afkorting>N{i}</Afkorting><Type>{kinds[i % 4]}</Type></Instantie>" for i in range(16))
    return spark.createDataFrame([(f"<Instanties>{entries}<Instantie><Naam>nobody</Naam></Instantie></Instanties>",)], "payload string")


_LEVEL = "CASE {} % 4 WHEN 0 THEN 'first_instance' WHEN 1 THEN 'appeal' WHEN 2 THEN 'supreme' END"


@query(f"""SELECT 'court/' || s_suppkey AS source_identifier, s_name || ' ' || CASE WHEN s_suppkey % 4 = 0 THEN 'new' ELSE 'old' END AS name, 'N' || s_nationkey AS abbreviation, CASE s_suppkey % 4 WHEN 0 THEN 'Rechtbank' WHEN 1 THEN 'Gerechtshof' WHEN 2 THEN 'TypeRvS' ELSE 'Onbekend' END AS source_type,
{_LEVEL.format('s_suppkey')} AS level, CASE WHEN s_suppkey % 4 = 2 THEN 'administrative' END AS domain FROM supplier""")
def court_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courts out of two vocabularies of many lists each: every supplier is an entry, and the later vocabulary names a quarter anew."""
    s = t.table(spark, sf_dir, "supplier")
    entry = lambda name: F.concat(F.lit("<Instantie><Naam>"), "s_name", F.lit(f" {name}</Naam><Identifier>court/"), "s_suppkey", F.lit("</Identifier><Afkorting>N"), "s_nationkey", F.lit("</Afkorting><Type>"), F.element_at(F.array(*map(F.lit, ("Rechtbank", "Gerechtshof", "TypeRvS", "Onbekend"))), (F.col("s_suppkey") % 4 + 1).cast("int")), F.lit("</Type></Instantie>"))
    entries = s.select(F.lit(1).alias("n"), F.col("s_suppkey") % 7, entry("old").alias("e")).union(s.where("s_suppkey % 4 = 0").select(F.lit(2), F.col("s_suppkey") % 3, entry("new")))
    lists = entries.toDF("n", "list", "e").groupBy("n", "list").agg(F.concat(F.lit("<Instanties>"), F.array_join(F.collect_list("e"), ""), F.lit("<Instantie><Naam>nobody</Naam></Instantie></Instanties>")).alias("payload"))
    return d.court_vocabulary(lists, order="n")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.decisions(_written(spark, sf_dir), d.court_vocabulary(_vocabulary(spark)))


_DECISIONS = f""", p AS ({_SQL_CASES}), r AS (
SELECT id, 'ECLI:NL:C' || id % 20 || ':' || 2000 + id % 25 || ':' || id AS source_id, nullif(title, '') AS title, CASE WHEN id % 4 = 0 THEN nullif(abstract, '') END AS abstract,
  CASE id % 3 WHEN 1 THEN 'Strafrecht; Tak ' || id % 4 WHEN 2 THEN 'Iets; Civiel recht' END AS subject, decision_date::VARCHAR AS decision_date, 'A' || id || '|B' || id % 7 AS case_numbers,
  CASE id % 3 WHEN 1 THEN 'criminal' WHEN 2 THEN 'private' END AS law_domain, CASE WHEN id % 3 = 1 THEN 'Tak ' || id % 4 END AS law_subfield, 'http://x/' || id AS source_url, 'court/' || id % 20 AS court_identifier,
  CASE WHEN id % 20 < 16 THEN 'Named ' || id % 20 ELSE 'Court ' || id % 20 END AS court, CASE WHEN id % 20 < 16 THEN {_LEVEL.format('(id % 20)')} END AS level,
  CASE WHEN id % 5 = 0 THEN 'other' WHEN id % 5 < 3 THEN 'judgment' ELSE 'opinion' END AS doc_type, CASE WHEN id % 5 >= 3 THEN 'fr' ELSE 'nl' END AS doc_language,
  CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 < 3 THEN 'Kop' || CASE WHEN abstract = '' THEN '' ELSE chr(10) || abstract END ELSE nullif(abstract, '') END AS full_text FROM p WHERE id % 13 <> 0)"""


@query(f"{_DECISIONS} SELECT source_id, title, abstract, subject, decision_date, case_numbers, law_domain, law_subfield, source_url, court_identifier, court, level, doc_type, doc_language, full_text FROM r")
def decision_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every decision's record with its court and its one document."""
    doc = F.col("documents")[0]
    return _decisions(spark, sf_dir).select(
        "source_id", "title", "abstract", "subject", F.col("decision_date").cast("string").alias("decision_date"), F.array_join("case_numbers", "|").alias("case_numbers"), "law_domain", "law_subfield", "source_url",
        "court_identifier", "court.name", "court.level", doc["doc_type"].alias("doc_type"), doc["language"].alias("doc_language"), doc["full_text"].alias("full_text"),
    ).withColumnRenamed("name", "court")


@query(f"""{_DECISIONS} SELECT source_id, 0 AS position, 'ECLI:NL:C1:2001:' || id % 50 AS target, 'ecli' AS scheme, 'cites' AS type FROM r
UNION ALL SELECT source_id, 1, 'BWBR' || id % 9, 'bwb', 'related' FROM r""")
def decision_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.children(_decisions(spark, sf_dir), "citations").select("source_id", "position", "target", "scheme", "type")


@query(f"{_DECISIONS} SELECT source_id, 'Hoger beroep' AS procedure, '2024-01-02T10:00:00' AS issued, 2::BIGINT AS n_numbers FROM r")
def decision_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the schema has no column for, as it is kept."""
    kept = lambda path: F.get_json_object("source_metadata", path)
    return _decisions(spark, sf_dir).select("source_id", kept("$.procedure[0]").alias("procedure"), kept("$.issued[0]").alias("issued"), F.size(F.from_json(kept("$.zaaknummer"), "array<string>")).cast("long").alias("n_numbers"))


_DIGEST = " || ".join(f"coalesce({p}, chr(0)) || chr(31)" for p in (
    "'NL'", "source_id", "'portal'", "title", "abstract", "subject", "decision_date", "NULL", "'2024-01-02'", "case_numbers", "'nl'", "law_domain", "law_subfield", "'Hoger beroep'", "NULL", "source_url", "court_identifier",
    "doc_type", "doc_language", "'xml'", "full_text", "'ECLI:NL:C1:2001:' || id % 50", "'cites'", "'BWBR' || id % 9", "'related'",
))


@query(f"{_DECISIONS} SELECT source_id, sha256({_DIGEST}) AS fingerprint FROM r")
def record_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every record's scalars, documents, parties and citations."""
    return _decisions(spark, sf_dir).select("source_id", d.record_fingerprint(F.lit("portal")).alias("fingerprint"))


@query("SELECT id, id % 13 <> 0 AND length(id::VARCHAR) <= 30 AS requestable FROM cases")
def fetch_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an identifier may be sent to the source."""
    n = F.col("id")
    made = F.when(n % 26 == 0, F.concat(F.lit("ECLI:NL:C1:2001:"), n, F.lit("/../x"))).when(n % 13 == 0, F.concat(F.lit("ecli:NL:C1:2001:"), n)).otherwise(F.concat(F.lit("ECLI:NL:C1:2001:"), n))
    return t.cases(spark, sf_dir).select("id", d.requestable(made).alias("requestable"))


def _notices(spark: SparkSession, sf_dir: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """A notice's payload for every order, with an embedded neighbour whose values are none of its own. Each is read once, and with
    ``names`` for the elements of these names alone."""
    n = "o_orderkey"
    payload = f"""concat('<!DOCTYPE NOTICE><NOTICE><WORK><URI><VALUE>http://c/', {n}, '</VALUE></URI><ECLI><VALUE>ECLI:EU:C:2001:', {n}, '</VALUE></ECLI><WORK_DATE_DOCUMENT><VALUE>', cast(o_orderdate AS date), '</VALUE></WORK_DATE_DOCUMENT>',
      '<WORK_HAS_RESOURCE-TYPE><URI><IDENTIFIER>', CASE {n} % 3 WHEN 0 THEN 'JUDG' WHEN 1 THEN 'OPIN_AG' ELSE 'X' END, '</IDENTIFIER></URI></WORK_HAS_RESOURCE-TYPE>',
      '<EXPRESSION_TITLE><VALUE>Judgment#A', {n}, ' v B', {n} % 5, '.#x</VALUE></EXPRESSION_TITLE><IS_ABOUT><PREFLABEL>topic ', {n} % 6, '</PREFLABEL><SUB><PREFLABEL>deep</PREFLABEL></SUB></IS_ABOUT><IS_ABOUT><PREFLABEL>deep</PREFLABEL></IS_ABOUT>',
      '<PART_OF><SAMEAS><URI><IDENTIFIER>T-', {n}, '/13, T-', {n} % 9, '/13</IDENTIFIER><TYPE>case</TYPE></URI><URI><IDENTIFIER>no</IDENTIFIER><TYPE>other</TYPE></URI></SAMEAS></PART_OF>',
      '<WORK_CITES_WORK><SAMEAS><URI><TYPE>ecli</TYPE><IDENTIFIER>E', {n} % 11, '</IDENTIFIER></URI><URI><TYPE>celex</TYPE><IDENTIFIER>6', {n} % 7, '</IDENTIFIER></URI></SAMEAS></WORK_CITES_WORK>',
      '<WORK_CITES_WORK><SAMEAS><URI><TYPE>celex</TYPE><IDENTIFIER>6', {n} % 7, '</IDENTIFIER></URI></SAMEAS></WORK_CITES_WORK>',
      '<CASE-LAW_APPLIES_RESOURCE_LEGAL><SAMEAS><URI><TYPE>ecli</TYPE><IDENTIFIER>E', {n} % 11, '</IDENTIFIER></URI></SAMEAS></CASE-LAW_APPLIES_RESOURCE_LEGAL>',
      '<WORK_HAS_EXPRESSION><SAMEAS><URI><IDENTIFIER>6X.FRA</IDENTIFIER></URI></SAMEAS></WORK_HAS_EXPRESSION>', CASE WHEN {n} % 2 = 0 THEN '<WORK_HAS_EXPRESSION><SAMEAS><URI><IDENTIFIER>6X.eng</IDENTIFIER></URI></SAMEAS></WORK_HAS_EXPRESSION>' ELSE '' END,
      '<WORK_HAS_EXPRESSION><SAMEAS><URI><IDENTIFIER>6X.DEU</IDENTIFIER></URI><URI><IDENTIFIER>none</IDENTIFIER></URI></SAMEAS></WORK_HAS_EXPRESSION><CASE-LAW_USES_PROCEDURE_LANGUAGE><URI><IDENTIFIER>', CASE WHEN {n} % 4 = 1 THEN 'FRA' ELSE 'ENG' END, '</IDENTIFIER></URI></CASE-LAW_USES_PROCEDURE_LANGUAGE>',
      '<WORK_CREATED_BY_AGENT><URI><TYPE>corporate-body</TYPE><IDENTIFIER>CJ</IDENTIFIER></URI><PREFLABEL>Court of Justice</PREFLABEL></WORK_CREATED_BY_AGENT></WORK>',
      '<WORK><IS_ABOUT><PREFLABEL>a neighbour</PREFLABEL></IS_ABOUT><WORK_CITES_WORK><SAMEAS><URI><TYPE>celex</TYPE><IDENTIFIER>wrong</IDENTIFIER></URI></SAMEAS></WORK_CITES_WORK></WORK></NOTICE>')"""
    # a small file is one split, and reading a payload takes far longer than reading its order
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").repartition(spark.sparkContext.defaultParallelism)
    return d.notice_facts(orders.selectExpr(f"cast({n} AS string) AS source_id", "cast(null AS string) AS title", f"{payload} AS payload"), names).drop("payload")


@query("""SELECT o_orderkey::VARCHAR AS source_id, 'Judgment A' || o_orderkey || ' v B' || o_orderkey % 5 || '. x' AS title, 'topic ' || o_orderkey % 6 || '; deep' AS subject, strftime(o_orderdate, '%Y-%m-%d') AS decision_date,
  CASE WHEN o_orderkey = o_orderkey % 9 THEN 'T-' || o_orderkey || '/13' ELSE 'T-' || o_orderkey || '/13|T-' || o_orderkey % 9 || '/13' END AS case_numbers,
  CASE WHEN o_orderkey % 10 = 0 THEN 'fr' WHEN o_orderkey % 4 = 1 THEN 'fr' ELSE 'en' END AS language, 'corporate-body/CJ' AS court_identifier, 'A' || o_orderkey || ' / B' || o_orderkey % 5 AS parties,
  CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END::BIGINT AS n_documents, 'ECLI:EU:C:2001:' || o_orderkey AS ecli FROM orders""")
def notice_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every notice's record; every tenth order has a fetched text."""
    texts = t.table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").cast("string").alias("source_id"), F.lit("FRA").alias("language"), F.lit("<p>Le texte<script>x</script></p>").alias("payload"))
    rows = d.notices(_notices(spark, sf_dir), texts)
    return rows.select(
        "source_id", "title", "subject", F.col("decision_date").cast("string").alias("decision_date"), F.array_join("case_numbers", "|").alias("case_numbers"), "language", "court_identifier",
        F.array_join(F.transform("parties", lambda p: p["name"]), " / ").alias("parties"), F.size("documents").cast("long").alias("n_documents"), F.get_json_object("source_metadata", "$.ecli").alias("ecli"),
    )


@query("""SELECT o_orderkey::VARCHAR AS source_id, '6' || o_orderkey % 7 AS target, 'celex' AS scheme, 'cites' AS citation_type FROM orders
UNION ALL SELECT o_orderkey::VARCHAR, 'E' || o_orderkey % 11, 'ecli', 'applies' FROM orders""")
def notice_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.notice_citations(_notices(spark, sf_dir, tuple(markup.RELATIONS))).select("source_id", "target", "scheme", "citation_type")


@query("""SELECT event_id, strftime(date_trunc('second', ts) - CASE WHEN event_id % 4 = 1 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M:%S') AS instant FROM events WHERE event_id % 5 <> 4
UNION ALL SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') || ' 00:00:00' END FROM events WHERE event_id % 5 = 4""")
def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as sources write them, as instants of UTC: with an offset, with none, days, and what is no time."""
    n, stamp = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when((n % 5 == 4) & (n % 2 == 0), F.date_format("ts", "yyyy-MM-dd")).when(n % 5 == 4, "soon").when(n % 4 == 0, F.concat(stamp, F.lit("Z"))).when(n % 4 == 1, F.concat(stamp, F.lit("+02:00"))).when(n % 4 == 2, stamp).otherwise(F.concat(stamp, F.lit(".000")))
    return t.table(spark, sf_dir, "events").select("event_id", F.date_format(markup.instant(text), "yyyy-MM-dd HH:mm:ss").alias("instant"))


@query("""SELECT o_orderkey::VARCHAR AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN 'DEU,ENG,FRA' ELSE 'DEU,FRA' END AS available, CASE WHEN o_orderkey % 2 = 0 THEN 'ENG' ELSE '' END AS preferred,
CASE WHEN o_orderkey % 4 = 1 THEN 'FRA procedural,DEU only_available' ELSE 'DEU only_available' END AS fallbacks FROM orders""")
def language_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which versions of a work are fetched, and what is tried if none of them comes."""
    f = F.col("f")
    rows = _notices(spark, sf_dir, d.LANGUAGE_NAMES).select("source_id", d.languages(f).alias("have"), d.procedure_language(f).alias("own")).select("source_id", "have", d.language_plan(F.col("have"), F.col("own")).alias("p"))
    return rows.select("source_id", F.array_join("have", ",").alias("available"), F.array_join("p.preferred", ",").alias("preferred"), F.array_join(F.transform("p.fallbacks", lambda x: F.concat_ws(" ", x["language"], x["reason"])), ",").alias("fallbacks"))


# ---- stored tables --------------------------------------------------------------------------------------------------


@query("""SELECT 'J' || s_nationkey % 3 AS jurisdiction_code, 'court/' || s_suppkey AS source_identifier, CASE WHEN s_suppkey % 4 = 0 THEN 'renamed ' || s_suppkey ELSE s_name END AS name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'appeal' END AS level FROM supplier
UNION ALL SELECT 'J9', 'court/new', 'new', 'supreme'""")
def court_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored courts after a vocabulary was seeded twice: some renamed, one new."""
    stored = t.table(spark, sf_dir, "supplier").selectExpr("concat('J', s_nationkey % 3) AS jurisdiction_code", "concat('court/', s_suppkey) AS source_identifier", "s_name AS name", "'appeal' AS level")
    renamed = stored.where("cast(substring(source_identifier, 7) AS int) % 4 = 0").selectExpr("jurisdiction_code", "source_identifier", "concat('renamed ', substring(source_identifier, 7)) AS name", "cast(null AS string) AS level")
    named = renamed.unionByName(spark.createDataFrame([("J9", "court/new", "new", "supreme")], stored.schema))
    return merge.upsert_courts(merge.upsert_courts(stored, named), named)


@query("""SELECT l_orderkey AS case_id, l_linenumber AS position, 'DOC:' || l_partkey AS target, c.id AS target_case_id FROM lineitem LEFT JOIN cases c ON c.source_id = 'DOC:' || l_partkey""")
def citation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case that each citation names, where it is held."""
    edges = t.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS case_id", "l_linenumber AS position", "concat('DOC:', l_partkey) AS target")
    return merge.resolve_citations(edges, t.cases(spark, sf_dir)).select("case_id", "position", "target", "target_case_id")


@query("""SELECT conv_id AS case_id, turn AS position, role AS name FROM conversations WHERE conv_id % 3 <> 0 UNION ALL SELECT DISTINCT conv_id, 0, 'new' FROM conversations WHERE conv_id % 3 = 0""")
def child_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child rows after some parents changed."""
    old = t.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("position"), F.col("role").alias("name"))
    changed = old.where("case_id % 3 = 0").select("case_id")
    new = old.select("case_id").distinct().select("case_id", F.lit(0).cast("long").alias("position"), F.lit("new").alias("name"))
    return merge.replace_children(old, new, changed)


@query(""", o AS (SELECT jurisdiction_code, max(modified_at) AS t, arg_max(source_id, pos) AS s FROM candidates WHERE pos % 2 = 0 GROUP BY 1), n AS (SELECT jurisdiction_code, min(modified_at) AS t, arg_max(source_id, pos) AS s FROM candidates WHERE pos % 3 = 0 GROUP BY 1)
SELECT coalesce(o.jurisdiction_code, n.jurisdiction_code) AS jurisdiction_code, greatest(o.t, n.t)::VARCHAR AS last_modified_seen, coalesce(n.s, o.s) AS last_source_id FROM o FULL JOIN n ON o.jurisdiction_code = n.jurisdiction_code""")
def checkpoint_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints after a run: the time never goes back."""
    rows = t.candidates(spark, sf_dir)
    of = lambda m, f: rows.where(f"pos % {m} = 0").groupBy("jurisdiction_code").agg(f("modified_at").alias("last_modified_seen"), F.max_by("source_id", "pos").alias("last_source_id"))
    return runs.advance(of(2, F.max), of(3, F.min), "jurisdiction_code").withColumn("last_modified_seen", F.col("last_modified_seen").cast("string"))


@query("SELECT pos, CASE WHEN pos % 4 = 0 THEN 'own' WHEN content_hash <> '' THEN content_hash ELSE 'computed' END AS hash FROM candidates")
def resolved_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("pos") % 4 == 0, "own").when(F.col("pos") % 4 == 1, "")
    return t.candidates(spark, sf_dir).select("pos", merge.resolved_hash(own, F.col("content_hash"), F.lit("computed")).alias("hash"))


@query("SELECT id, title FROM cases WHERE jurisdiction_code = 'EN' AND source_id = 'DOC:' || (SELECT min(id) FROM cases WHERE jurisdiction_code = 'EN')")
def case_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = t.cases(spark, sf_dir)
    first = cases.where("jurisdiction_code = 'EN'").agg(F.concat(F.lit("DOC:"), F.min("id")).alias("s"))
    return search.by_key(cases, jurisdiction_code="EN").where(F.col("source_id") == first.scalar()).select("id", "title")


@query("SELECT count(*) AS n FROM reviews r WHERE status = 'decided' AND decided_by = 'editor-1' AND EXISTS (SELECT 1 FROM cases c WHERE c.id = r.case_id AND jurisdiction_code = 'DE')".replace("decided_by = 'editor-1'", "id % 2 = 1"))
def review_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that one editor decided on in one jurisdiction."""
    rows = t.reviews(spark, sf_dir).withColumn("decided_by", F.when(F.col("status") == "decided", F.concat(F.lit("editor-"), F.col("id") % 2)))
    return reviews.count(rows, t.cases(spark, sf_dir), ("decided",), ("DE",), decided_by="editor-1")


_RANKED = {"flagged_desc": "flagged_on DESC, id DESC", "flagged_asc": "flagged_on ASC, id ASC", "score_asc": "score ASC NULLS FIRST, id ASC", "score_desc": "score DESC NULLS LAST, id DESC"}


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{sort}' AS sort, id, row_number() OVER (ORDER BY {by}) AS place FROM reviews" for sort, by in _RANKED.items()) + ") WHERE place <= 25")
def review_queue_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 reviews of each order with their places: what the queue shows is in order."""
    out = None
    for sort in _RANKED:
        top = reviews.queue(t.reviews(spark, sf_dir), t.cases(spark, sf_dir), sort, statuses=()).limit(25).select("id")
        listed = top.agg(F.collect_list("id").alias("ids")).select(F.lit(sort).alias("sort"), F.posexplode("ids").alias("p", "id")).select("sort", "id", (F.col("p") + 1).cast("long").alias("place"))
        out = listed if out is None else out.unionByName(listed)
    return out


_TOPICS = """, topic AS (SELECT i AS id, 'topic-' || i AS slug FROM range(7) r(i)), case_topic AS (SELECT id AS case_id, id % 5 AS topic_id FROM cases UNION SELECT id, (id + 1) % 3 FROM cases WHERE id % 2 = 0)"""


def _topics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cases = t.cases(spark, sf_dir).select("id")
    links = cases.selectExpr("id AS case_id", "id % 5 AS topic_id").union(cases.where("id % 2 = 0").selectExpr("id", "(id + 1) % 3")).distinct()
    return spark.range(7).select("id", F.concat(F.lit("topic-"), "id").alias("slug")), links


@query(f"{_TOPICS} SELECT id, jurisdiction_code FROM cases c WHERE is_published AND law_domain = 'private' AND EXISTS (SELECT 1 FROM case_topic x JOIN topic t ON t.id = x.topic_id WHERE x.case_id = c.id AND t.slug = 'topic-1')")
def case_search_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of a topic by the link table."""
    topics, links = _topics(spark, sf_dir)
    return search.matching(t.cases(spark, sf_dir), search.Criteria(topic="topic-1", law_domain="private"), topics=(topics, links)).select("id", "jurisdiction_code")


@query(f"{_TOPICS} SELECT slug FROM topic t WHERE EXISTS (SELECT 1 FROM case_topic x JOIN cases c ON c.id = x.case_id WHERE x.topic_id = t.id AND c.is_published)")
def facet_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics, links = _topics(spark, sf_dir)
    published = links.join(t.cases(spark, sf_dir).where("is_published").select(F.col("id").alias("case_id")), "case_id", "left_semi").withColumn("is_published", F.lit(True))
    return stats.with_published(topics, published, "id", "topic_id").select("slug")


@query("""SELECT id, source_id, jurisdiction_code FROM cases WHERE is_published AND jurisdiction_code IN ('EN', 'FR', 'DE') AND law_domain = 'private' AND law_subfield = 'branch-1' AND decision_date BETWEEN date '2015-06-01' AND date '2024-12-31' AND language = 'en'""".replace("law_subfield = 'branch-1'", "id % 3 = 1"))
def case_search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All filters of a search together, the subfield among them."""
    import datetime as dt

    cases = t.cases(spark, sf_dir).withColumn("law_subfield", F.concat(F.lit("branch-"), F.col("id") % 3))
    c = search.Criteria(jurisdictions=("EN", "FR", "DE"), law_domain="private", law_subfield="branch-1", language="en", decided_from=dt.date(2015, 6, 1), decided_until=dt.date(2024, 12, 31))
    return search.matching(cases, c).select("id", "source_id", "jurisdiction_code")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'T' || doc_id END AS title, NULL::VARCHAR AS court_name FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0""")
def coerced_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries out of loose JSON: rows without code or id go, values of another type are null."""
    n = "doc_id"
    loose = t.table(spark, sf_dir, "documents").selectExpr(n, f"""concat('{{"jurisdiction_code": ', CASE WHEN {n} % 3 = 0 THEN '""' ELSE '"EN"' END, ', "source_id": ', CASE WHEN {n} % 7 = 0 THEN cast({n} AS string) ELSE concat('"S', {n}, '"') END,
      ', "title": ', CASE WHEN {n} % 5 = 0 THEN '[1]' ELSE concat('"T', {n}, '"') END, ', "court_name": 7}}') AS payload""")
    return display.summaries(loose, "payload").select(F.col("doc_id").alias("id"), "title", "court_name")


@query("""SELECT doc_id AS identifier, CASE WHEN doc_id % 2 = 0 THEN 'skipped' WHEN doc_id % 101 = 51 THEN 'failed' ELSE 'written' END AS outcome FROM documents""")
def mirror_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of the mirror: what it holds is skipped, what fails is told, the rest is written."""
    rows = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("identifier"), F.col("doc_id").alias("pos"), (F.col("doc_id") % 101 == 51).alias("failed"))
    held = rows.where("identifier % 2 = 0").select("identifier", F.col("identifier").alias("metadata_identifier"))
    return mirror.outcomes(rows, held).select("identifier", "outcome")


@query("""SELECT name FROM (SELECT 'run' || n_regionkey || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS name FROM (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation))""")
def run_log_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of run logs; one that is taken gets the next number."""
    return export.free_names(t.table(spark, sf_dir, "nation").select(F.concat(F.lit("run"), "n_regionkey").alias("stem"), F.col("n_nationkey").alias("pos"))).select("name")
