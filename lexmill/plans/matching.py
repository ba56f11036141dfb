"""Queries of folding, keyword matching and markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import compose, fold, fold_table, word_count
from lexmill.operators import chain, export, keywords, phrases
from lexmill.plans.search import query
from lexmill.sources import markup
from lexmill.sources import tables as t

#: The test tables' letters with marks, for an oracle that strips accents.
_FOLDED = "lower(strip_accents({}))"


def _fold_sql(column: str) -> str:
    """Composing and folding in DuckDB's terms: its own NFC, then the table that the rule of ``fold_table`` gives."""
    source, target = (x.replace("'", "''") for x in fold_table(True))
    return f"translate(nfc_normalize({column}), '{source}', '{target}')"


_FOLDED_SQL = f"SELECT doc_id AS id, md5({_fold_sql("coalesce(text, '')")}) AS folded_md5 FROM documents"


@query(_FOLDED_SQL)
def keyword_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded texts of all documents."""
    return t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(fold(compose(F.coalesce("text", F.lit(""))))).alias("folded_md5"))


@query(_FOLDED_SQL)
def keyword_fold_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same; it had no SQL once and is held against brute force in tests, too."""
    return keyword_fold(spark, sf_dir)


@query(f"SELECT doc_id AS id, (length(f) - length(replace(f, 'ingthe', ''))) // 6 AS n FROM (SELECT doc_id, {_FOLDED.format('text')} AS f FROM documents WHERE text IS NOT NULL)")
def keyword_hits_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a literal stands in each text, inside words or not."""
    return _occurrences(spark, sf_dir, {"term": "ingthe", "match": "substring"})


@query(f"SELECT doc_id AS id, len(list_filter(regexp_split_to_array({_FOLDED.format('text')}, '[^a-z0-9_à-ɏ]+'), lambda w: w IN ('stupid', 'worthless'))) AS n FROM documents WHERE text IS NOT NULL")
def keyword_hits_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often some words stand in each text."""
    return _occurrences(spark, sf_dir, {"term": "stupid", "aliases": ["worthless"]})


def _occurrences(spark: SparkSession, sf_dir: str, term: dict) -> DataFrame:
    listed = keywords.parse(keywords.example() | {"terms": [{"id": "en-one", "lang": "en", "category": "general", "weight": 1, **term}], "exclusions": []})
    docs = t.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    hits = keywords.find(listed, False, full_text=F.col("text"))["hits"]
    return docs.select(F.col("doc_id").alias("id"), F.aggregate(hits, F.lit(0).cast("long"), lambda a, h: a + h["n"]).alias("n"))


def _list() -> keywords.KeywordList:
    return keywords.parse(keywords.example())


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents")
    verdict = keywords.score(_list(), title=F.substring("text", 1, 80), full_text=F.col("text"))
    return docs.select(F.col("doc_id").alias("id"), verdict.alias("v"))


_W = r"'(^|[^a-z0-9_à-ɏ]){}($|[^a-z0-9_à-ɏ])'"


def _has(word: str, column: str) -> str:
    return f"regexp_matches({column}, {_W.format(word)})"


_VERDICTS = f""", f AS (SELECT doc_id, {_FOLDED.format("coalesce(text, '')")} AS b, {_FOLDED.format("substring(coalesce(text, ''), 1, 80)")} AS a, coalesce(text, '') AS raw, substring(coalesce(text, ''), 1, 80) AS rawa FROM documents),
w AS (SELECT doc_id, {_has('idiot', 'a')} OR {_has('idiot', 'b')} AS vetoed,
  CASE WHEN {_has(r'(licensed|released\s+under)', 'a')} THEN 6.0 WHEN {_has(r'(licensed|released\s+under)', 'b')} THEN 3.0 ELSE 0.0 END AS w1,
  CASE WHEN {_has('stupid', 'a')} THEN 4.0 WHEN {_has('stupid', 'b')} THEN 2.0 ELSE 0.0 END AS w2, CASE WHEN {_has('worthless', 'a')} THEN 2.0 WHEN {_has('worthless', 'b')} THEN 1.0 ELSE 0.0 END AS w3,
  CASE WHEN regexp_matches(a, 'ingthe|onthely') THEN 2.0 WHEN regexp_matches(b, 'ingthe|onthely') THEN 1.0 ELSE 0.0 END AS w4,
  CASE WHEN {_has(r'that\s+the', 'a')} THEN 2.0 WHEN {_has(r'that\s+the', 'b')} THEN 1.0 ELSE 0.0 END AS w5,
  CASE WHEN regexp_matches(rawa, '(^|[^A-Za-z0-9_À-ɏ])MIT($|[^A-Za-z0-9_À-ɏ])') THEN 4.0 WHEN regexp_matches(raw, '(^|[^A-Za-z0-9_À-ɏ])MIT($|[^A-Za-z0-9_À-ɏ])') THEN 2.0 ELSE 0.0 END AS w6,
  CASE WHEN regexp_matches(rawa, '(?i)[0-9a-f]{{32,}}') THEN 2.0 WHEN regexp_matches(raw, '(?i)[0-9a-f]{{32,}}') THEN 1.0 ELSE 0.0 END AS w7,
  CASE WHEN {_has('(eleve|etait)', 'a')} THEN 2.0 WHEN {_has('(eleve|etait)', 'b')} THEN 1.0 ELSE 0.0 END AS w8 FROM f),
s AS (SELECT *, CASE WHEN vetoed THEN 0.0 ELSE w1 + w2 + CASE WHEN w2 > 0 THEN w3 ELSE 0.0 END + w4 + w5 + w6 + w7 + w8 END AS score FROM w)"""


_VERDICT_SQL = f"""{_VERDICTS} SELECT doc_id AS id, score::DOUBLE AS score, vetoed, score >= 3 AS passed, score >= 3 AND score < 6 AS needs_review,
  CASE WHEN vetoed THEN 0 ELSE (w1 > 0)::INT + (w2 > 0)::INT + (w3 > 0)::INT + (w4 > 0)::INT + (w5 > 0)::INT + (w6 > 0)::INT + (w7 > 0)::INT + (w8 > 0)::INT END AS n_terms FROM s"""


@query(_VERDICT_SQL)
def keyword_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's verdict."""
    return _scored(spark, sf_dir).select("id", "v.score", "v.vetoed", "v.passed", "v.needs_review", F.size("v.terms").alias("n_terms"))


@query(_VERDICT_SQL)
def keyword_verdict_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same verdicts by a list of over 500 terms, most of which no document has."""
    more = [{"id": f"en-more{i}", "term": f"zq{i} unheard{i % 50}", "lang": "en", "category": "general", "weight": 1, "aliases": [f"qz{i}x"]} for i in range(500)]
    whole = keywords.example()
    listed = keywords.parse(whole | {"terms": whole["terms"] + more})
    docs = t.table(spark, sf_dir, "documents")
    found = docs.select(F.col("doc_id").alias("id"), keywords.score(listed, title=F.substring("text", 1, 80), full_text=F.col("text")).alias("v"))
    return found.select("id", "v.score", "v.vetoed", "v.passed", "v.needs_review", F.size("v.terms").alias("n_terms"))


_EVIDENCE_TERMS = {"en-a": "ererer", "en-b": "erererer", "en-c": "ingthe", "en-d": "ingthe", "en-e": "thonon"}
_SPACE = r"[\t-\r\x{1C}- \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_PLACES = "list_filter(range(1, length(f)), lambda i: {})"
_AT = {"en-a": "substring(f, i, 6) = 'ererer' AND substring(f, i, 8) <> 'erererer'", "en-b": "substring(f, i, 8) = 'erererer'", **{k: f"substring(f, i, 6) = '{_EVIDENCE_TERMS[k]}'" for k in ("en-c", "en-d", "en-e")}}


@query(", d AS (SELECT doc_id AS id, nfc_normalize(coalesce(text, '')) AS c, " + _fold_sql("coalesce(text, '')") + " AS f FROM documents), h AS ("
  + " UNION ALL ".join(f"SELECT id, c, '{k}' AS term_id, {len(_EVIDENCE_TERMS[k])} AS size, {_PLACES.format(at)} AS places FROM d WHERE contains(f, '{_EVIDENCE_TERMS[k]}')" for k, at in _AT.items())
  + f"""), m AS (SELECT *, len(places) AS n, list_min(places) - 1 AS a, greatest(list_min(places) - 91, 0) AS low FROM h WHERE len(places) > 0)
SELECT id, term_id, n::INT AS occurrences, a::INT AS start, substring(c, (a + 1)::INT, size) AS matched_text,
  CASE WHEN a > 90 THEN '…' ELSE '' END || trim(regexp_replace(substring(c, (low + 1)::INT, (a + size + 90 - low)::INT), '{_SPACE}', ' ', 'g'), ' ') || CASE WHEN a + size + 90 < length(c) THEN '…' ELSE '' END AS snippet,
  row_number() OVER (PARTITION BY id ORDER BY a, term_id) AS place FROM m""")  # fmt: skip
def keyword_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a verdict rests on: of each term how often it stands in the text (overlapping, the longest of those that begin at one place, for
    each term that has the literal), where first, with its surroundings, and in which order the reason names it."""
    terms = [{"id": k, "term": v, "lang": "en", "category": "general", "weight": 1, "match": "substring"} for k, v in _EVIDENCE_TERMS.items()]
    whole = keywords.example()
    listed = keywords.parse(whole | {"terms": terms, "exclusions": [], "scoring": whole["scoring"] | {"min_score": 1}})
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), keywords.judge(listed, full_text=F.col("text")).alias("v"))
    said = F.split(F.regexp_extract("v.reason", "matched: (.*)$", 1), ", ")
    rows = docs.select("id", said.alias("said"), F.inline("v.matches"))
    return rows.select("id", "term_id", "occurrences", "start", "matched_text", "snippet", F.array_position("said", F.col("term_id")).alias("place"))


def _calm(text: str | None) -> dict:
    marks = (text or "").count("!")
    return {"passed": 20 * marks <= len(text or ""), "score": float(marks), "reason": f"{marks} marks"}


@query(f"""{_VERDICTS}, j AS (SELECT s.doc_id, score, score >= 3 AND score < 6 AS review, length(coalesce(text, '')) - length(replace(coalesce(text, ''), '!', '')) AS marks, length(coalesce(text, '')) AS size,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS words FROM s JOIN documents d ON d.doc_id = s.doc_id)
SELECT doc_id AS id, words >= 50 AND score >= 3 AND 20 * marks <= size AS passed, CASE WHEN words < 50 THEN 'length' WHEN score < 3 THEN 'keywords' ELSE 'calm' END AS stage,
  CASE WHEN words < 50 THEN words WHEN score < 3 THEN score ELSE marks END::DOUBLE AS score, words >= 50 AND score >= 3 AND 20 * marks <= size AND review AS needs_review FROM j""")
def filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through three stages, of which the last, in Python, sees only what the others let through."""

    def length(text):
        words = word_count(text)
        return F.struct((words >= 50).alias("passed"), words.cast("double").alias("score"))

    stages = [
        chain.Stage("length", ("text",), length), chain.Stage("keywords", ("title", "text"), lambda title, text: keywords.score(_list(), title=title, full_text=text)),
        chain.Stage("calm", ("text",), chain.lazily(_calm), knows_alive=True),
    ]
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.substring("text", 1, 80).alias("title"))
    return chain.evaluate(docs, stages).select("id", "verdict.passed", "verdict.stage", "verdict.score", "verdict.needs_review")


@query()
def keyword_full_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same verdicts with evidence. Held against hand-written cases and a naive search in tests."""
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), keywords.judge(_list(), title=F.substring("text", 1, 80), full_text=F.col("text")).alias("v"))
    return docs.select("id", F.round("v.score", 4).alias("score"), "v.passed", "v.vetoed", "v.needs_review", "v.reason", F.to_json("v.matches").alias("matches"))


@query()
def match_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("id", F.when(F.col("v.passed"), "insert").otherwise("reject").alias("action"), "v.score", F.transform("v.terms", lambda x: x["id"]).alias("terms"))
    return export.report_lines(rows)


@query("SELECT d.doc_id AS id, count(*) AS n_phrases FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text) GROUP BY 1")
def exclusion_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain listed phrases, whole and letter by letter, and how many."""
    found = phrases.containing(t.table(spark, sf_dir, "documents"), t.table(spark, sf_dir, "benchmark"))
    return found.groupBy("id").agg(F.count("*").alias("n_phrases"))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page. Held against a second parser in tests."""
    return t.table(spark, sf_dir, "pages").select("page_id", markup.html_text(F.col("html")).alias("text"))
