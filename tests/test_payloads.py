import datetime as dt
import html
import json
import re

import pytest
from pyspark.sql import functions as F

from lexmill.plans import records
from lexmill.sources import decisions, markup


def rows(spark, *payloads):
    return spark.createDataFrame([(p,) for p in payloads], "payload string")


def entry(name, identifier, kind="Rechtbank"):
    return f"<Instantie><Naam>{name}</Naam><Identifier>{identifier}</Identifier><Type>{kind}</Type></Instantie>"


def test_vocabularies_of_several_payloads(spark):
    first = f"<Instanties>{entry('A', 'a')}{entry('B', 'b')}</Instanties>"
    second = f"<Instanties>{entry('C', 'c', 'TypeRvS')}{entry('D', 'd')}{entry('A again', 'a')}{entry('nobody', '')}</Instanties>"
    df = spark.createDataFrame([(2, second), (1, first), (3, None), (4, "<broken")], "n int, payload string")
    got = {r["source_identifier"]: (r["name"], r["level"]) for r in decisions.court_vocabulary(df, order="n").collect()}
    assert got == {"a": ("A again", "first_instance"), "b": ("B", "first_instance"), "c": ("C", "supreme"), "d": ("D", "first_instance")}
    assert decisions.court_vocabulary(df.limit(0)).collect() == []


CITES = "<WORK_CITES_WORK><SAMEAS><URI><TYPE>celex</TYPE><IDENTIFIER>{}</IDENTIFIER></URI></SAMEAS></WORK_CITES_WORK>"
NOTICE = "<NOTICE decoding='eng'><WORK><WORK_DATE_DOCUMENT><VALUE>2020-01-02</VALUE></WORK_DATE_DOCUMENT>{}</WORK><WORK>" + CITES.format("neighbour") + "</WORK></NOTICE>"
CONCEPT = "<CASE-LAW_IS_ABOUT_CONCEPT><OP-CODE>4.11</OP-CODE><PREFLABEL>Top</PREFLABEL><BROADER><OP-CODE>4</OP-CODE><PREFLABEL>Root</PREFLABEL></BROADER></CASE-LAW_IS_ABOUT_CONCEPT>"
MATTER = "<RESOURCE_LEGAL_IS_ABOUT_SUBJECT-MATTER><PREFLABEL>Health</PREFLABEL></RESOURCE_LEGAL_IS_ABOUT_SUBJECT-MATTER>"


def test_two_notices_of_one_id(spark):
    raw = spark.createDataFrame([("n", None, NOTICE.format(CITES.format("61")), "u1"), ("n", None, NOTICE.format(CITES.format("62") + MATTER + CONCEPT), "u2"), (None, None, NOTICE.format(CITES.format("63")), None), ("bad", None, "<NOTICE>", None)], "source_id string, title string, payload string, notice_url string")
    facts = decisions.notice_facts(raw)
    assert sorted((r["source_id"] or "", r["target"]) for r in decisions.notice_citations(facts).collect()) == [("", "63"), ("n", "61"), ("n", "62")]
    texts = spark.createDataFrame([("n", "ENG", "<p>Hello <b>you</b></p>", "xhtml", "preferred", "x/n"), ("n", None, None, None, None, None)], "source_id string, language string, payload string, format string, selected_as string, source_url string")
    got = {(r["source_id"], r["citations"][0]["target"]): r for r in decisions.notices(facts, texts).collect()}
    assert set(got) == {("n", "61"), ("n", "62"), (None, "63")}
    kept = json.loads(got["n", "62"]["source_metadata"])
    assert kept["subject_matter"] == ["Health"] and kept["case_law_directory_codes"] == ["4.11", "4"] and kept["case_law_directory_labels"] == ["Top", "Root"]
    assert kept["notice_url"] == "u2" and kept["notice_decoding"] == "eng" and kept["retrieved_languages"] == [{"language": "ENG", "selected_as": "preferred", "source_url": "x/n"}]
    document = got["n", "61"]["documents"][0]
    assert (document["format"], document["full_text"], document["language"]) == ("xhtml", "Hello you", "en") and len(got[None, "63"]["documents"]) == 1
    plain = spark.createDataFrame([("n", "FRA", "<p>x")], "source_id string, language string, payload string")
    assert decisions.notices(facts, plain).count() == 3 and decisions.notices(facts.limit(0), plain).count() == 0


DEEP = "<a>" * 100_000 + "x" + "</a>" * 100_000


def test_deep_nesting_is_a_row_or_none(spark):
    described = "<open><RDF><Description><identifier>ECLI:X:1</identifier></Description></RDF>{}</open>"
    fits = described.format("<uitspraak>" + "<para>" * 200 + "x" + "</para>" * 200 + "</uitspraak>")
    df = rows(spark, DEEP, described.format(DEEP), fits, f"<NOTICE><WORK>{DEEP}</WORK></NOTICE>")
    got = df.select(markup.leaves(F.col("payload")).alias("f"), markup.xml_body_text(F.col("payload")).alias("t"), markup.properties(F.col("payload")).alias("p"), markup.reading_text(F.col("payload")).alias("r"), markup.notice(F.col("payload")).alias("n")).collect()
    assert [r["f"] is None for r in got] == [True, True, False, True] and [r["t"] for r in got] == [None, None, "x", None]
    assert [r["r"] for r in got][2] == "ECLI:X:1 x" and got[3]["n"] is None and got[0]["r"] == "x"
    raw = df.select(F.lit("s").alias("source_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("source_url"), "payload")
    none = spark.createDataFrame([], "source_identifier string, name string, level string, domain string")
    assert [r["source_id"] for r in decisions.decisions(raw, none).collect()] == ["ECLI:X:1"]


def test_a_payload_is_read_once(spark, sf):
    """One Python node, and no shuffle of records: the vocabulary is broadcast."""
    plan = records._decisions(spark, sf)._jdf.queryExecution().executedPlan().toString()
    of_records = plan.split("BroadcastQueryStage")[0].split("BroadcastExchange")[0]
    assert of_records.count("ArrowEvalPython") == 1 and "SortMergeJoin" not in plan and "Exchange" not in of_records


def other_reader(text):
    """Visible text by expressions instead of a parser."""
    text = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>", " ", text)
    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", text)
    text = re.sub(r"(?is)<(head|template|noscript)\b.*?</\1\s*>", " ", text)
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", text))).strip()


def test_html_text_against_another_reader(spark, sf):
    got = spark.read.parquet(f"{sf}/pages.parquet").where("html IS NOT NULL").select("html", markup.html_text(F.col("html")).alias("t")).collect()
    assert len(got) > 20 and all(r["t"] == other_reader(r["html"]) for r in got)


@pytest.mark.parametrize("payload,text", [
    ("<html><body><p>One</p><script>no</script> two<style>x</style><!-- c --><?pi z?> three</body></html>", "One two three"), ("<!DOCTYPE html><p>a&#228;<br/>b</p>", "aä b"), ("<p>loose <b>html", "loose html"),
    ("<!DOCTYPE a [<!ENTITY x 'boom'>]><a>&x;</a>", "]>&x;"), ("", None), ("  ", None), (None, None), ("<p></p>", None),
])
def test_xml_first_then_html(payload, text):
    got = markup.reading_string(payload)
    assert got == text or (payload and "ENTITY" in payload and "boom" not in (got or "").replace("'boom'", ""))


def test_instants(spark):
    cases = {"2024-03-01T10:00:00+02:00": dt.datetime(2024, 3, 1, 8), "2024-03-01T10:00:00": dt.datetime(2024, 3, 1, 10), " 2024-03-01T10:00:00.250Z ": dt.datetime(2024, 3, 1, 10, 0, 0, 250_000), "2024-03-01": dt.datetime(2024, 3, 1), "10:00": None, "soon": None, "2024-13-01T00:00:00Z": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # the session's zone doesn't matter
        got = df.select("t", F.unix_millis(markup.instant(F.col("t"))).alias("x")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert {r["t"]: r["x"] for r in got} == {k: None if v is None else int(v.replace(tzinfo=dt.UTC).timestamp() * 1000) for k, v in cases.items()}


def test_media_format(spark):
    df = spark.createDataFrame([("application/xhtml+xml; charset=UTF-8",), ("text/HTML",), ("application/xml",), ("text/plain",), (None,)], "t string")
    assert [r[0] for r in df.select(markup.media_format(F.col("t"))).collect()] == ["xhtml", "html", "xml", "text", "text"]


def test_notices_are_read_once_and_their_facts_not_shuffled(spark, sf):
    """Citations and case numbers come with the reading: one short row of each notice moves to tell equal ones, and no facts do."""
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    cited = plan(records.notice_citations(spark, sf))
    assert cited.count("ArrowEvalPython") == 1 and "SortAggregate" not in cited and "max(" not in cited
    assert plan(records.language_plan(spark, sf)).count("ArrowEvalPython") == 1
    raw = spark.createDataFrame([("n", None, NOTICE.format(CITES.format("61") + CITES.format("61")))] * 2 + [("m", None, NOTICE.format(""))], "source_id string, title string, payload string")
    facts = decisions.notice_facts(raw, tuple(markup.RELATIONS))
    assert [(r["source_id"], r["target"], r["position"]) for r in decisions.notice_citations(facts).collect()] == [("n", "61", 1)]
    assert {r["source_id"]: len(r["f"]) for r in facts.collect()} == {"n": 4, "m": 0}  # a notice without such elements is still one
