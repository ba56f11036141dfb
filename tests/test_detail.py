import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions.streams import joined_in_order
from lexmill.operators import detail, reviews, search
from lexmill.operators.search import Criteria

CASE = "id long, source_id string, title string, abstract string, decision_date date, is_published boolean, jurisdiction_code string"


def cases(spark, n=137):
    rng = random.Random(n)
    day = lambda: rng.choice([None, dt.date(2024, 1, rng.randint(1, 6))])
    words = [None, "the one", "other", "THE"]
    return spark.createDataFrame([(i, f"s{i}", rng.choice(words), rng.choice(words), day(), True, "DE") for i in range(n)], CASE)


@pytest.mark.parametrize("c", [Criteria(), Criteria(sort="date_asc"), Criteria(sort="relevance", term="the"), Criteria(sort="relevance")])
def test_pages_by_cursor_are_those_by_offset(spark, c):
    found = search.matching(cases(spark).repartition(3), c).persist()
    cursor, seen = None, []
    for number in range(1, 99):
        page = search.page_after(found, c, cursor, 20)
        ids = [r["id"] for r in page.collect()]
        assert ids == [r["id"] for r in search.page(found, c, number, 20).collect()]
        if not ids:
            break
        seen += ids
        cursor = search.cursor_of(page, c)
    assert len(seen) == len(set(seen)) == found.count() and search.cursor_of(found.limit(0), c) is None


def test_damaged_cursors(spark):
    found, c = cases(spark), Criteria()
    cursor = search.cursor_of(search.page_after(found, c, None, 5), c)
    for bad in ("", "x", cursor[:-3], cursor + "AAAA"):
        with pytest.raises(ValueError):
            search.page_after(found, c, bad, 5)
    with pytest.raises(ValueError):
        search.page_after(found, Criteria(sort="date_asc"), cursor, 5)  # of another search
    with pytest.raises(ValueError):
        search.page_after(found, c, cursor, 0)


@pytest.mark.parametrize("sort", reviews.SORTS)
def test_review_queue_by_its_keys(spark, sort):
    rng = random.Random(3)
    rows = [(i, i, "pending", rng.choice([None, 0.5, 1.0, 2.5]), rng.choice([None, dt.date(2024, 1, 1), dt.date(2024, 1, 2)])) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, case_id long, status string, score double, flagged_on date")
    queued = reviews.queue(df, None, sort)
    whole = [(r[reviews.SORTS[sort][0]], r["id"]) for r in queued.collect()]
    got, last = [], None
    while last is None or got[-1:] != whole[-1:]:
        page = queued.limit(7) if last is None else reviews.queue_after(queued, sort, list(last), 7)
        got += [(r[reviews.SORTS[sort][0]], r["id"]) for r in page.collect()]
        last = got[-1]
    assert got == whole


def test_detail_of_odd_tables(spark):
    fields = [f for f in (*detail.SUMMARY, *detail.HISTORY) if f not in ("jurisdiction_name", "court_name", "id", "court_id", "jurisdiction_code")]
    whole = spark.createDataFrame([(1, 5, "DE"), (2, None, None), (3, 9, "ZZ")], "id long, court_id long, jurisdiction_code string").select("*", *[F.lit(f).alias(f) for f in fields], F.lit("secret").alias("raw_payload"))
    jurisdictions = spark.createDataFrame([("DE", "Germany")], "code string, name string")
    courts = spark.createDataFrame([(5, "High Court")], "id long, name string")
    topics = spark.createDataFrame([(1, "b", "B", 0.5, "x"), (1, "a", None, None, None), (1, "a", None, None, None), (None, "c", "C", 0.1, "x"), (77, "d", "D", 0.1, "x")], "case_id long, slug string, label string, confidence double, assigned_by string")
    got = {r["id"]: r for r in detail.detail(whole, jurisdictions, courts, topics=topics).collect()}
    assert sorted(got) == [1, 2, 3] and set(got[1].asDict()) == {*detail.SUMMARY, *detail.HISTORY, *detail.CHILDREN}
    assert [x["slug"] for x in got[1]["topics"]] == ["a", "a", "b"] and got[2]["topics"] == [] and got[1]["documents"] == []
    assert got[1]["court_name"] == "High Court" and got[3]["court_name"] is None and got[3]["jurisdiction_name"] is None
    assert detail.detail(whole.limit(0), jurisdictions, courts, topics=topics).collect() == []
    with pytest.raises(ValueError):
        detail.detail(whole, jurisdictions, courts, topic=topics)
    plan = detail.detail(whole, jurisdictions, courts, topics=topics)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_joined_in_order(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.randint(0, 9), rng.choice([None, "", "x", "ä€", "y" * 50])) for _ in range(3_000)] + [("only null", 1, None)]
    df = spark.createDataFrame(rows, "key string, place int, text string").withColumn("k", F.lit(1))
    groups = {}
    for k, p, x in rows:
        if x is not None:
            groups.setdefault(k, []).append((p, x))
    expected = {k: (len(v), "\n\n".join(x for _, x in sorted(v))) for k, v in groups.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = {r["key"]: (r["n"], r["value"]) for r in joined_in_order(df, "key", [F.col("place")], F.col("text"), "\n\n").collect()}
        sums = {r["key"]: r["value"] for r in joined_in_order(df, "key", [F.col("place")], F.col("text"), "\n\n", digest=True).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == expected and sums == {k: hashlib.sha256(v.encode()).hexdigest() for k, (_, v) in expected.items()}
    assert joined_in_order(df.limit(0), "key", [F.col("place")], F.col("text"), ",").collect() == []


def test_parameters_of_lists(spark):
    assert search.latest_limit(None) == 20 and search.latest_limit(" 50 ") == 50 and search.latest_limit("") == 20
    assert reviews.parse_statuses([]) == ("pending",) and reviews.parse_statuses(["decided, pending", "DECIDED"]) == ("decided", "pending") and reviews.parse_statuses(["pending", "any"]) == ()
    for bad in ("0", "51", "x", "1.5"):
        with pytest.raises(ValueError):
            search.latest_limit(bad)
    for bad in (["gone"], ["pending,"] * 17):
        with pytest.raises(ValueError):
            reviews.parse_statuses(bad)
    rows = spark.createDataFrame([("DE", "a", True), ("DE", "b", False), ("EN", "a", True), ("DE", "c", None)], "jurisdiction_code string, source_id string, is_published boolean")
    assert [detail.published(rows, "DE", x).count() for x in "abcd"] == [1, 0, 0, 0]
