import datetime as dt
import http.server
import random
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from lexmill.plans import sources
from lexmill.session import scratch_path
from lexmill.sources import fetch, walk
from lexmill.sources.discovery import SECOND, Pace, Planner, Retries

START = dt.datetime(2026, 1, 1)


def fast(transport, tries=3, **options):
    slept = []
    client = fetch.Client(transport, Pace(1e9, sleep=lambda _: None), Retries(tries), sleep=slept.append, **options)
    return client, slept


@pytest.mark.parametrize("closed", [True, False])
def test_walk_is_the_planner_over_each_stretch(spark, closed):
    rng = random.Random(closed)
    items = [START + dt.timedelta(seconds=rng.choice([rng.randint(0, 86_399), 40_000, rng.randint(30_000, 31_000)]), microseconds=rng.randint(0, 999_999)) for _ in range(600)]
    listed = spark.createDataFrame([(x,) for x in items] + [(None,), (START - SECOND,), (START + dt.timedelta(days=2),)], "modified_at timestamp_ntz")
    planner = Planner(20, dt.timedelta(hours=1), SECOND, dt.timedelta(hours=6)) if closed else Planner(20, dt.timedelta(hours=1), dt.timedelta(seconds=60), closed=False)
    until = START + dt.timedelta(days=1) - (SECOND if closed else dt.timedelta())
    stretch = dt.timedelta(hours=7)
    got = walk.walk(listed, planner, START, until, stretch=stretch)
    floor = [x.replace(microsecond=0) for x in items]
    count = lambda a, b: sum(a <= x <= b if closed else a <= x < b for x in floor)
    cut = lambda x: x.replace(microsecond=0)
    expected = []
    for k in range(4):
        a = START + k * stretch
        b = min(a + stretch - (SECOND if closed else dt.timedelta()), until)
        expected += [(k, i, s.first, s.last, s.found) for i, s in enumerate(planner.spans(lambda x, y: count(cut(x), cut(y)), a, b))]
    assert sorted(map(tuple, got.collect())) == expected and sum(x[4] for x in expected) == 600
    held = walk.in_spans(listed, got, planner, START, stretch)
    counts = {(r["stretch"], r["place"]): r["count"] for r in held.groupBy("stretch", "place").count().collect()}
    assert counts == {x[:2]: x[4] for x in expected if x[4]}


def test_walk_of_nothing(spark):
    none = spark.createDataFrame([], "modified_at timestamp_ntz")
    got = walk.walk(none, Planner(5, dt.timedelta(days=1), SECOND, dt.timedelta(days=4)), START, START + dt.timedelta(days=9)).collect()
    assert got and not any(r["found"] for r in got) and got[-1]["last"] == START + dt.timedelta(days=9)
    assert walk.walk(none, Planner(5, dt.timedelta(days=1), SECOND), START, START - dt.timedelta(days=1)).collect() == []


def test_client():
    a = fetch.Answer
    client, slept = fast(fetch.Replayed([("x", None, a(503, retry_after=7.0)), ("x", None, a(429)), ("x", None, a(200, "ok"))]))
    got = client.get("x")
    assert got.kind == "fetched" and got.requests == 3 and slept[0] == 7.0 and 0 < slept[1] <= 60 and got.waited == sum(slept)
    assert fast(fetch.Replayed([("x", None, a(500))]))[0].get("x")[0::2] == ("broken", 4)
    assert fast(fetch.Replayed([]))[0].get("y")[0::2] == ("missing", 1)
    client, slept = fast(fetch.Replayed([("x", None, a(503, retry_after=901.0))]))
    assert client.get("x").kind == "broken" and slept == []


class Feed(http.server.BaseHTTPRequestHandler):
    """A source over the network: 50 entries, one a minute; every third request is refused at first."""

    seen = 0

    def do_GET(self):  # noqa: N802
        Feed.seen += 1
        if Feed.seen % 3 == 1:
            self.send_response(503)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        asked = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
        first, last = (dt.datetime.strptime(x, fetch.STAMP) for x in asked["modified"])
        found = [i for i in range(50) if first <= START + i * dt.timedelta(minutes=1) <= last]
        page = found[int(asked["from"][0]) :][: int(asked["max"][0])]
        entries = "".join(f"<entry><id>e{i}</id><title>é</title><updated>x</updated></entry>" for i in page)
        self.send_response(200)
        self.send_header("Content-Type", "application/atom+xml; charset=utf-8")
        self.end_headers()
        self.wfile.write(f"<feed><subtitle>{len(found)}</subtitle>{entries}</feed>".encode())

    def log_message(self, *args):
        pass


def test_over_the_network(spark):
    listed = spark.createDataFrame([(START + i * dt.timedelta(minutes=1),) for i in range(50)], "modified_at timestamp_ntz")
    where = scratch_path(spark, "spans")
    planner = Planner(9, dt.timedelta(minutes=30), SECOND, dt.timedelta(hours=1))
    walk.walk(listed, planner, START, START + dt.timedelta(hours=1), stretch=dt.timedelta(minutes=20)).write.partitionBy("stretch").parquet(where)
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Feed)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        fetch.register(spark)
        base = f"http://127.0.0.1:{server.server_port}"
        rows = spark.read.format("walk_source").options(spans=where, base=base, stretches="4", lanes="2", per_second="10000", page_size="4").load()
        assert rows.rdd.getNumPartitions() == 2
        got = rows.collect()
        assert sorted(r["source_id"] for r in got) == sorted(f"e{i}" for i in range(50)) and {r["title"] for r in got} == {"é"}
        assert {r["error"] for r in got} == {None} and {r["requests"] for r in got} == {1, 2}
        plan = spark.createDataFrame([("d", "gone", (["ENG"], []))], "source_id string, address string, plan struct<preferred: array<string>, fallbacks: array<struct<language: string, reason: string>>>")
    finally:
        server.shutdown()
        server.server_close()
    closed = fetch.versions(plan, fetch.Http(base, timeout=2), retries=Retries(1), sleep=lambda _: None).first()
    assert closed["error"] == "every language version failed: ENG" and closed["requests"] == 2 and closed["language"] is None


def test_versions_of_odd_plans(spark):
    kind = f"source_id string, address string, plan struct<preferred: array<string>, fallbacks: array<struct<language: string, reason: string>>>, recorded {fetch.RECORDED}, format int"
    ok = lambda x: ("a", x, 200, None, "text/xml", x)
    rows = [
        ("both", "a", (["ENG", "FRA"], [("DEU", "only_available")]), [ok("ENG"), ok("FRA"), ok("DEU")], 1), ("none", "a", ([], []), [], 1), ("null", None, None, None, 1), (None, "a", (["ENG"], None), [ok("ENG")], 1),
        ("missing", "a", (["ENG"], [("FRA", "procedural")]), [], 1), ("both", "a", (["ENG", "FRA"], [("DEU", "only_available")]), [ok("FRA")], 1),
    ]
    got = fetch.versions(spark.createDataFrame(rows, kind)).select("source_id", "language", "selected_as", "format", "error").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([
        ("both", "ENG", "preferred", "xml", None), ("both", "FRA", "preferred", "xml", None), ("none", None, None, None, None), ("null", None, None, None, None), (None, "ENG", "preferred", "xml", None),
        ("missing", None, None, None, None), ("both", "FRA", "preferred", "xml", None),
    ], key=repr)
    assert fetch.versions(spark.createDataFrame([], kind)).collect() == []


def test_retry_after_as_a_date():
    assert fetch._wish("12") == 12 and fetch._wish(None) is None and fetch._wish("soon") is None
    assert fetch._wish("Thu, 01 Jan 1970 00:01:00 GMT", now=lambda: 20.0) == 40.0


def test_lanes_share_the_pages(spark, sf):
    rows = sources._pages(spark, sf)
    assert rows.rdd.getNumPartitions() == sources.LANES
    assert rows.where(F.col("error").isNull()).groupBy("source_id").count().where("count > 1").count() == 0
