import datetime as dt
import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from lexmill import session
from lexmill.functions import hashing, text
from lexmill.operators import export, merge, mirror, notify, reviews, runs
from lexmill.operators.search import Criteria, bounded
from lexmill.sources import discovery, markup


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fingerprint_and_hmac(spark):
    got = one(spark, hashing.fingerprint(F.lit("NL"), F.lit("a"), F.lit(None).cast("string"), F.lit("")))
    assert got == "4890e931fcf6d19a56a7b43c435f6de16499d1a9624074776e4ca5985fff7184"
    for key in (b"pepper-secret", b"k" * 100):
        assert one(spark, hashing.hmac_sha256(key, F.lit("v1:a@b.nl"))) == hmac.new(key, b"v1:a@b.nl", hashlib.sha256).hexdigest()


def test_tokens(spark):
    made = one(spark, hashing.token(b"key", F.lit("seed"), "confirm", "v1"))
    check = lambda value, purpose: one(spark, hashing.verify_token(b"key", F.lit(value), purpose, "v1"))
    assert check(made, "confirm") == "seed" and check(made, "leave") is None and check(made + "x", "confirm") is None


def test_text(spark):
    assert one(spark, text.fold(text.compose(F.lit("ÉLÈVE Straße œuvre")))) == "eleve straße œuvre"
    assert one(spark, text.collapse(F.lit(" a \n b "))) == "a b"
    assert one(spark, text.clip(F.lit("abcdef"), 4)) == "abc…" and one(spark, text.clip(F.lit("abcd"), 4)) == "abcd"
    assert one(spark, text.csv_cell(F.lit("=1+1"))) == "'=1+1" and one(spark, text.csv_cell(F.lit(None))) == ""
    assert one(spark, text.paragraphs(F.lit("a\n\n b\nc"))) == ["a", "b\nc"]
    assert one(spark, text.clean(F.lit("a\x00‮b\tc\r\n"))) == "ab\tc\n"


def test_criteria():
    c = Criteria(term="a b", jurisdictions=("NL", "EU"), decided_from=dt.date(2020, 1, 2), sort="relevance")
    assert Criteria.from_query(c.to_query()) == c and Criteria().to_query() == "" and c.active() == 3
    for bad in ({"sort": "x"}, {"term": "x" * 201}, {"jurisdictions": ("nl",)}, {"topic": "A b"}):
        with pytest.raises(ValueError):
            Criteria(**bad)
    with pytest.raises(ValueError):
        bounded("101", 1, 100, "page")


OFFER = "jurisdiction_code string, source_id string, content_hash string, title string"


def test_snapshot_is_idempotent(spark, tmp_path):
    store = merge.Snapshots(spark, str(tmp_path / "s"))
    schema = OFFER + ", revision int, first_seen_at timestamp, last_seen_at timestamp"
    at = lambda d: F.lit(d).cast("timestamp")
    offers = spark.createDataFrame([("NL", "a", "1", "x"), ("NL", "b", "2", "y")], OFFER)
    store.commit(merge.upsert(store.read(schema), offers, at("2026-01-01")))
    store.commit(merge.upsert(store.read(schema), offers, at("2026-01-02")))
    changed = spark.createDataFrame([("NL", "a", "9", "z")], OFFER)
    store.commit(merge.upsert(store.read(schema), changed, at("2026-01-03")))
    got = {r["source_id"]: (r["content_hash"], r["title"], r["revision"], r["first_seen_at"].day, r["last_seen_at"].day) for r in store.read(schema).collect()}
    assert got == {"a": ("9", "z", 2, 1, 3), "b": ("2", "y", 1, 1, 2)} and store.version() == 3


REVIEW = "name string, status string, decision string, is_published boolean, needs_review boolean, suppressed boolean, flagged_hash string, content_hash string"


def test_review_machine(spark):
    rows = [
        ("new", None, None, True, True, False, None, "A"), ("leaves", "pending", None, True, False, False, "A", "B"), ("same hash", "withdrawn", None, True, True, False, "A", "A"),
        ("decided leaves", "pending", "confirmed", True, False, False, "A", "B"), ("rejected", "decided", "rejected", True, True, False, "A", "A"), ("restored", "decided", "confirmed", False, False, True, "A", "A"),
        ("reopens", "decided", "rejected", True, True, True, "A", "B"), ("no review", None, None, False, False, False, None, "A"),
    ]
    got = {r["name"]: (r["new_status"], r["new_published"], r["new_suppressed"]) for r in reviews.transition(spark.createDataFrame(rows, REVIEW)).collect()}
    assert got == {
        "new": ("pending", True, False), "leaves": ("withdrawn", True, False), "same hash": ("withdrawn", True, False), "decided leaves": ("pending", True, False),
        "rejected": ("decided", False, True), "restored": ("decided", True, False), "reopens": ("pending", False, True), "no review": (None, False, False),
    }


def test_hold_back_against_loop(spark):
    rng = random.Random(2)
    rows = [(f"r{rng.randint(0, 5)}", i, f"s{i}", dt.datetime(2026, 1, 1) + dt.timedelta(minutes=rng.randint(0, 500)), rng.random() < 0.1) for i in range(200)]
    got = {r["run"]: (r["last_modified_seen"], r["last_source_id"], r["committed"]) for r in runs.held_back(spark.createDataFrame(rows, "run string, pos int, source_id string, modified_at timestamp_ntz, failed boolean"), "run").collect()}
    expected = {}
    for run in {r[0] for r in rows}:
        seen = []
        for r in (r for r in rows if r[0] == run):
            if r[4]:
                break
            seen.append(r)
        if seen:
            expected[run] = (max(s[3] for s in seen), seen[-1][2], len(seen))
    assert got == expected


def test_spans():
    rng, hour, day = random.Random(4), dt.timedelta(hours=1), dt.timedelta(days=1)
    start = dt.datetime(2026, 1, 1)
    for _ in range(50):
        items = [start + dt.timedelta(seconds=rng.randint(0, 86_400)) for _ in range(rng.randint(0, 300))]
        count = lambda a, b: sum(a <= x <= b for x in items)  # noqa: B023, E731
        got = list(discovery.Planner(20, hour, discovery.SECOND, 6 * hour).spans(count, start, start + day))
        assert sum(x.found for x in got) == len(items) and got[-1].last == start + day
        assert all(b.first == a.last + discovery.SECOND for a, b in zip(got, got[1:]))
        assert all(x.found <= 20 or x.last - x.first <= discovery.SECOND for x in got) and max(x.last - x.first for x in got) <= 6 * hour
        half = lambda a, b: sum(a <= x < b for x in items)  # noqa: B023, E731
        got = list(discovery.Planner(20, hour, dt.timedelta(seconds=60), closed=False).spans(half, start, start + day + discovery.SECOND))
        assert sum(x.found for x in got) == len(items) and all(b.first == a.last for a, b in zip(got, got[1:]))
    assert len(list(discovery.Planner(20, hour, discovery.SECOND, 6 * hour).spans(lambda a, b: 0, start, start + day))) < 8


def test_bounds_and_retries(spark):
    rows = spark.createDataFrame([(i, None if i == 9 else dt.datetime(2026, 1, 1, i)) for i in range(10)], "id int, modified_at timestamp_ntz")
    assert sorted(r["id"] for r in discovery.within(rows, "modified_at", dt.datetime(2026, 1, 1, 2), dt.datetime(2026, 1, 1, 4)).collect()) == [2, 3, 4, 9]
    assert list(discovery.pauses(iter([0, 0, 1, 1]), longest=3)) == [0.5, 1, 3, 3]
    r = discovery.Retries(tries=3)
    assert list(r.schedule(iter([(503, 7), (404, None), (503, 1)]))) == [7] and len(list(r.schedule(iter([(503, None)] * 9)))) == 3 and list(r.schedule(iter([(200, None)]))) == []


def test_recorded_source(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.jsonl").write_text("".join(f'{{"source_id": "s{i}{j}", "jurisdiction_code": "NL"}}\n' for j in range(4)))
    discovery.register(spark)
    assert spark.read.format("recorded_source").load(str(tmp_path)).count() == 12
    seen = []
    spark.readStream.format("recorded_source").load(str(tmp_path)).writeStream.foreachBatch(lambda df, n: seen.extend(r[0] for r in df.select("source_id").collect())).option("checkpointLocation", session.scratch_path(spark, "t")).trigger(processingTime="0 seconds").start().processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    assert len(seen) == len(set(seen)) == 12


DECISION = """<?xml version="1.0"?><!DOCTYPE open><open><RDF><Description><identifier>ECLI:X:1</identifier><subject>Bestuursrecht; Belasting</subject><subject label="x">Onzin</subject></Description></RDF>
<uitspraak><title>Kop</title><para>Eerste <emphasis>regel</emphasis> hier.<?linebreak?>Tweede</para><para/><para>Derde</para></uitspraak></open>"""


def test_markup(spark):
    assert markup.body_text(DECISION) == "Kop\nEerste regel hier.\nTweede\n\nDerde"
    assert markup.body_text("<a><b></a>") is None and markup.body_text(None) is None
    assert markup.parse('<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>') is None
    assert markup.html_string("<p>a<script>no</script>b &amp; <b>c") == "a b & c"
    df = spark.createDataFrame([(DECISION,)], "p string").select(markup.properties(F.col("p")).alias("props"))
    subjects = df.select(markup.values(F.col("props"), "subject").alias("s")).select("s", markup.law_domain(F.col("s")).alias("d")).first()
    assert subjects["s"] == ["Bestuursrecht; Belasting", "Onzin"] and tuple(subjects["d"]) == ("public", "Belasting")
    cites = '<r xmlns:ecli="e" xmlns:x="y"><Description><references ecli:resourceIdentifier="ECLI:1" x:k="v">T</references><relation x:k="v"/></Description></r>'
    cited = spark.createDataFrame([(cites,)], "p string").select(markup.citations(markup.properties(F.col("p"))).alias("c")).first()["c"]
    assert [tuple(c) for c in cited] == [("ECLI:1", "ecli", "cites", "T")]
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><subtitle>Total 2</subtitle><entry><id>a</id><title>T</title><link href="u"/></entry></feed>'
    got = spark.createDataFrame([(feed,), ("<",), (None,)], "p string").select(markup.feed(F.col("p")).alias("f")).collect()
    assert got[0]["f"]["total"] == 2 and got[0]["f"]["entries"][0]["link"] == "u" and got[1]["f"] is None and got[2]["f"] is None


def test_notice_fields(spark):
    assert [tuple(p) for p in one(spark, markup.parties(F.lit("Judgment#A Ltd v B Inc.#x")))] == [("A Ltd", "applicant", 0), ("B Inc", "defendant", 1)]
    assert one(spark, markup.case_numbers(F.array(F.lit("C-1/19, C-2/19"), F.lit("C-1/19")))) == ["C-1/19", "C-2/19"]
    assert one(spark, markup.language(F.lit("FRA"))) == "fr" and one(spark, markup.language(F.lit("XXX"))) == "xxx"
    assert one(spark, markup.date_prefix(F.lit("2026-02-31T"))) is None and one(spark, markup.date_prefix(F.lit("2026-02-03T1"))) == dt.date(2026, 2, 3)
    assert tuple(one(spark, markup.court(F.lit("TypeRvS")))) == ("supreme", "administrative") and one(spark, markup.document_kind(F.lit("X"))) == "other" and one(spark, markup.clean_title(F.lit("a#b  c"))) == "a b c"


def test_exports(spark, tmp_path):
    flat = spark.createDataFrame([(1, "=x", "a,b")], "id long, title string, note string")
    export.write_csv(flat.coalesce(1), str(tmp_path / "c"))
    raw = b"".join(p.read_bytes() for p in (tmp_path / "c").glob("part-*"))
    assert raw == b"id,title,note\r\n1,'=x,\"a,b\"\r\n"
    lines = [r["line"] for r in export.json_lines(flat, F.struct(F.lit("x").alias("q"))).orderBy("position").collect()]
    assert '"record_type":"metadata"' in lines[0] and '"record_type":"case"' in lines[1]
    assert one(spark, export.run_log_name(F.lit("2027-01-01").cast("timestamp"))) == "2026-W53"
    sizes = {0: "0 bytes", 1: "1 byte", 999: "999 bytes", 1_000: "1.0 kB", 840_249: "840.2 kB", 12_400_000: "12.4 MB", 5_000_000_000: "5000.0 MB"}
    durations = {0: "0s", 59.4: "59s", 60: "1m 00s", 2186: "36m 26s", 14531: "4h 02m 11s", 0.5: "0s", 1.5: "2s"}
    assert [one(spark, export.human_size(F.lit(n))) for n in sizes] == list(sizes.values()) and [one(spark, export.human_duration(F.lit(x))) for x in durations] == list(durations.values())
    assert one(spark, export.human_count(F.lit(18204), "case")) == "18,204 cases" and one(spark, export.human_count(F.lit(1), "case")) == "1 case"
    many = spark.createDataFrame([(1, "reject", 1.23456, [f"t{i}" for i in range(60)])], "id long, action string, score double, terms array<string>")
    assert '"terms_omitted":10' in export.report_lines(many).first()["line"]


def test_free_names_are_free(spark):
    rng = random.Random(5)
    stems = ["a", "a", "a_2", "a", "b", "a_2", "a_4", "a_02", "b_x", "b"] + [rng.choice(["c", "c", "c_2", "c_3", "c_2_2"]) for _ in range(60)]
    logs = spark.createDataFrame(list(enumerate(stems)), "pos long, stem string").repartition(5)
    got = [(r["stem"], r["pos"], r["name"]) for r in export.free_names(logs).collect()]
    assert len(got) == len(stems) and len({n for _, _, n in got}) == len(stems) and all(n == s or n.rpartition("_")[0] == s for s, _, n in got)
    assert sorted(n for s, _, n in got if s == "a") == ["a", "a_3", "a_5"] and {n for s, _, n in got if s == "a_2"} == {"a_2", "a_2_2"}
    first = {s: min(p for t, p, _ in got if t == s) for s in stems}
    assert all(n == s for s, p, n in got if p == first[s])
    taken = spark.createDataFrame([("b",), ("b_2",), ("a_9",)], "name string")
    again = [r["name"] for r in export.free_names(logs, taken).collect()]
    assert len(set(again)) == len(stems) and not {"b", "b_2", "a_9"} & set(again) and "b_3" in again


def test_run_reports(spark):
    at = dt.datetime(2027, 1, 1, 3, 12, 5)
    rows = [
        ("a", "NL", "partial", at, at + dt.timedelta(seconds=2186), 1300, 1275, 20, 25, 12_400_000, "2026-12-30, after case x", "2026-12-30, after case x", None), ("b", "EU", "success", at, at, 3, 3, 0, 0, 0, None, "y", None),
        ("c", "EU", "failed", at, None, 5, 0, 1, 0, 10, None, None, "the source is gone"), ("d", "EU", "success", at, at, 0, 0, 0, 0, 0, None, None, None), ("e", "EU", "interrupted", at, at, 9, 0, 2, 1, 2000, "p", "q", None),
    ]
    runs_ = spark.createDataFrame(rows, "id string, jurisdiction_code string, status string, started_at timestamp, finished_at timestamp, discovered long, skipped long, written long, failed long, bytes long, before string, after string, error string")
    failures = spark.createDataFrame([("a", i, f"c{i:02d}", "Timeout" if i % 3 else "Gone", f"reason {i}") for i in range(25)] + [("e", 1, "x", "Gone", "went")], "run string, pos long, identifier string, kind string, reason string")
    got = {r["id"]: (r["name"], r["text"]) for r in export.run_reports(runs_, failures).collect()}
    text = got["a"][1]
    assert got["a"][0] == "2026-W53_20270101T031205Z" and text.startswith("NL corpus mirror - 2026-W53\n===========================\n\n20 new cases, 25 failed.\n\nThe run\n-------\n")
    assert "Took              36m 26s" in text and "Written           12.4 MB" in text and "Discovered        1,300 cases" in text and "the position did not move" in text
    assert "      16  Timeout\n       9  Gone\n    c00  reason 0\n" in text and "c19  reason 19\n    ... and 5 more\n" in text and "c20" not in text
    assert "A quiet week: 3 cases offered" in got["b"][1] and "Failures" not in got["b"][1] and "FAILED after 1 new case: the source is gone" in got["c"][1] and "Finished          not recorded" in got["c"][1]
    assert "Nothing at all was offered" in got["d"][1] and "INTERRUPTED after 2 new cases, 1 failed." in got["e"][1] and "... and" not in got["e"][1]


def test_lookups(spark):
    key = b"pepper"
    gone = hmac.new(key, b"subscriber.v1:gone@x.org", hashlib.sha256).hexdigest()
    rows = [(1, "here@x.org", "confirmed", None, "s1"), (2, None, "unsubscribed", gone, "s2"), (3, None, "unsubscribed", gone.upper(), "s3"), (4, None, "unsubscribed", None, None)]
    subscribers = spark.createDataFrame(rows, "id long, email string, status string, email_digest string, token_seed string")
    asked = spark.createDataFrame([("a", " Here@X.org ", None), ("b", "GONE@x.org", None), ("c", "who@x.org", None), ("d", None, "s3"), ("e", None, None), ("f", "who@x.org", "s1")], "ask string, email string, token_seed string")
    got = {r["ask"]: (r["id"], r["found_by"]) for r in notify.lookup(asked, subscribers, key, "subscriber.v1").collect()}
    assert got == {"a": (1, "email"), "b": (2, "digest"), "c": (None, None), "d": (3, "token"), "e": (None, None), "f": (1, "token")}


def test_explicit_since(spark):
    df = spark.createDataFrame([(1, "x", "y"), (2, None, "y"), (3, None, None)], "id int, given string, stored string")
    assert [r[0] for r in df.orderBy("id").select(runs.begin(F.col("given"), F.col("stored"))).collect()] == ["x", "y", None]


def test_mirror_names(spark):
    names = {"a b/c": ("a_b_c", None), " ": (None, "blank"), ".x": (None, "hidden"), "x.": (None, "trailing dot"), "con.txt": (None, "reserved"), "_RUNS": (None, "bookkeeping"), "x" * 101: (None, "too long")}
    got = {r["n"]: tuple(r["f"]) for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", mirror.folder_name(F.col("n")).alias("f")).collect()}
    assert got == names
    done = spark.createDataFrame([(i, dt.datetime(2026, 1, 1) + dt.timedelta(days=i), 10) for i in range(60)], "id long, finished_at timestamp, bytes long")
    row = mirror.manifest(done).first()
    assert (row["runs"], row["bytes"], len(row["history"]), row["history"][-1]["id"]) == (60, 600, 50, 59)


def test_digest_is_resumable(spark):
    rows = [(i, "confirmed" if i % 3 else "pending", None, 0) for i in range(20)]
    people = spark.createDataFrame(rows, "id long, status string, last_digest_at timestamp, digest_count int")
    until = F.lit("2026-01-08").cast("timestamp")
    first = notify.recipients(people, until, size=5)
    people = notify.stamp(people, first, until)
    rest = notify.recipients(people, until)
    assert rest.count() == 13 - 5
    people = notify.stamp(people, rest, until)
    assert notify.recipients(people, until).count() == 0 and people.agg(F.sum("digest_count")).first()[0] == 13
    assert one(spark, notify.overflow_note(F.lit(2), F.lit(5))) == "2 of 5 new cases are listed."
    with pytest.raises(ValueError):
        notify.window(people, dt.date(2026, 1, 2), dt.date(2026, 1, 2), 5)


def test_display(spark):
    from lexmill.operators import display, offers

    assert display.pager(1, 1) == [1] and display.pager(5, 9) == [1, None, 4, 5, 6, None, 9] and display.pager(3, 5) == [1, 2, 3, 4, 5]
    assert one(spark, display.short_date(F.lit(dt.date(2024, 3, 5)))) == "5 March 2024"
    rows = spark.createDataFrame([("b", dt.date(2026, 1, 1)), ("a", None), ("c", dt.date(2025, 1, 1))], "source_id string, modified_at date")
    assert [r["source_id"] for r in offers.in_order(rows).collect()] == ["a", "c", "b"]


def test_constraints(spark):
    from lexmill import schemas
    from lexmill.operators import constraints

    empty = {n: spark.createDataFrame([], ddl) for n, ddl in schemas.TABLES.items()}
    assert all(not v.take(1) for v in constraints.violations(empty).values())
    reviews_ = spark.createDataFrame([(1, 7, "odd"), (2, 7, "pending"), (3, None, None)], "id bigint, case_id bigint, status string").withColumn("decision", F.lit(None).cast("string"))
    cases = spark.createDataFrame([(8,)], "id bigint").selectExpr("id", "'NL' AS jurisdiction_code", "'a' AS source_id", "cast(null AS bigint) AS court_id")
    got = {n: v.count() for n, v in constraints.violations({"case_review": reviews_, "case": cases}).items()}
    assert got == {"unique case_review": 1, "reference case_review.case_id": 2, "values case_review.status": 1, "values case_review.decision": 0, "unique case": 0}
