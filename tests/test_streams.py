import os

import pytest
from pyspark.sql import functions as F

from lexmill.operators import merge, runs
from lexmill.session import scratch_path
from lexmill.streaming.ingest import Ingest, isolated
from lexmill.streaming.mirror import Mirror

OFFER = "jurisdiction_code string, source_id string, pos bigint, modified_at timestamp, content_hash string, title string, failed boolean"


def offers(spark, rows):
    return spark.createDataFrame(rows, OFFER.replace("modified_at timestamp", "s bigint")).withColumn("modified_at", F.timestamp_seconds("s"))


def stored(ingest):
    return {r["source_id"]: (r["content_hash"], r["revision"]) for r in ingest.snapshot().collect()}


def size(path):
    path = path.removeprefix("file://")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_a_poisoned_record_is_a_dead_letter(spark):
    def read(value):
        if value == "bad":
            raise KeyError("no title")
        return value.upper()

    def prepare(batch):
        done = batch.withColumn("r", isolated(read, "string", F.col("title")))
        return done.drop("title").select("*", F.col("r.value").alias("title"), F.col("r.error").alias("error"))

    ingest = Ingest(spark, scratch_path(spark, "i"), prepare, 4)
    rows = offers(spark, [("NL", "a", 1, 10, "1", "x", False), ("NL", "b", 2, 20, "1", "bad", False), ("NL", "c", 3, 30, "1", None, False), ("NL", None, 4, 40, "1", "x", False), ("EU", "d", 5, 50, "1", "y", False)])
    ingest._batch(rows, 0)
    assert {r["source_id"]: r["title"] for r in ingest.snapshot().collect()} == {"a": "X", "d": "Y"}
    assert sorted((r["source_id"] or "", r["error"].split(":")[0]) for r in ingest.dead_letters().collect()) == [("", "no key"), ("b", "KeyError"), ("c", "AttributeError")]
    assert sorted(r["source_id"] for r in ingest.retries().collect()) == ["b", "c"]
    assert {r["jurisdiction_code"]: (r["last_source_id"], r["committed"]) for r in ingest.checkpoint().collect()} == {"NL": ("a", 1), "EU": ("d", 1)}
    ingest._batch(offers(spark, [("NL", "b", 6, 60, "2", "good", False), ("EU", "e", 7, 70, "1", "z", False)]), 1)
    assert sorted(r["source_id"] for r in ingest.retries().collect()) == ["c"]
    assert {r["jurisdiction_code"]: (r["last_source_id"], r["committed"]) for r in ingest.checkpoint().collect()} == {"NL": ("a", 1), "EU": ("e", 2)}


def test_replayed_and_broken_batches(spark, monkeypatch):
    ingest = Ingest(spark, scratch_path(spark, "i"), buckets=4)
    first = offers(spark, [("NL", "a", 1, 10, "1", "x", False), ("NL", "b", 2, 20, "1", "x", False)])
    second = offers(spark, [("NL", "a", 3, 30, "2", "x", False), ("NL", "z", 4, 40, "1", "x", True)])
    ingest._batch(first, 0)
    ingest._batch(first, 0)
    assert stored(ingest) == {"a": ("1", 1), "b": ("1", 1)}
    with monkeypatch.context() as m:
        m.setattr(type(ingest.table), "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            ingest._batch(second, 1)
    assert stored(ingest) == {"a": ("1", 1), "b": ("1", 1)}  # staged, not committed
    again = Ingest(spark, ingest.path, buckets=4)
    again._batch(second, 1)
    again._batch(second, 1)
    assert stored(again) == {"a": ("2", 2), "b": ("1", 1)} and again.dead_letters().count() == 1
    again._batch(offers(spark, [("NL", "a", 2, 20, "9", "late", False)]), 2)  # an old offer that comes late
    assert stored(again) == {"a": ("2", 2), "b": ("1", 1)}
    again._batch(offers(spark, []), 3)
    assert stored(again) == {"a": ("2", 2), "b": ("1", 1)} and {r["last_source_id"] for r in again.checkpoint().collect()} == {"a"}


def test_bytes_follow_the_batch(spark):
    ingest = Ingest(spark, scratch_path(spark, "i"), buckets=32)
    many = spark.range(20_000).select(F.lit("NL").alias("jurisdiction_code"), F.concat(F.lit("s"), "id").alias("source_id"), F.col("id").alias("pos"), F.timestamp_seconds("id").alias("modified_at"), F.md5(F.col("id").cast("string")).alias("content_hash"), F.sha2(F.col("id").cast("string"), 256).alias("title"), F.lit(False).alias("failed"))
    ingest._batch(many, 0)
    whole = size(f"{ingest.path}/snapshot/data/commit=0")
    for n in range(1, 6):
        ingest._batch(offers(spark, [("NL", "s7", 30_000 + n, 30_000 + n, f"new{n}", "t", False)]), n)
        assert size(f"{ingest.path}/snapshot/data/commit={n}") < whole / 16
    assert ingest.snapshot().count() == 20_000 and stored(ingest)["s7"] == ("new5", 6)
    data = f"{ingest.path}/snapshot/data".removeprefix("file://")
    kept = [d for d, _, names in os.walk(data) if any(f.endswith(".parquet") for f in names)]
    assert len(kept) <= 32 + 2  # old versions of the one touched bucket are gone but for the last two
    assert len(os.listdir(f"{ingest.path}/snapshot/lists".removeprefix("file://"))) <= 2


def candidates(spark, rows):
    schema = "identifier string, pos bigint, payload string, error string"
    return spark.createDataFrame(rows, schema).select("*", F.timestamp_seconds("pos").alias("modified_at"), F.lit("{}").alias("metadata"))


def outcome(store):
    return sorted((r["identifier"], r["payload"]) for r in store.cases().collect()), sorted((r["identifier"] or "", r["kind"]) for r in store.failures().collect())


def test_mirror_parts(spark):
    store = Mirror(spark, scratch_path(spark, "m"))
    store.run_number = 1
    first = candidates(spark, [("a", 1, "A", None), ("a", 2, "later", None), ("A", 3, "clash", None), ("b", 4, None, "timeout: x"), (None, 5, "n", None), ("CON", 6, "r", None), ("c", 7, "C", None)])
    store._batch(first, 0)
    assert outcome(store) == ([("a", "A"), ("c", "C")], [("", "name"), ("A", "folder"), ("CON", "name"), ("b", "timeout")])
    assert store.checkpoint()[1] == "a" and store.ledger().first()["held"]
    store._batch(first, 0)  # replayed
    assert store.ledger().count() == 1 and store.cases().count() == 2
    fetched = []
    lazy = Mirror(spark, store.path, lambda df: (fetched.extend(r[0] for r in df.select("identifier").collect()), df)[1])
    lazy.run_number = 2
    lazy._batch(candidates(spark, [("a", 8, "A2", None), ("b", 9, "B", None), ("C", 10, "x", None)]), 1)
    assert sorted(fetched) == ["C", "b"]  # what is held is not fetched
    assert outcome(lazy)[0] == [("a", "A"), ("b", "B"), ("c", "C")] and sorted(r["identifier"] or "" for r in lazy.unresolved().collect()) == ["", "A", "C", "CON"]
    assert lazy.checkpoint()[1] == "a"


def test_mirror_restarts_where_it_broke(spark, monkeypatch):
    store = Mirror(spark, scratch_path(spark, "m"))
    rows = candidates(spark, [(f"x{i}", i, str(i), None) for i in range(9)])
    with monkeypatch.context() as m:
        m.setattr(Mirror, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store._batch(rows, 0)
    assert store.cases().count() == 0  # written, but in no ledger
    store._batch(rows, 0)
    assert store.cases().count() == 9 and store.ledger().first()["written"] == 9


def test_mirror_limits(spark):
    where = scratch_path(spark, "offers")
    rows = candidates(spark, [(f"x{i}", i, str(i), "gone: y" if i % 5 == 2 else None) for i in range(20)])
    for k in range(2):
        rows.where(f"pos div 10 = {k}").coalesce(1).write.mode("append").parquet(where)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(where)
    store = Mirror(spark, scratch_path(spark, "m"))
    done = []
    for limit in (3, 3, 4, None, 5):
        store.run(stream, limit)
        done.append(store.cases().count())
    assert done == [3, 6, 10, 16, 16]
    assert sorted(r["pos"] for r in store.failures().collect()) == [2, 7, 12, 17]
    assert store.checkpoint()[1] == "x1"
    totals = store.ledger().groupBy("run").agg(F.sum("written").alias("w")).collect()
    assert {r["run"]: r["w"] for r in totals} == {1: 3, 2: 3, 3: 4, 4: 6}


def test_scratch_tables_are_deleted(spark):
    from lexmill import session

    kept = session.materialize(spark.range(3).toDF("x"), "kept")
    path = session.scratch_path(spark, "result")
    with session.scratch_scope(spark):
        inner = session.materialize(spark.range(5).toDF("x"), "inner")
        where = inner.inputFiles()[0].rpartition("/")[0]
        inner.write.parquet(path)
    assert session.list_path(spark, where) == [] and spark.read.parquet(path).count() == 5 and kept.count() == 3
    session.delete_path(spark, path)


def test_offers_and_positions_are_hashed_not_sorted(spark):
    """No task sorts or buffers its share of the records: maxima of numbers are aggregated, and texts only of the rows that have them."""
    rows = [("NL", "a", 1, 10, "1", "x", False), ("NL", "a", 3, 30, "3", "x", False), ("NL", "a", 3, 30, "3", "y", False), (None, "a", 2, 20, "2", "z", True), (None, "a", 1, 50, "1", "z", False), ("EU", None, None, 5, "9", "n", False), ("NL", "b", 3, 5, "4", "x", False), ("NL", "c", 9, 99, "4", "x", True)]
    df = offers(spark, rows)
    last = merge.last_of_each(df, ["pos"])
    assert sorted((r["jurisdiction_code"] or "", r["source_id"] or "", r["pos"], r["title"]) for r in last.collect()) == [("", "a", 2, "z"), ("EU", "", None, "n"), ("NL", "a", 3, "y"), ("NL", "b", 3, "x"), ("NL", "c", 9, "x")]
    got = runs.held_back(df, "jurisdiction_code")
    assert {r["jurisdiction_code"]: (r["last_source_id"], r["committed"]) for r in got.collect()} == {"NL": ("b", 4), None: ("a", 2), "EU": (None, 1)}
    for found in (last, got):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "max_by" not in plan and "LeftSemi" in plan and "SortAggregate" not in plan[plan.index("LeftSemi") :]
    few = merge.last_of_each(df.select("jurisdiction_code", "source_id", "pos"), ["pos"])
    assert few.count() == 5 and "SortAggregate" not in few._jdf.queryExecution().sparkPlan().toString()
