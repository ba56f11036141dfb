"""Incremental ingestion: a stream of candidates merged into a keyed table, with a checkpoint that failures hold back.

Each micro-batch is prepared, deduplicated, decided against the buckets of the table that its keys fall into, and committed. Only
those buckets are read and written, so a batch costs what it touches and not what is stored. A record that cannot be prepared is a
dead letter; the rest of its batch goes on. Spark's own offsets move past failed records; the logical checkpoint and the retry
table do not. The commit is one small file, so a batch that is replayed, or broke off half-way, leaves the same table.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lexmill.operators import merge, runs
from lexmill.session import delete_path, list_path

SNAPSHOT = "jurisdiction_code string, source_id string, content_hash string, title string, revision int, first_seen_at timestamp, last_seen_at timestamp"
STORED = f"{SNAPSHOT}, pos bigint"
OFFERS = "jurisdiction_code string, source_id string, pos bigint, modified_at timestamp, content_hash string, title string"
DEAD = "jurisdiction_code string, source_id string, pos bigint, error string"
POSITION = "jurisdiction_code string, last_modified_seen timestamp, last_source_id string, committed bigint, held boolean"
ERROR_MOST = 500


def isolated(function: Callable, kind: str, *columns: Column) -> Column:
    """struct<value, error> of a Python function of rows: where it raises, value is null and error says what went wrong. One bad
    record is one bad row, not a failed task."""

    @arrow_udf(f"struct<value: {kind}, error: string>")
    def run(*arrays: pa.Array) -> pa.Array:
        out = []
        for row in zip(*(a.to_pylist() for a in arrays)):
            try:
                out.append({"value": function(*row), "error": None})
            except Exception as e:  # noqa: BLE001  any error of the record's own
                out.append({"value": None, "error": f"{type(e).__name__}: {e}"[:ERROR_MOST]})
        return pa.array(out) if out else pa.array([], pa.struct([("value", pa.null()), ("error", pa.string())]))

    return run.asNondeterministic()(*columns)


def told(batch: DataFrame) -> DataFrame:
    """Prepares nothing: a candidate failed if its column ``failed`` says so."""
    return batch.withColumn("error", F.when(F.col("failed"), "failed"))


class Buckets:
    """A table of rows by key in ``count`` buckets of key hashes. A commit writes the buckets it touches beside the old ones, and then
    the list of which folder holds which bucket; readers see the last list. Folders that neither the last list nor the one
    before it names are deleted, so a reader may be one commit late."""

    def __init__(self, spark: SparkSession, path: str, schema: str, count: int = 64):
        self.spark, self.path, self.schema, self.count = spark, path.rstrip("/"), schema, count

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*merge.KEY), F.lit(self.count)).cast("int")

    def _lists(self) -> list[int]:
        return sorted(int(name) for name in list_path(self.spark, f"{self.path}/lists") if name.isdigit() and "_SUCCESS" in list_path(self.spark, f"{self.path}/lists/{name}"))

    def number(self) -> int:
        """The last commit; -1 before the first."""
        return max(self._lists(), default=-1)

    def _places(self, number: int) -> dict[int, int]:
        """Bucket to the commit that wrote it, as of a commit."""
        return {r["bucket"]: r["commit"] for r in self.spark.read.schema("bucket int, commit bigint").parquet(f"{self.path}/lists/{number:012d}").collect()} if number >= 0 else {}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        places = self._places(self.number())
        paths = [f"{self.path}/data/commit={n}/bucket={b}" for b, n in places.items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def stage(self, number: int, rows: DataFrame, touched: int) -> None:
        """Write the rows of the touched buckets; a folder left by a broken attempt is overwritten."""
        placed = rows.withColumn("bucket", self.bucket()).repartition(max(1, touched), "bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/commit={number}")

    def commit(self, number: int, touched: list[int]) -> None:
        """Make a staged commit the last one, and delete what no list names any more."""
        lists = self._lists()
        before = self._places(lists[-1]) if lists else {}
        now = before | {b: number for b in touched}
        rows = self.spark.createDataFrame(sorted(now.items()), "bucket int, commit bigint")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/{number:012d}")
        for old in lists[:-1]:
            for b, n in self._places(old).items():
                if n not in (before.get(b), now[b]):
                    delete_path(self.spark, f"{self.path}/data/commit={n}/bucket={b}")
            delete_path(self.spark, f"{self.path}/lists/{old:012d}")


class Ingest:
    """``run`` drains what is there and stops; running it again with nothing new changes nothing.

    ``prepare`` turns a batch into (jurisdiction_code, source_id, pos, modified_at, content_hash, title, error); a row with an error is a
    dead letter. Rows without a key are dead letters too. Of several offers of one key the one with the greatest pos counts, within
    a batch and across batches, so batches may come in any order. A batch's own rows, without payloads, are kept for two batches.
    """

    def __init__(self, spark: SparkSession, path: str, prepare: Callable[[DataFrame], DataFrame] = told, buckets: int = 64):
        self.spark, self.path, self.prepare = spark, path.rstrip("/"), prepare
        self.table = Buckets(spark, f"{self.path}/snapshot", STORED, buckets)

    def _batch(self, batch: DataFrame, number: int) -> None:
        if number <= self.table.number():
            return  # replayed after its commit
        folder = f"{self.path}/batches/{number:012d}"
        ready = self.prepare(batch)
        lost = F.when(F.col("jurisdiction_code").isNull() | F.col("source_id").isNull(), "no key")
        ready.select(*merge.KEY, F.col("pos").cast("long").alias("pos"), F.col("modified_at").cast("timestamp").alias("modified_at"), "content_hash", "title", F.coalesce("error", lost).alias("error")).write.mode("overwrite").parquet(folder)
        rows = self.spark.read.parquet(folder)
        rows.where("error IS NOT NULL").select(*merge.KEY, "pos", "error").write.mode("overwrite").parquet(f"{self.path}/dead/batch={number}")
        self._advance(rows, number)
        offers = f"{self.path}/last/{number:012d}"  # read several times
        merge.last_of_each(rows.where("error IS NULL").drop("error"), ["pos"]).write.mode("overwrite").parquet(offers)
        last = self.spark.read.schema(OFFERS).parquet(offers)
        touched = [r["bucket"] for r in last.select(self.table.bucket().alias("bucket")).distinct().collect()]
        if touched:
            now = last.agg(F.max("modified_at")).first()[0]
            self.table.stage(number, merge.upsert(self.table.read(touched), last, F.lit(now).cast("timestamp"), order="pos"), len(touched))
        self.table.commit(number, touched)
        delete_path(self.spark, offers)
        delete_path(self.spark, f"{self.path}/batches/{number - 2:012d}")
        delete_path(self.spark, f"{self.path}/positions/{number - 2:012d}")

    def _advance(self, rows: DataFrame, number: int) -> None:
        """The positions after a batch, by jurisdiction: those that an earlier failure holds stay."""
        old = self._positions(number - 1).select("jurisdiction_code", F.struct("last_modified_seen", "last_source_id", "committed", "held").alias("o"))
        told_ = rows.where("jurisdiction_code IS NOT NULL").withColumn("failed", F.col("error").isNotNull())
        done = runs.held_back(told_, "jurisdiction_code")
        bad = told_.groupBy("jurisdiction_code").agg(F.bool_or("failed").alias("bad"))
        new = bad.join(done, "jurisdiction_code", "left").select("jurisdiction_code", F.struct("last_modified_seen", "last_source_id", "committed", "bad").alias("n"))
        both = old.join(new, "jurisdiction_code", "full_outer")
        stays = F.coalesce(F.col("o.held"), F.lit(False)) | F.col("n").isNull()
        pick = lambda name, value: F.when(stays, F.col(f"o.{name}")).otherwise(value).alias(name)
        after = both.select(
            "jurisdiction_code", pick("last_modified_seen", F.greatest("o.last_modified_seen", "n.last_modified_seen")), pick("last_source_id", F.coalesce("n.last_source_id", "o.last_source_id")),
            pick("committed", F.coalesce("o.committed", F.lit(0)) + F.coalesce("n.committed", F.lit(0))), pick("held", F.coalesce("o.held", F.lit(False)) | F.col("n.bad")),
        )
        after.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/positions/{number:012d}")

    def _positions(self, number: int) -> DataFrame:
        there = number >= 0 and f"{number:012d}" in list_path(self.spark, f"{self.path}/positions")
        return self.spark.read.schema(POSITION).parquet(f"{self.path}/positions/{number:012d}") if there else self.spark.createDataFrame([], POSITION)

    def run(self, candidates: DataFrame) -> None:
        writer = candidates.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.path}/_stream")
        writer.trigger(availableNow=True).start().awaitTermination()

    def snapshot(self) -> DataFrame:
        return self.table.read().drop("pos")

    def dead_letters(self) -> DataFrame:
        """Every record that could not be prepared, with its error."""
        if not list_path(self.spark, f"{self.path}/dead"):
            return self.spark.createDataFrame([], f"{DEAD}, batch int")
        return self.spark.read.schema(f"{DEAD}, batch int").parquet(f"{self.path}/dead")

    def retries(self) -> DataFrame:
        """Records whose last offer failed, over all batches."""
        last = merge.last_of_each(self.dead_letters().where("jurisdiction_code IS NOT NULL AND source_id IS NOT NULL").select(*merge.KEY, "pos"), ["pos"])
        stored = self.table.read().select(*merge.KEY, F.col("pos").alias("__ok"))
        return last.join(stored, merge.KEY, "left").where("__ok IS NULL OR __ok < pos").drop("__ok")

    def checkpoint(self) -> DataFrame:
        """The logical position per jurisdiction: nothing after its first failure counts, and one that begins with a failure has none."""
        return self._positions(self.table.number()).where("committed > 0").drop("held")
