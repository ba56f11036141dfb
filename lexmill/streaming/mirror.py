"""The mirror loop: a stream of candidates stored once each, in parts that a ledger commits.

A micro-batch is as many candidates as are processed between two checkpoints. What the store holds is skipped before anything is
fetched; the rest is fetched, named and written; what fails is logged and holds the checkpoint back. The ledger row of a part is written
last, and only parts with one are read: a batch that broke off is done again, one that ended is not. A limit ends the stream in the
middle of a batch, whose rest the next run does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import mirror, runs
from lexmill.session import delete_path, list_path

CASE = "identifier string, name string, pos bigint, modified_at timestamp, payload string, metadata string, run int"
FAILURE = "identifier string, pos bigint, kind string, reason string, run int"
LEDGER = "batch bigint, turn int, run int, discovered bigint, skipped bigint, written bigint, failed bigint, bytes bigint, last_modified_seen timestamp, last_source_id string, held boolean, upto bigint, ended boolean"


class _Enough(Exception):
    """The limit is reached; Spark must not take the batch as done."""


def fetched(batch: DataFrame) -> DataFrame:
    """For candidates that come with payload, metadata and error (``kind: reason``, or null)."""
    return batch


class Mirror:
    """A store below ``path``. ``fetch`` adds payload, metadata and error to candidates (identifier, pos, modified_at); rows that repeat an
    identifier are one candidate, the first by pos. A null identifier is a failure."""

    def __init__(self, spark: SparkSession, path: str, fetch: Callable[[DataFrame], DataFrame] = fetched):
        self.spark, self.path, self.fetch = spark, path.rstrip("/"), fetch
        self.limit: int | None = None
        self.run_number = 0

    def ledger(self) -> DataFrame:
        """A row for each part that was committed: the checkpoints, and what each run did."""
        parts = [p for p in list_path(self.spark, f"{self.path}/ledger") if "_SUCCESS" in list_path(self.spark, f"{self.path}/ledger/{p}")]
        return self.spark.read.schema(LEDGER).parquet(*[f"{self.path}/ledger/{p}" for p in parts]) if parts else self.spark.createDataFrame([], LEDGER)

    def _table(self, name: str, schema: str) -> DataFrame:
        """Rows of committed parts."""
        done = self.ledger().select(F.concat_ws("-", "batch", "turn").alias("part"))
        if not list_path(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, part string").parquet(f"{self.path}/{name}")
        return rows.join(F.broadcast(done), "part", "left_semi").drop("part")  # a row for each checkpoint

    def cases(self) -> DataFrame:
        return self._table("cases", CASE)

    def failures(self) -> DataFrame:
        """The failure log; what failed and came later is in it as well."""
        return self._table("failures", FAILURE)

    def unresolved(self) -> DataFrame:
        """Failed candidates that the store doesn't hold."""
        return self.failures().join(self.cases().select("identifier"), "identifier", "left_anti")

    def checkpoint(self) -> tuple | None:
        """(last_modified_seen, last_source_id) of the last part; nothing after a failure counts."""
        last = self.ledger().orderBy(F.desc("batch"), F.desc("turn")).select("last_modified_seen", "last_source_id").first()
        return tuple(last) if last and last[1] is not None else None

    def _batch(self, batch: DataFrame, number: int) -> None:
        before = self.ledger()
        turns = before.where(F.col("batch") == number).select("turn", "upto", "ended").collect()
        if any(r["ended"] for r in turns):
            return
        left = None if self.limit is None else self.limit - (before.where(F.col("run") == self.run_number).agg(F.sum("written")).first()[0] or 0)
        if left is not None and left <= 0:
            raise _Enough
        if turns:  # an earlier run ended inside this batch, and judged it up to some pos
            batch = batch.where(F.col("pos") > max(r["upto"] for r in turns))
        part = f"{number}-{len(turns)}"
        first = batch.groupBy("identifier").agg(F.min("pos").alias("pos"))
        rows = batch.join(first, (batch["identifier"].eqNullSafe(first["identifier"])) & (batch["pos"] == first["pos"]), "left_semi").dropDuplicates(["identifier"])
        held = self.cases().select(F.col("identifier"), F.lit(True).alias("__held"))
        marked = rows.join(held, "identifier", "left")
        got = self.fetch(marked.where("__held IS NULL").drop("__held"))
        name = mirror.folder_name(F.col("identifier"))
        staged = got.select("identifier", "pos", F.col("modified_at").cast("timestamp").alias("modified_at"), "payload", "metadata", name["name"].alias("name"), F.coalesce("error", F.concat(F.lit("name: "), name["error"])).alias("error"))
        skipped = marked.where("__held").select("identifier", "pos", F.col("modified_at").cast("timestamp").alias("modified_at"), F.lit("skipped").alias("outcome"))
        work = f"{self.path}/work/{part}"
        staged.write.mode("overwrite").parquet(f"{work}/staged")  # fetched once
        skipped.write.mode("overwrite").parquet(f"{work}/skipped")
        staged, skipped = self.spark.read.parquet(f"{work}/staged"), self.spark.read.parquet(f"{work}/skipped")
        judged = self._judged(staged)
        cut = self._cut(judged, left)
        upto: Column = F.lit(True) if cut is None else F.col("pos") <= cut
        judged, skipped = judged.where(upto), skipped.where(upto)
        good = judged.where("error IS NULL").select("identifier", "name", "pos", "modified_at", "payload", "metadata", F.lit(self.run_number).alias("run"))
        good.write.mode("overwrite").parquet(f"{self.path}/cases/part={part}")
        kind = F.substring_index("error", ":", 1)
        bad = judged.where("error IS NOT NULL").select("identifier", "pos", kind.alias("kind"), F.col("error").alias("reason"), F.lit(self.run_number).alias("run"))
        bad.write.mode("overwrite").parquet(f"{self.path}/failures/part={part}")
        self._commit(judged, skipped, before, number, len(turns), cut)
        delete_path(self.spark, work)
        if cut is not None:
            raise _Enough

    def _judged(self, staged: DataFrame) -> DataFrame:
        """Of several candidates, or one and a stored case, whose folder names are the same but for case, the first keeps the folder."""
        taken = self.cases().select(F.lower("name").alias("folder"), F.lit(-1).cast("long").alias("pos"))
        asked = staged.where("error IS NULL").select(F.lower("name").alias("folder"), "pos")
        owner = taken.unionByName(asked).groupBy("folder").agg(F.min("pos").alias("owner"))
        both = staged.withColumn("folder", F.when(F.col("error").isNull(), F.lower("name"))).join(owner, "folder", "left")
        clash = F.when(F.col("error").isNull() & (F.col("owner") != F.col("pos")), "folder: taken by another identifier")
        return both.withColumn("error", F.coalesce("error", clash)).drop("folder", "owner")

    @staticmethod
    def _cut(judged: DataFrame, left: int | None) -> int | None:
        """Pos of the case that reaches the run's limit, if this batch does."""
        if left is None:
            return None
        top = judged.where("error IS NULL").select("pos").orderBy("pos").limit(left).agg(F.max("pos"), F.count("*")).first()
        return top[0] if top[1] == left else None

    def _commit(self, judged: DataFrame, skipped: DataFrame, before: DataFrame, number: int, turn: int, cut: int | None) -> None:
        outcome = F.when(F.col("error").isNull(), "written").otherwise("failed")
        size = F.octet_length("payload") + F.octet_length("metadata")
        plain = judged.select("identifier", "pos", "modified_at", outcome.alias("outcome"), F.when(F.col("error").isNull(), size).alias("bytes")).unionByName(skipped, allowMissingColumns=True)
        n = lambda name: F.count_if(F.col("outcome") == name).alias(name)
        counts = plain.agg(F.count("*").alias("discovered"), n("skipped"), n("written"), n("failed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first().asDict()
        last = before.orderBy(F.desc("batch"), F.desc("turn")).first()
        held = bool(last and last["held"])
        seen = [last["last_modified_seen"], last["last_source_id"]] if last else [None, None]
        if not held:
            moved = runs.held_back(plain.select(F.lit(0).alias("one"), F.col("identifier").alias("source_id"), "pos", "modified_at", (F.col("outcome") == "failed").alias("failed")), "one").first()
            if moved:
                seen = [max((x for x in (seen[0], moved["last_modified_seen"]) if x is not None), default=None), moved["last_source_id"] or seen[1]]
        row = {"batch": number, "turn": turn, "run": self.run_number, **counts, "last_modified_seen": seen[0], "last_source_id": seen[1], "held": held or counts["failed"] > 0, "upto": cut, "ended": cut is None}
        self.spark.createDataFrame([tuple(row[c.split()[0]] for c in LEDGER.split(", "))], LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/{number:012d}-{turn:04d}")

    def run(self, candidates: DataFrame, limit: int | None = None) -> DataFrame:
        """Mirror what the stream offers, or until ``limit`` cases are written. Returns the run's row: counts and position."""
        self.limit = limit
        self.run_number = 1 + (self.ledger().agg(F.max("run")).first()[0] or 0)
        started = candidates.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.path}/_stream").trigger(availableNow=True).start()
        try:
            started.awaitTermination()
        except Exception as e:  # noqa: BLE001
            if _Enough.__name__ not in str(e):
                raise
        return self.ledger().where(F.col("run") == self.run_number)
