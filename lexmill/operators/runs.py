"""Run ledger: counters, status, failures, and the checkpoint that a failure holds back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counters(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Per run: discovered, and how many ended in each outcome."""
    n = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    grouped = outcomes.groupBy(*keys)
    return grouped.agg(F.count("*").alias("discovered"), n("skipped"), n("rejected"), n("inserted"), n("updated"), n("error"))


def status(failed: Column, interrupted: Column, errors: Column) -> Column:
    return F.when(failed, "failed").when(interrupted, "interrupted").when(errors > 0, "partial").otherwise("success")


def exit_code(run_status: Column) -> Column:
    return F.when(run_status == "failed", 1).when(run_status == "interrupted", 130).when(run_status == "partial", 3).otherwise(0)


#: Runs (a key and two numbers each) that may be broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 100_000


def held_back(candidates: DataFrame, *keys: str) -> DataFrame:
    """Checkpoint of each run: the highest time and the last record before the run's first failure. Later successes count for
    nothing; a run that begins with a failure has no checkpoint and no row. Of records at one last pos the greatest counts.

    Tasks hold a few numbers for each run, and no record is sorted or, with few runs, shuffled."""
    few = candidates.select(*keys).distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    small = lambda df: F.broadcast(df) if few else df
    first = candidates.where("failed").groupBy(*keys).agg(F.min("pos").alias("__first"))
    before = candidates.join(small(first), list(keys), "left").where("__first IS NULL OR pos < __first").select(*keys, "pos", "modified_at", "source_id")
    done = before.groupBy(*keys).agg(F.max("modified_at").alias("last_modified_seen"), F.max("pos").alias("__last"), F.count("*").alias("committed"))
    named = lambda df: df.toDF(*[f"__{k}" if k in keys else k for k in df.columns])
    met = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    at_last = before.join(small(named(done.select(*keys, "__last"))), [*met, F.col("pos") == F.col("__last")], "left_semi").groupBy(*keys).agg(F.max("source_id").alias("last_source_id"))
    return done.join(named(at_last), met, "left").select(*keys, "last_modified_seen", "last_source_id", "committed")


def advance(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Time never goes back; the cursor is the latest one that is not null."""
    a, b = (df.select(*keys, F.struct("last_modified_seen", "last_source_id").alias(n)) for df, n in ((old, "o"), (new, "n")))
    joined = a.join(b, list(keys), "full_outer")
    return joined.select(*keys, F.greatest("o.last_modified_seen", "n.last_modified_seen").alias("last_modified_seen"), F.coalesce("n.last_source_id", "o.last_source_id").alias("last_source_id"))


def begin(explicit: Column, stored: Column) -> Column:
    """From when a run looks: the time it was given beats the stored checkpoint; without either it has no lower bound."""
    return F.coalesce(explicit, stored)


def failure_kinds(failures: DataFrame) -> DataFrame:
    return failures.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def failure_sample(failures: DataFrame, most: int = 20) -> DataFrame:
    """(kind, n, sample): how many records failed by each kind, and the first ``most`` of them by pos. Every task keeps ``most`` rows of a
    kind before anything is shuffled, so a kind with any number of failures stays small."""
    first = failures.withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy("pos", "identifier"))).where(F.col("k") <= most)
    sample = first.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "identifier"))), lambda x: x["identifier"]).alias("sample"))
    return failures.groupBy("kind").agg(F.count("*").alias("n")).join(sample, "kind")


def quarantined(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """Records whose last ``limit`` attempts all failed (an extension)."""
    last_ok = attempts.where("NOT failed").groupBy("source_id").agg(F.max("pos").alias("__ok"))
    since = attempts.join(last_ok, "source_id", "left").where("failed AND (__ok IS NULL OR pos > __ok)")
    return since.groupBy("source_id").agg(F.count("*").alias("failures")).where(F.col("failures") >= limit)
