"""A mirror of records: folder names, what is missing, its manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that a folder cannot have.
DEVICES = ["CON", "PRN", "AUX", "NUL", *[f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)]]
BOOKKEEPING = ["_manifest.json", "_checkpoint.json", "_failures.jsonl", "_runs"]
NAME_MOST, HISTORY = 100, 50


def folder_name(identifier: Column) -> Column:
    """struct<name, error>: unsafe characters become ``_``; a name that cannot be used has an error and no name."""
    name = F.regexp_replace(F.trim(identifier), r"[^A-Za-z0-9()._-]", "_")
    stem = F.upper(F.substring_index(name, ".", 1))
    error = (
        F.when(F.coalesce(name, F.lit("")) == "", "blank")
        .when(F.char_length(name) > NAME_MOST, "too long")
        .when(name.startswith("."), "hidden")
        .when(name.endswith("."), "trailing dot")
        .when(stem.isin(*DEVICES), "reserved")
        .when(F.lower(name).isin(*BOOKKEEPING), "bookkeeping")
    )
    return F.struct(F.when(error.isNull(), name).alias("name"), error.alias("error"))


def collisions(named: DataFrame) -> DataFrame:
    """Names that several identifiers share."""
    return named.where("name IS NOT NULL").groupBy(F.lower("name").alias("name")).agg(F.count_distinct("identifier").alias("n")).where("n > 1")


def missing(candidates: DataFrame, held: DataFrame) -> DataFrame:
    """Candidates without a complete entry: one whose metadata names the same identifier."""
    complete = held.where(F.col("metadata_identifier") == F.col("identifier")).select("identifier")
    return candidates.join(complete, "identifier", "left_anti")


def outcomes(candidates: DataFrame, held: DataFrame) -> DataFrame:
    """What one pass does with each candidate: skipped if it is held, failed if its payloads could not be had, else written. An entry is
    complete once it is committed with its metadata, so whatever a broken pass left is written anew by the next."""
    complete = held.where(F.col("metadata_identifier") == F.col("identifier")).select("identifier", F.lit(True).alias("__held"))
    joined = candidates.join(complete.distinct(), "identifier", "left")
    return joined.withColumn("outcome", F.when(F.col("__held"), "skipped").when(F.col("failed"), "failed").otherwise("written")).drop("__held")


def write(entries: DataFrame, path: str) -> None:
    """Entries (identifier, jurisdiction_code, metadata, payloads) by jurisdiction. Rows of names that collide are refused before anything
    is written; a folder appears whole or not at all, by Spark's commit."""
    named = entries.withColumn("f", folder_name(F.col("identifier"))).select("*", F.col("f.name").alias("name"), F.col("f.error").alias("error")).drop("f")
    bad = named.where("error IS NOT NULL").select("identifier").unionByName(collisions(named).join(named.withColumn("name", F.lower("name")), "name").select("identifier"))
    if first := bad.take(1):
        raise ValueError(f"{first[0][0]!r}: no folder of its own")
    named.drop("error").write.mode("append").partitionBy("jurisdiction_code").parquet(path)


def manifest(runs: DataFrame) -> DataFrame:
    """One row: start, number of runs, bytes, and the last HISTORY runs, oldest first."""
    recent = runs.orderBy(F.desc("finished_at"), F.desc("id")).limit(HISTORY)
    history = recent.agg(F.array_sort(F.collect_list(F.struct("finished_at", "id"))).alias("history"))
    totals = runs.agg(F.min("finished_at").alias("started_at"), F.count("*").alias("runs"), F.sum("bytes").alias("bytes"))
    return totals.withColumn("history", history.scalar())
