"""Deduplication against a stored snapshot and the upsert into its next version.

A snapshot is a table keyed by (jurisdiction_code, source_id). Every step is one join over whole sets: nothing is looked up row
by row. ``Snapshots`` stores versions beside each other and moves a pointer, so a reader never sees half a version and a plan
never overwrites what it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["jurisdiction_code", "source_id"]


def resolved_hash(case_hash: Column, candidate_hash: Column, computed: Column) -> Column:
    """First of the source's hash, the candidate's and the fingerprint that is not empty."""
    return F.coalesce(F.nullif(case_hash, F.lit("")), F.nullif(candidate_hash, F.lit("")), computed)


def decide(candidates: DataFrame, snapshot: DataFrame, prefetch: bool) -> DataFrame:
    """Adds ``action``: insert what is unknown; skip what has the stored hash (before fetching: only if there is one); else update. Beside
    it stands what is stored of the record: its hash and, where the snapshot has them, id, revision and last_seen_at; no other column
    of the snapshot is read."""
    stored = snapshot.select(*KEY, F.col("content_hash").alias("stored_hash"), *[F.col(c).alias(f"stored_{c}") for c in ("id", "revision", "last_seen_at") if c in snapshot.columns])
    joined = candidates.join(stored.withColumn("__known", F.lit(True)), KEY, "left")
    same = F.col("content_hash") == F.col("stored_hash")
    if prefetch:
        same = same & (F.col("content_hash") != "")
    action = F.when(F.col("__known").isNull(), "insert").when(F.coalesce(same, F.lit(False)), "skip").otherwise("update")
    return joined.withColumn("action", action).drop("__known")


#: Types whose maximum is aggregated in place, without a sort.
_FIXED = (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType)


def last_of_each(candidates: DataFrame, order: list[str]) -> DataFrame:
    """The last offer of each key, by a partially aggregated maximum rather than a window, so a hot key costs one row per task.

    The maximum of a struct with texts would sort all rows of a task. So where ``order`` is one column of fixed width, its maximum alone is
    aggregated, by hashing; rows meet it by key and order, which spreads a hot key, and only rows equal in both are compared as wholes."""
    rest = [c for c in candidates.columns if c not in (*KEY, *order)]
    if len(order) == 1 and isinstance(candidates.schema[order[0]].dataType, _FIXED):
        last = candidates.groupBy(*KEY).agg(F.max(order[0]).alias(order[0]))
        if not rest:
            return last
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*KEY, *order)]
        candidates = candidates.join(last.toDF(*[f"__{c}" for c in last.columns]), same, "left_semi")
    top = candidates.groupBy(*KEY).agg(F.max(F.struct(*order, *rest)).alias("t"))
    return top.select(*KEY, *[F.col(f"t.{c}").alias(c) for c in (*order, *rest)])


def upsert(snapshot: DataFrame, offers: DataFrame, now: Column, order: str | None = None) -> DataFrame:
    """Next snapshot: new keys at revision 1, changed ones in place at the next revision, equal ones only touched. ``offers`` has
    at most one row per key. Topics and reviews are tables of their own, so an update leaves them alone. With ``order``, a column of both,
    an offer that isn't after the stored one counts for nothing, so that offers may come late or twice."""
    placed = [order] if order else []
    old = snapshot.select(*KEY, F.struct("content_hash", "title", "revision", "first_seen_at", "last_seen_at", *placed).alias("o"))
    new = offers.select(*KEY, F.struct("content_hash", "title", *placed).alias("n"))
    both = old.join(new, KEY, "full_outer")
    absent, unknown, same = F.col("n").isNull(), F.col("o").isNull(), F.col("n.content_hash") == F.col("o.content_hash")
    if order:
        absent = absent | F.coalesce(F.col(f"n.{order}") <= F.col(f"o.{order}"), F.lit(False))
    keeps = absent | F.coalesce(same, F.lit(False))
    pick = lambda c: F.when(keeps, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return both.select(
        *KEY, pick("content_hash"), pick("title"),
        F.when(unknown, 1).when(keeps, F.col("o.revision")).otherwise(F.col("o.revision") + 1).alias("revision"),
        F.when(unknown, now).otherwise(F.col("o.first_seen_at")).alias("first_seen_at"),
        F.when(absent, F.col("o.last_seen_at")).otherwise(now).alias("last_seen_at"),
        *[F.when(absent, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in placed],
    )


def replace_children(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """Children of changed parents are replaced wholesale; all others stay. ``changed``: case_id."""
    kept = old.join(changed.select("case_id").distinct(), "case_id", "left_anti")
    return kept.unionByName(new.join(changed.select("case_id").distinct(), "case_id", "left_semi"))


def upsert_courts(courts: DataFrame, named: DataFrame) -> DataFrame:
    """Courts by (jurisdiction_code, source_identifier): what is named anew overwrites all descriptive fields, what is not stays. Of
    several rows for one court the last by name counts. Seeding a vocabulary is the same, and doing it twice changes nothing."""
    key = ["jurisdiction_code", "source_identifier"]
    rest = [c for c in courts.columns if c not in key]
    new = named.groupBy(*key).agg(F.max(F.struct(*rest)).alias("n"))
    both = courts.select(*key, F.struct(*rest).alias("o")).join(new, key, "full_outer")
    return both.select(*key, *[F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest])


def resolve_citations(citations: DataFrame, cases: DataFrame) -> DataFrame:
    """Adds the id of the case that a citation names, where there is one (an extension). Of cases with one identifier the first counts."""
    known = cases.groupBy(F.col("source_id").alias("target")).agg(F.min("id").alias("target_case_id"))
    return citations.join(known, "target", "left")


def distinct_citations(citations: DataFrame) -> DataFrame:
    """First of each (case, target, type) by position; blank targets are dropped."""
    some = citations.withColumn("target", F.trim("target")).where("target <> ''")
    rest = [c for c in some.columns if c not in ("case_id", "target", "citation_type", "position")]
    first = some.groupBy("case_id", "target", "citation_type").agg(F.min(F.struct("position", *rest)).alias("f"))
    return first.select("case_id", "target", "citation_type", "f.*")


class Snapshots:
    """Versions of a table below one path: ``v=<n>`` folders and a one-row pointer table that names the current one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        jvm = self.spark._jvm
        pointers = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_current")
        if not pointers.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(pointers):
            return 0
        return int(self.spark.read.parquet(f"{self.path}/_current/*").agg(F.max("version")).first()[0] or 0)

    def read(self, schema: str) -> DataFrame:
        n = self.version()
        return self.spark.read.schema(schema).parquet(f"{self.path}/v={n}") if n else self.spark.createDataFrame([], schema)

    def commit(self, table: DataFrame) -> int:
        """Write the next version, then its pointer. A version without a pointer was never committed and is written anew."""
        n = self.version() + 1
        table.write.mode("overwrite").parquet(f"{self.path}/v={n}")
        self.spark.range(1).select(F.lit(n).alias("version")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_current/{n:08d}")
        return n
