"""Review queue: orders, the state machine of a review, recorded decisions and their effect on publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.search import Key, beyond

#: Sort to what it sorts by, whether downwards, and whether nulls come first. Ids break ties the same way.
SORTS = {"flagged_desc": ("flagged_on", True, False), "flagged_asc": ("flagged_on", False, True), "score_asc": ("score", False, True), "score_desc": ("score", True, False)}


def keys(sort: str) -> list[Key]:
    column, descending, nulls_first = SORTS[sort]
    return [Key(F.col(column), descending, nulls_first), Key(F.col("id"), descending)]


# Statuses of a review, and how many may be asked for at once.
STATUSES, STATUSES_MOST = ("pending", "decided", "withdrawn"), 16


def parse_statuses(values: list[str]) -> tuple[str, ...]:
    """The statuses that repeated parameters with commas ask for, each once: pending without any; ``any`` asks for all, that is no filter."""
    asked = [x for v in values for x in (p.strip().lower() for p in v.split(",")) if x]
    if not asked:
        return ("pending",)
    if "any" in asked:
        return ()
    if len(asked) > STATUSES_MOST or not set(asked) <= set(STATUSES):
        raise ValueError(f"status: at most {STATUSES_MOST} of {', '.join(STATUSES)}, or any")
    return tuple(dict.fromkeys(asked))


def queue(reviews: DataFrame, cases: DataFrame, sort: str, statuses: tuple[str, ...] = ("pending",), jurisdictions: tuple[str, ...] = (), list_version: str | None = None, decided_by: str | None = None) -> DataFrame:
    """Reviews by status, jurisdiction of their case, list version and who decided, in a total order; no status means any."""
    rows = _chosen(reviews, cases, statuses, jurisdictions, list_version, decided_by)
    return rows.orderBy(*[k.sort() for k in keys(sort)])


def queue_after(queued: DataFrame, sort: str, values: list, size: int) -> DataFrame:
    """The reviews of ``queue`` that follow the one with these values of its keys."""
    return queued.where(beyond(keys(sort), values)).orderBy(*[k.sort() for k in keys(sort)]).limit(size)


def count(reviews: DataFrame, cases: DataFrame, statuses: tuple[str, ...] = ("pending",), jurisdictions: tuple[str, ...] = (), list_version: str | None = None, decided_by: str | None = None) -> DataFrame:
    """How many reviews ``queue`` would give, as one row; nothing is sorted."""
    return _chosen(reviews, cases, statuses, jurisdictions, list_version, decided_by).agg(F.count("*").alias("n"))


def _chosen(reviews: DataFrame, cases: DataFrame, statuses: tuple[str, ...], jurisdictions: tuple[str, ...], list_version: str | None, decided_by: str | None) -> DataFrame:
    out = reviews.where(F.col("status").isin(*statuses)) if statuses else reviews
    if list_version:
        out = out.where(F.col("list_version") == list_version)
    if jurisdictions:
        mine = cases.where(F.col("jurisdiction_code").isin(*jurisdictions)).select(F.col("id").alias("__case"))
        out = out.join(mine, out["case_id"] == mine["__case"], "left_semi")
    return out.where(F.col("decided_by") == decided_by) if decided_by else out


def currency(reviews: DataFrame, cases: DataFrame) -> DataFrame:
    """Whether a decision was taken on the case's present revision."""
    joined = reviews.join(cases.select(F.col("id").alias("case_id"), "revision", "is_published"), "case_id")
    current = F.col("decision").isNotNull() & (F.col("decided_revision") == F.col("revision"))
    return joined.withColumn("decision_is_current", F.coalesce(current, F.lit(False)))


def transition(old: DataFrame) -> DataFrame:
    """Next state of each review, from rows with the old review (status null: there is none), the new verdict (needs_review, score)
    and the new content hash.

    In the band: none becomes pending; another content than the flagged one makes it pending again and keeps a decision. Out
    of the band: a pending review without a decision is withdrawn. Then a standing rejection unpublishes, and any other
    decision gives back what a rejection had taken.
    """
    none, other = F.col("status").isNull(), ~F.col("flagged_hash").eqNullSafe(F.col("content_hash"))
    flags = F.col("needs_review") & (none | other)
    withdraws = ~F.col("needs_review") & (F.col("status") == "pending") & F.col("decision").isNull()
    status = F.when(flags, "pending").when(withdraws, "withdrawn").otherwise(F.col("status"))
    rejected = (F.col("decision") == "rejected") & ~none
    restores = ~none & F.col("suppressed") & ~F.coalesce(rejected, F.lit(False))
    rejects = F.coalesce(rejected, F.lit(False))
    return old.select(
        "*",
        status.alias("new_status"),
        F.when(flags, F.col("content_hash")).otherwise(F.col("flagged_hash")).alias("new_flagged_hash"),
        F.when(rejects, False).when(F.coalesce(restores, F.lit(False)), True).otherwise(F.col("is_published")).alias("new_published"),
        F.when(rejects, F.col("is_published") | F.coalesce("suppressed", F.lit(False))).when(F.coalesce(restores, F.lit(False)), False).otherwise(F.coalesce("suppressed", F.lit(False))).alias("new_suppressed"),
    )


def record_decisions(reviews: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviews, history): the last decision of each review stands; all are kept. Review flags of cases do not change."""
    stamp = F.struct("decided_at", "decision_id", "decision", "decided_by", "case_revision")
    last = decisions.groupBy("review_id").agg(F.max(stamp).alias("d"))
    joined = reviews.join(last, reviews["id"] == last["review_id"], "left")
    kept = [c for c in reviews.columns if c not in ("status", "decision", "decided_revision")]
    has: Column = F.col("d").isNotNull()
    standing = joined.select(*kept, F.when(has, "decided").otherwise(F.col("status")).alias("status"), F.coalesce("d.decision", "decision").alias("decision"), F.coalesce("d.case_revision", "decided_revision").alias("decided_revision"))
    return standing, decisions
