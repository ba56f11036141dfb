"""What is shown of a case: the summary in a list, and the detail with its child lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a dimension (some 100 bytes each) that may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
SUMMARY = (
    "id", "jurisdiction_code", "jurisdiction_name", "source_id", "source_system", "court_id", "court_name", "title", "abstract", "decision_date", "publication_date",
    "case_numbers", "language", "law_domain", "law_subfield", "procedure_type", "outcome", "source_url",
)
#: What the detail adds to the summary.
HISTORY = ("filing_date", "revision", "first_seen_at", "last_seen_at", "updated_at")
#: Child lists: their fields, in the order of a row; raw payloads are never among them. Each is ordered by its first field.
CHILDREN = {
    "documents": ("id", "language", "doc_type", "format", "full_text", "source_url", "byte_size", "retrieved_at"),
    "parties": ("ordinal", "id", "name", "role", "party_type"),
    "topics": ("slug", "label", "confidence", "assigned_by"),
    "keyword_matches": ("id", "term_id", "term", "list_version", "field", "weight_applied", "match_count", "snippet"),
    "citations": ("position", "target_identifier", "target_scheme", "citation_type", "target_title", "target_url"),
}


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def named(cases: DataFrame, jurisdictions: DataFrame, courts: DataFrame) -> DataFrame:
    """Cases with the names of their jurisdiction and court, null where unknown."""
    out = cases.join(_few(jurisdictions.select(F.col("code").alias("jurisdiction_code"), F.col("name").alias("jurisdiction_name"))), "jurisdiction_code", "left")
    return out.join(_few(courts.select(F.col("id").alias("court_id"), F.col("name").alias("court_name"))), "court_id", "left")


def summary(cases: DataFrame, jurisdictions: DataFrame, courts: DataFrame) -> DataFrame:
    """The 18 fields of a case in a list; other columns are left out."""
    return named(cases, jurisdictions, courts).select(*SUMMARY)


def published(cases: DataFrame, jurisdiction: str, source_id: str) -> DataFrame:
    """The case of a code and an identifier, at most one row; one that isn't published is as if it were not there."""
    return cases.where((F.col("jurisdiction_code") == jurisdiction) & (F.col("source_id") == source_id) & F.coalesce(F.col("is_published"), F.lit(False)))


def detail(cases: DataFrame, jurisdictions: DataFrame, courts: DataFrame, **children: DataFrame) -> DataFrame:
    """Summary, history and the child lists of CHILDREN. children: tables with case_id and the list's fields; a missing one is an empty list.

    Cases and all children are one tagged union, so there is one shuffle by case, whatever the number of lists, and no child meets a
    child of another list. A child without a case is left out; a case without children has empty lists. A case's lists are one row:
    for many cases at once, restrict ``cases`` first, and the children by a semi-join with them.
    """
    if unknown := children.keys() - CHILDREN.keys():
        raise ValueError(f"{sorted(unknown)}: no such lists")
    whole = F.struct(*SUMMARY, *HISTORY)
    rows = named(cases, jurisdictions, courts).select(F.col("id").alias("case_id"), whole.alias("case"))
    for name, table in children.items():
        rows = rows.unionByName(table.select("case_id", F.struct(*CHILDREN[name]).alias(name)), allowMissingColumns=True)
    lists = [F.sort_array(F.collect_list(name)).alias(name) for name in children]  # nulls are no elements
    found = rows.groupBy("case_id").agg(F.first("case", ignorenulls=True).alias("case"), *lists).where("case IS NOT NULL")
    empty = [F.array().alias(name) for name in CHILDREN if name not in children]
    return found.select("case.*", *children, *empty)
