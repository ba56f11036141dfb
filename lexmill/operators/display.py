"""Coercions and orders of what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Document types in reading order.
READING_ORDER = ["judgment", "opinion", "order", "summary", "other"]


def counts(raw: DataFrame) -> DataFrame:
    """(code, case_count, map_feature_id) from text: counts that are no number or negative are dropped, others lose their fraction;
    a missing feature is that of the code."""
    n = F.expr("try_cast(case_count AS double)")
    good = raw.withColumn("n", n).where(F.col("n").isNotNull() & ~F.isnan("n") & (F.col("n") >= 0) & F.col("code").isNotNull())
    return good.select("code", F.floor("n").cast("long").alias("case_count"), F.coalesce("map_feature_id", "code").alias("map_feature_id"))


def summaries(rows: DataFrame, payload: str) -> DataFrame:
    """Case summaries out of loose JSON, beside the other columns: rows whose code or id is no text, or an empty one, are dropped; any
    other value that is no text is null."""
    found = F.try_parse_json(payload)
    names = ("jurisdiction_code", "jurisdiction_name", "source_id", "title", "court_name", "decision_date")
    # a variant that is text is one whose type is a string; casting alone would turn numbers into text
    text = lambda n: F.when(F.schema_of_variant(F.try_variant_get(found, f"$.{n}", "variant")) == "STRING", F.try_variant_get(found, f"$.{n}", "string"))
    read = rows.select(*[c for c in rows.columns if c != payload], *[text(n).alias(n) for n in names])
    return read.where("jurisdiction_code <> '' AND source_id <> ''")


def reading_order(documents: DataFrame, own_language: Column) -> DataFrame:
    """Documents with text: by type, the case's own language first, then by language and id."""
    kind = F.array_position(F.lit(READING_ORDER), F.col("doc_type"))
    some = documents.where(F.coalesce(F.trim("text"), F.lit("")) != "")
    return some.withColumn("rank", F.struct(F.when(kind == 0, len(READING_ORDER) + 1).otherwise(kind).alias("kind"), (F.col("language") != own_language).alias("foreign"), "language", "id"))


def short_date(day: Column) -> Column:
    """5 March 2024"""
    return F.date_format(day, "d MMMM yyyy")


def pager(page: int, pages: int, around: int = 1) -> list[int | None]:
    """Page numbers to offer: the first, the last, those around the present one; None is a gap."""
    if not 1 <= page <= pages:
        raise ValueError("page: from 1 to the last")
    shown = sorted({1, pages, *(p for p in range(page - around, page + around + 1) if 1 <= p <= pages)})
    out: list[int | None] = []
    for p in shown:
        if out and out[-1] is not None and p - out[-1] == 2:
            out.append(p - 1)
        elif out and out[-1] is not None and p - out[-1] > 2:
            out.append(None)
        out.append(p)
    return out
