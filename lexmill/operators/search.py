"""Search over cases: criteria, predicates, orders, pages, counts."""

from __future__ import annotations

import base64
import datetime as dt
import json
import re
from dataclasses import dataclass, replace
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import contains_folded

# Bounds of parameters.
PAGE_DEFAULT, PAGE_MOST, TERM_MOST, JURISDICTIONS_MOST = 20, 100, 200, 32
CODE, SLUG = re.compile(r"[A-Z0-9]{2,8}"), re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")
SORTS = ("date_desc", "date_asc", "relevance")


@dataclass(frozen=True)
class Key:
    """A part of an order: what it sorts by, which way, and whether nulls come first."""

    column: Column
    descending: bool
    nulls_first: bool = False

    def of(self, column: Column) -> Key:
        return replace(self, column=column)

    def sort(self, reverse: bool = False) -> Column:
        down, first = self.descending != reverse, self.nulls_first != reverse
        if down:
            return self.column.desc_nulls_first() if first else self.column.desc_nulls_last()
        return self.column.asc_nulls_first() if first else self.column.asc_nulls_last()

    def after(self, value: object) -> Column:
        """Whether the row comes strictly after one with this value."""
        if value is None:
            return self.column.isNotNull() if self.nulls_first else F.lit(False)
        further = self.column < F.lit(value) if self.descending else self.column > F.lit(value)
        return F.coalesce(further, F.lit(not self.nulls_first))


@dataclass(frozen=True)
class Criteria:
    """A logical query. Empty parts filter nothing."""

    term: str | None = None
    jurisdictions: tuple[str, ...] = ()
    law_domain: str | None = None
    law_subfield: str | None = None
    language: str | None = None
    court_id: int | None = None
    topic: str | None = None
    decided_from: dt.date | None = None
    decided_until: dt.date | None = None
    include_unpublished: bool = False
    sort: str = "date_desc"

    def __post_init__(self) -> None:
        if self.sort not in SORTS:
            raise ValueError(f"sort: one of {SORTS}")
        if self.term is not None and len(self.term) > TERM_MOST:
            raise ValueError(f"term: at most {TERM_MOST} characters")
        if len(self.jurisdictions) > JURISDICTIONS_MOST or not all(CODE.fullmatch(c) for c in self.jurisdictions):
            raise ValueError("jurisdictions: at most 32 codes of 2 to 8 capitals and digits")
        if self.topic is not None and not SLUG.fullmatch(self.topic):
            raise ValueError("topic: a slug")
        if self.decided_from and self.decided_until and self.decided_from > self.decided_until:
            raise ValueError("decided_from: not after decided_until")

    def active(self) -> int:
        """How many filters are set."""
        return sum(bool(x) for x in (self.term, self.jurisdictions, self.law_domain, self.law_subfield, self.language, self.court_id is not None, self.topic, self.decided_from or self.decided_until))

    def to_query(self) -> str:
        """Canonical order; defaults are left out."""
        pairs = [("q", self.term), *[("jurisdiction", c) for c in self.jurisdictions], ("law_domain", self.law_domain), ("law_subfield", self.law_subfield), ("language", self.language), ("court_id", self.court_id), ("topic", self.topic), ("date_from", self.decided_from), ("date_to", self.decided_until), ("sort", self.sort if self.sort != "date_desc" else None)]
        return urlencode([(k, v) for k, v in pairs if v not in (None, "")])

    @classmethod
    def from_query(cls, query: str) -> Criteria:
        names = {"q": "term", "law_domain": "law_domain", "law_subfield": "law_subfield", "language": "language", "topic": "topic", "sort": "sort"}
        out = cls()
        for k, v in parse_qsl(query):
            if k == "jurisdiction":
                out = replace(out, jurisdictions=(*out.jurisdictions, v))
            elif k == "court_id":
                out = replace(out, court_id=bounded(v, 1, 2**31 - 1, k))
            elif k in ("date_from", "date_to"):
                out = replace(out, **{"decided_from" if k == "date_from" else "decided_until": dt.date.fromisoformat(v)})
            elif k in names:
                out = replace(out, **{names[k]: v.strip() or None})
            else:
                raise ValueError(f"{k}: no such filter")
        return out


def bounded(value: str | int, least: int, most: int, name: str) -> int:
    """Out of bounds is an error; nothing is clamped."""
    if not re.fullmatch(r"-?[0-9]+", str(value)) or not least <= int(value) <= most:
        raise ValueError(f"{name}: a whole number from {least} to {most}")
    return int(value)


# Cases in a list of the newest ones.
LATEST_DEFAULT, LATEST_MOST = 20, 50


def latest_limit(value: str | None) -> int:
    """How many of the newest cases are asked for; out of bounds is an error."""
    return LATEST_DEFAULT if value is None or not value.strip() else bounded(value.strip(), 1, LATEST_MOST, "limit")


def term_predicate(term: str, columns: tuple[str, ...] = ("title", "abstract", "source_id")) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(contains_folded(F.col(c), term), F.lit(False))
    return out


def matching(cases: DataFrame, c: Criteria, documents: DataFrame | None = None, topics: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Cases that meet all criteria. With ``documents``, a term also matches in a document's full text: the ids of those are
    found first, without their texts, and marked by a left join on distinct ids, so no case is repeated. ``topics``: the tables of topics
    (id, slug) and of links (case_id, topic_id); without them cases have a column ``topic_slug``."""
    out = cases if c.include_unpublished else cases.where("is_published")
    if c.jurisdictions:
        out = out.where(F.col("jurisdiction_code").isin(*c.jurisdictions))
    for name in ("law_domain", "law_subfield", "language", "court_id"):
        if getattr(c, name) is not None:
            out = out.where(F.col(name) == getattr(c, name))
    if c.topic and topics:
        tagged = topics[1].join(topics[0].where(F.col("slug") == c.topic).select(F.col("id").alias("topic_id")), "topic_id", "left_semi")
        out = out.join(tagged.select(F.col("case_id").alias("id")), "id", "left_semi")
    elif c.topic:
        out = out.where(F.col("topic_slug") == c.topic)
    if c.decided_from:
        out = out.where(F.col("decision_date") >= F.lit(c.decided_from))
    if c.decided_until:
        out = out.where(F.col("decision_date") <= F.lit(c.decided_until))
    if c.term:
        if documents is None:
            return out.where(term_predicate(c.term))
        hits = documents.where(contains_folded(F.col("full_text"), c.term)).select(F.col("case_id").alias("__hit")).distinct()
        out = out.join(hits, out["id"] == hits["__hit"], "left").where(term_predicate(c.term) | F.col("__hit").isNotNull()).drop("__hit")
    return out


def keys(c: Criteria) -> list[Key]:
    """What cases are ordered by: every order is total, as it ends on the id. Cases without a date come last, either way."""
    if c.sort == "date_asc":
        return [Key(F.col("decision_date"), False), Key(F.col("id"), False)]
    by_date = [Key(F.col("decision_date"), True), Key(F.col("id"), True)]
    if c.sort == "relevance" and c.term:
        hit = lambda name: F.coalesce(contains_folded(F.col(name), c.term), F.lit(False))
        return [Key(F.when(hit("title"), 0).when(hit("abstract"), 1).otherwise(2), False), *by_date]
    return by_date


def order(c: Criteria) -> list[Column]:
    return [k.sort() for k in keys(c)]


def page(found: DataFrame, c: Criteria, number: int = 1, size: int = PAGE_DEFAULT) -> DataFrame:
    """One page, as offset and limit over a total order. For deep reads use ``after``."""
    if number < 1 or size < 1:
        raise ValueError("page and size: 1 at least")
    return found.orderBy(*order(c)).offset((number - 1) * size).limit(size)


def beyond(by: list[Key], values: list) -> Column:
    """Whether a row comes after the row that has these values, in an order over several columns that may be null."""
    out, equal = F.lit(False), F.lit(True)
    for key, value in zip(by, values, strict=True):
        out, equal = out | (equal & key.after(value)), equal & key.column.eqNullSafe(F.lit(value))
    return out


def page_after(found: DataFrame, c: Criteria, cursor: str | None = None, size: int = PAGE_DEFAULT) -> DataFrame:
    """The page that follows ``cursor`` (see ``cursor_of``), or the first one. Unlike an offset it costs the same at any depth, and loses
    or repeats no row when cases come or go between two pages."""
    if size < 1:
        raise ValueError("size: 1 at least")
    by = keys(c)
    rows = found if cursor is None else found.where(beyond(by, _values(cursor, c)))
    return rows.orderBy(*[k.sort() for k in by]).limit(size)


def cursor_of(page_: DataFrame, c: Criteria) -> str | None:
    """Cursor of a page's last row, as an opaque text; none for an empty page."""
    by = keys(c)
    last = page_.select(*[k.column.alias(f"k{i}") for i, k in enumerate(by)]).orderBy(*[k.of(F.col(f"k{i}")).sort(reverse=True) for i, k in enumerate(by)]).first()
    if last is None:
        return None
    values = [x.isoformat() if isinstance(x, dt.date) else x for x in last]
    return base64.urlsafe_b64encode(json.dumps([c.to_query(), values]).encode()).decode().rstrip("=")


def _values(cursor: str, c: Criteria) -> list:
    """Values of a cursor; one that is damaged, or belongs to another search, is an error."""
    try:
        query, values = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        *rank, day, last_id = values
        if query != c.to_query() or len(values) != len(keys(c)) or not all(type(x) is int for x in (*rank, last_id)):
            raise ValueError
        return [*rank, None if day is None else dt.date.fromisoformat(day), last_id]
    except (ValueError, TypeError) as e:
        raise ValueError("cursor: not one of this search") from e


def after(found: DataFrame, last_id: int, size: int) -> DataFrame:
    """The next rows by id; costs the same at any depth."""
    return found.where(F.col("id") > last_id).orderBy("id").limit(size)


def envelope(found: DataFrame, number: int, size: int) -> DataFrame:
    """Totals of a paged result, as one row."""
    total = found.agg(F.count("*").alias("total"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long")
    return total.select("total", F.lit(number).cast("long").alias("page"), F.lit(size).cast("long").alias("page_size"), pages.alias("page_count"), (F.lit(number) < pages).alias("has_next"))


def latest(cases: DataFrame, n: int) -> DataFrame:
    return cases.where("is_published").orderBy(*order(Criteria())).limit(n)


def by_key(rows: DataFrame, **key: object) -> DataFrame:
    """Point look-up; the caller expects one row at most."""
    for name, value in key.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows
