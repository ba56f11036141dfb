"""Weighted keyword lists: validation, one pass for all literals, and verdicts by column expressions.

An Arrow function finds, in one automaton pass over each field, how often each term stands there and where first (``phrases``); Spark
has no expression for thousands of literals with offsets. All that follows, gates, field multipliers, veto, review band
and the sentence of reasons, are expressions over the array of found terms.

Literals that fold alike in case and sides are treated together: at one place the longest whose sides are free is found and
shorter ones are not; hits may overlap. Treatments are independent of each other.
"""

from __future__ import annotations

import collections
import datetime as dt
import functools
import json
import os
import re
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lexmill.functions.text import fold_string
from lexmill.operators.phrases import Earliest, Finder, Text, Treatment, is_word

EPSILON, BAND, SNIPPET, REASON_TERMS, SUBSTRING_LEAST = 1e-9, 3.0, 90, 8, 6
MATCHES = ("word", "phrase", "substring", "regex")
# Categories of terms.
CATEGORIES = ("active_substance", "product_class", "brand", "statute", "authority", "procedure", "crop_or_practice", "exposure_or_harm", "environment", "general")


# Wording of reasons.
NO_TERM = "no curated term contributed weight ({source})"
DECIDED = "score {score:g} {comparison} min_score {least:g}{band} ({source}); matched: {terms}"
IN_BAND = ", inside the review band [{least:g}, {ceiling:g})"
VETOED = "vetoed by exclusion {pattern!r} in {field} (matched {text!r}): {why}"


class InvalidList(ValueError):
    """A keyword list that must not be used."""


@dataclass(frozen=True)
class Term:
    id: str
    term: str
    lang: str
    category: str
    weight: float
    match: str = "word"
    case_sensitive: bool = False
    case_sensitive_exception: bool = False
    aliases: tuple[str, ...] = ()
    requires: tuple[str, ...] = ()
    note: str = ""

    @property
    def literals(self) -> tuple[str, ...]:
        return (self.term, *self.aliases)


@dataclass(frozen=True)
class Exclusion:
    pattern: str
    reason: str
    match: str = "phrase"


@dataclass(frozen=True)
class KeywordList:
    jurisdiction: str
    list_version: str
    min_score: float
    fields: tuple[tuple[str, float], ...]
    terms: tuple[Term, ...]
    exclusions: tuple[Exclusion, ...] = ()
    review_band: float = BAND
    count_term_once: bool = True
    languages: tuple[str, ...] = field(default=())

    @property
    def ceiling(self) -> float:
        return self.min_score + max(self.review_band, 0.0)


def _shape(value: Any, kinds: dict[str, Any], required: set[str], where: str, errors: list[str]) -> bool:
    if not isinstance(value, dict):
        errors.append(f"at {where}: not an object")
        return False
    errors += [f"at {where}: {k!r} is missing" for k in sorted(required - value.keys())]
    errors += [f"at {where}: {k!r} is not allowed" for k in sorted(value.keys() - kinds.keys())]
    for k, check in kinds.items():
        if k in value and not check(value[k]):
            errors.append(f"at {where}/{k}: {value[k]!r} is not valid")
    return not required - value.keys()


def _rules() -> tuple[dict, dict, dict, dict]:
    text = lambda least=0, pattern=None: lambda v: isinstance(v, str) and len(v) >= least and (pattern is None or re.search(pattern, v) is not None)
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v >= 0
    flag = lambda v: isinstance(v, bool)
    many = lambda check, least=0: lambda v: isinstance(v, list) and len(v) >= least and all(map(check, v))
    whole = {
        "schema_version": lambda v: v == "1.0.0", "jurisdiction": text(0, r"\A[A-Z]{2}\Z"), "jurisdiction_name": text(1), "list_version": text(0, r"\A\d+\.\d+\.\d+\Z"),
        "updated": text(0, r"\A\d{4}-\d\d-\d\d\Z"), "maintainer": text(), "languages": many(text(0, r"\A[a-z]{2}\Z"), 1), "notes": text(), "scoring": lambda v: True,
        "terms": many(lambda v: True, 1), "exclusions": many(lambda v: True), "$schema": text(),
    }
    scoring = {
        "min_score": lambda v: number(v) and v > 0, "review_band": number, "count_term_once": flag,
        "fields": lambda v: isinstance(v, dict) and {"title", "abstract", "full_text"} <= v.keys() and all(map(number, v.values())),
    }
    term = {
        "id": text(0, r"\A[a-z]{2}-[a-z0-9-]+\Z"), "term": text(2), "lang": text(0, r"\A[a-z]{2}\Z"), "category": lambda v: v in CATEGORIES, "weight": number, "match": lambda v: v in MATCHES,
        "case_sensitive": flag, "case_sensitive_exception": flag, "aliases": many(text(2)), "requires": many(text()), "note": text(),
    }
    exclusion = {"pattern": text(1), "match": lambda v: v in MATCHES, "reason": text(1)}
    return whole, scoring, term, exclusion


def _abbreviates(literal: str) -> bool:
    """One word, and no small letter in it."""
    return len(literal.split()) == 1 and not any(map(str.islower, literal))


def _consistency(terms: tuple[Term, ...]) -> list[str]:
    """What holds between terms, and between a term and its literals."""
    times = collections.Counter(t.id for t in terms)
    rules = [
        (lambda t: times[t.id] > 1, "duplicate id"),
        (lambda t: t.id in t.requires, "requires itself"),
        (lambda t: not times.keys() >= set(t.requires), "requires an unknown term"),
        (lambda t: t.match == "substring" and min(len(x.strip()) for x in t.literals) < SUBSTRING_LEAST, f"a substring literal has under {SUBSTRING_LEAST} characters"),
        (lambda t: _wordy(t) and not t.case_sensitive_exception, "a case_sensitive literal is no abbreviation"),
        (lambda t: t.case_sensitive_exception and not _wordy(t), "needs no case_sensitive_exception"),
    ]
    return [f"term {t.id!r}: {what}" for t in terms for broken, what in rules if broken(t)]


def _wordy(t: Term) -> bool:
    """Case counts for it although a literal of it is an ordinary word."""
    return t.case_sensitive and t.match != "regex" and not all(map(_abbreviates, t.literals))


def parse(document: Any) -> KeywordList:
    """A list from its JSON form; every violation is reported."""
    whole, scoring, term, exclusion = _rules()
    errors: list[str] = []
    if not _shape(document, whole, {"schema_version", "jurisdiction", "list_version", "languages", "scoring", "terms"}, "<root>", errors):
        raise InvalidList("; ".join(errors))
    _shape(document["scoring"], scoring, {"min_score", "fields"}, "scoring", errors)
    for kind, rules, required in (("terms", term, {"id", "term", "lang", "category", "weight"}), ("exclusions", exclusion, {"pattern", "reason"})):
        for i, x in enumerate(document.get(kind) or []):
            _shape(x, rules, required, f"{kind}/{i}", errors)
    if errors:
        raise InvalidList("; ".join(errors))
    s = document["scoring"]
    terms = tuple(Term(**{k: tuple(v) if isinstance(v, list) else v for k, v in t.items()}) for t in document["terms"])
    if errors := _consistency(terms):
        raise InvalidList("; ".join(errors))
    return KeywordList(
        document["jurisdiction"], document["list_version"], float(s["min_score"]), tuple((k, float(v)) for k, v in s["fields"].items()), terms,
        tuple(Exclusion(**x) for x in document.get("exclusions") or []), float(s.get("review_band", BAND)), bool(s.get("count_term_once", True)), tuple(document["languages"]),
    )


@functools.lru_cache(32)
def _loaded(path: str, size: int, changed: int) -> KeywordList:
    with open(path, encoding="utf-8") as f:
        return parse(json.load(f))


def load(path: str) -> KeywordList:
    """The list of a file; it is read again only after it has changed in size or time."""
    found = os.stat(path)
    return _loaded(os.path.abspath(path), found.st_size, found.st_mtime_ns)


# ---- finding --------------------------------------------------------------------------------------------------------


def folded(literal: str, cased: bool) -> str:
    return re.sub(r"\s+", " ", fold_string(literal, not cased)).strip()


def literals(terms: tuple[Term, ...]) -> list[tuple[str, Treatment, int]]:
    """Folded literals of all terms but regular expressions, with their treatment and the place of their term in the list. A side must be
    free if the literal has a word character there; sides of a substring never."""
    out = []
    for i, t in enumerate(terms):
        for x in (folded(x, t.case_sensitive) for x in t.literals if t.match != "regex"):
            free = [t.match != "substring" and is_word(c) for c in (x[0], x[-1])]
            out.append((x, Treatment(t.case_sensitive, *free), i))
    return out


class Scanner:
    """A list as one Python worker uses it."""

    def __init__(self, keywords: KeywordList):
        self.finder = Finder(literals(keywords.terms))
        self.patterns = [(i, re.compile(p, 0 if t.case_sensitive else re.IGNORECASE)) for i, t in enumerate(keywords.terms) if t.match == "regex" for p in t.literals]
        self.raw = [(k, re.compile(e.pattern, re.IGNORECASE)) for k, e in enumerate(keywords.exclusions) if e.match == "regex"]
        plain = [(k, e, folded(e.pattern, False)) for k, e in enumerate(keywords.exclusions) if e.match != "regex"]
        self.plain = [k for k, _, _ in plain]
        self.earliest = Earliest([(x, *(e.match != "substring" and is_word(c) for c in (x[0], x[-1]))) for _, e, x in plain])

    def veto(self, text: Text) -> tuple[int, str] | None:
        """The first exclusion that holds, and the words it is about."""
        met = {self.plain[i]: text.span(*span) for i, span in self.earliest.first(text).items()}
        for k, pattern in self.raw:  # regular expressions see white space as it is
            if k < min(met, default=k + 1) and (m := pattern.search(text.raw)):
                met[k] = m.span()
        if not met:
            return None
        k = min(met)
        return k, text.composed[met[k][0] : met[k][1]]

    def count(self, text: Text) -> dict[int, list[int]]:
        """Term to occurrences, start and end of the first; terms in the order in which they are met."""
        met: dict[int, list[int]] = {}
        spans = [(term, *text.span(start, end)) for term, start, end in self.finder.hits(text)]
        spans += [(term, *m.span()) for term, p in self.patterns for m in p.finditer(text.raw)]
        for term, start, end in spans:
            met.setdefault(term, [0, start, end])[0] += 1
        return met


@functools.lru_cache(16)
def _broadcast(keywords: KeywordList, application: str) -> Broadcast:
    """The compiled list, built once and sent to each worker process once."""
    return SparkSession.active().sparkContext.broadcast(Scanner(keywords))


def snippet(text: str, start: int, end: int, radius: int = SNIPPET) -> str:
    """A match with ``radius`` characters on either side, on one line; an ellipsis where more text follows."""
    shown = re.sub(r"\s+", " ", text[max(start - radius, 0) : end + radius]).strip()
    return "…" * (start > radius) + shown + "…" * (end + radius < len(text))


_HIT = [("term", pa.int32()), ("field", pa.int32()), ("n", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("snippet", pa.string())]
_FOUND = pa.struct([("veto", pa.struct([("exclusion", pa.int32()), ("field", pa.int32()), ("text", pa.string())])), ("hits", pa.list_(pa.struct(_HIT)))])
FOUND = "struct<veto: struct<exclusion: int, field: int, text: string>, hits: array<struct<term: int, field: int, n: int, start: int, end: int, text: string, snippet: string>>>"


def find(keywords: KeywordList, evidence: bool = True, **columns: Column) -> Column:
    """What a record's fields hold: the first exclusion met, or else all terms found, by field in the list's order and then as met.
    Terms, fields and exclusions are known by their places in the list. Fields that are not in the list are not read; null and
    empty ones hold nothing. Without ``evidence`` hits have neither text nor snippet."""
    places = [i for i, (name, _) in enumerate(keywords.fields) if name in columns]
    if not places:
        return F.lit(None).cast(FOUND)
    shared = _broadcast(keywords, SparkSession.active().sparkContext.applicationId)

    def one(scan: Scanner, record: tuple) -> dict:
        hits = []
        for i, raw in zip(places, record):
            if not raw:
                continue
            text = Text.of(raw)
            if veto := scan.veto(text):
                return {"veto": {"exclusion": veto[0], "field": i, "text": repr(veto[1])}, "hits": []}
            for term, (n, start, end) in scan.count(text).items():
                shown = {"text": text.composed[start:end], "snippet": snippet(text.composed, start, end)} if evidence else {}
                hits.append({"term": term, "field": i, "n": n, "start": start, "end": end, **shown})
        return {"veto": None, "hits": hits}

    @arrow_udf(FOUND)
    def run(*arrays: pa.Array) -> pa.Array:
        scan, step = shared.value, 256  # records whose texts are Python objects at a time
        parts = [pa.array([one(scan, r) for r in zip(*(a.slice(i, step).to_pylist() for a in arrays))], _FOUND) for i in range(0, len(arrays[0]), step)]
        return pa.concat_arrays(parts) if parts else pa.array([], _FOUND)

    return run.asNondeterministic()(*[columns[keywords.fields[i][0]] for i in places])


# ---- verdicts -------------------------------------------------------------------------------------------------------

VERDICT = "passed, score, vetoed, needs_review, reason, matches array<struct<term_id, field, weight, occurrences, start, end, matched_text, snippet, gated>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shortest(number: Column) -> Column:
    """A number in six significant digits at most, without zeros that say nothing."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6g", number), r"(\.\d*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")


def _table(values: list) -> Column:
    return F.array(*map(F.lit, values))


def _weighted(keywords: KeywordList, hits: Column) -> Column:
    """The hits with id and name, weight and gate. A term whose required terms aren't all there is gated, and weighs nothing."""
    factors = [m for _, m in keywords.fields]
    # fields by rank: the greatest multiplier first, of equals the first
    rank = {i: r for r, i in enumerate(sorted(range(len(factors)), key=lambda i: (-factors[i], i)))}
    ids, weights, rank = _table([t.id for t in keywords.terms]), _table([float(t.weight) for t in keywords.terms]), _table([rank[i] for i in range(len(factors))])
    names, factors = _table([n for n, _ in keywords.fields]), _table([float(m) for m in factors])
    place = {t.id: i for i, t in enumerate(keywords.terms)}
    needs = [(i, [place[r] for r in t.requires]) for i, t in enumerate(keywords.terms) if t.requires]
    wanted = F.create_map(*[x for i, r in needs for x in (F.lit(i), _table(r))]) if needs else None

    def over(met: Column) -> Column:
        def each(h: Column) -> Column:
            gated = F.coalesce(F.size(F.array_except(F.try_element_at(wanted, h["term"]), met)) > 0, F.lit(False)) if needs else F.lit(False)
            full = F.get(weights, h["term"]) * F.get(factors, h["field"])
            if keywords.count_term_once:  # the whole weight in the term's best field
                better = F.exists(hits, lambda x: (x["term"] == h["term"]) & (F.get(rank, x["field"]) < F.get(rank, h["field"])))
                weight = F.when(better, 0.0).otherwise(full)
            else:
                weight = full * h["n"]
            return F.struct(
                F.get(ids, h["term"]).alias("term_id"), F.get(names, h["field"]).alias("field"), F.when(gated, 0.0).otherwise(weight).alias("weight"), h["n"].alias("occurrences"),
                h["start"].alias("start"), h["end"].alias("end"), h["text"].alias("matched_text"), h["snippet"].alias("snippet"), gated.alias("gated"),
                (~gated & (F.get(weights, h["term"]) > 0)).alias("counts"),
            )

        return F.transform(hits, each)

    return _let(F.array_distinct(F.transform(hits, lambda h: h["term"])), over)


def judge(keywords: KeywordList, evidence: bool = True, **columns: Column) -> Column:
    """A record's verdict: struct<VERDICT>, without ``evidence`` with no matched texts and snippets. Matches stand by field in the list's order and then as met. A record without any field has
    no match; one with an exclusion is vetoed and has none either."""
    source = f"{keywords.jurisdiction} list v{keywords.list_version}"
    band = keywords.review_band > 0

    def reason(points: Column, matches: Column, passed: Column, review: Column) -> Column:
        def said(ids: Column) -> Column:
            more = F.size(ids) - REASON_TERMS
            shown = F.concat(F.array_join(F.slice(ids, 1, REASON_TERMS), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))
            inside = F.lit(IN_BAND.format(least=keywords.min_score, ceiling=keywords.ceiling) if band else "")
            values = {"score": shortest(points), "comparison": F.when(passed, "reaches").otherwise("is below"), "band": F.when(review, inside).otherwise(""), "terms": shown}
            return F.when(F.size(ids) == 0, NO_TERM.format(source=source)).otherwise(_filled(DECIDED, values, least=keywords.min_score, source=source))

        return _let(F.array_distinct(F.transform(F.filter(matches, lambda m: m["counts"]), lambda m: m["term_id"])), said)

    def decided(matches: Column) -> Column:
        def by(points: Column) -> Column:
            passed = points + EPSILON >= keywords.min_score
            review = passed & F.lit(band) & (points + EPSILON < keywords.ceiling)
            shown = F.transform(matches, lambda m: F.struct(*[m[c].alias(c) for c in ("term_id", "field", "weight", "occurrences", "start", "end", "matched_text", "snippet", "gated")]))
            return F.struct(passed.alias("passed"), points.alias("score"), F.lit(False).alias("vetoed"), review.alias("needs_review"), reason(points, matches, passed, review).alias("reason"), shown.alias("matches"))

        return _let(F.aggregate(matches, F.lit(0.0), lambda a, m: a + m["weight"]), by)

    def whole(found: Column) -> Column:
        hits = F.coalesce(found["hits"], F.from_json(F.lit("[]"), FOUND[FOUND.index("array<") : -1]))
        judged = _let(_weighted(keywords, hits), decided)
        if not keywords.exclusions:
            return judged
        veto = found["veto"]
        at = lambda values, i: F.get(_table(values), i)
        values = {"pattern": at([repr(e.pattern) for e in keywords.exclusions], veto["exclusion"]), "field": at([n for n, _ in keywords.fields], veto["field"]), "text": veto["text"], "why": at([e.reason for e in keywords.exclusions], veto["exclusion"])}
        vetoed = F.struct(F.lit(False).alias("passed"), F.lit(0.0).alias("score"), F.lit(True).alias("vetoed"), F.lit(False).alias("needs_review"), _filled(VETOED, values).alias("reason"), judged["matches"].alias("matches"))
        return F.when(veto.isNotNull(), vetoed).otherwise(judged)

    return _let(find(keywords, evidence, **columns), whole)


def _filled(wording: str, values: dict[str, Column], **fixed) -> Column:
    """A wording with columns in the places of its names."""
    parts = re.split(r"\{(\w+)(?:!r)?(?::g)?\}", wording)
    known = {k: f"{v:g}" if isinstance(v, float) else v for k, v in fixed.items()}
    return F.concat(*[F.lit(p) if i % 2 == 0 else values[p] if p in values else F.lit(known[p]) for i, p in enumerate(parts) if p])


def score(keywords: KeywordList, **columns: Column) -> Column:
    """The verdict without its evidence: struct<passed, score, vetoed, needs_review, terms array<struct<id, occurrences, gated, weight>>>,
    a row for each term, in the list's order."""

    def short(v: Column) -> Column:
        mine = lambda i: F.filter(v["matches"], lambda m: m["term_id"] == i)
        sums = lambda i: F.struct(
            i.alias("id"), F.aggregate(mine(i), F.lit(0), lambda a, m: a + m["occurrences"]).alias("occurrences"), F.exists(mine(i), lambda m: m["gated"]).alias("gated"),
            F.aggregate(mine(i), F.lit(0.0), lambda a, m: a + m["weight"]).alias("weight"),
        )
        met = F.array_intersect(_table([t.id for t in keywords.terms]), F.transform(v["matches"], lambda m: m["term_id"]))
        return F.struct(*[v[c].alias(c) for c in ("passed", "score", "vetoed", "needs_review")], F.transform(met, sums).alias("terms"))

    return _let(judge(keywords, False, **columns), short)


def chain(stages: list[tuple[str, Column]]) -> Column:
    """First rejecting stage decides; a review flag of any stage up to there stays. Stages are verdict structs; none passes all."""
    passed, review, by = F.lit(True), F.lit(False), F.lit(None).cast("string")
    for name, v in reversed(stages):
        by = F.when(~v["passed"], F.lit(name)).otherwise(by)
        passed = v["passed"] & passed
        review = v["needs_review"] | F.when(v["passed"], review).otherwise(F.lit(False))
    return F.struct(passed.alias("passed"), review.alias("needs_review"), by.alias("rejected_by"))


def example(updated: dt.date = dt.date(2026, 1, 1)) -> dict:
    """A list over the vocabulary of the test tables."""
    term = lambda i, t, w, **more: {"id": f"en-{i}", "term": t, "lang": "en", "category": "general", "weight": w, **more}
    return {
        "schema_version": "1.0.0", "jurisdiction": "EN", "list_version": "1.0.0", "updated": updated.isoformat(), "languages": ["en", "fr"],
        "scoring": {"min_score": 3, "review_band": 3, "count_term_once": True, "fields": {"title": 2.0, "abstract": 1.5, "full_text": 1.0}},
        "terms": [
            term("license", "licensed", 3, aliases=["released under"]), term("stupid", "stupid", 2), term("worthless", "worthless", 1, requires=["en-stupid"]),
            term("ingthe", "ingthe", 1, match="substring", aliases=["onthely"]), term("thereof", "that the", 1, match="phrase"), term("mit", "MIT", 2, case_sensitive=True),
            {**term("hex", r"[0-9a-f]{32,}", 1, match="regex")}, {**term("eleve", "élève", 1), "id": "fr-eleve", "lang": "fr", "aliases": ["était"]},
        ],
        "exclusions": [{"pattern": "idiot", "match": "word", "reason": "abuse"}],
    }
