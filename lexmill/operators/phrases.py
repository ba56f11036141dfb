"""Many literals at once in whole texts: one automaton pass over a text for a list, a join by anchors for a table of phrases.

Spark has no expression for thousands of literals with offsets, so the pass is an Arrow function over an automaton that is built once and
broadcast; what is made of its hits is left to column expressions.
"""

from __future__ import annotations

import bisect
import functools
import re
import unicodedata
from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import fold_table
from lexmill.session import materialize


@functools.lru_cache(2)
def _points(lower: bool) -> np.ndarray:
    """Code point to the one it folds to."""
    table = np.arange(0x110000, dtype=np.uint32)
    source, target = fold_table(lower)
    table[[ord(c) for c in source]] = [ord(c) for c in target]
    return table


def _folded(text: str, lower: bool) -> str:
    """Length-preserving folding of a composed text, by one look-up of all its code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _points(lower)[points].tobytes().decode("utf-32-le", "surrogatepass")


class Text:
    """A text as it is searched: composed; folded with and, where it is asked for, without loss of case; in ``low`` and ``cased`` runs of
    white space are one space, ``raw`` has them as they are."""

    def __init__(self, raw: str):
        plain = raw.isascii()
        self.composed = raw if plain or unicodedata.is_normalized("NFC", raw) else unicodedata.normalize("NFC", raw)
        low = self.composed.lower() if plain else _folded(self.composed, True)
        self._raw = self._cased = self.composed if plain else None
        #: places of shortened runs in the searched texts, and by how much places after each are moved
        self.runs: list[int] = []
        self.moved: list[int] = []
        self._spaced = re.search(r"\s\s|[^\S ]", low) is not None
        if self._spaced:
            total = 0
            for m in re.finditer(r"\s{2,}", low):
                self.runs.append(m.start() - total)
                total += m.end() - m.start() - 1
                self.moved.append(total)
            low, self._cased = re.sub(r"\s+", " ", low), None
        self.low = low

    @classmethod
    def of(cls, raw: str) -> Text:
        return cls(raw)

    @property
    def raw(self) -> str:
        if self._raw is None:
            self._raw = _folded(self.composed, False)
        return self._raw

    @property
    def cased(self) -> str:
        if self._cased is None:
            self._cased = re.sub(r"\s+", " ", self.raw) if self._spaced else self.raw
        return self._cased

    def place(self, at: int) -> int:
        """Where a place of the searched texts is in the composed one."""
        k = bisect.bisect_left(self.runs, at)
        return at + (self.moved[k - 1] if k else 0)

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.place(start), self.place(end - 1) + 1 if end > start else self.place(start)


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


@dataclass(frozen=True, order=True)
class Treatment:
    """Whether case counts, and on which sides a hit must not touch a word character."""

    cased: bool
    left: bool
    right: bool


class Finder:
    """Literals with their treatment and owner. A literal is folded already and has single spaces."""

    def __init__(self, literals: list[tuple[str, Treatment, int]]):
        known: dict[tuple[bool, str], dict[Treatment, list[int]]] = {}
        for text, how, owner in literals:
            owners = known.setdefault((how.cased, text), {}).setdefault(how, [])
            if owner not in owners:
                owners.append(owner)
        self.automata: dict[bool, ahocorasick.Automaton] = {}
        for (cased, text), uses in known.items():
            self.automata.setdefault(cased, ahocorasick.Automaton()).add_word(text, (len(text), tuple(uses.items())))
        for a in self.automata.values():
            a.make_automaton()

    def hits(self, text: Text) -> list[tuple[int, int, int]]:
        """(owner, start, end) in the searched text: by treatment, then place. Of the literals of one treatment that begin at one
        place, the longest that its sides allow is found; hits may overlap."""
        longest: dict[tuple[Treatment, int], tuple[int, list[int]]] = {}
        for cased, automaton in self.automata.items():
            searched = text.cased if cased else text.low
            for last, (size, uses) in automaton.iter(searched):
                start, end = last + 1 - size, last + 1
                open_left = not start or not is_word(searched[start - 1])
                open_right = end == len(searched) or not is_word(searched[end])
                for how, owners in uses:
                    if (open_left or not how.left) and (open_right or not how.right) and end > longest.get((how, start), (0, []))[0]:
                        longest[how, start] = end, owners
        return [(owner, start, end) for (_, start), (end, owners) in sorted(longest.items()) for owner in owners]


class Earliest:
    """Literals of which only the first hit counts: (text, free on the left, free on the right), folded without case. Built once, it finds any
    number of them in one pass."""

    def __init__(self, literals: list[tuple[str, bool, bool]]):
        self.automaton = ahocorasick.Automaton() if literals else None
        uses: dict[str, list[tuple[int, bool, bool]]] = {}
        for i, (text, left, right) in enumerate(literals):
            uses.setdefault(text, []).append((i, left, right))
        for text, of in uses.items():
            self.automaton.add_word(text, (len(text), of))
        if literals:
            self.automaton.make_automaton()

    def first(self, text: Text) -> dict[int, tuple[int, int]]:
        """Literal's number to start and end of its first hit in the searched text."""
        found: dict[int, tuple[int, int]] = {}
        for last, (size, uses) in self.automaton.iter(text.low) if self.automaton else ():
            start, end = last + 1 - size, last + 1
            open_left = not start or not is_word(text.low[start - 1])
            open_right = end == len(text.low) or not is_word(text.low[end])
            for i, left, right in uses:
                if i not in found and (open_left or not left) and (open_right or not right):
                    found[i] = start, end
        return found


# ---- phrases of a table ---------------------------------------------------------------------------------------------

#: Words of an anchor at most; characters of one of a phrase that has no whole word inside.
ANCHOR_WORDS, ANCHOR_CHARS = 4, 12
#: Anchors (some 100 bytes each), or candidate pairs, that may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
_SPACE = r"[ \t\n\x0B\f\r]+"


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _windows(words: Column, *sizes: int) -> Column:
    """Hashes of all runs of each of these numbers of words. The words are computed once."""
    at = lambda w, n: F.sequence(F.lit(0), F.size(w) - n)
    of = lambda w, n: F.when(F.size(w) >= n, F.transform(at(w, n), lambda i: F.xxhash64(F.lit(n), *[F.get(w, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))
    return F.flatten(F.transform(F.array(words), lambda w: F.concat(*[of(w, n) for n in sizes])))


def _starts(text: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` characters."""
    places = F.sequence(F.lit(1), F.char_length(text) - size + 1)
    return F.when(F.char_length(text) >= size, F.transform(places, lambda i: F.xxhash64(F.lit(-size), F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<bigint>"))


def containing(docs: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrase_id: str = "item_id", phrase_col: str = "text") -> DataFrame:
    """(id, phrase_id): which texts contain which whole phrases, letter by letter. Null texts and null or empty phrases match nothing.

    A phrase's anchor is its first ANCHOR_WORDS words that stand between white space inside it, so that a text that contains the phrase
    has them as whole words; of a phrase without such a word, its first characters. Texts and phrases meet by hashes of anchors, and the
    whole phrase is then looked for in the texts it meets. Neither table passes through the driver. Repeated texts match as often as
    they stand there, repeated phrases under each id. A frequent anchor meets all texts that have it.
    """
    inner = F.slice(F.split(F.col("phrase"), _SPACE), 2, F.greatest(F.size(F.split(F.col("phrase"), _SPACE)) - 2, F.lit(0)))
    listed = phrases.select(F.col(phrase_id).alias("phrase_id"), F.col(phrase_col).alias("phrase")).where("phrase <> ''").withColumn("inner", inner)
    size = F.least(F.size("inner"), F.lit(ANCHOR_WORDS))
    first = F.coalesce(*[F.when(size == n, F.get(_windows(F.col("inner"), n), F.lit(0))) for n in range(1, ANCHOR_WORDS + 1)])
    chars = F.least(F.char_length("phrase"), F.lit(ANCHOR_CHARS))
    listed = listed.select("phrase_id", "phrase", F.when(size > 0, size).otherwise(-chars).alias("size"), F.coalesce(first, F.xxhash64(-chars, F.substring("phrase", F.lit(1), chars))).alias("anchor"))
    sizes = sorted(r["size"] for r in listed.select("size").distinct().collect())  # 16 of them at most
    kind = phrases.schema[phrase_id].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    if not sizes:
        return texts.select("id", F.lit(None).cast(kind).alias("phrase_id")).limit(0)
    texts = texts.withColumn("key", F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.lit("\0"), "text")))  # equal rows are alike
    runs = [_windows(F.split("text", _SPACE), *(n for n in sizes if n > 0))] if sizes[-1] > 0 else []
    runs += [_starts(F.col("text"), -n) for n in sizes if n < 0]
    met = texts.select("key", F.explode(F.array_distinct(F.concat(*runs))).alias("anchor")).join(_few(listed.select("phrase_id", "anchor")), "anchor").select("key", "phrase_id").distinct()
    met = materialize(met, "anchors")
    pairs = _few(met.join(_few(listed.select("phrase_id", "phrase").distinct()), "phrase_id"))
    return texts.join(pairs, "key").where(F.contains("text", F.col("phrase"))).select("id", "phrase_id")
