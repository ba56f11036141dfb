"""Text expressions: folding, collapsing, cleaning, clipping."""

from __future__ import annotations

import functools
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Folding covers these code points.
FOLD_FIRST, FOLD_LAST = 0x80, 0x2FFF


@functools.lru_cache(2)
def fold_table(lower: bool) -> tuple[str, str]:
    """Two equally long strings: code points and what they fold to. A code point folds if its canonical decomposition is one
    base character and marks; the lower variant lowers characters whose lower case is one character as well."""
    source, target = [], []
    for c in range(FOLD_FIRST, FOLD_LAST + 1):
        char = chr(c)
        parts = unicodedata.normalize("NFD", char)
        base = [p for p in parts if not unicodedata.combining(p)]
        to = base[0] if len(parts) > 1 and len(base) == 1 else char
        if lower and len(to.lower()) == 1:
            to = to.lower()
        if to != char:
            source.append(char)
            target.append(to)
    if lower:
        source += [chr(c) for c in range(ord("A"), ord("Z") + 1)]
        target += [chr(c) for c in range(ord("a"), ord("z") + 1)]
    return "".join(source), "".join(target)


def fold_string(text: str, lower: bool = True) -> str:
    """The same on a Python string, after composing it."""
    return unicodedata.normalize("NFC", text).translate(str.maketrans(*fold_table(lower)))


def compose(text: Column) -> Column:
    """NFC. Python gets only the texts with a combining mark, as only these can change."""

    @arrow_udf("string")
    def composed(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in column.to_pylist()], pa.string())

    marked = text.rlike(r"\p{M}")
    return F.when(marked, composed(F.when(marked, text))).otherwise(text)


def fold(text: Column, lower: bool = True) -> Column:
    """Length-preserving folding of already composed text."""
    return F.translate(text, *fold_table(lower))


def collapse(text: Column) -> Column:
    """White space runs (Unicode) to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clip(text: Column, width: int) -> Column:
    """Over-long values end in an ellipsis and have ``width`` characters."""
    return F.when(F.char_length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def clean(text: Column) -> Column:
    """Without control characters other than tab and newline, and without bidirectional overrides."""
    unified = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(unified, r"[\x00-\x08\x0B-\x1F\x7F-\x9F\x{202A}-\x{202E}\x{2066}-\x{2069}]", "")


def paragraphs(text: Column) -> Column:
    """Split at blank lines, or where there are none at newlines; blank parts are dropped."""
    blank = r"\n[ \t]*\n\s*"
    parts = F.when(text.rlike(blank), F.split(text, blank)).otherwise(F.split(text, "\n"))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def word_count(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[ \t\n\r\f\x0B]+"))).cast("long")


def contains_folded(text: Column, term: str) -> Column:
    """Case-insensitive containment of a literal; no pattern characters, so nothing needs escaping."""
    return F.contains(F.lower(text), F.lit(term.lower()))


def csv_cell(value: Column) -> Column:
    """A cell that a spreadsheet takes as text: a leading ``= + - @ TAB CR`` gets an apostrophe; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(F.substring(text, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), text)).otherwise(text)
