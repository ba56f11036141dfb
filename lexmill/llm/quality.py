"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for every document: the ledger keeps its measurement and sets its bit where it fails. Policies
are versioned bit masks over the ledger; changing one, or asking what each rule alone removes, never reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"\x20\x09-\x0D"


@dataclass(frozen=True)
class Rule:
    """bit: its place in the mask; failed: SQL over the measurements."""

    bit: int
    name: str
    failed: str


#: The order of bits never changes; new rules get new bits.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 5 * n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule(5, "few_letters", "2 * n_letter_words < n_words"),
)
#: Policy and version to the names of its rules.
POLICIES = {
    ("base", 1): ("few_words", "repeated_words"),
    ("corpus", 1): ("few_words", "repeated_words", "symbols", "duplicate_lines"),
    ("corpus", 2): tuple(r.name for r in RULES),
}


def mask(policy: tuple[str, int]) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


def _repeat_words(words: Column, window: int = 3) -> Column:
    """How many words stand in a window of words that occurs twice or more. Windows are compared by 64-bit hashes, sorted
    with their positions; sorting keeps a text of n words at n log n."""
    last = F.size(words) - window
    gram = lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(window)]).alias("h"), i.alias("p"))
    grams = F.when(last > 0, F.sort_array(F.transform(F.sequence(F.lit(0), last), gram)))

    def repeated(s: Column) -> Column:
        twin = lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))
        return F.sort_array(F.filter(F.transform(s, lambda x, k: F.when(twin(x, k), x["p"])), lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))), F.lit(0), lambda a, b: a + b)

    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return F.coalesce(let(grams, lambda s: let(repeated(s), covered)), F.lit(0))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the measurements, and ``failed`` (bigint, a bit for each failed rule).

    A null text has no words and, like any text without them, no lines. Rows that repeat get equal entries; other columns are not read.
    A text of any length is one row's arrays: some 40 bytes a word.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.withColumns({
        "words": F.array_remove(F.split("text", f"[{BLANK}]+"), ""),
        "lines": F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{BLANK}]")),
    })
    n = lambda pattern: F.char_length(F.regexp_replace("text", pattern, "")).cast("long")
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (F.char_length("text") - n(f"[^{BLANK}]+")).alias("word_chars"),
        n("[^#*$%&|<>]+").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    bits = [F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return rows.withColumn("failed", failed)


def passes(policy: tuple[str, int], failed: str = "failed") -> Column:
    """Whether none of the policy's rules failed."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(entries: DataFrame, policy: tuple[str, int]) -> DataFrame:
    """(rule, n_failed, n_only): rows that fail a rule of the policy, and rows that only this rule removes.

    One aggregation by the masked bits (at most as many groups as masks), then bitwise tests on these groups.
    """
    groups = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in POLICIES[policy]])
    tested = groups.select("bits", "n", F.inline(rules))
    return tested.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
    )
