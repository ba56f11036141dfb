"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

1. Words are lower-cased and hashed once a document. Every window of as many words as an item has is a candidate that holds enough
   places of shingles of the item to be as similar as is asked for; the places in a window bound what it shares, so none is missed.
2. Every window and every item gets a 64-bit SimHash of its words; a window stays if it is within RADIUS bits of its item.
3. Candidates are verified by the exact similarity of weighted shingles: the sum of the lesser over the sum of the greater
   counts of each shingle, in integers.

Two windows at a weighted similarity of 0.75 differ in a few words only: with 59 words in 9 bits on average, at a standard
deviation of 2.8, so RADIUS leaves five deviations. Blocks that guarantee this radius would be RADIUS + 1 of 2 or 3 bits each; nearly any
two fingerprints agree in one of them, so they can't find candidates, and shared shingles do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import Scratch

RADIUS = 23
#: Bytes of a side that may be broadcast, by a count of its rows or words; beyond, joins shuffle.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64
BLANK = r"[\x20\x09-\x0D]+"


def _bounded(df: DataFrame, words: str | Column | None = None) -> DataFrame:
    """Marked for broadcast if its counted rows, and the words of its array column ``words`` (or so many as a column says), are few."""
    rows, held = df.agg(F.count("*"), F.coalesce(F.sum(F.size(words) if isinstance(words, str) else words) if words is not None else F.lit(0).cast("long"), F.lit(0).cast("long"))).first()
    return F.broadcast(df) if rows * ROW_BYTES + held * 16 <= BROADCAST_BYTES else df


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANK), ""), lambda w: F.xxhash64(w))


def _shingles(words: str, width: int) -> Column:
    """Hash of each run of ``width`` words, in order; none if there are fewer words."""
    at = lambda i: F.xxhash64(F.lit(width), *[F.get(words, i + k) for k in range(width)])
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(0), F.size(words) - width), at)).otherwise(F.array().cast("array<bigint>"))


def _fingerprint(df: DataFrame, words: str) -> DataFrame:
    """Adds ``print``: bit b is set if more than half of the word hashes have it. 32 sums count two bits each."""
    pair = lambda k: F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.shiftrightunsigned(w, k).bitwiseAND(F.lit(0x0000000100000001)))
    sums = df.withColumn("sums", F.array(*[pair(k) for k in range(32)]))
    half = lambda count, bit: F.when(2 * count > F.size(words), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long"))
    value = F.lit(0).cast("long")
    for k in range(32):
        both = F.get("sums", F.lit(k))
        value = value.bitwiseOR(half(both.bitwiseAND(F.lit(0xFFFFFFFF)), k)).bitwiseOR(half(F.shiftrightunsigned(both, 32), 32 + k))
    return sums.withColumn("print", value).drop("sums")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: First words of windows that share one copy of their words.
RUN = 256


def _candidates(places: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, item_id, n, start) of all windows of ``n`` words that hold enough of the places ``at``, which are in order. A window whose first place
    is the j-th begins after the place before, and holds enough if the one so many further on is in it; so each window comes once. A
    text shorter than the item is one window."""
    z = F.least("n", F.lit(width))
    both = F.least("n", "m") + F.col("n") - 2 * z + 2
    enough = F.greatest(F.lit(1), F.floor((percent * both + (99 + percent)) / F.lit(100 + percent)).cast("int"))
    able = places.withColumns({"enough": enough, "z": z}).where("size(at) >= enough")
    at = lambda j: F.get("at", j)
    low = lambda j: F.greatest(F.lit(0), at(j - 1) + 1, at(j + F.col("enough") - 1) - F.col("n") + F.col("z"))
    high = lambda j: F.least(at(j), F.greatest(F.lit(0), F.col("m") - F.col("n")))
    starts = lambda j: F.when(low(j) <= high(j), F.sequence(low(j), high(j))).otherwise(F.array().cast("array<int>"))
    firsts = F.sequence(F.lit(0), F.size("at") - F.col("enough"))
    return able.select("key", "item_id", "n", F.explode(F.flatten(F.transform(firsts, starts))).alias("start"))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 5, percent: int = 75, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start, shared, total, similarity, distance): the best window of each document for each item it contains, by
    ``100 * shared >= percent * total``; ``start`` is the window's first word.

    Null, empty and word-free texts and items match nothing. An item of fewer than ``width`` words has its whole sequence as its one
    shingle. Items of equal texts all match. Repeated documents match once; texts that share an id match under it, a null
    id matches as null. Other columns are not read; empty tables give an empty result. A text's words are hashed twice, whatever the
    number of its windows; it takes some 16 bytes a word and its windows as many words as they have.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    texts = texts.withColumn("key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\0"), "text")))  # equal rows are alike
    known = items.select(F.col(item_col).alias("item_id"), word_hashes(F.col(item_text)).alias("words")).where("size(words) > 0")
    known = known.dropDuplicates(["item_id", "words"]).withColumn("n", F.size("words"))
    widths = sorted(r[0] for r in known.select(F.least("n", F.lit(width))).distinct().collect())  # at most ``width`` values
    if not widths:
        widths = [width]

    def placed_shingles(df: DataFrame, *columns: str) -> DataFrame:
        """Width, place and hash of the shingles of each width asked for, from one reading of the table."""
        of = lambda w: F.transform(_shingles("words", w), lambda s, q: F.struct(F.lit(w).alias("w"), q.alias("q"), s.alias("s")))
        counted = df.select(*columns, "words", F.size("words").alias("n"))  # else every generated row would hold all words
        return counted.select(*columns, "n", F.inline(F.concat(*[of(w) for w in widths])))

    scratch = Scratch(docs.sparkSession)
    of_items = placed_shingles(known, "item_id").where(f"w = least(n, {width})").select("item_id", "n", "s", "q")
    hashed = texts.select("key", word_hashes(F.col("text")).alias("words"))
    anchors = placed_shingles(hashed, "key").select("key", F.col("n").alias("m"), F.col("q").alias("p"), "s")
    places = anchors.join(_bounded(of_items), "s").groupBy("key", "item_id", "n", "m").agg(F.sort_array(F.collect_set("p")).alias("at"))
    starts = _candidates(places, width, percent)
    runs = starts.groupBy("key", "item_id", "n", F.floor(F.col("start") / RUN).alias("run")).agg(F.min("start").alias("low"), F.max("start").alias("high"), F.collect_list("start").alias("starts"))
    windows = scratch.write(runs.groupBy("key").agg(F.collect_list(F.struct("item_id", "n", "low", "high", "starts")).alias("windows"), F.sum(F.size("starts") + 4).alias("held")), "windows")

    # each run takes its own words along, so that no row holds those of all windows of a text
    words_of = lambda w, words: F.slice(words, w["low"] + 1, w["high"] - w["low"] + w["n"])
    cut = lambda words: F.transform("windows", lambda w: F.struct(w["item_id"].alias("item_id"), w["n"].alias("n"), w["low"].alias("low"), w["starts"].alias("starts"), words_of(w, words).alias("run")))
    held = texts.join(_bounded(windows, F.col("held")), "key").select("doc_id", F.inline(_let(word_hashes(F.col("text")), cut)))
    of_run = F.transform("starts", lambda x: F.struct(x.alias("start"), F.slice("run", x - F.col("low") + 1, F.col("n")).alias("words")))
    cuts = held.select("doc_id", "item_id", F.inline(of_run)).where("size(words) > 0")
    cuts = cuts.groupBy("doc_id", "item_id", "words").agg(F.min("start").alias("start"))  # windows of the same words are one
    cuts = _fingerprint(cuts, "words")
    prints = _fingerprint(known, "words").select("item_id", F.col("print").alias("item_print"), F.col("words").alias("item_words"))
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    near = cuts.join(_bounded(prints, "item_words"), "item_id").withColumn("distance", distance).where(F.col("distance") <= radius)
    pairs = near.select("doc_id", "item_id", "start", "distance", *[_counted(_shingles_of(w, width, "item_words")).alias(x) for w, x in (("words", "a"), ("item_words", "b"))])
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("a", "b")).cast("long"))
    sums = pairs.withColumn("total", F.size("a") + F.size("b") - F.col("shared")).where(f"100 * shared >= {percent} * total")
    best = F.struct((F.col("shared") / F.col("total")).alias("similarity"), (-F.col("start")).alias("at"), (-F.col("distance")).alias("near"), "shared", "total")
    top = sums.groupBy("doc_id", "item_id").agg(F.max(best).alias("t"))
    return top.select("doc_id", "item_id", (-F.col("t.at")).alias("start"), "t.shared", "t.total", "t.similarity", (-F.col("t.near")).alias("distance"))


def _counted(shingles: Column) -> Column:
    """The shingles with their repetitions told apart, so that the size of an intersection is the sum of the lesser counts."""
    def numbered(s: Column) -> Column:
        turn = lambda x, i: i - F.array_position(s, x) + 1
        return F.transform(s, lambda x, i: F.when(turn(x, i) == 0, x).otherwise(F.xxhash64(x, turn(x, i))))

    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), shingles).otherwise(_let(F.sort_array(shingles), numbered))


def _shingles_of(words: str, width: int, item: str) -> Column:
    """Shingles of the width that the item asks for."""
    out = _shingles(words, width)
    for w in range(1, width):
        out = F.when(F.size(item) == w, _shingles(words, w)).otherwise(out)
    return out
