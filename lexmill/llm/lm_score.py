"""Cross-entropy difference of documents under a target and a background n-gram model.

Both models are interpolated bigram models over one vocabulary: every word of all documents, the end of a text, and one unseen event.
Every word and every bigram of all documents has an exact count of its own, in rows that grow with the input; nothing is
capped. An event's probability after a context is MIX of its share among the context's successors and the rest of its smoothed share among
all events; after a context that the model has never seen, the smoothed share alone. So the probabilities after any context
sum to 1.

A document's score is the mean over its words of target loss minus background loss: the lower, the more like the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.batches import bound_batches, release, text_batches
from lexmill.llm.shingles import WordHashes, _mix

#: Ids (8 bytes each) of target documents that may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Bytes of text whose grams are counted and looked up together.
PART_BYTES = 16 << 20
#: Characters of a long text whose words are Python objects at a time.
PIECE = 1 << 20
#: Words whose losses are computed at a time.
SLICE = 1 << 18
#: Stands for the start of a text among the hashes of words.
START = 0
SMOOTH, MIX = 0.5, 0.6


def _hashes(text: str | None, cache: WordHashes) -> Iterator[list[int]]:
    """Hashes of a text's lower-cased words, ASCII white space between them; a long text by pieces that end at white space."""
    data = b"" if text is None else text.lower().encode("utf-8", "surrogatepass")
    start = 0
    while start < len(data):
        end = start + PIECE
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield [cache[w] & ~1 for w in data[start:end].split()]
        start = end


def _words(length: np.ndarray) -> np.ndarray:
    """Places of words among all words with a START before each text."""
    is_word = np.ones(int(length.sum()) + len(length), bool)
    is_word[np.cumsum(length + 1) - (length + 1)] = False
    return np.flatnonzero(is_word)


def _part(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a table with the columns text and t: distinct grams, ascending; where each of its words, a START before each text, is among them,
    and where each pair that ends at a word is; the lengths of its texts, and their t.

    A gram is a 64-bit hash whose lowest bit tells pairs from words.
    """
    cache, flat, length = WordHashes(), [], []
    for batch in table.select(["text"]).to_batches():
        for texts in text_batches(batch.column(0)):
            for t in texts:
                n = 0
                flat.append(np.array([START], np.uint64))
                for hashes in _hashes(t, cache):
                    flat.append(np.array(hashes, np.uint64))
                    n += len(hashes)
                length.append(n)
    length = np.array(length, np.int64)
    word = np.concatenate([*flat, np.empty(0, np.uint64)])
    del flat
    at = _words(length)
    every = np.empty(len(word) + len(at), np.uint64)
    every[: len(word)] = word
    with np.errstate(over="ignore"):
        pair = _mix(word[at - 1])
        pair *= np.uint64(0x9E3779B97F4A7C15)
        pair += word[at]
        every[len(word) :] = _mix(pair) | np.uint64(1)
    n = len(word)
    del word, pair, at
    order = np.argsort(every)
    every = every[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    gram = every[new]
    place = np.empty(len(every), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return gram, place[:n], place[n:], length, table.column("t").to_numpy().astype(bool)


def _squeezed(numbers: np.ndarray) -> bytes:
    """Eight-byte numbers as bytes, first bytes first: small numbers leave long runs of zeros, which a shuffle compresses."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes()


def _loosened(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


def _steps(gram: np.ndarray) -> np.ndarray:
    """The first of ascending grams and the differences after it; ``cumsum`` gives the grams again."""
    return np.diff(gram, prepend=np.zeros(1, np.uint64))


def _dealt(gram: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct ascending grams: the buckets that hold any; their grams' order by bucket; and where each bucket begins and ends."""
    bucket = ((gram >> np.uint64(1)) % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    some, n = np.unique(bucket, return_counts=True)
    return some, order, np.concatenate([[0], np.cumsum(n)])


PACKED = "gram binary, target binary, background binary"


def _asked(parts: DataFrame, n_parts: int) -> DataFrame:
    """(bucket, part, gram, target, background): for each part its distinct grams and their counts in it, dealt over ``n_parts`` buckets of grams."""

    def run(table: pa.Table) -> pa.Table:
        gram, word, pair, length, t = _part(table)
        background = np.bincount(word, minlength=len(gram)) + np.bincount(pair, minlength=len(gram))
        target = np.bincount(word[np.repeat(t, length + 1)], minlength=len(gram)) + np.bincount(pair[np.repeat(t, length)], minlength=len(gram))
        del word, pair
        some, order, ends = _dealt(gram, n_parts)
        cut = lambda x, f: pa.array([_squeezed(f(x[order[i:j]])) for i, j in zip(ends[:-1], ends[1:])], pa.binary())
        same = lambda x: x
        part = np.full(len(some), table.column("part")[0].as_py(), np.int64)
        out = pa.table({"bucket": pa.array(some), "part": pa.array(part), "gram": cut(gram, _steps), "target": cut(target, same), "background": cut(background, same)})
        del gram, target, background, order
        release()
        return out

    return parts.groupBy("part").applyInArrow(run, f"bucket bigint, part bigint, {PACKED}")


def _merged(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], dict[str, np.ndarray]]:
    """Distinct grams of all rows; for each row, where its grams are among them; and the sums of their counts."""
    each = [np.cumsum(_loosened(x, np.uint64), dtype=np.uint64) for x in table.column("gram").to_pylist()]
    ends = np.cumsum([len(x) for x in each])[:-1]
    every = np.concatenate(each)
    del each
    order = np.argsort(every)
    every = every[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    place = np.empty(len(every), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    gram, sums = every[new], {}
    del order, every, new
    for c in ("target", "background"):  # sums of doubles are exact up to 2**53
        sums[c] = np.bincount(place, np.concatenate([_loosened(x, np.int64) for x in table.column(c).to_pylist()]), len(gram)).astype(np.int64)
    release()
    return gram, np.split(place, ends), sums


TOTALS = ("n", "target", "background", "target_texts", "background_texts")


def _totals(asked: DataFrame) -> DataFrame:
    """One row: distinct words, and of both sides how many words and texts there are."""

    def run(table: pa.Table) -> pa.Table:
        gram, _, sums = _merged(table)
        start = gram == START
        word = (gram & np.uint64(1) == 0) & ~start
        found = [int(word.sum()), *(int(sums[c][which].sum()) for which in (word, start) for c in ("target", "background"))]
        return pa.table({k: pa.array([v], pa.int64()) for k, v in zip(TOTALS, found)})

    counts = asked.groupBy("bucket").applyInArrow(run, ", ".join(f"{c} bigint" for c in TOTALS))
    return counts.agg(F.struct(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS)).alias("totals"))


def _answered(asked: DataFrame) -> DataFrame:
    """For each request (part, bucket) the counts over all parts of its grams, in their order; the grams aren't sent again."""

    def run(table: pa.Table) -> pa.Table:
        _, at, sums = _merged(table)
        counts = {c: pa.array([_squeezed(x[i]) for i in at], pa.binary()) for c, x in sums.items()}
        return pa.table({"part": table.column("part"), "bucket": table.column("bucket"), **counts})

    return asked.groupBy("bucket").applyInArrow(run, "part bigint, bucket bigint, target binary, background binary")


def score_all(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score) per row of ``docs``, by models of every word and bigram of ``docs``.

    Target: the documents whose id is in ``target_ids``; background: all documents. Null texts have no words, null ids are in the
    background only; losses and score are null without words. A word or bigram is known by a 64-bit hash. Rows are dealt by their place, so
    that equal rows are spread like others, to parts of about ``part_bytes`` bytes of text; ``docs`` must give the same rows when it is
    read again, as a table does. A longer text is in one part: its grams take some 100 bytes a word there, its words only a piece at
    a time. Each part asks once for each of its grams, so a gram has at most as many requests as there are parts, however frequent it
    is; requests meet by gram and the exact sums return to the parts. Other columns are not read; an empty table gives an empty
    one; equal rows get equal scores.
    """
    bound_batches(docs.sparkSession)
    ids = target_ids.select(F.col(id_col).alias("key")).where("key is not null").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = size // part_bytes + 1
    placed = rows.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_parts)).cast("long"))
    parts = placed.join(ids, placed["doc_id"] == ids["key"], "left").select("part", "doc_id", "text", F.col("key").isNotNull().alias("t"))

    def run(mine: pa.Table, answers: pa.Table) -> pa.Table:
        gram, word, pair, length, _ = _part(mine)
        _, order, _ = _dealt(gram, n_parts)
        answers = answers.sort_by("bucket")
        total = answers.column("totals")[0].as_py()
        at = _words(length)
        owner = np.repeat(np.arange(len(length), dtype=np.int32), length)
        losses = []
        for c in ("target", "background"):
            counts = np.empty(len(gram), np.int64)
            counts[order] = np.concatenate([_loosened(x, np.int64) for x in answers.column(c).to_pylist()])
            every, loss = total[c] + total[f"{c}_texts"] + SMOOTH * (total["n"] + 2), np.zeros(len(length))
            for i in range(0, len(at), SLICE):
                part = at[i : i + SLICE]
                single, seen = (counts[word[part]] + SMOOTH) / every, counts[word[part - 1]]
                p = np.where(seen > 0, MIX * counts[pair[i : i + SLICE]] / np.maximum(seen, 1) + (1 - MIX) * single, single)
                loss += np.bincount(owner[i : i + SLICE], -np.log(p), len(length))
            mean = np.full(len(length), np.nan)
            np.divide(loss, length, out=mean, where=length > 0)
            losses.append(mean)
        double = lambda x: pa.array(x, pa.float64(), mask=length == 0)
        out = pa.table({"doc_id": mine.column("doc_id"), "n_words": pa.array(length), "target_loss": double(losses[0]), "background_loss": double(losses[1]), "score": double(losses[0] - losses[1])})
        del gram, word, pair, order, counts, owner, at
        release()
        return out

    asked = _asked(parts, n_parts)  # one shuffle of the texts, and one of the requests, serve both uses
    answers = _answered(asked).withColumn("totals", _totals(asked).scalar())
    kind = rows.schema["doc_id"].dataType.simpleString()
    return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, f"doc_id {kind}, n_words bigint, target_loss double, background_loss double, score double")
