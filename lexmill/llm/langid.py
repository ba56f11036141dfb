"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

Subwords are the 2-, 3- and 4-grams of a text's lower-cased letters, with everything else as word boundary, hashed into
BUCKETS rows of an embedding table; a text's vector is the mean over all its subwords. Table and softmax are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows (``per_label`` whole texts per label at most, chosen by
a hash of the id). A tenth of the sample calibrates: a temperature by likelihood, and the score under which a prediction is
rejected. The trained model is two small arrays of fixed size; prediction streams over all texts.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lexmill.llm.batches import bound_batches, text_batches

BUCKETS, SIZE = 1 << 16, 16
GRAMS = (2, 3, 4)
UNKNOWN = "und"


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """Code point to lower-cased letter; 0 for everything that is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def subwords(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of all texts, and the text each belongs to."""
    texts = [t or "" for t in texts]
    length = np.array([len(t) for t in texts], np.int64) + 2  # a boundary at either end
    whole = "".join(f"\0{t}\0" for t in texts)
    letters = _letters()[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = (letters != 0) | np.concatenate([[True], letters[:-1] != 0])  # runs of boundaries as one
    keep[np.cumsum(length) - length] = True
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), length)[keep]
    letters = letters[keep].astype(np.uint32)
    out, owners = [], []
    h = letters * np.uint32(0x9E3779B1)
    rolled = h.copy()
    for n in range(2, max(GRAMS) + 1):
        if len(letters) < n:
            break
        rolled = (rolled[: len(letters) - n + 1] ^ (rolled[: len(letters) - n + 1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + h[n - 1 :]
        # neither across texts nor with a boundary inside
        ok = owner[: len(rolled)] == owner[n - 1 :]
        for k in range(1, n - 1):
            ok &= letters[k : k + len(rolled)] != 0
        ok &= (letters[: len(rolled)] != 0) | (letters[n - 1 :] != 0)
        if n in GRAMS:
            out.append(((rolled * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - 16))[ok].astype(np.int32))
            owners.append(owner[: len(rolled)][ok])
    empty = np.empty(0, np.int32)
    return (np.concatenate(out), np.concatenate(owners)) if out else (empty, empty)


@dataclass
class Model:
    """table[bucket, label]: what a subword adds to a label's logit; the embeddings times the softmax weights."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        bucket, owner = subwords(texts)
        count = np.bincount(owner, minlength=len(texts))
        columns = [np.bincount(owner, self.table[:, k].take(bucket), minlength=len(texts)) for k in range(len(self.labels))]
        return np.stack(columns, axis=1) / np.maximum(count, 1)[:, None] + self.bias, count

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label, calibrated probability and whether it is rejected; without letters (or labels) ``und``, 0 and rejected."""
        if not self.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        z, count = self.logits(texts)
        p = _softmax(z / self.temperature)
        best, score = p.argmax(axis=1), np.where(count > 0, p.max(axis=1), 0.0)
        return [self.labels[b] if c else UNKNOWN for b, c in zip(best, count)], score, (score < self.threshold) | (count == 0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 0.5, pieces: int = 3, reject: float = 0.002, seed: int = 7) -> Model:
    """Train on whole texts and, so that short texts are known as well, on ``pieces`` short spans cut from each. Of the
    calibration texts predicted right a share of ``reject`` at most would be rejected, and never a score over one half."""
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = set(order[: len(texts) // 10].tolist()) if len(texts) >= 20 else set()
    rows: list[tuple[str, int]] = []
    for i in order.tolist():
        if i in held:
            continue
        y = names.index(labels[i])
        rows.append((texts[i], y))
        for _ in range(pieces):
            n = int(rng.integers(20, 200))
            at = int(rng.integers(0, max(1, len(texts[i]) - n)))
            rows.append((texts[i][at : at + n], y))
    counted = []
    for text, y in rows:
        bucket, _ = subwords([text])
        if len(bucket):
            ids, n = np.unique(bucket, return_counts=True)
            counted.append((ids, (n / n.sum()).astype(np.float32), y))
    embed = rng.normal(0, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    weight, bias = np.zeros((SIZE, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, step = epochs * max(1, len(counted)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(counted)):
            ids, n, y = counted[i]
            lr = rate * (1 - step / steps)
            step += 1
            x = n @ embed[ids]
            g = _softmax(x @ weight + bias)
            g[y] -= 1
            back = weight @ g
            weight -= lr * np.outer(x, g)
            bias -= lr * 0.1 * g
            embed[ids] -= (lr * 20.0) * n[:, None] * back[None, :]
    model = Model(names, embed @ weight, bias, 1.0, 0.0)
    tested = [i for i in (sorted(held) or range(len(texts)))]
    z, count = model.logits([texts[i] for i in tested])
    y = np.array([names.index(labels[i]) for i in tested])
    z, y = z[count > 0], y[count > 0]
    if len(y):
        loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
        p = _softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        model.threshold = float(min(0.5, np.quantile(right, reject))) if len(right) else 0.5
    return model


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = 600, max_chars: int = 100_000, max_labels: int = 1_000, most: int = 240_000_000, **options) -> Model:
    """Fit on at most ``per_label`` whole texts of each label, of at most ``max_chars`` characters each; that sample is all that reaches
    the driver, and has at most ``most`` characters: with more labels than that allows, fewer and then shorter texts of each are drawn.
    Rows without id, text or label teach nothing.

    Rows are drawn by a hash of id and text, so equal rows are drawn together and count once; each label's share follows from an
    estimate of its distinct rows, and where more are drawn, those of the least hashes stay. More than ``max_labels`` labels are
    an error.
    """
    bound_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    rows = rows.where(F.char_length("text") <= max_chars).withColumn("draw", F.xxhash64("doc_id", "text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n")).limit(max_labels + 1).collect()
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    if not counts:
        return fit([], [])
    per_label = min(per_label, max(50, most // (len(counts) * max_chars)))
    max_chars = min(max_chars, most // (len(counts) * per_label))
    rows = rows.where(F.char_length("text") <= max_chars)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_label / max(r["n"], 1)))])
    drawn = rows.where(F.pmod("draw", F.lit(1 << 20)) / (1 << 20) < share[F.col("lang")]).dropDuplicates(["lang", "draw"])
    order = Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1 << 20)), "draw")
    sample = drawn.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_label).select("doc_id", "text", "lang").toPandas().sort_values(["doc_id", "text"])
    return fit(sample["text"].tolist(), sample["lang"].tolist(), **options)


def predict(docs: DataFrame, model: Model, text: Column) -> Column:
    """struct<lang, score, rejected> of each whole text; other columns are not read."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<lang: string, score: double, rejected: boolean>")
    def run(column: pa.Array) -> pa.Array:
        lang, score, rejected = [], [], []
        for texts in text_batches(column):
            a, b, c = shared.value.predict(texts)
            lang += a
            score += b.tolist()
            rejected += c.tolist()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["lang", "score", "rejected"])

    return run.asNondeterministic()(text)
