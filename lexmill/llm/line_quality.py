"""Document quality from the lines of a text: a linear-chain conditional random field calls every line good or bad.

A line's evidence is a set of binned measurements (FEATURES) of itself, of the line before and of the line after it; neighbouring lines
also speak through the transition weights. Forward-backward gives every line's probability to be good, and their mean, weighted
by length, the document's quality through a calibrated logistic curve.

Only documents are labelled. In the first round of training each line has the label of its document; in the second, the lines of a bad
document have the labels that the first field gives them, but its worst line stays bad. Weights are fitted in numpy on the driver, from
binned measurements (FEATURES bytes a line, no texts) of a bounded sample; scoring streams over all whole texts.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lexmill.llm.batches import bound_batches, text_batches

SYMBOLS = "#*$%&|<>"
_UPPER, _LOWER, _DIGIT, _BLANK, _SYMBOL, _MARK, _OTHER = range(7)
#: Upper ends of the bins of each measurement of a line.
FEATURES = {
    "characters": (0, 10, 30, 60, 100, 200, 400, 1000, 4000),
    "words": (0, 1, 2, 5, 10, 20, 50, 200),
    "word_length": (0, 2, 3, 4, 5, 6, 8, 10, 14, 20),
    "upper": (0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "digits": (0, 0.02, 0.05, 0.1, 0.2, 0.5),
    "symbols": (0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4),
    "marks": (0, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.3),
    "repeats": (0, 0.01, 0.03, 0.1, 0.2, 0.5, 0.8),
    "distinct": (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 0.999),
    "seen_before": (0,),
    "ends_in_mark": (0,),
}
#: Code points of lines that are measured at a time; a longer line is measured alone.
PIECE = 1 << 20


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"Lu": _UPPER, "Lt": _UPPER}
    table = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        table[c] = kinds.get(kind, _LOWER if kind[0] == "L" else _DIGIT if kind == "Nd" else _MARK if kind[0] in "PS" else _OTHER)
    table[[*range(9, 14), 32]] = _BLANK
    table[[ord(c) for c in SYMBOLS]] = _SYMBOL
    return table


@functools.lru_cache(1)
def _factors() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)


def _pieces(texts: list[str | None]) -> Iterator[str]:
    """The lines of all texts, joined by line feeds, in pieces of about PIECE characters."""
    whole = "\n".join(t or "" for t in texts)
    start = 0
    while len(whole) - start > PIECE:
        end = whole.find("\n", start + PIECE)
        if end < 0:
            break
        yield whole[start:end]
        start = end + 1
    yield whole[start:]


def _hashed(values: np.ndarray, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each run of values that begins at ``starts``; place: of a value in its run."""
    f = _factors()
    mixed = (values + np.uint64(0x9E3779B97F4A7C15)) * f[place & 4095] + (place >> 12).astype(np.uint64)
    mixed ^= mixed >> np.uint64(29)
    return np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), starts) if len(starts) else np.empty(0, np.uint64)


def _measured(piece: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measurements of each line but ``seen_before``, its characters, and a hash of its words (0 without any)."""
    points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
    feeds = np.flatnonzero(points == 10)
    begin, end = np.concatenate([[0], feeds + 1]), np.concatenate([feeds, [len(points)]])
    n, size = len(begin), end - begin
    kind = _classes()[points]
    line = np.repeat(np.arange(n), np.diff(np.concatenate([begin, [len(points)]])))
    count = np.bincount(line * 8 + kind, minlength=n * 8).reshape(n, 8).astype(np.float64)
    solid = kind != _BLANK
    at = np.flatnonzero(solid)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = np.flatnonzero(first[at])  # of words, among solid characters
    lengths = np.diff(np.concatenate([starts, [len(at)]]))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    words = _hashed(points[at].astype(np.uint64), starts, place)
    of = line[at[starts]]
    n_words = np.bincount(of, minlength=n).astype(np.float64)
    twice = np.zeros(len(words), bool)
    twice[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((words, of))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=n)
    begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
    hashes = np.zeros(n, np.uint64)
    hashes[of[begins]] = _hashed(words, begins, np.arange(len(words)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(words)]]))))
    last = np.zeros(n, bool)
    ends = np.maximum.reduceat(at, starts[begins]) if len(begins) else np.empty(0, np.int64)
    last[of[begins]] = np.isin(kind[ends], (_MARK, _SYMBOL))
    chars = count[:, [_UPPER, _LOWER, _DIGIT, _SYMBOL, _MARK, _OTHER]].sum(axis=1)
    some, letters, worded = np.maximum(chars, 1), np.maximum(count[:, _UPPER] + count[:, _LOWER], 1), np.maximum(n_words, 1)
    values = {
        "characters": size, "words": n_words, "word_length": chars / worded, "upper": count[:, _UPPER] / letters, "digits": count[:, _DIGIT] / some, "symbols": count[:, _SYMBOL] / some,
        "marks": count[:, _MARK] / some, "repeats": np.bincount(of[twice], minlength=n) / worded, "distinct": np.where(n_words > 0, distinct / worded, 1.0), "ends_in_mark": last,
    }
    bins = np.zeros((n, len(FEATURES)), np.uint8)
    for k, (name, edges) in enumerate(FEATURES.items()):
        if name in values:
            bins[:, k] = np.searchsorted(np.array(edges, np.float64), values[name], "left")
    return bins, size, hashes


def measure(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of every line of all texts, the characters of each line, and how many lines each text has (one at least)."""
    lines = np.array([(t or "").count("\n") + 1 for t in texts], np.int64)
    bins, size, hashes = (np.concatenate(c) for c in zip(*map(_measured, _pieces(texts))))
    owner = np.repeat(np.arange(len(texts)), lines)
    order = np.lexsort((hashes, owner))  # stable: of equal lines the first stays first
    again = np.zeros(len(owner), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1]) & (hashes[order][1:] != 0)
    bins[order[again], list(FEATURES).index("seen_before")] = 1
    return bins, size, lines


@functools.lru_cache(1)
def _offsets() -> tuple[np.ndarray, int]:
    width = np.array([len(e) + 1 for e in FEATURES.values()])
    one = np.concatenate([[0], np.cumsum(width)])
    total = int(one[-1])
    # own bins, then those of the line before and after, then "no line before" and "no line after"
    return np.concatenate([one[:-1], one[:-1] + total, one[:-1] + 2 * total]), total


def _emissions(weights: np.ndarray, bins: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's log-odds to be good, before transitions."""
    at, total = _offsets()
    k = len(FEATURES)
    own, before, after = (weights[at[i * k : (i + 1) * k] + bins].sum(axis=1) for i in range(3))
    start = np.concatenate([[0], np.cumsum(lines)[:-1]])
    x = own + weights[-1]
    x[1:] += before[:-1]
    x[start[1:]] -= before[start[1:] - 1]
    x[start] += weights[3 * total]
    x[:-1] += after[1:]
    end = np.cumsum(lines) - 1
    x[end[:-1]] -= after[end[:-1] + 1]
    x[end] += weights[3 * total + 1]
    return x


def _scattered(g: np.ndarray, bins: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The gradient by the weights, from that by the emissions: the transpose of _emissions."""
    at, total = _offsets()
    k = len(FEATURES)
    start, end = np.concatenate([[0], np.cumsum(lines)[:-1]]), np.cumsum(lines) - 1
    before, after = np.append(g[1:], 0.0), np.concatenate([[0.0], g[:-1]])
    before[end], after[start] = 0.0, 0.0
    out = np.zeros(3 * total + 3)
    for i, v in enumerate((g, before, after)):
        for j in range(k):
            out[at[i * k + j] :][: len(list(FEATURES.values())[j]) + 1] += np.bincount(bins[:, j], v, len(list(FEATURES.values())[j]) + 1)
    out[3 * total], out[3 * total + 1], out[-1] = g[start].sum(), g[end].sum(), g.sum()
    return out


def _chains(x: np.ndarray, lines: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward odds of every line; all texts step by step side by side, longest first. same: weights of staying good,
    of staying bad (a change weighs 0)."""
    gg, bb = np.exp(same)
    e = np.exp(np.clip(x, -50, 50))
    order = np.argsort(-lines, kind="stable")
    start = np.concatenate([[0], np.cumsum(lines)[:-1]])[order]
    size = lines[order]
    ahead, back = e.copy(), np.ones_like(e)
    for t in range(1, int(size[0])):
        m = int(np.searchsorted(-size, -t, "left"))  # texts of more than t lines
        i = start[:m] + t
        r = ahead[i - 1]
        ahead[i] = e[i] * (r * gg + 1) / (r + bb)
    for t in range(int(size[0]) - 2, -1, -1):
        m = int(np.searchsorted(-size, -(t + 1), "left"))
        i = start[:m] + t
        u = e[i + 1] * back[i + 1]
        back[i] = (gg * u + 1) / (u + bb)
    return ahead, back, e


@dataclass
class Model:
    """weights: of bins; same: of transitions; curve: intercept and slope of the document's logistic curve."""

    weights: np.ndarray
    same: np.ndarray
    curve: tuple[float, float]

    def line_odds(self, bins: np.ndarray, lines: np.ndarray) -> np.ndarray:
        ahead, back, _ = _chains(_emissions(self.weights, bins, lines), lines, self.same)
        return ahead * back

    def share_good(self, bins: np.ndarray, size: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the mean over its lines of the probability to be good, weighted by characters; and of each line."""
        odds = self.line_odds(bins, lines)
        good = odds / (1 + odds)
        owner = np.repeat(np.arange(len(lines)), lines)
        total = np.bincount(owner, size, len(lines))
        weight = np.where(total[owner] > 0, size, 1.0)
        return np.bincount(owner, good * weight, len(lines)) / np.bincount(owner, weight, len(lines)), good

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text, probability of each line, lines of each text."""
        bins, size, lines = measure(texts)
        share, good = self.share_good(bins, size, lines)
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * share))), good, lines


def likelihood(weights: np.ndarray, same: np.ndarray, bins: np.ndarray, lines: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the lines' labels (1 good) under the field, and its gradients by weights and transitions."""
    x = _emissions(weights, bins, lines)
    ahead, back, e = _chains(x, lines, same)
    gg, bb = np.exp(same)
    end = np.cumsum(lines) - 1
    inner = np.ones(len(x), bool)
    inner[end] = False
    i = np.flatnonzero(inner)
    u = e[i + 1] * back[i + 1]
    r = ahead[i]
    both = np.stack([r * gg * u, r, u, np.full_like(u, bb)])  # good-good, good-bad, bad-good, bad-bad
    share = both / both.sum(axis=0)
    g = labels - ahead * back / (1 + ahead * back)
    stay = np.array([((labels[i] == 1) & (labels[i + 1] == 1)).sum() - share[0].sum(), ((labels[i] == 0) & (labels[i + 1] == 0)).sum() - share[3].sum()])
    # the partition function, from the odds: each step's sum of the states' weights, in units of the bad state
    steps = np.log1p(ahead[end]).sum() + np.log(r + bb).sum()
    seen = (np.clip(x, -50, 50) * labels).sum() + same[0] * ((labels[i] == 1) & (labels[i + 1] == 1)).sum() + same[1] * ((labels[i] == 0) & (labels[i + 1] == 0)).sum()
    return float(seen - steps), _scattered(g, bins, lines), stay


def _fitted(bins: np.ndarray, lines: np.ndarray, labels: np.ndarray, steps: int, rate: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the mean log-likelihood of a line, with a ridge."""
    theta = np.zeros(3 * _offsets()[1] + 3 + 2)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        _, by_weights, by_same = likelihood(theta[:-2], theta[-2:], bins, lines, labels)
        g = np.concatenate([by_weights, by_same]) / len(bins) - ridge * theta
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        theta = theta + rate * (1 - 0.9 * t / steps) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
    return theta[:-2], theta[-2:]


def _curve(share: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton's steps, with a small ridge and a slope that isn't negative."""
    x = np.stack([np.ones_like(share), share], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        b = b + np.clip(np.linalg.solve(h, x.T @ (weight * (good - p)) - 1e-2 * b), -4, 4)
    return float(b[0]), float(max(b[1], 0.0))


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], shares: dict[int, float], longest: int = 64, steps: int = 150, rate: float = 0.1, ridge: float = 1e-4, rounds: int = 2) -> Model:
    """samples: bins, characters and label (1 good) of each text. A fifth of them calibrates; shares: how often each label is in the whole
    table. Texts of more than ``longest`` lines are learned in pieces. Without samples of both labels all scores are the good share."""
    if len({y for _, _, y in samples}) < 2:
        p = min(max(shares.get(1, 0) / max(sum(shares.values()), 1e-9), 0.01), 0.99) if shares else 0.5
        return Model(np.zeros(3 * _offsets()[1] + 3), np.zeros(2), (float(np.log(p / (1 - p))), 0.0))
    held = [s for i, s in enumerate(samples) if i % 5 == 0]
    if len({y for _, _, y in held}) < 2:
        held = samples
    learned = [s for i, s in enumerate(samples) if i % 5] or samples
    pieces = [(b[k : k + longest], y) for b, _, y in learned for k in range(0, len(b), longest)]
    bins, lines = np.concatenate([b for b, _ in pieces]), np.array([len(b) for b, _ in pieces])
    given = np.repeat(np.array([y for _, y in pieces], np.float64), lines)
    labels = given
    for _ in range(rounds):
        weights, same = _fitted(bins, lines, labels, steps, rate, ridge)
        odds = Model(weights, same, (0.0, 0.0)).line_odds(bins, lines)
        worst = np.minimum.reduceat(odds, np.concatenate([[0], np.cumsum(lines)[:-1]]))
        labels = np.where((given == 1) | ((odds > 1) & (odds > np.repeat(worst, lines))), 1.0, 0.0)
    model = Model(weights, same, (0.0, 1.0))
    share = np.concatenate([model.share_good(b, c, np.array([len(b)]))[0] for b, c, _ in held])
    good = np.array([y for _, _, y in held], np.float64)
    drawn = {y: max(1, int((good == y).sum())) for y in (0, 1)}
    weight = np.array([shares.get(int(y), 1.0) / drawn[int(y)] for y in good])
    return Model(weights, same, _curve(share, good, weight * len(good) / weight.sum()))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 1_500, max_chars: int = 20_000, max_lines: int = 2_000, **options) -> Model:
    """Fit on at most 2 * ``per_label`` texts, about as many of each label, drawn by a hash of the id, of at most ``max_chars`` characters and
    ``max_lines`` lines; what reaches the driver are their binned lines, 15 bytes each, 90 MB at most.

    Rows without id, text or label (0 or 1) teach nothing, nor does an id with both labels; of rows that share an id, one does.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("draw"))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], {})
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, min(1.0, per_label / n))])
    drawn = marked.where(F.col("draw") < (1 << 20) * share[F.col("y")]).orderBy("draw", "doc_id").limit(2 * per_label)
    @arrow_udf("binary")
    def bins(column: pa.Array) -> pa.Array:
        out = []
        for texts in text_batches(column):
            found, size, lines = measure(texts)
            ends = np.cumsum(lines)
            table = np.concatenate([found, size.astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1)
            out += [table[e - k : e].tobytes() for e, k in zip(ends, lines)]
        return pa.array(out, pa.binary())

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.char_length("text") <= max_chars)
    rows = rows.where(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) < max_lines)
    rows = rows.join(F.broadcast(drawn), "doc_id").withColumn("bins", bins("text")).groupBy("doc_id").agg(F.min("bins").alias("bins"), F.first("y").alias("y"), F.first("draw").alias("draw"))
    samples = []
    for r in sorted(rows.collect(), key=lambda r: (r["draw"], r["doc_id"])):
        table = np.frombuffer(r["bins"], np.uint8).reshape(-1, len(FEATURES) + 4)
        samples.append((table[:, :-4], table[:, -4:].copy().view("<u4")[:, 0].astype(np.float64), r["y"]))
    return fit(samples, counts, **options)


def predict(docs: DataFrame, model: Model, text: Column, lines: bool = False) -> Column:
    """struct<score, lines> of each whole text: the probability of label 1, and, if asked for, of each line to be good (else null).

    A null or empty text is one empty line. A text takes memory of some 60 bytes a character of its longest line, but at least of
    PIECE characters, and 100 bytes a line; other columns are not read, repeated rows score alike.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<score: double, lines: array<double>>")
    def run(column: pa.Array) -> pa.Array:
        scores, each = [], []
        for texts in text_batches(column):
            score, good, n = shared.value.score(texts)
            scores.append(score)
            each += np.split(good, np.cumsum(n)[:-1]) if lines else [None] * len(texts)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(each, pa.list_(pa.float64()))], ["score", "lines"])

    return run.asNondeterministic()(text)
