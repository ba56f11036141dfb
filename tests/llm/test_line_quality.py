import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import line_quality as lq
from lexmill.llm import queries

rng = np.random.default_rng(0)


def some_lines(lines):
    lines = np.array(lines)
    bins = np.stack([rng.integers(0, len(e) + 1, lines.sum()) for e in lq.FEATURES.values()], axis=1).astype(np.uint8)
    weights = rng.normal(0, 0.5, 3 * lq._offsets()[1] + 3)
    return bins, lines, weights, rng.normal(0, 1, 2)


def enumerated(x, same):
    """All labelings of one chain and their weights."""
    all_ = list(itertools.product((0, 1), repeat=len(x)))
    weight = [sum(a * b for a, b in zip(x, y)) + sum(same[0] if p == q == 1 else same[1] if p == q == 0 else 0 for p, q in zip(y, y[1:])) for y in all_]
    return np.array(all_), np.array(weight)


def test_marginals_and_likelihood_against_all_labelings():
    bins, lines, weights, same = some_lines([1, 5, 3, 8, 1])
    x = lq._emissions(weights, bins, lines)
    odds = lq.Model(weights, same, (0.0, 1.0)).line_odds(bins, lines)
    labels = rng.integers(0, 2, len(x)).astype(float)
    total, start = 0.0, 0
    for n in lines:
        at = slice(start, start + n)
        all_, weight = enumerated(x[at], same)
        p = np.exp(weight - weight.max())
        p /= p.sum()
        assert np.allclose(odds[at] / (1 + odds[at]), p @ all_)
        total += np.log(p[(all_ == labels[at]).all(axis=1)][0])
        start += n
    assert np.isclose(lq.likelihood(weights, same, bins, lines, labels)[0], total)


def test_gradient():
    bins, lines, weights, same = some_lines([4, 1, 6, 2])
    labels = rng.integers(0, 2, lines.sum()).astype(float)
    _, by_weights, by_same = lq.likelihood(weights, same, bins, lines, labels)
    value = lambda w, s: lq.likelihood(w, s, bins, lines, labels)[0]
    for k in [*rng.choice(len(weights), 60, replace=False), len(weights) - 1, len(weights) - 2, len(weights) - 3]:
        step = np.zeros_like(weights)
        step[k] = 1e-5
        assert np.isclose((value(weights + step, same) - value(weights - step, same)) / 2e-5, by_weights[k], atol=1e-5)
    for k in (0, 1):
        step = np.zeros(2)
        step[k] = 1e-5
        assert np.isclose((value(weights, same + step) - value(weights, same - step)) / 2e-5, by_same[k], atol=1e-5)


TEXTS = [None, "", "\n", "One line here.", "a a a a\nB!! C!!\n\na a a a\n  \t\n12 %% x", "Ä ß é\nä ß é\n" * 3, "x" * 5000 + "\n" + "y z " * 4000, "tail\n", "\ud83d bad"]


def slow(text):
    out, seen = [], set()
    classes = lq._classes()
    for line in (text or "").split("\n"):
        words = [w for w in "".join(" " if classes[ord(c)] == lq._BLANK else c for c in line).split(" ") if w]
        kinds = [int(classes[ord(c)]) for c in line]
        count = lambda *k: sum(x in k for x in kinds)  # noqa: B023, E731
        chars, letters = len(kinds) - count(lq._BLANK), max(1, count(lq._UPPER, lq._LOWER))
        values = [len(line), len(words), chars / max(1, len(words)), count(lq._UPPER) / letters, *(count(k) / max(1, chars) for k in (lq._DIGIT, lq._SYMBOL, lq._MARK))]
        values += [sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words)), len(set(words)) / len(words) if words else 1.0, bool(words) and tuple(words) in seen]
        values.append(bool(words) and kinds[max(i for i, k in enumerate(kinds) if k != lq._BLANK)] in (lq._MARK, lq._SYMBOL))
        seen.add(tuple(words))
        out.append([int(np.searchsorted(np.array(e, float), v, "left")) for e, v in zip(lq.FEATURES.values(), values)])
    return out


@pytest.mark.parametrize("piece", [1 << 20, 1, 40])
def test_measurements(monkeypatch, piece):
    monkeypatch.setattr(lq, "PIECE", piece)
    bins, size, lines = lq.measure(TEXTS)
    assert lines.tolist() == [(t or "").count("\n") + 1 for t in TEXTS]
    assert size.tolist() == [len(x) for t in TEXTS for x in (t or "").split("\n")]
    assert bins.tolist() == [r for t in TEXTS for r in slow(t)]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op13_quality_classifier(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()
    held = got[got["held_out"]].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert (held["predicted"] == held["quality"]).mean() > 0.99
    assert held[held["quality"] == 1]["score"].mean() > held[held["quality"] == 0]["score"].mean() + 0.6


def test_lines_of_a_document(spark):
    sf = "/root/testdata/sf0.01"
    model = lq.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    prose = "The of and there was onthe with it, this and that for them."
    text = "\n".join([prose, "Thion, and by the more of these words as before it."] + ["Foo Foo Foo Foo Foo Foo Foo Foo Foo"] * 3 + ["one | two | three | four | five | six"] * 3)
    df = spark.createDataFrame([(text,), (prose,), (None,), ("",), ("word\n" * 100_000,)], "text string")
    got = [r["p"] for r in df.select(lq.predict(df, model, F.col("text"), lines=True).alias("p")).collect()]
    assert [len(p["lines"]) for p in got] == [8, 1, 1, 1, 100_001]
    assert min(got[0]["lines"][:2]) > 0.5 > max(got[0]["lines"][2:])
    assert got[0]["score"] < 0.5 < got[1]["score"] and got[2]["score"] == got[3]["score"]


def test_odd_rows_and_tables(spark):
    """Nulls anywhere, repeated ids and rows, an id with both labels, clashing names, one label only, no label at all."""
    rows = [(i, t, "x", 1.0, 1) for i, t in [(1, "Good words here and more."), (2, "a | b | c"), (None, "Good"), (3, None), (4, ""), (1, "Good words here and more."), (5, "x x x x")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bins string, score double, y int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, 1, 1), (4, None, 0), (5, 0, 0), (5, 1, 0), (99, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for kept in (labels, labels.where("quality = 1"), labels.where("quality = 0"), labels.limit(0)):
        model = lq.train(docs, kept)
        got = docs.select("doc_id", "bins", lq.predict(docs, model, F.col("text"))["score"].alias("p")).collect()
        assert len(got) == len(rows) and all(0 <= r["p"] <= 1 for r in got)
        assert got[0]["p"] == got[5]["p"] and got[3]["p"] == got[4]["p"]
    assert docs.limit(0).select(lq.predict(docs, model, F.col("text"))["score"]).collect() == []
    assert lq.train(docs.limit(0), labels).curve[1] == 0.0
