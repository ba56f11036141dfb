import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from lexmill.llm import distance_index, queries
from lexmill.llm.hard_negatives import mine

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, slot int, rank int"


def brute(rows, step, positives=5, negatives=10):
    valid = {}
    for i, v, label in sorted((r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[2], [math.floor(256 * float(np.float32(x))) for x in r[1]])):
        valid.setdefault(i, (label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, (label, v) in valid.items():
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, other == label) for b, (other, w) in valid.items() if b != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fit = [(n, b) for n, b, same in scored if not same and 30 * -s <= 100 * -n <= 90 * -s]
            out += [(a, p, k + 1, b, -s, -n) for k, (n, b) in enumerate(fit[:negatives])]
    return sorted(out)


def mined(spark, rows, step=10):
    df = spark.createDataFrame([(i, v, y, "x", 1, 2, 3) for i, v, y in rows], SCHEMA)
    got = mine(df, F.col("vec_id") % step == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def cloud(n, dims, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    rows = [(i, (centres[i % labels] * 0.4 + rng.normal(size=dims)).tolist(), int(rng.integers(labels))) for i in range(n)]
    return rows


def test_against_all_pairs(spark):
    rows = cloud(500, 12, 1)
    assert mined(spark, rows) == brute(rows, 10)


def test_odd_rows(spark):
    """Nulls, non-finite components, ties, one vector in a third of all rows, repeated ids, shorter and empty vectors."""
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(3)], rng.choice([0, 1, 2])) for i in range(200)]
    rows += [(200 + i, [1.0, 0.25, 0.0], i % 3) for i in range(100)]
    rows += [(300, None, 1), (310, [1.0, None, 0.0], 1), (320, [float("nan"), 0.0, 0.0], 1), (330, [float("inf"), 0.0, 0.0], 1), (340, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(350, [1.0], 1), (360, [], 0), (-20, [0.5, 0.5, 0.5], 2), rows[0], rows[0], (5, [0.9, 0.9, 0.9], 1), (370, [1.0, 1.0, 1.0], 77)]
    assert mined(spark, rows) == brute(rows, 10)


def test_many_rounds_and_shards(spark, monkeypatch):
    """Small shards and chunks, and radii that begin far too small."""
    monkeypatch.setattr(distance_index, "SHARD_ROWS", 7)
    monkeypatch.setattr(distance_index, "CHUNK_ROWS", 5)
    monkeypatch.setattr(distance_index, "SLICE", 2)
    fit = distance_index._fit
    monkeypatch.setattr(distance_index, "_fit", lambda *a, **b: (fit(*a, **b)[0], 40.0, 60.0))
    rows = cloud(260, 5, 3)
    assert mined(spark, rows, 20) == brute(rows, 20)


def test_wide_values(spark):
    """Scores beyond what doubles hold exactly."""
    rows = [(i, [x * 1e6 for x in v], y) for i, v, y in cloud(80, 3, 4)]
    assert mined(spark, rows) == brute(rows, 10)


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, None, 1), (100, None, 2)], [(0, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [0.0, 0.0], 2)]])
def test_small_tables(spark, rows):
    assert mined(spark, rows) == brute(rows, 10)


def test_only_touched_intervals_are_scanned(spark):
    """Well separated clusters: an anchor's positives are found without joining it to the other clusters' shards."""
    rows = [(i, [(4.0 if i % 8 == j else 0.0) + 0.001 * (i % 13) for j in range(8)], 0) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label long").select("id", "label", distance_index.integers(F.col("v")).alias("v"))
    index = distance_index.Index(df)
    none = F.lit(None).cast("long")
    state = index.scratch.write(index._opened(df.where("id % 100 = 0").select("id", F.lit(0).alias("slot"), "label", "v", none.alias("low"), none.alias("high"))), "queries")
    needs = index._chunks(state.where("id = 0").withColumn("radius", F.lit(200.0)), 1).select(F.inline("needs"))
    touched = needs.join(index.bounds, "pivot").where("high >= start AND low <= stop").count()
    assert 0 < touched < index.shards.count() / 2


def test_oracle(spark, sf):
    oracle.compare(queries.op12_hard_negatives(spark, sf), oracle.connect(sf), queries.OP12)
