import random

import numpy as np
import pytest

from lexmill.llm import near_dedup, setsketch
from lexmill.llm.components import components
from lexmill.llm.shingles import WordHashes, shingle_sets, words


def brute(rows):
    """Component of every row by comparing all pairs of string shingle sets."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(s), (least.get(find(i)) if s else doc)) for i, ((doc, _), s) in enumerate(zip(rows, sets)) if doc is not None)


def corpus(seed, families=12, size=14):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefg", k=rng.randint(1, 6))) for _ in range(400)]
    rows = []
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 40, 90, 200]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(copy)))
    return rows + [(10_000, None), (10_001, ""), (10_002, " \n\t"), (10_003, "one"), (10_004, "ONE"), (0, rows[0][1]), (None, rows[3][1]), (10_005, "é" * 50_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, n_shingles int")
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


@pytest.mark.parametrize("large", [5, 1000])
def test_blocks_of_large_buckets(spark, monkeypatch, large):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "LARGE", large)
    rows = corpus(3, families=4, size=30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == brute(rows)


def test_alike_but_unlinked_texts_emit_few_pairs(spark, monkeypatch):
    """2,000 texts that share most of their words, at a similarity of 0.65, fall into the same buckets; what is emitted stays linear."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    core = [word() for _ in range(154)]
    rows = [(i, " ".join([*core, *(word() for _ in range(40))])) for i in range(2_000)]
    rows += [(5_000 + i, rows[i][1] + " " + word()) for i in range(20)]
    emitted, write = {}, near_dedup.Scratch.write

    def counted(self, df, name):
        table = write(self, df, name)
        if name in ("pairs", "mixed"):
            emitted[name] = table.count()
        return table

    monkeypatch.setattr(near_dedup.Scratch, "write", counted)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(2_000)} | {5_000 + i: i for i in range(20)}
    assert emitted["mixed"] > 0 and emitted["pairs"] < 2_000


def test_fine_sketches_lose_no_link():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 2**63, 2_000).astype(np.uint64)
    sets = [np.unique(pool[a : a + n]) for a, n in rng.integers(1, 900, (60, 2)) if n]
    for each in (near_dedup.COARSE, near_dedup.FINE):
        for a in sets[:30]:
            for b in sets[30:]:
                x, y = near_dedup.parity(a, each), near_dedup.parity(b, each)
                while len(x) > len(y):
                    x = near_dedup._folded(x)
                while len(y) > len(x):
                    y = near_dedup._folded(y)
                assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_empty(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_registers():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    union = np.unique(np.concatenate([a, b]))
    ra, rb, ru = setsketch.sketch([a, b, union])
    assert (setsketch.merge(ra, rb) == ru).all()
    estimate = setsketch.jaccard(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(estimate - 1500 / 2500) < 0.2
    assert not setsketch.sketch([np.empty(0, np.uint64)]).any()


def test_estimate_is_unbiased():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = np.unique(pool[:340]), np.unique(pool[60:])
        ra, rb = setsketch.sketch([a, b])
        errors.append(setsketch.jaccard(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0] - 280 / 400)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_parity_is_a_lower_bound():
    rng = np.random.default_rng(5)
    for n in (1, 30, 500, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 7 :], rng.integers(0, 2**63, n // 3).astype(np.uint64)]))
        x, y = near_dedup.parity(a), near_dedup.parity(b)
        while len(x) > len(y):
            x = near_dedup._folded(x)
        while len(y) > len(x):
            y = near_dedup._folded(y)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_shingles_of_a_batch_are_those_of_each_text():
    texts = ["a b c d e f", None, "", "a b", "A B c d E", "x " * 9]
    cache = WordHashes()
    for t, s in zip(texts, shingle_sets(texts, cache)):
        assert (s == shingle_sets([t], cache)[0]).all()
    sets = shingle_sets(texts, cache)
    assert [len(s) for s in sets] == [2, 0, 0, 1, 1, 1] and sets[4][0] in sets[0]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in touched}
