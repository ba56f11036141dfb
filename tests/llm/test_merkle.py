import hashlib
import random
import zlib

import pytest

import oracle
from lexmill.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, leaf string, pos int, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row, text):
    return sha(*[field(text if c == "text" else row[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])


def climb(level):
    """The root of a level, and for each of its nodes the siblings on the way up."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for leaf, i in enumerate(at):
            run = range(i - i % 3, min(i - i % 3 + 3, len(level)))
            paths[leaf].append(("".join(level[k] for k in run if k < i), "".join(level[k] for k in run if k > i)))
        level, at = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)], [i // 3 for i in at]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, upper = climb([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, upper):
        for (_, _, leaf, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            folded = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                folded = leaf_of(r, r["text"].replace("\n", ""))
            for a, b in path + above:
                folded = sha(a, folded, b)
            out.append((r["doc_id"], leaf, trees[s][0], root, sha(*[a + b for a, b in path + above]), folded, folded == root))
    return sorted(out, key=repr)


def table(n, sources, seed):
    rng = random.Random(seed)
    texts = [None, "", "\n", "a\nb", "ä€😀\n\n", "plain", "x\n" * 20_000]
    rows = []
    for i in range(n):
        text = rng.choice(texts)
        rows.append({"doc_id": None if i % 41 == 5 else i - 7, "text": text, "lang": rng.choice([None, "", "de"]), "source": sources(i, rng), "n_chars": rng.choice([None, 5, -1]), "leaf": "x", "pos": 3, "path": "y"})
    return rows + [dict(rows[0]), dict(rows[0]), dict(rows[-1], doc_id=0)] if n else rows


@pytest.mark.parametrize("n,sources", [
    (0, None), (1, lambda i, rng: None), (1200, lambda i, rng: "hot" if i % 3 else rng.choice([None, "", "ä", "z", "-"])), (800, lambda i, rng: f"s{i // 2}"),
])
def test_against_a_tree_in_memory(spark, n, sources):
    rows = table(n, sources, n)
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in merkle.document_manifest(df).collect()), key=repr)
    assert got == brute(rows) if rows else got == []


def test_block_edges(spark):
    """Groups of one leaf, of a whole block, of one more than that, and of more than a block of blocks' leaves."""
    rows = [{"doc_id": i, "text": f"t{i}", "lang": None, "source": s, "n_chars": 1} for s, n in (("a", 1), ("b", 3), ("c", 243), ("d", 244), ("e", 730)) for i in range(n)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted((tuple(r) for r in merkle.document_manifest(df).collect()), key=repr) == brute(rows)


def test_three_rounds_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 3)
    rows = table(200, lambda i, rng: "hot" if i % 4 else f"s{i}", 9)
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in merkle.document_manifest(df).collect()), key=repr) == brute(rows)


def test_tampering_is_found(spark, sf):
    got = queries.op11_merkle_manifest(spark, sf).toPandas()
    assert got["root"].nunique() == 1 and 0 < got["verified"].sum() < len(got)
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")["text"]
    for r in got.itertuples():
        changed = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (docs[r.doc_id] or "")
        assert r.verified == (not changed)


def test_oracle(spark, sf):
    oracle.compare(queries.op11_merkle_manifest(spark, sf), oracle.connect(sf), queries.OP11)
