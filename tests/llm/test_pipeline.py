import collections
import random

import pytest
import tiktoken
from test_dedup import brute

import corpus_pipeline
from lexmill.llm import langid, pii
from lexmill.llm.bpe import load_ranks
from lexmill.llm.near_dedup import near_duplicates
from lexmill.llm.queries import vocabulary

public = pytest.importorskip("public_tokenizers")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns and docs.schema == before.schema
        assert docs.join(before.select("doc_id").distinct(), "doc_id", "left_anti").count() == 0
        if name == "language":
            assert docs.count() >= 0.98 * before.count()
        if name == "near_dedup":
            assert docs.count() == near_duplicates(before).select("component_id").distinct().count()
        if name == "personal_data":
            assert docs.count() == before.count() and docs.where("text RLIKE '[0-9a-z]@[a-z0-9]+[.]example'").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count() and last.where("NOT round_trip").count() == 0


def test_nulls_and_clashes(spark, sf):
    rows = [(1, "the cat and the dog " * 12, "en", "s", 3, "x"), (1, "the cat and the dog " * 12, "en", "s", 3, "x"), (None, "le chat et le chien " * 12, "fr", None, None, None), (2, None, "en", "s", 0, "x"), (3, "", None, "s", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.collect()
    assert corpus_pipeline.STAGES[1][1](spark, docs, sf).count() == 4
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rows_of_one_id_are_told_apart(spark, sf, kind):
    rng = random.Random(4)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60))
    item = max((r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()), key=len)
    ids = [None, None, None, 7, 7, -3, 5, 5, 5]
    texts = [prose() for _ in ids]
    texts[2], texts[4] = texts[2] + " " + item, item + " " + texts[4]
    texts[8] = texts[3]  # the copy has the lesser id and stays
    texts[7] = texts[6]
    rows = [(i if i is None or kind == "long" else str(i), t, "en", "s", len(t)) for i, t in zip(ids, texts)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, sf)
    shown = lambda df: sorted((str(r["doc_id"]), r["text"]) for r in df.collect())
    expected = [0, 1, 2, 4, 5, 6, 8]
    assert kept.columns == docs.columns and shown(kept) == sorted((str(ids[i]), texts[i]) for i in expected)
    assert shown(corpus_pipeline.decontamination(spark, kept, sf)) == sorted((str(ids[i]), texts[i]) for i in expected if i not in (2, 4))


def test_language_and_tokens_of_odd_rows(spark, sf):
    """Nulls in every column, a clashing name, repeated rows and ids."""
    english, french = "the cat and the dog sat on the mat with them " * 6, "le chat et le chien sont dans la maison avec eux " * 6
    rows = [(i, english if i % 2 else french, "en" if i % 2 else "fr", "s", 1, "x") for i in range(60)]
    rows += [(None, english, None, None, None, None), (70, None, "en", "s", 0, "x"), (71, "", None, "s", 0, "x"), (72, "12 !? 34", "en", "s", 0, "x"), rows[1], (1, french, "fr", "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    kept = corpus_pipeline.language(spark, docs, sf)
    assert kept.columns == docs.columns and sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if r["text"] and "cat" in r["text"] or r["text"] and "chat" in r["text"])
    ids = docs.withColumnRenamed("score", "ids")
    out = corpus_pipeline.tokens(spark, ids, sf).collect()
    assert len(out) == len(rows) and all(r["round_trip"] for r in out) and {r["n_tokens"] for r in out if r["doc_id"] in (70, 71)} == {0}


def test_run_against_brute_force(spark, sf, tmp_path):
    """All stages over a small table, each by its plain definition: the same documents with the same ids stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(110)
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    copies = docs.where("doc_id < 12").selectExpr("doc_id + 10000 AS doc_id", "concat(text, ' end') AS text", "lang", "source", "n_chars")
    holding = docs.where("doc_id BETWEEN 12 AND 15").crossJoin(items.limit(1).select(items["text"].alias("item"))).selectExpr("doc_id + 20000 AS doc_id", "concat(item, ' ', text) AS text", "lang", "source", "n_chars")
    docs.union(copies).union(holding).select(*docs.columns).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = langid.train(table)
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    rejected = model.predict([t for _, t in rows])[2]
    rows = [r for r, gone in zip(rows, rejected) if not gone]
    top = {doc: c for doc, _, c in brute(rows)}
    rows = [(d, t) for d, t in rows if top[d] == d]
    shingles = lambda w, n: collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    listed = [x for x in ((r["text"] or "").lower().split() for r in items.collect()) if x]

    def holds(text):
        words = (text or "").lower().split()
        for item in listed:
            n = min(5, len(item))
            b = shingles(item, n)
            if not shingles(words, n) & b:
                continue
            for s in range(max(1, len(words) - len(item) + 1)):
                a = shingles(words[s : s + len(item)], n)
                if 100 * sum((a & b).values()) >= 75 * sum((a | b).values()) > 0:
                    return True
        return False

    rows = [(d, t) for d, t in rows if not holds(t)]
    redacted = [(d, t if not t else pii._cut(t, [x[:3] for x in pii.spans(t, pii.train())])) for d, t in rows]
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=load_ranks(vocabulary()), special_tokens={})
    expected = sorted((d, library.encode_ordinary(t or "")) for d, t in redacted)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in got) == expected and all(r["round_trip"] for r in got)
    assert 20 < len(expected) < table.count() and not any(d >= 20_000 for d, _ in expected)
