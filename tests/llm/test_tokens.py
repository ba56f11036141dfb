import random

import numpy as np
import pytest
import tiktoken
from oracle import compare, connect
from pyspark.sql import functions as F

from lexmill.llm import chat, queries
from lexmill.llm.bpe import Encoder, Tokenizer, load_ranks

public = pytest.importorskip("public_tokenizers")
RANKS = load_ranks(queries.vocabulary())
REFERENCE = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = Encoder(RANKS)
ALPHABET = "aàb's'stmdrevl'' \n\t\r     1²٣!?.中文é😀́\x1c\x85'll've're"


def encoded(texts):
    flat, counts = ENCODER.encode(texts)
    out, at = [], 0
    for n in counts.tolist():
        out.append(flat[at : at + n].tolist())
        at += n
    return out


def test_random_texts():
    rng = random.Random(1)
    for _ in range(400):
        texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(9)]
        assert encoded(texts) == [REFERENCE.encode_ordinary(t) for t in texts]


def test_long_pieces():
    texts = ["a" * 5_000, " " * 3_000 + "x", "'" * 2_000, None, "", "é" * 1_000]
    assert encoded(texts) == [REFERENCE.encode_ordinary(t or "") for t in texts]


def test_documents(spark, sf):
    tokenizer = Tokenizer(spark, queries.vocabulary())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    rows = docs.select("text", tokenizer.encode(F.col("text")).alias("ids"))
    rows = rows.select("text", "ids", tokenizer.decode(F.col("ids")).alias("back"), tokenizer.offsets(F.col("ids")).alias("at")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        raw = (r["text"] or "").encode()
        assert r["ids"] == REFERENCE.encode_ordinary(r["text"] or "") and bytes(r["back"]) == raw
        ends = [*r["at"][1:], len(raw)]
        assert all(REFERENCE.decode_single_token_bytes(i) == raw[a:b] for i, a, b in zip(r["ids"], r["at"], ends))


def test_empty_table(spark):
    tokenizer = Tokenizer(spark, queries.vocabulary())
    assert spark.createDataFrame([], "text string").select(tokenizer.encode(F.col("text")).alias("ids")).collect() == []


def test_escapes():
    rng = random.Random(2)
    for _ in range(2000):
        t = "".join(rng.choices("<\\|>a", k=rng.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t and not any(m in chat.escape(t) for m in ("<|",))


def test_chat(spark):
    rows = [(1, 0, "user", "<|im_start|>"), (1, 1, "assistant", None), (1, 1, "assistant", "a\n<\\|b"), (2, 0, None, "x"), (None, 0, "assistant", "<|im_end|>"), (2, None, "ass<|im_sep|>", "é😀" * 500)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    tokenizer = Tokenizer(spark, queries.vocabulary())
    formatted = chat.format_turns(df, tokenizer)
    assert formatted.count() == len(rows)
    first = max(RANKS.values()) + 1
    for r in formatted.collect():
        assert sum(i >= first for i in r["ids"]) == 3 and len(r["mask"]) == len(r["ids"])
    got = {r["conv_id"]: r for r in chat.digests(formatted, tokenizer).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 6 and got[2]["loss_chars"] == 0 and got[None]["loss_chars"] == len("<|im_end|>")


def test_chat_oracle(spark, sf):
    compare(queries.op6_chat_formatting(spark, sf), connect(sf), queries.oracle_sql()["op6_chat_formatting"])


def test_groups_and_evictions_change_nothing(monkeypatch):
    """Small groups, a cache that is emptied all the time, and a text of one long slice: the ids of the tiktoken library."""
    rng = random.Random(4)
    texts = [None, "", " ".join("".join(rng.choices("abcdeéß ", k=rng.randint(1, 9))) for _ in range(3_000)), "x" * 5_000 + " y" * 900, "\n\n \t", "don't we'll I'M 12 345 ééé ", " ".join(f"w{i}" for i in range(2_000))] * 2
    expected = [REFERENCE.encode_ordinary(t or "") for t in texts]
    for bound, many in ((500_000, 1 << 20), (50, 7), (3_000, 500)):
        monkeypatch.setattr(Encoder, "bound", bound)
        monkeypatch.setattr(Encoder, "many", many)
        encoder = Encoder(RANKS)
        for part in (texts, texts[:3], texts[3:]):
            flat, counts = encoder.encode(part)
            got = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
            assert got == (expected if part is texts else expected[:3] if len(part) == 3 else expected[3:])


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", [1], b"x"), (1, "a b", [2], b"y"), (None, None, None, None)], "doc_id long, text string, ids array<int>, decoded binary")
    got = queries.bpe_digests(df, Tokenizer(spark, queries.vocabulary())).collect()
    assert len(got) == 3 and len({r["ids_sha256"] for r in got if r["doc_id"] == 1}) == 1 and {r["n_tokens"] for r in got if r["doc_id"] is None} == {0}
    assert queries.bpe_digests(df.limit(0), Tokenizer(spark, queries.vocabulary())).collect() == []
