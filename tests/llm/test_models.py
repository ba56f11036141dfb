import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, langid, pii, queries


def test_held_out_language(spark, sf):
    rows = queries.op3_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert sum(r["rejected"] for r in rows) <= 0.02 * len(rows)


def test_language_edges(spark):
    texts = [("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 30
    model = langid.fit(*zip(*texts))
    df = spark.createDataFrame([(t,) for t in [None, "", "123 !?", "the dog", "le chien " * 20_000]], "text string")
    got = [tuple(r["p"]) for r in df.select(langid.predict(df, model, F.col("text")).alias("p")).collect()]
    assert [g[0] for g in got] == ["und", "und", "und", "en", "fr"] and [g[2] for g in got[:3]] == [True] * 3
    assert all(0 <= g[1] <= 1 for g in got)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    none = langid.train(empty)
    assert none.predict(["x"])[0] == ["und"]
    nulls = spark.createDataFrame([(None, "a", "en"), (1, None, "en"), (2, "b", None)], "doc_id long, text string, lang string")
    assert langid.train(nulls).labels == []


def plain(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15],
    }


def test_base_spans():
    rng = random.Random(3)
    for _ in range(8000):
        t = "".join(rng.choices("a.@-1203+() 45٣\n", k=rng.randint(0, 60)))
        assert pii.base_spans(t) == plain(t), t
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 50_000, "+1" + " " * 100_000, "@" * 50_000):
        pii.spans(t, pii.train())


def test_base_spans_of_documents(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert pii.base_spans(r["text"] or "") == plain(r["text"] or "")


def test_field_on_unseen_sentences():
    weights, rng = pii.train(), random.Random(99)
    right = found = wanted = 0
    for _ in range(300):
        text, labels = pii._sentence(rng)
        got = set(pii.decode(text, weights))
        right, found, wanted = right + len(got & set(labels)), found + len(got), wanted + len(labels)
    assert right >= 0.95 * found and right >= 0.95 * wanted


@pytest.mark.parametrize("mail", ["anna [at] example.com", "anna.meier(at)example.org", "anna.meier [at] mail [dot] example [dot] com", "anna at example.com"])
def test_addresses_without_digits(mail):
    text = f"please write to {mail}, or wait"
    assert [(k, text[a:b]) for k, a, b, _ in pii.spans(text, pii.train())] == [("email", mail)]


@pytest.mark.parametrize("mail", ["john.de.la.cruz [at] example [dot] com", "max-peter-hans-otto [at] example [dot] com", "a-b-c-d-e-f-g at example dot com", "x_y.z-1.2.3.q.r.s.t.u(at)mail.example.org", "j.r.r.t.van.der.berg.jr[at]uni-x.example.com"])
def test_whole_local_parts(mail):
    """However many words a local part has, none of it is left."""
    for text in (f"please write to {mail}, or wait", f"{mail}", f"(see {mail})", f"a b c\n{mail}\nd"):
        got = [(k, text[a:b]) for k, a, b, _ in pii.spans(text, pii.train())]
        assert got == [("email", mail)], text


def test_generated_local_parts():
    rng = random.Random(21)
    found = 0
    for _ in range(200):
        words = ["".join(rng.choices("abcdeilmnorstu", k=rng.randint(1, 6))) + rng.choice(["", "", "7"]) for _ in range(rng.randint(1, 12))]
        local = "".join(w + s for w, s in zip(words, [*rng.choices(".-_", k=len(words) - 1), ""]))
        mail = local + rng.choice([" [at] ", "(at)", " at ", "[at]"]) + "example" + rng.choice([" [dot] ", "(dot)", " dot ", "."]) + rng.choice(["com", "org", "de"])
        text = f"we said that {mail}; nothing else"
        got = [text[a:b] for _, a, b, _ in pii.spans(text, pii.train())]
        assert not got or got == [mail], text  # never a part of one
        found += got == [mail]
    assert found >= 190


def test_query_against_plain_patterns(spark, sf):
    """Counts and digests of the base spans of all documents, by regular expressions; added spans touch no base span."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain(texts[r["doc_id"]])
        listed = [f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k]]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(base[k]) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = [x.split(":") for x in r["spans"].split(",")] if r["spans"] else []
        assert set(listed) <= {":".join(x) for x in spans} and [(pii.KINDS.index(k), int(a)) for k, a, _ in spans] == sorted((pii.KINDS.index(k), int(a)) for k, a, _ in spans)
        taken = [s for found in base.values() for s in found]
        assert all(int(b) <= x or int(a) >= y for k, a, b in spans if f"{k}:{a}:{b}" not in listed for x, y in taken)


def test_pii_of_an_empty_table(spark):
    assert spark.createDataFrame([], "text string").select(pii.find(F.col("text")), pii.redacted(F.col("text"))).collect() == []


def test_every_generated_label_is_a_candidate():
    rng = random.Random(12)
    for _ in range(500):
        text, labels = pii._sentence(rng)
        known = {seg[2:] for region in pii._regions(text) for seg in pii._candidates(text, *region)[1]}
        assert {(a, b) for _, a, b in labels} <= known, text


def test_pii_columns(spark):
    texts = [None, "", "mail a.b@c.de now, 10.0.0.1 and +1 (743) 555-3824", "write jo04 [at] there [dot] com", "😀 4111 1111 1111 1111", "plain words only. at the dot"]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, found int")
    rows = df.select("text", pii.find(F.col("text")).alias("f"))
    got = rows.select("text", "f", pii.redact(F.col("text"), F.col("f")).alias("r"), pii.digest(F.col("f")).alias("d")).collect()
    assert [r["r"] for r in rows.select(pii.redacted(F.col("text")).alias("r")).collect()] == [r["r"] for r in got]
    assert [r["r"] for r in got] == [None, "", "mail <EMAIL> now, <IP> and <PHONE>", "write <EMAIL>", "😀 <CARD>", "plain words only. at the dot"]
    assert got[2]["d"] == "email:5:13,ip:19:27,phone:32:49" and got[4]["d"] == "card:2:21"
    assert [x["base"] for x in got[3]["f"]] == [False]


def test_decontamination_oracle(spark, sf):
    compare(queries.op5_benchmark_decontamination(spark, sf), connect(sf), queries.oracle_sql()["op5_benchmark_decontamination"])


def test_decontamination_against_all_windows(spark):
    """Every window of every item's size, whether a shared shingle is aligned in it or not: the same documents match the same items."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    items = [[word() for _ in range(n)] for n in (3, 5, 9, 20, 45, 45)] + [[*"xy"] * 12]
    rows = []
    for i in range(120):
        part = list(rng.choice(items))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(part))
            part[at : at + rng.choice([0, 1, 1])] = [word() for _ in range(rng.choice([0, 1, 1]))]
            part = part or [word()]
        rows.append((i, " ".join([*(word() for _ in range(rng.randint(0, 30))), *part, *(word() for _ in range(rng.randint(0, 30)))])))
    shingles = lambda w, n: collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    expected = set()
    for i, text in rows:
        w = text.split()
        for k, item in enumerate(items):
            n = min(5, len(item))
            b = shingles(item, n)
            for s in range(max(1, len(w) - len(item) + 1)):
                a = shingles(w[s : s + len(item)], n)
                if 100 * sum((a & b).values()) >= 75 * sum((a | b).values()) > 0:
                    expected.add((i, k))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    listed = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, listed).collect()}
    assert got == expected and len(got) > 40


def test_decontamination_by_a_window_that_no_shingle_is_aligned_in(spark):
    """Both ends of the item are changed and eight words put in between: windows aligned on a shingle share 83 of 100, one between them 86, and
    86 are needed."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=7))
    item = [word() for _ in range(104)]
    part = [*item[:4], word(), *item[5:51], *(word() for _ in range(8)), *item[51:99], word(), *item[100:]]
    docs = spark.createDataFrame([(1, " ".join([*(word() for _ in range(300)), *part, *(word() for _ in range(300))])), (2, " ".join(part))], "doc_id long, text string")
    listed = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: (r["shared"], r["total"], r["start"]) for r in decontaminate.matches(docs, listed).collect()}
    assert got == {1: (86, 114, 303), 2: (86, 114, 3)}


def test_decontamination_of_a_long_text(spark):
    """One text that repeats an item: its words are hashed once, so ten times the text takes about ten times as long."""
    rng = random.Random(2)
    item = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(30)]
    listed = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")

    def took(times):
        docs = spark.createDataFrame([(1, " ".join(item * times))], "doc_id long, text string")
        start = time.perf_counter()
        assert [r["shared"] for r in decontaminate.matches(docs, listed).collect()] == [26]
        return time.perf_counter() - start

    took(50)
    assert took(20_000) < 12 * max(took(2_000), 1.0)


def test_decontamination_edges(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    item = [word() for _ in range(40)]
    edited = [*item[:39], "changed"]
    rows = [
        (1, " ".join([*(word() for _ in range(30)), *item, *(word() for _ in range(30))])), (2, " ".join(edited).upper()), (3, " ".join(item[:15])), (4, None), (5, ""), (6, "x y two words z"),
        (None, " ".join(item)), (1, "other text"), (7, " ".join(word() for _ in range(5_000)) + " " + "\n".join(item)), (8, " ".join(item[:35])),
    ]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, words string, item_id int")
    items = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(item)), (12, "Two words"), (13, None), (14, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["shared"], r["total"]) for r in decontaminate.matches(docs, items).collect()}
    full = {(d, i): (36, 36) for d in (1, 7, None) for i in (10, 11)}
    assert got == full | {(2, i): (35, 37) for i in (10, 11)} | {(8, i): (31, 36) for i in (10, 11)} | {(6, 12): (1, 1)}
    assert decontaminate.matches(docs.limit(0), items).count() == 0 and decontaminate.matches(docs, items.limit(0)).count() == 0


def test_radius_at_the_limit():
    """Fingerprints of windows at a similarity of exactly 0.75: the last k of 7k + 4 different words changed."""
    rng = np.random.default_rng(9)
    draws = far = 0
    for k in (1, 2, 4, 8, 20):
        for _ in range(1_000):
            words = rng.integers(0, 1 << 63, 7 * k + 4, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 7 * k + 4).astype(np.uint64)
            changed = words.copy()
            changed[-k:] = rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2)
            bits = [np.unpackbits(w.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0) * 2 > len(w) for w in (words, changed)]
            draws, far = draws + 1, far + int((bits[0] != bits[1]).sum() > decontaminate.RADIUS)
    assert far <= draws // 1_000


@pytest.mark.parametrize("n", [1, 2, 5, 33])
def test_fingerprint(spark, n):
    rng = random.Random(n)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(n)]
    got = decontaminate._fingerprint(spark.createDataFrame([(hashes,)], "w array<long>"), "w").first()["print"]
    expected = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > n)
    assert got & ((1 << 64) - 1) == expected


def test_decoding_against_every_segmentation():
    """The dynamic programme finds a segmentation of the greatest score among all of them."""
    weights, tried = pii.train(), 0
    for text in ("call 212-555-0199 or 4111 1111", "a [at] b.com 10.0.0.1", "1234567 8901", "x@y.de, z at q dot org"):
        for start, end in pii._regions(text):
            ends, segments = pii._candidates(text, start, end)
            if not 1 <= len(segments) <= 60:
                continue
            score = [max(sum(f * w for f, w in zip(pii._features(text, s, e), weights[:, k])) for k in range(len(pii.KINDS))) for _, _, s, e in segments]

            def best(at, ends=ends, segments=segments, score=score):
                rest = [score[k] + best(segments[k][1]) for k in range(len(segments)) if segments[k][0] >= at]
                return max([0.0, *rest])

            got = {(s, e) for _, s, e in pii.decode(text, weights)}
            total = sum(score[k] for k, seg in enumerate(segments) if seg[2:] in got)
            assert total == pytest.approx(best(0)), text
            tried += 1
    assert tried >= 2


def test_long_tokens_near_an_anchor():
    for mail in ("a" * 60 + " [at] site [dot] com", "john dot doe at example dot co dot uk"):
        text = f"words before {mail} and after"
        assert [(k, text[a:b]) for k, a, b, _ in pii.spans(text, pii.train())] == [("email", mail)]


def test_language_sample_is_bounded(spark, monkeypatch):
    rows = [(1, "the same text", "en")] * 500 + [(i, f"text number {i}", "en") for i in range(2, 300)] + [(i, f"le texte {i}", "fr") for i in range(300, 330)] + [(900, "x" * 200, "fr")]
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda texts, labels, **o: seen.update(texts=texts, labels=labels))
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_label=40, max_chars=100)
    assert 20 <= seen["labels"].count("en") <= 40 and seen["labels"].count("fr") == 30
    assert len(seen["texts"]) == len(set(seen["texts"])) and max(map(len, seen["texts"])) <= 100
    with pytest.raises(ValueError):
        langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_labels=1)
