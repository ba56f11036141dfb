import base64
import collections
import hashlib
import io
import math
import random
import re
import textwrap

import pytest
import zstandard
from oracle import compare, connect
from pyspark.sql import functions as F

from lexmill.llm import licenses, lm_score, quality, queries, warc
from lexmill.session import scratch_path

PAGES = "page_id long, url string, html string, digest string"


def test_warc_round_trip(spark):
    rows = [(i, f"http://x/{i}", "<p>" + "é" * (i % 7) * 50) for i in range(200)] + [(500, None, None), (501, "http://a b\r\nX: y", ""), (None, "u", "<p>"), (7, "twice", "<p>"), (502, "long", "x" * 600_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], PAGES)
    archive = warc.write(df, scratch_path(spark, "t"), frame_bytes=2_000, bundle_bytes=20_000)
    got = warc.read(archive).collect()
    assert len(got) == len(rows)
    best = {}
    for i, _, html in rows:
        if i is not None:
            best[html or ""] = max(best.get(html or "", i), i)
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r["page_id"]].append(r)
    for i, _, html in rows:
        raw = (html or "").encode()
        for r in by_id[i]:
            if r["payload_bytes"] == len(raw):
                response = best[html or ""] == i
                assert (r["record_type"], r["refers_to"]) == (("response", None) if response else ("revisit", best[html or ""]))
                assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
                assert bytes(r["payload"]) == (raw if response else b"")
    bundle = archive.first()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(bundle["data"])), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == len(bundle["records"])
    wanted = spark.createDataFrame([(3,), (502,), (9999,), (None,)], "page_id long")
    assert sorted(r["page_id"] for r in warc.fetch(archive, wanted).collect()) == [3, 502]


def test_warc_least_bytes_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "x", ""), (2, "b", "x", ""), (3, "c", "yy", ""), (4, "d", "yy", "")], PAGES)
    marked = {r["page_id"]: r["is_revisit"] for r in warc.mark_revisits(df, min_bytes=2).collect()}
    assert marked == {1: False, 2: False, 3: True, 4: False}
    empty = warc.write(spark.createDataFrame([], PAGES), scratch_path(spark, "t"))
    assert empty.count() == 0 and warc.read(empty).count() == 0


@pytest.mark.parametrize("name", ["op1_warc_bundles", "op10_quality_rules"])
def test_oracles(spark, sf, name):
    compare(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name])


def test_quality(spark):
    texts = [None, "", "a b c a b c", "x\nx\nx\ny\nx", " ".join(f"w{i}" for i in range(60)), "# $ % " * 30, "\x0bone two", "a b " * 5_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    entries = quality.ledger(df)
    for r in entries.collect():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", texts[r["doc_id"]] or "") if x]
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (texts[r["doc_id"]] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(inside), len(lines) - len(set(lines)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", texts[r["doc_id"]] or ""))
    bits = [r["failed"] for r in entries.collect()]
    policy = ("corpus", 2)
    for r in quality.ablations(entries, policy).collect():
        bit = 1 << next(x.bit for x in quality.RULES if x.name == r["rule"])
        assert r["n_failed"] == sum(bool(b & bit) for b in bits) and r["n_only"] == sum(b & quality.mask(policy) == bit for b in bits)
    assert quality.ledger(df.limit(0)).count() == 0


def counted(texts, ids):
    """Counts of words (with the start of each text) and of pairs, how many events there are, by counting."""
    one, two = collections.Counter(), collections.Counter()
    for i in ids:
        w = ["<s>", *(texts[i] or "").lower().split()]
        one.update(w)
        two.update(zip(w, w[1:]))
    return one, two, sum(one.values())  # a start for each end


def chance(a, b, side, size):
    """Of the event b after a, under a model of the counts; size: distinct words of all documents."""
    one, two, events = side
    single = (one[b] + lm_score.SMOOTH) / (events + lm_score.SMOOTH * (size + 2))
    return lm_score.MIX * two[a, b] / one[a] + (1 - lm_score.MIX) * single if one[a] else single


@pytest.mark.parametrize("part_bytes", [1000, 100_000, lm_score.PART_BYTES])
def test_every_word_and_bigram_is_counted(spark, part_bytes, monkeypatch):
    monkeypatch.setattr(lm_score, "PIECE", 700)
    rng = random.Random(5)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(40_000)]
    texts = [" ".join([*rng.choices(common, k=10), *rng.sample(rare, 300)]) for _ in range(300)] + ["A b  a b\n", None, "", "a b", "a b"]
    df = spark.createDataFrame([(i if i != 7 else None, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    good = spark.createDataFrame([(i,) for i in (0, 0, 7, 8, 300, 301, None)], "doc_id long")
    sides = [counted(texts, ids) for ids in ((0, 8, 300, 301), range(len(texts)))]
    size = len(sides[1][0]) - 1
    loss = lambda w, side: sum(-math.log(chance(a, b, side, size)) for a, b in zip(w, w[1:])) / (len(w) - 1)
    expected = collections.Counter()
    for i, t in enumerate(texts):
        w = ["<s>", *(t or "").lower().split()]
        expected[(i if i != 7 else None, len(w) - 1, *[round(loss(w, s), 9) if len(w) > 1 else None for s in sides])] += 1
    got = lm_score.score_all(df, good, part_bytes=part_bytes).collect()
    rounded = lambda x: None if x is None else round(x, 9)
    assert collections.Counter((r["doc_id"], r["n_words"], rounded(r["target_loss"]), rounded(r["background_loss"])) for r in got) == expected
    assert lm_score.score_all(df.limit(0), good, part_bytes=part_bytes).count() == 0


def test_probabilities_sum_to_one(spark):
    """After a context that the target has seen, one that ends a text, one it has never seen, and the start: the chances of all words as the
    operator gives them, and those of the end and of the unseen event, are 1 together."""
    target = ["a b a b c", "b c d", "z", ""]
    words = ["a", "b", "c", "d", "z", "new", "other"]
    probes = [w for w in words] + [f"{c} {w}" for c in words for w in words]
    df = spark.createDataFrame(list(enumerate(target + probes)), "doc_id long, text string")
    got = {r["text"]: r["target_loss"] * r["n_words"] for r in lm_score.score_all(df, df.where(f"doc_id < {len(target)}").select("doc_id")).join(df, "doc_id").where(f"doc_id >= {len(target)}").collect()}
    one, two, events = counted(target, range(len(target)))
    smooth = events + lm_score.SMOOTH * (len(words) + 2)
    for c in ["", *words]:
        given = sum(math.exp((got[c] if c else 0.0) - got[f"{c} {w}".strip()]) for w in words)
        context = c or "<s>"
        ends = one[context] - sum(n for (a, _), n in two.items() if a == context)
        end = (one["<s>"] + lm_score.SMOOTH) / smooth
        end = lm_score.MIX * ends / one[context] + (1 - lm_score.MIX) * end if one[context] else end
        unseen = lm_score.SMOOTH / smooth * (1 - lm_score.MIX if one[context] else 1)
        assert given + end + unseen == pytest.approx(1.0)


def test_equal_rows_are_dealt_over_the_parts(spark):
    text = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(1, text)] * 400, "doc_id long, text string").repartition(8).persist()
    n = 400 * len(text) // 10_000
    parts = df.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in parts) < 5 * 400 / n
    got = lm_score.score_all(df, df.select("doc_id"), part_bytes=10_000).select("score", "n_words").distinct().collect()
    assert len(got) == 1 and got[0]["score"] == pytest.approx(0.0)


def test_licences(spark):
    mit = "Released under the MIT License."
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/x.txt", "prose only here"), (3, "a/b/c/y.txt", "words\nLicensed under the Apache License, Version 2.0.\nmore words"), (4, "a/b/COPYING", "x\nThis work is licensed under the GNU General Public License, version 3.\n"),
        (5, "z/q.txt", None), (6, None, mit), (7, "q.txt", ""), (8, "a/b2/k.txt", "the license was the matter of a long dispute under the law of the land"), (8, "a/b2/k.txt", "w"),
    ]
    df = spark.createDataFrame([(*r, 0.1) for r in rows], "id long, path string, text string, score double")
    got = collections.defaultdict(set)
    for r in licenses.scan(df).collect():
        got[r["id"]].add((r["license"], r["basis"], r["licensed_dir"]))
    assert got == {
        1: {("MIT", "file", None)}, 2: {("GPL-3.0", "inherited", "a/b")}, 3: {("Apache-2.0", "header", None)}, 4: {("GPL-3.0", "file", None)},
        5: {(None, None, None)}, 6: {("MIT", "file", None)}, 7: {(None, None, None)}, 8: {("MIT", "inherited", "a")},
    }
    assert licenses.scan(df.limit(0)).count() == 0


def test_common_licences(spark):
    header = 'Licensed under the Apache License, Version 2.0 (the "License");'
    mit = "Released under the MIT License."
    rows = [(i, f"d{i}/x.txt", [header + "\nbody of a file", f"prose number {i}", f"{i}\n{mit}"][i % 3]) for i in range(300)] + [(300, "e/LICENSE", header), (301, "e/f.txt", "prose")]
    got = {r["id"]: (r["license"], r["basis"]) for r in licenses.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    own = [("Apache-2.0", "header"), (None, None), ("MIT", "header")]
    assert {i: got[i] for i in range(300) if i % 3 != 2} == {i: own[i % 3] for i in range(300) if i % 3 != 2}
    assert {got[i][0] for i in range(2, 300, 3)} == {"MIT"} and got[300] == ("Apache-2.0", "file") and got[301] == ("Apache-2.0", "inherited")
    # words at the end of a sentence count as those within
    counts, n = licenses.document_frequencies(spark.createDataFrame([("the license.",), ("License",), ("v. 2.0.",), (None,)], "text string"), "text", ["license", "2.0"])
    assert counts == {"license": 2, "2.0": 1} and n == 4


def test_wrapped_and_embedded_licences(spark):
    prose = " ".join(f"word{i}" for i in range(400))
    rows = [(100 * i + 10 * j + k, name, text) for i, (name, texts) in enumerate(sorted(licenses.TEMPLATES.items())) for j, t in enumerate(texts) for k, text in enumerate((
        "# " + textwrap.fill(t, 40).replace("\n", "\n# ") + "\n" + prose, prose + "\n/* " + textwrap.fill(t, 72).replace("\n", "\n * ") + "\n */\n" + prose, f"{prose} {t} {prose}",
    ))]
    df = spark.createDataFrame([(i, f"d{i}/x.c", t) for i, _, t in rows] + [(-1, "p/x.c", prose + "\n" + prose), (-2, "q/x.c", "the the " * 9_000)], "id long, path string, text string")
    got = {r["id"]: (r["license"], r["basis"], r["score"]) for r in licenses.scan(df).collect()}
    assert got == {i: (name, "header", 1.0) for i, name, _ in rows} | {-1: (None, None, None), -2: (None, None, None)}


DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE."""
GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation; either version {3} of the License, or (at your option) any later version."
ALIKE = {
    "GPL-2.0": [GNU.format("program", ";", "", 2), GNU.format("file", ";", "", 2)], "GPL-3.0": [GNU.format("program", ":", "", 3), GNU.format("software", ":", "", 3)],
    "LGPL-2.1": [GNU.format("library", ";", "Lesser ", 2.1), GNU.format("program", ";", "Lesser ", 2.1)], "LGPL-3.0": [GNU.format("library", ":", "Lesser ", 3)], "AGPL-3.0": [GNU.format("program", ":", "Affero ", 3), GNU.format("file", ":", "Affero ", 3)],
    **{name: licenses.TEMPLATES[name] for name in licenses.TEMPLATES if name.startswith("CC-BY")},
    **{name: [licenses.TEMPLATES[name][-1] + " " + DISCLAIMER] for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "Zlib", "PostgreSQL", "MIT-0", "Unlicense", "WTFPL")},
    "0BSD": [licenses.TEMPLATES["0BSD"][0].removesuffix("THE SOFTWARE IS PROVIDED") + DISCLAIMER], "Apache-2.0": ["Copyright 2024 Someone\n\n" + licenses.TEMPLATES["Apache-2.0"][-1]], "MPL-2.0": [licenses.TEMPLATES["MPL-2.0"][-1]],
}


def test_close_licences_are_told_apart(spark):
    """Headers and whole files of licences that differ in a word or a paragraph each give their own identifier, wherever they stand, also
    where every word of the templates is frequent."""
    assert len(licenses.TEMPLATES) >= 25
    prose = " ".join(f"word{i}" for i in range(60))
    rows = [(name, text) for name, texts in sorted(ALIKE.items()) for t in texts for text in (t, "Copyright (c) 2024 A. Writer\n\n" + textwrap.fill(t, 70), f"{prose}\n# " + textwrap.fill(t, 60).replace("\n", "\n# ") + f"\n{prose}")]
    common = [t for texts in licenses.TEMPLATES.values() for t in texts]
    for filler in ([], [f"{prose} {common[i % len(common)]}" for i in range(400)]):
        listed = [(i, f"d{i}/x.c", text) for i, (_, text) in enumerate(rows)] + [(10_000 + i, f"f{i}/y.c", t) for i, t in enumerate(filler)]
        got = {r["id"]: (r["license"], r["basis"]) for r in licenses.scan(spark.createDataFrame(listed, "id long, path string, text string")).collect()}
        wrong = {(name, got[i][0]) for i, (name, _) in enumerate(rows) if got[i][0] != name}
        assert not wrong


def test_inheritance_over_documents(spark, sf):
    """Of all documents, by walking up from each one's directory."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()
    got = {r["doc_id"]: r for r in queries.op8_license_scan(spark, sf).collect()}

    def path(r):
        n = r["doc_id"]
        folder = r["source"] if n % 20_000 == 0 else f"{r['source']}/{n // 1000}" if n % 1000 == 0 else f"{r['source']}/{n // 1000}/{n // 50}"
        return folder, f"{folder}/{'LICENSE' if n % 50 == 0 else f'{n}.txt'}"

    licensed = {}
    for r in docs:
        found = got[r["doc_id"]]
        assert found["path"] == path(r)[1]
        if found["basis"] == "file":
            licensed.setdefault(path(r)[0], []).append((-found["score"], found["license"]))
    for r in docs:
        found, folder = got[r["doc_id"]], path(r)[0]
        while folder and folder not in licensed:
            folder = folder.rpartition("/")[0]
        if found["basis"] in ("file", "header"):
            assert found["licensed_dir"] is None and found["score"] >= 0.8
        elif folder in licensed:
            assert (found["basis"], found["licensed_dir"], found["license"], found["score"]) == ("inherited", folder, min(licensed[folder])[1], -min(licensed[folder])[0])
        else:
            assert found["license"] is None and found["basis"] is None


def test_sliding_cosines():
    rng = random.Random(2)
    texts = {n: t for n, t in licenses.TEMPLATES.items()}
    known = sorted({w for t in texts.values() for x in t for w in licenses.terms(x)})
    matcher = licenses.Matcher(texts, {w: rng.uniform(0.1, 3) for w in known}, 3.0, 0.5)
    for _ in range(100):
        t = licenses.terms(rng.choice(rng.choice(list(texts.values()))))
        words = [*rng.choices([*known, "x", "y"], k=20), *(w if rng.random() < 0.8 else "x" for w in t), *rng.choices(known, k=20)]
        expected = 0.0
        for vector, size in matcher.vectors:
            for p in range(len(words) - size + 1):
                v = matcher.vector(words[p : p + size])
                expected = max(expected, sum(x * vector.get(w, 0) for w, x in v.items()) / math.sqrt(sum(x * x for x in v.values())))
        got = max((h.score for h in matcher.windows(words)), default=None)
        assert expected < 0.5 if got is None else got == pytest.approx(expected)


def test_licences_of_documents(spark, sf):
    found = {r["doc_id"]: r["license"] for r in queries.op8_license_scan(spark, sf).where("basis IN ('header', 'file')").collect()}
    stated = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").where(r"text RLIKE '(?m)^(Licensed under|Released under the MIT|This work is licensed)'").collect()}
    assert set(found) == stated
