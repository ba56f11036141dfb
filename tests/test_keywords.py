import copy
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.functions.text import fold_string
from lexmill.operators import chain
from lexmill.operators import keywords as k
from lexmill.operators import phrases


def listing(terms, exclusions=(), **scoring):
    return k.parse({
        "schema_version": "1.0.0", "jurisdiction": "NL", "list_version": "1.0.0", "languages": ["nl"],
        "scoring": {"min_score": 3, "fields": {"title": 2.0, "abstract": 1.5, "full_text": 1.0}, **scoring},
        "terms": [{"lang": "nl", "category": "general", "weight": 1, **t} for t in terms], "exclusions": list(exclusions),
    })


SPRAY = {"id": "nl-spray", "term": "bespuiting", "weight": 2, "match": "substring"}
DRIFT = {"id": "nl-drift", "term": "drift", "weight": 3, "requires": ["nl-spray"]}
GOLDEN = [
    (listing([SPRAY, DRIFT]), {"full_text": "in een vlaag van drift"}, 0.0, False),
    (listing([SPRAY, DRIFT]), {"full_text": "drift bij de bespuiting"}, 5.0, True),
    (listing([SPRAY, DRIFT, {"id": "nl-field", "term": "perceel"}]), {"full_text": "drift op het perceel"}, 1.0, False),
    (listing([{"id": "nl-x", "term": "spuitzone"}]), {"title": "spuitzone", "full_text": "spuitzone spuitzone spuitzone"}, 2.0, False),
    (listing([{"id": "nl-x", "term": "spuitzone"}], count_term_once=False), {"full_text": "spuitzone, spuitzone. Spuitzone"}, 3.0, True),
    (listing([{"id": "nl-x", "term": "sterk", "weight": 3}], [{"pattern": "in een opwelling van drift", "reason": "idiom"}]), {"full_text": "sterk, in een  opwelling van drift"}, 0.0, False),
    (listing([{"id": "nl-x", "term": "woord"}]), {"full_text": "woorden antwoord"}, 0.0, False),
    (listing([{"id": "nl-x", "term": "twee woorden", "match": "phrase"}]), {"full_text": "twee\n woorden"}, 1.0, False),
    (listing([{"id": "nl-x", "term": "elève"}]), {"full_text": "ELEVE élève"}, 1.0, False),
    (listing([{"id": "nl-x", "term": "DDT", "case_sensitive": True}]), {"full_text": "ddt"}, 0.0, False),
    (listing([{"id": "nl-x", "term": r"art\. \d+", "match": "regex"}], count_term_once=False), {"full_text": "Art. 12 en art. 3"}, 2.0, False),
    (listing([{"id": "nl-a", "term": "drift"}, {"id": "nl-b", "term": "drift reducing", "match": "phrase"}], count_term_once=False), {"full_text": "drift reducing drift"}, 2.0, False),
    (listing([{"id": "nl-a", "term": "aardappel"}, {"id": "nl-b", "term": "aardappel"}]), {"full_text": "aardappel"}, 2.0, False),
    (listing([{"id": "nl-x", "term": "drift"}]), {"full_text": "ßdrift drift_ drifté"}, 0.0, False),
    (listing([{"id": "nl-x", "term": "drift"}]), {"subject": "drift", "full_text": ""}, 0.0, False),
]


def verdict(spark, keywords, record):
    return spark.range(1).select(k.judge(keywords, **{n: F.lit(t) for n, t in record.items()}).alias("v")).first()["v"].asDict(True)


@pytest.mark.parametrize("case", range(len(GOLDEN)))
def test_golden(spark, case):
    keywords, record, points, passed = GOLDEN[case]
    v = verdict(spark, keywords, record)
    assert (v["score"], v["passed"]) == (points, passed)
    short = spark.range(1).select(k.score(keywords, **{n: F.lit(t) for n, t in record.items()}).alias("v")).first()["v"]
    assert (short["score"], short["passed"]) == (points, passed)
    assert {m["term_id"] for m in v["matches"]} == {t["id"] for t in short["terms"]}


def naive(terms, text):
    """Occurrences by trying every literal of a treatment at every place, the longest first."""
    found, groups = {}, {}
    for literal, how, owner in k.literals(terms):
        groups.setdefault(how, {}).setdefault(literal, set()).add(owner)
    for how, owners in groups.items():
        folded = fold_string(text, not how.cased)
        for at in range(len(folded)):
            if how.left and at and re.match(r"\w", folded[at - 1]):
                continue
            for literal in sorted(owners, key=lambda x: -len(x)):
                m = re.compile(r"\s+".join(map(re.escape, literal.split(" ")))).match(folded, at)
                if m and not (how.right and m.end() < len(folded) and re.match(r"\w", folded[m.end()])):
                    for o in owners[literal]:
                        found.setdefault(o, []).append((m.start(), m.end()))
                    break
    return {o: sorted(x) for o, x in found.items()}


def test_overlaps_against_naive():
    rng = random.Random(5)
    literals = ["aa", "aab", "ab a", "b", "ba", "é", "aa b", "bab"]
    keywords = listing([{"id": f"nl-{i}", "term": x + "x" * (6 - len(x)) if m == "substring" else x * (1 if len(x) > 1 else 2), "match": m} for i, (x, m) in enumerate((x, m) for x in literals for m in ("word", "phrase"))], count_term_once=False)
    scan = k.Scanner(keywords)
    for _ in range(2000):
        text = "".join(rng.choices("ab é \n\u00a0A", k=rng.randint(1, 30)))
        seen, got = phrases.Text.of(text), {}
        for term, start, end in scan.finder.hits(seen):
            got.setdefault(term, []).append(seen.span(start, end))
        assert {o: sorted(x) for o, x in got.items()} == naive(keywords.terms, text), text


@pytest.mark.parametrize("points,review", [(3.0, True), (5.999, True), (6.0, False)])
def test_band_is_half_open(spark, points, review):
    keywords = listing([{"id": "nl-x", "term": "woord", "weight": points}])
    assert verdict(spark, keywords, {"full_text": "woord"})["needs_review"] is review
    assert not verdict(spark, listing([{"id": "nl-x", "term": "woord", "weight": points}], review_band=0), {"full_text": "woord"})["needs_review"]


def test_evidence(spark):
    text = "x" * 100 + " Spuitzone " + "y" * 100
    v = verdict(spark, listing([{"id": "nl-x", "term": "spuitzone", "weight": 3}]), {"full_text": text})
    m = v["matches"][0]
    assert (m["start"], m["end"], m["matched_text"]) == (101, 110, "Spuitzone")
    assert m["snippet"].startswith("…") and m["snippet"].endswith("…")
    assert v["reason"] == "score 3 reaches min_score 3, inside the review band [3, 6) (NL list v1.0.0); matched: nl-x"
    assert verdict(spark, listing([{"id": "nl-x", "term": "spuitzone"}]), {"full_text": "niets"})["reason"] == "no curated term contributed weight (NL list v1.0.0)"
    vetoed = verdict(spark, listing([{"id": "nl-x", "term": "sterk"}], [{"pattern": "in opwelling", "reason": "idiom"}]), {"title": "sterk", "full_text": "a In \n opwelling"})
    assert vetoed["reason"] == "vetoed by exclusion 'in opwelling' in full_text (matched 'In \\n opwelling'): idiom" and vetoed["matches"] == []
    many = listing([{"id": f"nl-{c}", "term": c * 3} for c in "abcdefghij"])
    assert verdict(spark, many, {"full_text": " ".join(c * 3 for c in "jihgfedcba")})["reason"].endswith("matched: nl-j, nl-i, nl-h, nl-g, nl-f, nl-e, nl-d, nl-c and 2 more")


def test_numbers_in_reasons(spark):
    values = [0.0, 1.0, 3.25, 100000.0, 1234567.0, 0.1 + 0.2, 12.3456789]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(k.shortest(F.col("x"))).collect()]
    assert got == [f"{v:g}" for v in values]


def test_emoji_offsets(spark):
    df = spark.createDataFrame([("😀 drift",)], "t string")
    m = df.select(k.judge(listing([{"id": "nl-x", "term": "drift"}]), full_text=F.col("t")).alias("v")).first()["v"]["matches"][0]
    assert (m["start"], m["end"]) == (2, 7)


def test_phrases(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abcdef"), (2, "xabcx abc"), (3, None), (4, "")], "doc_id long, text string")
    listed = spark.createDataFrame([(10, "abc"), (11, "abcdef"), (12, None), (13, ""), (14, "abc"), (15, "zz")], "item_id long, text string")
    for rows in (1, 1000):
        monkeypatch.setattr(phrases, "BROADCAST_ROWS", rows)
        got = sorted(tuple(r) for r in phrases.containing(docs, listed).collect())
        assert got == [(1, 10), (1, 11), (1, 14), (2, 10), (2, 14)]
    assert phrases.containing(docs, listed.limit(0)).count() == 0


def test_phrases_against_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("ab", k=rng.randint(1, 2)))
    text = lambda n: rng.choice(["", " "]) + rng.choice([" ", "\n", "  "]).join(word() for _ in range(n)) + rng.choice(["", "\t"])
    docs = [(i % 40, text(rng.randint(0, 30))) for i in range(50)] + [(None, "aa b a"), (7, "ä€ b ä€ c ä€"), (8, "x" * 40 + " " + "y" * 40)]
    docs.append(docs[0])
    listed = [(100 + i, text(rng.randint(1, 9))) for i in range(60)] + [(1, "b ä€ c"), (2, "x y"), (3, "€"), (4, "xxxxxxxxxxxxxxxxxxxx"), (5, " ")]
    got = phrases.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(listed, "item_id long, text string")).collect()
    expected = [(d, p) for d, t in docs for p, x in listed if x and x in t]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_lists_are_read_again_when_they_change(tmp_path):
    path = tmp_path / "list.json"
    path.write_text(json.dumps(k.example()))
    first = k.load(str(path))
    assert k.load(str(path)) is first
    changed = k.example() | {"list_version": "1.0.10"}
    path.write_text(json.dumps(changed))
    assert k.load(str(path)).list_version == "1.0.10"


def test_exclusions_in_one_pass(spark):
    exclusions = [{"pattern": "zebra", "reason": "1"}, {"pattern": r"x\s+y", "match": "regex", "reason": "2"}, {"pattern": "aber hallo", "reason": "3"}, {"pattern": "bra", "match": "substring", "reason": "4"}]
    keywords = listing([{"id": "nl-x", "term": "sterk"}], exclusions)
    said = lambda text: verdict(spark, keywords, {"full_text": text})["reason"]
    assert said("een Zèbra").endswith("zebra' in full_text (matched 'Zèbra'): 1") and said("zebras").endswith("(matched 'bra'): 4")
    assert said("aber  hallo en X \n y").startswith("vetoed by exclusion 'x") and said("ABER\thallo").endswith(": 3") and "vetoed" not in said("aberhallo")


def test_stages_run_only_on_what_passed(spark):
    calls = spark.sparkContext.accumulator(0)

    def dear(text):
        calls.add(1)
        return {"passed": text != "bad", "score": 2.0, "reason": "seen"}

    stages = [
        chain.Stage("short", ("text",), lambda text: F.struct((F.length(text) < 5).alias("passed"), (F.length(text) == 2).alias("needs_review"))),
        chain.Stage("dear", ("text",), chain.lazily(dear), knows_alive=True), chain.Stage("last", ("n",), lambda n: F.struct((n % 2 == 0).alias("passed"), n.cast("double").alias("score"))),
    ]
    rows = [(0, "ok"), (1, "far too long"), (2, "bad"), (3, "ok"), (4, None), (5, ""), (6, "fine")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "n int, text string, verdict string")
    got = {r["n"]: tuple(r["verdict"]) for r in chain.evaluate(df, stages).select("n", "verdict").collect()}
    assert got == {
        0: (True, 0.0, None, "last", True), 1: (False, 0.0, None, "short", False), 2: (False, 2.0, "seen", "dear", False), 3: (False, 3.0, None, "last", False), 4: (False, 0.0, None, "short", False),
        5: (False, 5.0, None, "last", False), 6: (True, 6.0, None, "last", False),
    }
    assert calls.value == 5
    assert tuple(chain.evaluate(df, []).first()["verdict"]) == (True, 0.0, "no filter stages configured", "chain", False)
    assert chain.evaluate(df.limit(0), stages).collect() == []


BROKEN = [
    lambda d: d.pop("terms"), lambda d: d.update(extra=1), lambda d: d["terms"].append(dict(d["terms"][0])), lambda d: d["terms"][0].update(requires=["en-none"]),
    lambda d: d["terms"][0].update(requires=[d["terms"][0]["id"]]), lambda d: d["terms"][0].update(case_sensitive=True), lambda d: d["terms"][3].update(aliases=["short"]),
    lambda d: d["terms"][5].update(case_sensitive_exception=True), lambda d: d["scoring"].update(min_score=0), lambda d: d["terms"][0].update(weight="3"), lambda d: d.update(list_version="1"),
]


@pytest.mark.parametrize("spoil", range(len(BROKEN)))
def test_invalid_lists(spoil):
    d = copy.deepcopy(k.example())
    k.parse(d)
    BROKEN[spoil](d)
    with pytest.raises(k.InvalidList):
        k.parse(d)


def test_short_verdict_on_documents(spark, sf):
    keywords = k.parse(k.example())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fields = {"title": F.substring("text", 1, 80), "full_text": F.col("text")}
    both = docs.select(k.score(keywords, **fields).alias("n"), k.judge(keywords, **fields).alias("j"))
    odd = both.where("n.score <> j.score OR n.passed <> j.passed OR abs(aggregate(transform(n.terms, x -> x.weight), 0D, (a, x) -> a + x) - n.score) > 1e-9")
    assert odd.count() == 0


def test_chain(spark):
    v = lambda p, r: F.struct(F.lit(p).alias("passed"), F.lit(r).alias("needs_review"))
    got = lambda *stages: tuple(spark.range(1).select(k.chain(list(stages)).alias("c")).first()["c"])
    assert got() == (True, False, None)
    assert got(("a", v(True, True)), ("b", v(True, False))) == (True, True, None)
    assert got(("a", v(True, True)), ("b", v(False, False)), ("c", v(True, True))) == (False, True, "b")
    assert got(("a", v(False, False)), ("b", v(True, True))) == (False, False, "a")
