"""Personal data in whole texts: plain patterns, and a semi-Markov conditional random field beside them.

The plain patterns give the base spans. They are found in time linear in the text, by maximal runs that are cut by rule.

The semi-Markov field scores whole candidate segments: of the tokens near a digit, an ``@``, the word *dot*, or *at* in brackets or before a domain, every segment of bounded
length that begins and ends plausibly is described by features of the whole segment (shape, digit groups, check
digit, separators, neighbours). Dynamic programming over the tokens chooses boundaries and types together. Its weights are
learned by stochastic gradient ascent on the exact log-likelihood (forward-backward over segments) from generated sentences, a
fixed number under a fixed seed; no document is used. Segments it finds are added where they touch no base span.
"""

from __future__ import annotations

import bisect
import functools
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lexmill.llm.batches import bound_batches, text_batches

KINDS = ("email", "ip", "card", "phone")
#: Longest segment without letters, in tokens; longest one with letters, in characters: an address has 320 at most, the rest is room for
#: how it is noted.
SPAN, MOST = 32, 512

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Spans = list[tuple[int, int]]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Spans:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def _ips(text: str) -> Spans:
    out = []
    for m in _CHAIN.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, groups = m.start(), m[0].split(".")
        for i in range(0, len(groups) - 3, 4):
            four = groups[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in four):
                out.append((at, at + size))
            at += size + 1
    return out


def _cards(text: str) -> Spans:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def _phones(text: str) -> Spans:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


def base_spans(text: str) -> dict[str, Spans]:
    """Spans of each kind by the plain patterns: leftmost, not overlapping within a kind."""
    digits = _DIGIT.search(text) is not None
    return {
        "email": _emails(text) if "@" in text else [],
        "ip": _ips(text) if digits else [],
        "card": _cards(text) if digits else [],
        "phone": _phones(text) if digits and "+" in text else [],
    }


# ---- the field ------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s+|[^A-Za-z0-9\s]")
_ANCHOR = re.compile(r"(?i)[0-9@]|\bdot\b|[\[({]\s{0,2}at\s{0,2}[\])}]|\bat\s{1,2}[a-z0-9-]{1,64}\.[a-z]", re.ASCII)
#: Characters around an anchor that are looked at; overlapping surroundings are joined.
AROUND, WIDEN = 48, MOST
_CUES = {
    "email": re.compile(r"(?i)(?:e-?mail|mail|contact|write)\W*(?:\w+\W+)?$"),
    "ip": re.compile(r"(?i)(?:\bip|host|server|address)\W*(?:\w+\W+)?$"),
    "card": re.compile(r"(?i)(?:card|visa|pan|payment)\W*(?:\w+\W+)?$"),
    "phone": re.compile(r"(?i)(?:tel|phone|call|fax|mobile|cell)\W*(?:\w+\W+)?$"),
}
_AT, _DOT = r"(?:@|\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+)", r"(?:\.|\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+)"
_MAIL_SHAPE = re.compile(rf"(?i)[a-z0-9_%+-]+(?:{_DOT}[a-z0-9_%+-]+)*{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,10}}")
_IP_SHAPE = re.compile(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}")
_PHONE_SHAPES = (re.compile(r"\(?[0-9]{3}\)?[\s.-]?[0-9]{3}[\s.-][0-9]{4}"), re.compile(r"00[0-9]{1,3}(?:[\s.-]?[0-9]{2,5}){2,4}"))
_MORE = re.compile(rf"(?i){_DOT}[a-z0-9]")
_DATE = re.compile(r"(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4})")
# Common top-level domains.
_TOP = re.compile(r"(?i)(?<![a-z0-9])(?:com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|ch|at|us)$")
N_FEATURES = 28


def _features(text: str, start: int, end: int) -> list[float]:
    """Of a whole segment, whatever its type."""
    s = text[start:end]
    groups = re.findall("[0-9]+", s)
    digits = "".join(groups)
    seps = set(re.sub("[A-Za-z0-9]", "", s))
    before, after = text[start - 1 : start], text[end : end + 1]
    left = text[max(0, start - 24) : start]
    n = len(digits)
    return [
        1.0,
        float(_MAIL_SHAPE.fullmatch(s) is not None),
        float(_IP_SHAPE.fullmatch(s) is not None and all(int(g) <= 255 for g in groups)),
        float(_PHONE_SHAPES[0].fullmatch(s) is not None),
        float(_PHONE_SHAPES[1].fullmatch(s) is not None),
        float(_DATE.fullmatch(s) is not None),
        float(13 <= n <= 19 and not re.search("[A-Za-z@]", s)),
        float(13 <= n <= 19 and luhn(digits)),
        float(n == 10),
        float(9 <= n <= 15),
        float(n == 0),
        float(len(groups) == 1),
        float(2 <= len(groups) <= 3),
        float(len(groups) == 4 and all(len(g) == 4 for g in groups)),
        float(len(seps) == 0),
        float(len(seps) == 1),
        float(len(seps) > 2),
        float(bool(re.search("[A-Za-z]", s))),
        float(bool(re.match(r"[A-Za-z0-9]", before)) or before in ("-", ".", "/", "_", "$", "#", "=", ":")),
        float(bool(re.match(r"[A-Za-z0-9]", after)) or (after in ("-", "/", "_", "%", "@") and after != "")),
        float(s.startswith("+")),
        *[float(_CUES[k].search(left) is not None) for k in KINDS],
        float(s.startswith("(") != (")" in s)),
        float(_MORE.match(text, end) is not None),
        float(_TOP.search(s) is not None),
    ]


def _regions(text: str) -> Iterator[tuple[int, int]]:
    """Joined surroundings of the anchors. Each side reaches on to the next white space, by WIDEN characters at most, so that it
    cuts no token that a segment may have."""
    start = end = None
    for m in _ANCHOR.finditer(text):
        if start is None or m.start() - AROUND - WIDEN > end:
            if start is not None:
                yield start, end
            low, start = end or 0, max(m.start() - AROUND, end or 0)
            low = max(low, start - WIDEN)
            while start > low and not text[start - 1].isspace():
                start -= 1
        end = min(len(text), m.end() + AROUND)
        high = min(len(text), end + WIDEN)
        while end < high and not text[end].isspace():
            end += 1
    if start is not None:
        yield start, end


def _beside_marks(words: list[str], mark: list[bool]) -> list[bool]:
    """Of each token whether, brackets and white space left out, a mark is the next one after it or the last one before it."""
    n = len(words)
    out = [False] * n
    for order, skipped in ((range(n - 1, -1, -1), "[({"), (range(n), "])}")):
        near = False
        for k in order:
            out[k] = out[k] or near
            if mark[k]:
                near = True
            elif not (words[k].isspace() or words[k] in skipped):
                near = False
    return out


def _candidates(text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """Token ends of a region, and segments as (first token, last token + 1, start, end). A segment has an anchor, no line
    break, begins with a letter, digit, ``+`` or ``(``, and ends with a letter or digit.

    With letters it is built like an address: it begins where a run of the characters of local parts begins, it has an ``@``, *at* or *dot*,
    and white space only beside these; so the whole local part belongs to it, however many words it has. It has at most MOST
    characters. With digits alone it has at least 7 of them and at most SPAN tokens.
    """
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
    words = [text[a:b] for a, b in tokens]
    digit = [w[0] in "0123456789" for w in words]
    alpha = [w[0].isascii() and w[0].isalpha() for w in words]
    mark = [w == "@" or w.lower() in ("at", "dot") for w in words]
    beside = _beside_marks(words, mark)
    whole, inside = [], False  # whether an address may begin here: no letter or digit before it in its run
    for w, d, x in zip(words, digit, alpha):
        whole.append(not inside)
        inside = d or x or (inside and w in "._%+-")
    out = []
    for i, w in enumerate(words):
        if not (digit[i] or alpha[i] or w in "+("):
            continue
        letters = marks = gaps = False
        digits = 0
        for j in range(i, len(words)):
            space = words[j][0].isspace()
            if "\n" in words[j] or len(words[j]) > 64 or (space and len(words[j]) > 2) or tokens[j][1] - tokens[i][0] > MOST:
                break
            letters, marks = letters or alpha[j], marks or mark[j]
            gaps = gaps or (space and not beside[j])
            if letters and (gaps or not whole[i]) or not letters and j - i >= SPAN:
                break
            if digit[j]:
                digits += len(words[j])
            elif not (alpha[j] or space or words[j] in "@.()[]{}-+/_%"):
                break
            if digits > 20 and not marks and not letters:
                break
            if (digit[j] or alpha[j]) and (marks if letters else digits >= 7) or (digit[j] and not letters and words[i : j + 1].count(".") >= 3):
                out.append((i, j + 1, tokens[i][0], tokens[j][1]))
    return [b for _, b in tokens], out


def decode(text: str, weights: np.ndarray) -> list[tuple[str, int, int]]:
    """The best segmentation of each region of a text."""
    found = []
    for start, end in _regions(text):
        ends, segments = _candidates(text, start, end)
        if not segments:
            continue
        scores = np.array([_features(text, s, e) for _, _, s, e in segments]) @ weights
        by_end: dict[int, list[int]] = {}
        for k, seg in enumerate(segments):
            by_end.setdefault(seg[1], []).append(k)
        best, back = [0.0] * (len(ends) + 1), [None] * (len(ends) + 1)
        for j in range(1, len(ends) + 1):
            best[j] = best[j - 1]
            for k in by_end.get(j, ()):
                t = int(scores[k].argmax())
                if (value := best[segments[k][0]] + scores[k, t]) > best[j]:
                    best[j], back[j] = value, (k, t)
        j = len(ends)
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                k, t = back[j]
                found.append((KINDS[t], segments[k][2], segments[k][3]))
                j = segments[k][0]
    return sorted(found, key=lambda x: x[1])


def _sentence(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A generated sentence with labelled segments: words, personal data in several notations, and numbers that are none."""
    word = lambda: "".join(rng.choice(["th", "an", "er", "in", "de", "la", "on", "es", "ti", "mo"]) for _ in range(rng.randint(1, 3)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(sep: str) -> str:
        body = "4" + number(14)
        body += next(d for d in "0123456789" if luhn(body + d))
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        at, dot = rng.choice([("@", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), ("@", ".")])
        local = word() + (rng.choice(["", ".", "_"]).join(["", number(2)]) if rng.random() < 0.6 else "")
        if rng.random() < 0.25:
            local = word() + dot + word()
        elif rng.random() < 0.2:
            local = "".join(word() + rng.choice(".-_") for _ in range(rng.randint(1, 6))) + word()
        return local + at + word() + rng.choice(["", dot + word()]) + dot + rng.choice(["com", "org", "net", "de", "fr", "co" + dot + "uk"])

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+{number(2)} {a} {number(7)}", f"00{number(2)} {a} {number(6)}"])

    ip = lambda: rng.choice([".", "[.]", ".", "(.)"]).join(str(rng.randint(0, 255)) for _ in range(4))
    none = lambda: rng.choice([
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1990, 2030)}",
        lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", lambda: number(rng.randint(1, 12)), lambda: f"{number(1)},{number(3)},{number(3)}.{number(2)}",
        lambda: "4" + number(14) + "x", lambda: f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
        lambda: f"{number(4)}-{number(4)}", lambda: " ".join(number(2) for _ in range(rng.randint(4, 8))), lambda: f"at {word()} dot", lambda: f"{word()} at the dot {word()}",
        lambda: f"{word()}@{word()}", lambda: number(16), lambda: f"{rng.randint(256, 999)}.{number(3)}.{number(3)}.{number(3)}", lambda: f"{number(2)}:{number(2)}:{number(2)}",
        lambda: f"#{number(10)}", lambda: f"${number(4)}.{number(2)}",
    ])()
    makers = {"email": email, "ip": ip, "card": lambda: card(rng.choice(["", " ", "-", "."])), "phone": phone}
    cues = {"email": ["mail", "contact"], "ip": ["host", "server"], "card": ["card", "payment"], "phone": ["call", "tel"]}
    text, labels = "", []
    for _ in range(rng.randint(1, 3)):
        text += " ".join(word() for _ in range(rng.randint(1, 5))) + " "
        if rng.random() < 0.5:
            kind = rng.choice(KINDS)
            if rng.random() < 0.3:
                text += rng.choice(cues[kind]) + rng.choice([" ", ": "])
            made = makers[kind]()
            labels.append((kind, len(text), len(text) + len(made)))
            text += made
        else:
            text += none()
        text += rng.choice([" ", ", ", ". "])
    return text + word(), labels


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


@functools.lru_cache(4)
def train(sentences: int = 1200, epochs: int = 12, rate: float = 0.2, decay: float = 1e-4, seed: int = 11) -> np.ndarray:
    """weights[feature, kind], by gradient ascent on the log-likelihood of generated segmentations."""
    rng = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, labels = _sentence(rng)
        for start, end in _regions(text):
            ends, segments = _candidates(text, start, end)
            if segments:
                truth = {(s, e): KINDS.index(k) for k, s, e in labels}
                gold = [(i, truth[s, e]) for i, (_, _, s, e) in enumerate(segments) if (s, e) in truth]
                data.append((len(ends), segments, np.array([_features(text, s, e) for _, _, s, e in segments]), gold))
    weights = np.zeros((N_FEATURES, len(KINDS)))
    weights[0] = -2.0
    for epoch in range(epochs):
        rng.shuffle(data)
        for n, segments, features, gold in data:
            scores = features @ weights
            total = np.log(np.exp(scores).sum(axis=1))
            forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
            by_end, by_start = {}, {}
            for k, (i, j, _, _) in enumerate(segments):
                by_end.setdefault(j, []).append((k, i))
                by_start.setdefault(i, []).append((k, j))
            for j in range(1, n + 1):
                forward[j] = forward[j - 1]
                for k, i in by_end.get(j, ()):
                    forward[j] = _log_add(forward[j], forward[i] + total[k])
            for i in range(n - 1, -1, -1):
                backward[i] = backward[i + 1]
                for k, j in by_start.get(i, ()):
                    backward[i] = _log_add(backward[i], backward[j] + total[k])
            around = np.array([forward[i] + backward[j] - forward[n] for i, j, _, _ in segments])
            expected = np.exp(scores + around[:, None])
            gradient = -features.T @ expected
            for k, t in gold:
                gradient[:, t] += features[k]
            weights += rate / (1 + 0.5 * epoch) * (gradient - decay * weights)
    return weights


def spans(text: str | None, weights: np.ndarray) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether it is a base span) in code points, by kind as listed and then start."""
    if not text:
        return []
    base = base_spans(text)
    taken = sorted(s for found in base.values() for s in found)
    out = [(k, s, e, True) for k in KINDS for s, e in base[k]]
    if _ANCHOR.search(text):
        starts, reach = [s for s, _ in taken], []
        for _, e in taken:
            reach.append(max(e, reach[-1] if reach else 0))
        for kind, s, e in decode(text, weights):
            at = bisect.bisect_left(starts, e)
            if not at or reach[at - 1] <= s:
                out.append((kind, s, e, False))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def find(text: Column, weights: np.ndarray | None = None) -> Column:
    """array<struct<kind, start, end, base>> of each whole text; empty for a null or empty one. Base spans of different kinds may
    overlap; added spans overlap nothing. A very long text is read in one piece, its regions one after the other, so it takes memory for
    itself and its spans; rows that repeat get equal spans; other columns are not read."""
    weights = train() if weights is None else weights
    if spark := SparkSession.getActiveSession():
        bound_batches(spark)

    @arrow_udf("array<struct<kind: string, start: int, end: int, base: boolean>>")
    def run(column: pa.Array) -> pa.Array:
        found, at = [], [0]
        for texts in text_batches(column):
            for t in texts:
                found += spans(t, weights)
                at.append(len(found))
        kind, start, end, base = zip(*found) if found else ((), (), (), ())
        fields = [pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(base, pa.bool_())]
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(fields, ["kind", "start", "end", "base"]))

    return run.asNondeterministic()(text)


def _cut(text: str, found: list[tuple[str, int, int]]) -> str:
    parts, end = [], 0
    for kind, start, stop in sorted(found, key=lambda x: (x[1], x[2])):
        if start >= end:
            parts += [text[end:start], f"<{kind.upper()}>"]
        end = max(end, stop)
    return "".join(parts) + text[end:]


def redact(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; where spans overlap, their union by the first one's kind.
    Null stays null."""

    @arrow_udf("string")
    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), found.to_pylist())
        return pa.array([t if t is None or not spans_ else _cut(t, [(x["kind"], x["start"], x["end"]) for x in spans_]) for t, spans_ in rows], pa.string())

    return run(text, found)


def redacted(text: Column, weights: np.ndarray | None = None) -> Column:
    """``redact`` of what ``find`` finds, in one pass."""
    weights = train() if weights is None else weights
    if spark := SparkSession.getActiveSession():
        bound_batches(spark)

    @arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([t if not t else _cut(t, [x[:3] for x in spans(t, weights)]) for texts in text_batches(column) for t in texts], pa.string())

    return run(text)


def digest(found: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
