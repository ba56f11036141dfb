"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from directories.

Words are weighed by how many of the scanned files have them, counted over all files. Every line of a file is a candidate
header, so is every run of as many successive words as a template has, across line breaks, and the whole file is a
candidate licence file; a candidate's vector has all its words, those of no template at the
greatest weight, so prose around a phrase lowers the cosine. A file named like a licence, or alike to a template as a
whole, licenses its directory. A file without a licence of its own inherits that of its nearest ancestor directory with
one, by joins over directories.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lexmill.llm.batches import bound_batches, text_batches
from lexmill.session import Scratch

# Whole texts of short public licences without their disclaimers, and statements and standard headers of all, by SPDX
# identifier. A long licence's own text holds its header.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = (
    f"{_BSD} 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = f"{_BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_CC = "This work is licensed under the Creative Commons Attribution{} 4.0 International License."
TEMPLATES = {
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED", "Licensed under the BSD Zero Clause License."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: " + _GNU.format("Affero ", 3)],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "Artistic-2.0": ["Licensed under the Artistic License 2.0.", "This program is free software; you may redistribute it and/or modify it under the terms of the Artistic License version 2.0."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", _BSD_2],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", _BSD, _BSD_3],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", _CC.format("")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", _CC.format("-NonCommercial")],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", _CC.format("-NonCommercial-NoDerivatives")],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", _CC.format("-NonCommercial-ShareAlike")],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", _CC.format("-NoDerivatives")],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", _CC.format("-ShareAlike")],
    "CC0-1.0": ["Licensed under CC0 1.0 Universal.", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."],
    "CDDL-1.0": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "This program is free software; " + _GNU.format("", 2),
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: " + _GNU.format("", 3)],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; " + _GNU.format("Lesser ", 2.1)],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "This library is free software: " + _GNU.format("Lesser ", 3)],
    "MIT": [
        "Released under the MIT License.", f"{_MIT}.",
        f"{_MIT}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MIT-0": [
        "Released under the MIT No Attribution License.",
        f"{_MIT}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "WTFPL": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE. Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
}
#: Licences within this much of the best cosine are close: the words that tell them apart decide.
MARGIN = 0.1
LICENCE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.[a-z]+)?$"
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: A word broken after its hyphen, and what stands before a comment's next line.
_BROKEN = re.compile(r"(?<=[A-Za-z0-9])-\n[^A-Za-z0-9\n]*(?=[A-Za-z0-9])")
#: Directories (of at most a few hundred bytes) that may be broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000


def terms(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Hit(NamedTuple):
    """A template's cosine to the ``size`` words from ``start`` on."""

    score: float
    template: int
    start: int
    size: int


class Matcher:
    """Cosines against all templates; ``weights`` by word, ``rare`` that of any other word."""

    def __init__(self, templates: dict[str, list[str]], weights: dict[str, float], rare: float, threshold: float = 0.8):
        self.weights, self.rare, self.postings, self.names, self.vectors = weights, rare, {}, [], []
        for name, texts in sorted(templates.items()):
            for text in texts:
                vector = self.vector(terms(text))
                norm = math.sqrt(sum(x * x for x in vector.values())) or 1.0
                for w, x in vector.items():
                    self.postings.setdefault(w, []).append((len(self.names), x / norm))
                self.names.append(name)
                self.vectors.append(({w: x / norm for w, x in vector.items()}, len(terms(text))))
        # a cosine is at most the root of the summed squares of the template's entries that the candidate has
        self.most = {w: max(x for _, x in entries) ** 2 for w, entries in self.postings.items()}
        self.threshold, self.least = threshold, threshold * threshold - 1e-9
        self.index = {w: k for k, w in enumerate(self.postings)}
        #: squares of the templates' entries by word; the last column is for all other words
        self.squares = np.zeros((len(self.names), len(self.index) + 1))
        for w, k in self.index.items():
            for i, x in self.postings[w]:
                self.squares[i, k] = x * x

    def vector(self, words: list[str]) -> dict[str, float]:
        out: dict[str, float] = {}
        for w in words:
            out[w] = out.get(w, 0.0) + self.weights.get(w, self.rare)
        return out

    def best(self, words: list[str]) -> list[Hit]:
        """Hits of all the words together that reach the threshold."""
        if sum(self.most[w] for w in self.most.keys() & words) < self.least:
            return []
        vector = self.vector(words)
        norm = math.sqrt(sum(x * x for x in vector.values()))
        dots = np.zeros(len(self.names))
        for w, x in vector.items():
            for i, y in self.postings.get(w, ()):
                dots[i] += x * y
        return [Hit(dots[i] / norm, int(i), 0, len(words)) for i in np.flatnonzero(dots >= self.threshold * norm)] if norm else []

    def windows(self, words: list[str]) -> list[Hit]:
        """For each template that reaches the threshold the best run of as many words as it has."""
        if sum(self.most[w] for w in self.most.keys() & words) < self.least:
            return []
        other, hits = len(self.index), []
        ids = np.array([self.index.get(w, other) for w in words])
        for i, (vector, size) in enumerate(self.vectors):
            if size > len(words):
                continue
            sums = np.concatenate([[0.0], np.cumsum(self.squares[i, ids])])
            starts = np.flatnonzero(sums[size:] - sums[: len(words) - size + 1] >= self.least)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                if len(run):
                    score, at = self._sliding(words, int(run[0]), int(run[-1]), vector, size)
                    if score >= self.threshold:
                        hits.append(Hit(score, i, at, size))
        return hits

    def decided(self, words: list[str], hits: list[Hit]) -> tuple[float, str] | None:
        """The licence of the best hit. If hits of others overlap it within MARGIN, the one whose own words agree most with the passage: of the
        words that not all of them have, those that it has and that stand there, less those that only one of the two has."""
        if not hits:
            return None
        top = max(hits, key=lambda h: (h.score, self.names[h.template]))
        close = [h for h in hits if h.score >= top.score - MARGIN and h.start < top.start + top.size and top.start < h.start + h.size]
        if len({self.names[h.template] for h in close}) > 1:
            sets = {h.template: self.vectors[h.template][0].keys() for h in close}
            telling = set().union(*sets.values()) - set.intersection(*map(set, sets.values()))
            there = telling & set(words[min(h.start for h in close) : max(h.start + h.size for h in close)])
            agrees = lambda h: sum(1 if (w in there) == (w in sets[h.template]) else -1 for w in telling) - (1 - h.score)
            top = max(close, key=lambda h: (round(agrees(h), 9), h.size, self.names[h.template]))
        return top.score, self.names[top.template]

    def _sliding(self, words: list[str], first: int, last: int, vector: dict[str, float], size: int) -> tuple[float, int]:
        """Greatest cosine of the windows that start at ``first`` to ``last``, and where; a step changes two words."""
        counts: dict[str, int] = {}
        dot = square = 0.0
        best = (0.0, first)
        for k in range(first, last + size):
            for w, step in ((words[k], 1), (words[k - size], -1))[: 1 + (k >= first + size)]:
                n, x = counts.get(w, 0), self.weights.get(w, self.rare)
                counts[w] = n + step
                dot += step * x * vector.get(w, 0.0)
                square += x * x * ((n + step) ** 2 - n * n)
            if k >= first + size - 1:
                if (value := dot / math.sqrt(max(square, 1e-12))) > best[0]:
                    best = value, k - size + 1
        return best


def document_frequencies(files: DataFrame, text_col: str, words: list[str]) -> tuple[dict[str, int], int]:
    """In how many files each template word stands, and how many files there are."""
    found = F.array_intersect(F.regexp_extract_all(F.lower(text_col), F.lit(_WORD.pattern), F.lit(0)), F.lit(words))
    counts = files.select(F.explode(found).alias("w")).groupBy("w").count().collect()  # at most one row per template word
    return {r["w"]: r["count"] for r in counts}, files.count()


def scan(files: DataFrame, id_col: str = "id", path_col: str = "path", text_col: str = "text", threshold: float = 0.8, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, path, license, basis, score, licensed_dir) per row; basis: file, header, inherited, or null with the licence.

    Null and empty texts have no licence of their own; a null path inherits nothing. If several files license a directory, the best
    score counts, then the least name. Repeated rows get equal results; other columns are not read. A text takes some 100 bytes a word
    while it is scored.
    """
    templates = templates or TEMPLATES
    words = sorted({w for texts in templates.values() for t in texts for w in terms(t)})
    seen, n = document_frequencies(files, text_col, words)
    rare = math.log(n + 2)
    weights = {w: max(math.log((n + 2) / (seen.get(w, 0) + 1)), 0.01) for w in words}

    bound_batches(files.sparkSession)
    shared = files.sparkSession.sparkContext.broadcast(Matcher(templates, weights, rare, threshold))

    def one(matcher: Matcher, text: str | None) -> dict | None:
        lines, top = [terms(line) for line in (text or "").split("\n")], None
        for line in lines:
            if line and (hit := matcher.decided(line, matcher.best(line))):
                top = max(top or hit, hit)
        words = [w for x in lines for w in x]
        whole = len(lines) == 1 and top is not None
        if len(lines) > 1 and (hit := matcher.decided(words, matcher.best(words))):
            top, whole = max(top or hit, hit), True
        # a wrapped statement may have a line that is like another licence, so runs of words are always looked at; the longest passage says most
        joined = terms(_BROKEN.sub("-", text)) if "-\n" in (text or "") else words
        if hits := matcher.windows(joined):
            hit = matcher.decided(joined, hits)
            top = hit if top is None or hit[0] >= top[0] - MARGIN else top
        return {"license": top[1], "score": round(top[0], 6), "whole": whole} if top else None

    @arrow_udf("struct<license: string, score: double, whole: boolean>")
    def own(column: pa.Array) -> pa.Array:
        out = [one(shared.value, text) for texts in text_batches(column) for text in texts]
        return pa.array(out, pa.struct([("license", pa.string()), ("score", pa.float64()), ("whole", pa.bool_())]))

    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), own.asNondeterministic()(text_col).alias("own"))
    rows = Scratch(files.sparkSession).write(rows, "licences")  # matched once
    rows = rows.select("id", "path", F.regexp_replace("path", r"(^|/)[^/]*$", "").alias("dir"), "own.license", "own.score", (F.col("own.whole") | F.col("path").rlike(LICENCE_NAME)).alias("is_file"))
    best = F.min(F.struct((-F.col("score")).alias("score"), "license"))
    licensed = rows.where("license is not null and is_file and dir is not null").groupBy("dir").agg(best.alias("b")).select(F.col("dir").alias("licensed_dir"), F.col("b.license").alias("inherited"), (-F.col("b.score")).alias("inherited_score"))

    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    dirs = rows.where("dir is not null").select("dir").distinct()
    near = dirs.select("dir", F.explode(ancestors).alias("licensed_dir")).join(licensed, "licensed_dir")
    near = near.groupBy("dir").agg(F.max_by(F.struct("licensed_dir", "inherited", "inherited_score"), F.char_length("licensed_dir")).alias("n"))
    near = F.broadcast(near) if near.count() <= BROADCAST_ROWS else near
    out = rows.join(near, "dir", "left")
    has, given = F.col("license").isNotNull(), F.col("n").isNotNull()
    return out.select(
        "id", "path",
        F.coalesce("license", "n.inherited").alias("license"),
        F.when(has & F.col("is_file"), "file").when(has, "header").when(given, "inherited").alias("basis"),
        F.coalesce("score", "n.inherited_score").alias("score"),
        F.when(~has, F.col("n.licensed_dir")).alias("licensed_dir"),
    )
