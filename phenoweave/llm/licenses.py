"""License scans by a trained paragraph classifier.

A sparse logistic regression on word n-grams, trained here on variations of
licence notices and sentences of licence texts and on bounded corpus paragraphs as
the unknown class, names a licence family for each paragraph.  The unknown class
is calibrated on templates that the fitted weights haven't seen.  A prediction
counts only if the unknown class is less likely and a comparison with the family's
templates confirms it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches

UNKNOWN = "unknown"
#: Notices by family, as their licences word them.  ``{v}`` stands for a version.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version {v}.",
        "Licensed under the Apache License, Version {v} (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache License {v}.",
        "This project is licensed under the Apache {v} license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License, see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the BSD {v}-Clause License.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version {v}.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU GPL v{v}.",
        "Released under the GNU Lesser General Public License, version {v}.",
        "Licensed under the GNU Affero General Public License, version {v}.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}.",
        "Licensed under the Mozilla Public License, version {v}.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc": [
        "Licensed under CC BY {v}.",
        "Licensed under CC BY-SA {v}.",
        "This work is licensed under a Creative Commons Attribution {v} International License.",
        "Released under CC0 {v}.",
        "Dedicated to the public domain under CC0.",
    ],
    "cc-restricted": [
        "Licensed under CC BY-NC {v}.",
        "Licensed under CC BY-NC-SA {v}.",
        "Licensed under CC BY-ND {v}.",
        "Licensed under CC BY-NC-ND {v}.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial {v} International License.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives {v} International License.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) 2020 Example. All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "No part of this publication may be reproduced without prior written permission.",
    ],
}
# fixed values: sentences of the licences' texts; each is a template of its own, so a part of a text is found
TEXTS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software
The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement
In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software""",
    "bsd": """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed
In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption)""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies
The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits
Released under the ISC License""",
    "apache": """You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied
See the License for the specific language governing permissions and limitations under the License
Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form""",
    "gpl": """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE
See the GNU General Public License for more details
You should have received a copy of the GNU General Public License along with this program
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version""",
    "mpl": """If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/
This Source Code Form is "Incompatible With Secondary Licenses", as defined by the Mozilla Public License, v. {v}""",
    "cc": """You are free to share, copy and redistribute the material in any medium or format, and to adapt, remix, transform, and build upon the material for any purpose, even commercially
You must give appropriate credit, provide a link to the license, and indicate if changes were made
If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original
To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work
This work is licensed under a Creative Commons Attribution-ShareAlike {v} International License""",
    "cc-restricted": """You may not use the material for commercial purposes
If you remix, transform, or build upon the material, you may not distribute the modified material""",
    "unlicense": """This is free and unencumbered software released into the public domain
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software
The origin of this software must not be misrepresented; you must not claim that you wrote the original software""",
    "boost": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software
Distributed under the Boost Software License, Version {v}
Use, modification and distribution are subject to the Boost Software License, Version {v}""",
    "proprietary": """This document contains confidential information and may not be disclosed to third parties without prior written consent
The content may not be copied, distributed or used without the express written permission of the owner
All trademarks are the property of their respective owners and all rights are reserved""",
}
VERSIONS = ("1", "1.0", "2", "2.0", "2.1", "3", "3.0", "4.0")
FAMILIES = sorted(TEMPLATES.keys() | TEXTS.keys())
LEAST = 0.4  # least probability of a family that counts
COVER = 0.6  # share of a template's pairs of words that confirms a prediction
FOLDS = 4  # templates are kept aside by fold for the calibration
#: Corpus paragraphs of the unknown class that the classifier is fitted on, at most.
MAX_UNKNOWN = 2000
_TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"\d")


def tokens(paragraph: str) -> list[str]:
    return ["0" if _NUMBER.match(t) else t for t in _TOKEN.findall(paragraph.lower())]


def grams(words: list[str]) -> list[str]:
    """Words and pairs of neighbours."""
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray  # gram x class, the last class unknown
    temperature: float
    templates: dict[str, list[frozenset]]
    cue: frozenset  # words of which every confirmed paragraph has one
    window: int  # words around a cue that hold any template

    def classify(self, words: list[str]) -> tuple[str, float]:
        at = [i for g in grams(words) if (i := self.vocabulary.get(g)) is not None]
        return self._best(np.bincount(at, minlength=len(self.vocabulary)) if at else None, len(at))

    def _best(self, counts, n) -> tuple[str, float]:
        if not n:
            return UNKNOWN, 1.0
        s = self._scores(counts) / self.temperature
        p = np.exp(s - s.max())
        p /= p.sum()
        k = int(p.argmax())
        return ([*FAMILIES, UNKNOWN])[k], float(p[k])

    def _scores(self, counts: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(counts)
        x = np.minimum(counts[at], 3).astype(float)
        return (x / np.sqrt(x @ x)) @ self.weights[at] * 4 + self.weights[-1]

    def confirm(self, words: list[str], family: str) -> float:
        """Share of the best template's pairs of words that the paragraph has."""
        have = set(zip(words, words[1:], strict=False))
        return max((len(t & have) / len(t) for t in self.templates[family] if t), default=0.0)


def templates() -> list[tuple[str, str]]:
    """All templates with their family, notices first."""
    return [(t, f) for f in FAMILIES for t in [*TEMPLATES.get(f, []), *TEXTS.get(f, "").split("\n")] if t]


def _variants(lines: list[tuple[str, str]], rng: np.random.Generator) -> list[tuple[list[str], str]]:
    """Each template in its versions, and with a word or an end missing."""
    out = []
    for line, family in lines:
        for v in VERSIONS if "{v}" in line else ("",):
            words = tokens(line.replace("{v}", v))
            out.append((words, family))
            if len(words) > 5:
                for _ in range(2):
                    at = int(rng.integers(0, len(words)))
                    out.append((words[:at] + words[at + 1 :], family))
                out.append((words[: max(5, int(len(words) * rng.uniform(0.6, 0.95)))], family))
    return out


def _matrix(texts: list[list[str]], vocabulary: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(vocabulary) + 1), dtype=np.float32)
    for i, words in enumerate(texts):
        for g in grams(words):
            if (at := vocabulary.get(g)) is not None:
                x[i, at] = min(3, x[i, at] + 1)
        norm = np.sqrt(x[i] @ x[i])
        x[i] *= 4 / norm if norm else 0
        x[i, -1] = 1
    return x


def _weights(x: np.ndarray, y: np.ndarray, classes: int, epochs: int, rate: float, l1: float) -> np.ndarray:
    """Batch gradient steps with soft thresholds; classes weigh the same."""
    w, target = np.zeros((x.shape[1], classes), dtype=np.float32), np.eye(classes, dtype=np.float32)[y]
    weight = (1 / np.maximum(np.bincount(y, minlength=classes), 1))[y]
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    for _ in range(epochs):
        s = x @ w
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= rate * 4 * (x.T @ ((p - target) * weight))
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    return w


def cues(lines: list[tuple[str, str]], unknown: list[list[str]], cover: float = COVER) -> frozenset:
    """Words of which every paragraph has one that reaches ``cover`` of some template.

    Of each template the rarest words (in the unknown paragraphs) are taken until
    the pairs without any of them are too few to confirm it, so nothing that could
    be confirmed is passed over.
    """
    common = Counter(w for words in unknown for w in set(words))
    out = set()
    for line, _ in lines:
        words = tokens(line.replace("{v}", VERSIONS[0]))
        pairs = set(zip(words, words[1:], strict=False))
        left = set(pairs)
        for w in sorted(set(words) - {"0"}, key=lambda w: (common[w], -len(w), w)):
            if len(left) < cover * len(pairs):
                break
            out.add(w)
            left = {p for p in left if w not in p}
    return frozenset(out)


def train(unknown: list[list[str]], seed: int = 0, epochs: int = 240, rate: float = 0.5, l1: float = 2e-4) -> Model:
    """Weights from all templates; the temperature from templates and paragraphs that a fold's weights haven't seen."""
    rng, lines = np.random.default_rng(seed), templates()
    classes = {f: i for i, f in enumerate([*FAMILIES, UNKNOWN])}

    def samples(part: list[tuple[str, str]], others: list[list[str]]) -> tuple[list[list[str]], np.ndarray]:
        known = _variants(part, rng)
        pool = [w for w, _ in known]
        # word salads of notice words: single words alone shouldn't make a licence
        salads = [[str(x) for x in rng.permutation(np.concatenate([pool[int(i)] for i in rng.integers(0, len(pool), 2)]))[: int(rng.integers(2, 12))]] for _ in known]
        texts = [w for w, _ in known] + others + salads
        return texts, np.array([classes[f] for _, f in known] + [classes[UNKNOWN]] * (len(others) + len(salads)))

    vocabulary: dict[str, int] = {}
    for words, _ in _variants(lines, rng):
        for g in grams(words):
            vocabulary.setdefault(g, len(vocabulary))
    scores, truth = [], []
    for fold in range(FOLDS):
        mine = lambda xs, f=fold, inside=False: [x for i, x in enumerate(xs) if (i % FOLDS == f) == inside]
        texts, y = samples(mine(lines), mine(unknown))
        w = _weights(_matrix(texts, vocabulary), y, len(classes), epochs, rate, l1)
        texts, y = samples(mine(lines, inside=True), mine(unknown, inside=True))
        scores.append(_matrix(texts, vocabulary) @ w)
        truth.append(y)
    s, t = np.concatenate(scores), np.concatenate(truth)
    texts, y = samples(lines, unknown)
    w = _weights(_matrix(texts, vocabulary), y, len(classes), epochs, rate, l1)

    def loss(temperature: float) -> float:
        q = s / temperature
        m = q.max(1)
        return float((m + np.log(np.exp(q - m[:, None]).sum(1)) - q[np.arange(len(q)), t]).mean())

    temperature = float(min(np.geomspace(0.05, 5, 80), key=loss))
    shapes: dict[str, list[frozenset]] = {f: [] for f in FAMILIES}
    longest = 0
    for line, f in lines:
        words = tokens(line.replace("{v}", VERSIONS[0]))
        longest = max(longest, len(words))
        shapes[f].append(frozenset(zip(words, words[1:], strict=False)))
    return Model(vocabulary, w.astype(float), temperature, shapes, cues(lines, unknown), 2 * longest)


def fit(docs: DataFrame, max_unknown: int = MAX_UNKNOWN) -> Model:
    """Learn the unknown class from ``max_unknown`` sampled paragraphs that name no licence.

    Of each sampled paragraph the first 2,000 characters are learnt from; null
    texts aren't, and an empty table leaves only word salads for that class.
    """
    cues = "(?i)licen|copyright|spdx|rights reserved|permission|redistribut|proprietary|public domain|free software|apache|mozilla|creative commons|\\b(cc0|cc[ -]by|bsd|l?gpl|agpl|gnu|mpl)\\b"
    known = docs.where("text is not null")
    share = min(1.0, max_unknown / max(known.count(), 1))  # about as many texts at any size, of several paragraphs each
    near = known.where(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 34) <= int(share * (1 << 30))).select("text")
    lines = near.select(F.explode(F.split("text", "\n")).alias("line")).where(~F.col("line").rlike(cues)).select(F.substring("line", 1, 2000).alias("line"), F.xxhash64("line").alias("h")).orderBy("h", "line").limit(max_unknown)
    return train([tokens(r["line"]) for r in lines.collect()])


def scan(docs: DataFrame, model: Model, least: float = LEAST, cover: float = COVER) -> DataFrame:
    """Every row with the licence families that its paragraphs name.

    Columns doc_id, n_paragraphs, families (sorted), n_notices, score (the
    likeliest notice's probability, 0 if none), starts (code points where the
    notices' paragraphs begin).  Paragraphs are non-blank lines; long ones are
    looked at in overlapping windows around cue words, so a notice inside a long
    text is found.  Null and empty texts have no paragraphs; repeated rows repeat;
    an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = [_document(m, t or "", least, cover) for t in batch.column(1).to_pylist()]
            n, fams, notices, scores, starts = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(fams, pa.list_(pa.string())), pa.array(notices, pa.int64()), pa.array(scores, pa.float64()), pa.array(starts, pa.list_(pa.int64()))],
                names=["doc_id", "n_paragraphs", "families", "n_notices", "score", "starts"],
            )

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_paragraphs long, families array<string>, n_notices long, score double, starts array<long>")


def _document(m: Model, text: str, least: float, cover: float) -> tuple:
    at, n, found, starts, best = 0, 0, set(), [], 0.0
    for line in text.split("\n"):
        if line.strip():
            n += 1
            low = line.lower()
            if not m.cue.isdisjoint(_TOKEN.findall(low)):
                words = tokens(line)
                hit = False
                for piece in _pieces(words, m.cue, m.window):
                    family, p = m.classify(piece)
                    if family != UNKNOWN and p >= least and m.confirm(piece, family) >= cover:
                        found.add(family)
                        best, hit = max(best, p), True
                if hit:
                    starts.append(at)
        at += len(line) + 1
    return n, sorted(found), len(starts), best, starts


def _pieces(words: list[str], cue: frozenset, window: int) -> Iterator[list[str]]:
    if len(words) <= window:
        yield words
        return
    end = -1
    for i, w in enumerate(words):
        if w in cue and i >= end:
            yield words[max(0, i - window // 2) : i + window // 2]
            end = i + window // 4


def annotate(docs: DataFrame) -> DataFrame:
    """Fit on the corpus and scan all of it; nulls, empty tables and repeated rows as in :func:`scan`, columns of any name are ignored."""
    return scan(docs, fit(docs))
