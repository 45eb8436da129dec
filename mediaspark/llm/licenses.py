"""Licence scan: sparse word n-gram logistic regression over paragraphs, confirmed against templates.

A paragraph is a line of text with a word in it. Its words and word pairs are hashed; the regression knows the
few thousand buckets that occur in its examples, so most of a text costs one table look-up a word. The classes
are the licence families and one for anything else, which is also what a paragraph without known words is.
Probabilities are calibrated by a temperature, and the least probability of a licence is set on examples left
out of the fit. A predicted family is confirmed if a template of it has CONFIRM of its words in the paragraph,
in order. Neighbouring lines without a blank one between them are joined where a stem that licences share is near,
and confirmed in the same way, so a wrapped notice is one licence paragraph.

The examples are made from the templates (words dropped, replaced and surrounded, seeded) and from a bounded
sample of the corpus: NEGATIVES paragraphs, chosen by a hash, without the word stems that all licences share.

Defined results: null and empty texts have no paragraphs and no licence; rows that repeat each get their row; of
tied families the first by name is told; a very long text is searched whole; an empty table gives an empty table and the templates alone are learned from. Columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.llm.common import ALNUM, LOWER, gram_hashes, slices, text_buffer, tidy, word_hashes, words

BUCKETS, NEGATIVES, CONFIRM = 1 << 18, 1000, 0.6

# Notices of the licence families; fixed values.
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
             "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "SPDX-License-Identifier: Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal public domain dedication."],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
            "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GNU General Public License, version 2."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
             "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "proprietary": ["All rights reserved. Unauthorized copying of this file, via any medium is strictly prohibited.", "This document is confidential and proprietary; no part may be reproduced without written permission."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Sentences that look like licences and are none.
LOOKALIKES = [
    "She renewed her driver's license last week.", "The license plate of the car was missing.", "The bar lost its liquor license in version two of the law.",
    "He is a licensed engineer in the state.", "Permission to leave was granted by the officer.", "The source of the river is subject to debate.",
    "The public was asked to distribute the leaflets.", "The software was released under pressure from the board.", "All rights of way are reserved for pedestrians.",
    "The general public may use the library free of charge.", "The foundation published a report on free trade.", "Copies of this work hang in the museum.",
]
#: Stems that all licences share.
_SHARED = r"(?i)licen[sc]|copyright|redistribut|warrant|permission|spdx|creative commons|public domain|rights reserved|\bcc\b"
UNKNOWN = "unknown"


@dataclass
class Model:
    families: list[str]  # the last is UNKNOWN
    row: np.ndarray  # of each bucket; 0: not known
    weights: np.ndarray  # rows x families, row 0 is zero
    bias: np.ndarray
    temperature: float
    least: float


def ngram_buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of the parts between offsets, and the part of each."""
    starts, ends, part = words(data, off, ALNUM)
    h = word_hashes(data, starts, ends, 31)
    two = gram_hashes(h, 2, 32)
    inside = part[:-1] == part[1:] if len(part) else np.zeros(0, bool)
    both = np.concatenate([h, two[inside]])
    return (both >> np.uint64(64 - 18)).astype(np.int64), np.concatenate([part, part[:-1][inside] if len(part) else part])


def paragraphs(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The offsets of all lines; a line's end is the next line's beginning."""
    return np.unique(np.concatenate([off, np.flatnonzero(data == 10) + 1]))


def log_odds(model: Model, data: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lines that hold known words, and their class probabilities."""
    bucket, line = ngram_buckets(data, lines)
    row = model.row[bucket]
    known = row > 0
    row, line = row[known], line[known]
    if not len(line):
        return np.zeros(0, np.int64), np.zeros((0, len(model.families)))
    order = np.argsort(line, kind="stable")
    row, line = row[order], line[order]
    some, first = np.unique(line, return_index=True)
    z = np.add.reduceat(model.weights[row], first, 0) / np.sqrt(np.diff(np.append(first, len(row))))[:, None] + model.bias
    z /= model.temperature
    e = np.exp(z - z.max(1, keepdims=True))
    return some, e / e.sum(1, keepdims=True)


def _words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def similarity(paragraph: str, template: list[str]) -> float:
    """Share of the template's words that occur in the paragraph in order, each found after the one before it."""
    have, at, found = _words(paragraph), 0, 0
    for w in template:
        try:
            at = have.index(w, at) + 1
            found += 1
        except ValueError:
            pass
    return found / len(template)


_TEMPLATE_WORDS = {f: [_words(t) for t in ts] for f, ts in TEMPLATES.items()}
_STEM = re.compile(_SHARED)
#: Words of a join of lines: twice those of the longest template.
LONGEST_JOIN = 2 * max(len(w) for ws in _TEMPLATE_WORDS.values() for w in ws)


def examples(negatives: list[str], seed: int = 3) -> tuple[list[str], list[str]]:
    """Paragraphs and families: disturbed templates, look-alikes and paragraphs of the corpus."""
    rng = np.random.default_rng(seed)
    filler = [w for t in negatives[:300] for w in t.split()[:20]] or "the of and to in for with as by at from".split()
    pick = lambda k: [filler[int(i)] for i in rng.integers(0, len(filler), k)]
    texts, labels = [], []
    for family, templates in TEMPLATES.items():
        for k in range(60):
            w = templates[k % len(templates)].split()
            if k >= len(templates):
                w = [x for x in w if rng.random() > 0.08]
                w = pick(int(rng.integers(0, 6))) + w + pick(int(rng.integers(0, 10)))
            texts.append(" ".join(w))
            labels.append(family)
    for t in LOOKALIKES:
        for _ in range(12):
            texts.append(" ".join(pick(int(rng.integers(0, 6))) + t.split() + pick(int(rng.integers(0, 6)))))
            labels.append(UNKNOWN)
    texts = [t or "-" for t in texts] + negatives
    labels += [UNKNOWN] * len(negatives)
    return texts, labels


def fit(texts: list[str], labels: list[str], seed: int = 3) -> Model:
    """Softmax regression by full-batch Adam on sparse counts; temperature and least probability on a third left out."""
    families = [*sorted(set(labels) - {UNKNOWN}), UNKNOWN]
    data = LOWER[np.frombuffer("\n".join(texts).replace("\n\n", "\n").encode(), np.uint8)]
    lines = np.append(paragraphs(data, np.array([0, len(data)])), [])
    bucket, line = ngram_buckets(data, lines.astype(np.int64))
    y = np.array([families.index(x) for x in labels])
    held = np.random.default_rng(seed).random(len(y)) < 1 / 3
    live, column = np.unique(bucket, return_inverse=True)
    size = np.bincount(line, minlength=len(y)).astype(float)
    value = 1 / np.sqrt(size[line])
    w, b = np.zeros((len(live), len(families))), np.zeros(len(families))
    own = ~held[line]
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]

    def logits() -> np.ndarray:
        return np.stack([np.bincount(line, w[column, k] * value, len(y)) for k in range(len(families))], 1) + b

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for step in range(1, 121):
        g = softmax(logits())
        g[np.arange(len(y)), y] -= 1
        g[held] = 0
        g /= (~held).sum()
        gw = np.stack([np.bincount(column[own], g[line[own], k] * value[own], len(live)) for k in range(len(families))], 1) + 1e-5 * w
        for j, (par, gr) in enumerate(((w, gw), (b, g.sum(0)))):
            m, v = state[2 * j], state[2 * j + 1]
            m += 0.1 * (gr - m)
            v += 0.01 * (gr * gr - v)
            par -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    z = logits()[held]
    tries = np.geomspace(0.3, 5, 40)
    loss = [-np.log(softmax(z / t)[np.arange(len(z)), y[held]] + 1e-12).mean() for t in tries]
    temperature = float(tries[int(np.argmin(loss))])
    p = softmax(z / temperature)
    wrong = p[y[held] == len(families) - 1, :-1].max(1, initial=0)
    least = float(np.clip(np.quantile(wrong, 0.999) if len(wrong) else 0.5, 0.3, 0.9))
    weights = np.zeros((len(live) + 1, len(families)), np.float32)
    strong = np.abs(w).max(1) > 0.05
    weights[1:][strong] = w[strong]
    row = np.zeros(BUCKETS, np.int32)
    row[live[strong]] = np.flatnonzero(strong) + 1
    return Model(families, row, weights, b.astype(np.float32), temperature, least)


def train(docs: DataFrame) -> Model:
    some = docs.filter(F.length("text") > 0).select("text").withColumn("_draw", F.xxhash64(F.lit("licence"), "text"))
    total = some.agg(F.count("*")).first()[0]
    some = some.filter(F.pmod("_draw", F.lit(1 << 20)) < F.lit(int(min(1.0, 3 * NEGATIVES / max(1, total)) * (1 << 20))))
    line = F.element_at(F.split("text", "\n"), 1)
    rows = some.select("_draw", F.substring(line, 1, 400).alias("line")).filter(~F.col("line").rlike(_SHARED) & (F.length("line") > 10)).orderBy("_draw", "line").limit(NEGATIVES)
    return fit(*examples([re.sub(r"\s+", " ", r["line"]).strip() or "-" for r in rows.collect()]))


def find(texts: pa.Array, model: Model) -> list[list[tuple[int, int, str, float, float]]]:
    """For each text its licence paragraphs: byte start and end, family, probability, likeness to the nearest template."""
    data, off = text_buffer(texts)
    lower = LOWER[data]
    lines = paragraphs(lower, off)
    some, p = log_odds(model, lower, lines)
    best = p[:, :-1].argmax(1) if len(p) else np.zeros(0, int)
    hit = np.flatnonzero((p[np.arange(len(p)), best] >= model.least) & (p.argmax(1) == best)) if len(p) else []
    raw, taken, out = data.tobytes(), set(), [[] for _ in range(len(off) - 1)]
    for i in hit:
        a, b = int(lines[some[i]]), int(lines[some[i] + 1])
        paragraph = raw[a:b].decode(errors="replace")
        family = model.families[best[i]]
        like = max(similarity(paragraph, t) for t in _TEMPLATE_WORDS[family])
        if like >= CONFIRM:
            doc = int(np.searchsorted(off, a, "right")) - 1
            out[doc].append((a - int(off[doc]), b - int(off[doc]), family, float(p[i, best[i]]), like))
            taken.add(int(some[i]))
    for i, j, *rest in _joined(raw, lines, off, taken, model):
        a, b = int(lines[i]), int(lines[j])
        doc = int(np.searchsorted(off, a, "right")) - 1
        out[doc].append((a - int(off[doc]), b - int(off[doc]), *rest))
    return [sorted(x) for x in out]


def _joined(raw: bytes, lines: np.ndarray, off: np.ndarray, taken: set[int], model: Model) -> list[tuple[int, int, str, float, float]]:
    """Licence paragraphs of several neighbouring lines: first line, the line after the last, family, probability, likeness.

    Joins have no blank line and no line of `taken`, a shared stem, and at most LONGEST_JOIN words and a line more.
    """
    cut = set(np.searchsorted(lines, off).tolist())
    heads: list[tuple[int, int, str]] = []
    n = len(lines) - 1
    own = [_words(raw[lines[i]:lines[i + 1]].decode(errors="replace")) if i not in taken else [] for i in range(n)]
    stem = [bool(_STEM.search(" ".join(w))) for w in own]
    # Lines of a join that has a stem, which may itself be wrapped.
    pair = [stem[i] or i + 1 < n and i + 1 not in cut and bool(_STEM.search(" ".join(own[i] + own[i + 1]))) for i in range(n)]
    ends = np.append(np.flatnonzero(pair), n + LONGEST_JOIN)
    for i in range(n):
        if not own[i] or ends[np.searchsorted(ends, i)] > i + LONGEST_JOIN:
            continue
        text, some = list(own[i]), stem[i]
        for j in range(i + 1, n):
            if j in cut or not own[j] or len(text) > LONGEST_JOIN:
                break
            text += own[j]
            some = some or pair[j - 1] or stem[j]
            if some:
                heads.append((i, j + 1, " ".join(text)))
    out = []
    for k in range(0, len(heads), 2000):
        part = heads[k:k + 2000]
        sizes = [len(t.encode()) for _, _, t in part]
        found, p = log_odds(model, LOWER[np.frombuffer("".join(t for _, _, t in part).encode(), np.uint8)], np.concatenate([[0], np.cumsum(sizes)]))
        for at, prob in zip(found.tolist(), p):
            best = int(prob.argmax())
            if best < len(model.families) - 1 and prob[best] >= model.least:
                like = max(similarity(part[at][2], t) for t in _TEMPLATE_WORDS[model.families[best]])
                if like >= CONFIRM:
                    out.append((part[at][0], part[at][1], model.families[best], float(prob[best]), like))
    chosen: list[tuple[int, int, str, float, float]] = []
    for x in sorted(out, key=lambda x: (-x[4], x[1] - x[0], x[0])):
        if all(x[1] <= y[0] or y[1] <= x[0] for y in chosen):
            chosen.append(x)
    return chosen


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, n_licensed, families (sorted, joined by commas), spans (family:start:end of each licence paragraph in UTF-8 bytes), score (largest probability, 0 without)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    names = ["doc_id", "n_paragraphs", "n_licensed", "families", "spans", "score"]

    @tidy
    def run(batches):
        net = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = text_buffer(part.column(1))
                lines = paragraphs(data, off)
                starts, _, line = words(data, lines, ALNUM)
                count = np.bincount(np.searchsorted(off, lines[np.unique(line)], "right") - 1, minlength=part.num_rows)
                got = find(part.column(1), net)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(count.astype(np.int64)), pa.array([len(g) for g in got], pa.int64()),
                    pa.array([",".join(sorted({x[2] for x in g})) for g in got], pa.string()),
                    pa.array([",".join(f"{x[2]}:{x[0]}:{x[1]}" for x in g) for g in got], pa.string()),
                    pa.array([max((x[3] for x in g), default=0.0) for g in got], pa.float64())], names)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, n_paragraphs long, n_licensed long, families string, spans string, score double")
