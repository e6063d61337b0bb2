"""License scans by a trained paragraph classifier with template confirmation.

A paragraph (a line of a text) becomes a sparse row of the word uni- and
bigrams that occur in licence notices. A multinomial logistic regression with
an L1 penalty, so most weights are zero, tells licence families and the class
``unknown`` apart. It is trained on the notices below, varied (cropped, words
lost, case changed, set among words of the corpus), against paragraphs of a
bounded corpus sample and shuffled notices as unknown. A temperature and an
offset of the unknown class are calibrated on rows that the model hasn't seen,
in ``FOLDS`` folds. Unknown rows made of one notice's words share a fold, so that
class is calibrated on unseen texts; variants of a notice may be in several,
since a family only counts where one of these notices is found. A predicted
family counts only if a notice of it is found in the paragraph: at least
``COVERAGE`` of the notice's word trigrams. Besides single lines, blocks of
lines up to a blank one are searched for passages that hold as much of a notice
(a notice may be wrapped, and a block may have several); a passage counts if
the classifier gives the words it shares with the notice the notice's family.

Plan. Training reads at most ``SAMPLE_DOCS`` documents (those with the
smallest hash of doc_id), and of each ``SAMPLE_LINES`` paragraphs at most, those
with the smallest hash; a paragraph of over ``SAMPLE_BYTES`` counts as several.
Variants are set among ``POOL_WORDS`` words of the sample at most. Scanning is one
narrow pass over all paragraphs of all texts; the model is a few thousand
numbers.

Edge cases. Null and empty texts have one empty paragraph and no licence.
Repeated rows give equal rows; a null doc_id is kept; an empty table gives an
empty result (the model then trains without corpus paragraphs). Other columns
are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_document, raw, table

SAMPLE_DOCS = 1500
SAMPLE_LINES, SAMPLE_BYTES = 5, 2000
POOL_WORDS = 20_000
FOLDS = 4
COVERAGE = 0.7
#: From this calibrated probability on a family is predicted.
LEAST = 0.5
VARIANTS = 24
UNKNOWN = "unknown"

# Notices of licences, by family.
NOTICES = {
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0": [
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "lgpl": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "This document is confidential and proprietary and may not be reproduced without permission.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
}

_BLANK = re.compile(rb"\n(?:[ \t\r\x0b\x0c]*\n)+")
_WORD = re.compile(rb"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def words_of(paragraph: bytes) -> list[bytes]:
    return _WORD.findall(paragraph.lower())


def grams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    """Word n-grams; the whole where there are fewer words."""
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


FAMILIES = sorted(NOTICES)
_TEMPLATES = {f: [grams(words_of(x.encode()), 3) for x in NOTICES[f]] for f in FAMILIES}
_VOCABULARY = {w: k for k, w in enumerate(sorted({w for f in FAMILIES for x in NOTICES[f] for w in words_of(x.encode())}), start=1)}
_V = len(_VOCABULARY) + 1


def _bigrams() -> np.ndarray:
    """(V, V) table of the bigram features' numbers, 0 for none; word 0 is any word outside the vocabulary."""
    out = np.zeros((_V, _V), np.int32)
    k = _V
    for f in FAMILIES:
        for x in NOTICES[f]:
            ids = [_VOCABULARY[w] for w in words_of(x.encode())]
            for a, b in zip(ids, ids[1:], strict=False):
                if not out[a, b]:
                    out[a, b] = k
                    k += 1
    return out


_BIGRAMS = _bigrams()
_FEATURES = int(_BIGRAMS.max()) + 1


def rows_of(paragraphs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every feature that a paragraph holds, once each."""
    ids, sizes = [], []
    for p in paragraphs:
        got = [_VOCABULARY.get(w, 0) for w in words_of(p)] if p else []
        ids += got
        ids.append(0)  # so that no bigram spans two paragraphs
        sizes.append(len(got) + 1)
    x = np.array(ids, np.int32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    pairs = _BIGRAMS[x[:-1], x[1:]]
    rows, features = np.concatenate([row[x > 0], row[:-1][pairs > 0]]), np.concatenate([x[x > 0], pairs[pairs > 0]])
    both = np.unique(rows.astype(np.int64) * _FEATURES + features)
    return both // _FEATURES, both % _FEATURES


def covered(paragraph: bytes, family: str) -> float:
    """The largest share of a notice's trigrams that the paragraph holds."""
    words = words_of(paragraph)
    own = {n: grams(words, n) for n in {len(next(iter(t))) for t in _TEMPLATES[family]}}
    return max(len(t & own[len(next(iter(t)))]) / len(t) for t in _TEMPLATES[family])


def _by_gram() -> dict[tuple[bytes, ...], list[int]]:
    """The notices (numbers in _ALL) that hold each gram."""
    out: dict[tuple[bytes, ...], list[int]] = {}
    for k, (_, t) in enumerate(_ALL):
        for g in t:
            out.setdefault(g, []).append(k)
    return out


_ALL = [(f, t) for f in FAMILIES for t in _TEMPLATES[f]]
_BY_GRAM = _by_gram()


def passages(block: bytes) -> list[tuple[str, bytes]]:
    """(family, shared words) of the passages that hold ``COVERAGE`` of a notice of it.

    A passage goes where another family's of higher coverage has most of it.
    """
    words = words_of(block)
    hits: dict[int, list[tuple[int, tuple[bytes, ...]]]] = {}
    for n in (2, 3):
        for at, g in enumerate(zip(*(words[k:] for k in range(n)), strict=False)):
            for k in _BY_GRAM.get(g, ()):
                hits.setdefault(k, []).append((at, g))
    found = []  # (coverage, family, positions, words of a gram)
    for k, own in hits.items():
        family, t = _ALL[k]
        long, i = len(t) + len(t) // 4 + 3, 0
        while i < len(own):
            j = i
            while j < len(own) and own[j][0] < own[i][0] + long:
                j += 1
            share = len({g for _, g in own[i:j]}) / len(t)
            if share >= COVERAGE:
                found.append((share, family, {at for at, _ in own[i:j]}, len(own[i][1])))
                i = j
            else:
                i += 1
    out = []
    for share, family, own, n in found:
        spans = [(min(y), max(y) + m) for s, f, y, m in found if f != family and s > share]
        if not any(2 * sum(a <= at < z for at in own) > len(own) for a, z in spans):
            out.append((family, b" ".join(words[k] for k in sorted({at + d for at in own for d in range(n)}))))
    return out


class Classifier:
    """Sparse multinomial logistic regression; class 0 is unknown, class k is FAMILIES[k - 1]."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0, offset: float = 0.0):
        self.weights, self.bias, self.temperature, self.offset = weights, bias, temperature, offset

    @staticmethod
    def logits(paragraphs: list[bytes], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Each row is divided by the root of its number of features."""
        out = np.repeat(bias[None].astype(np.float64), len(paragraphs), 0)
        rows, features = rows_of(paragraphs)
        if len(rows):
            begin = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            sizes = np.diff(np.append(begin, len(rows)))
            out[rows[begin]] += np.add.reduceat(weights[features], begin, axis=0) / np.sqrt(sizes)[:, None]
        return out

    def probabilities(self, paragraphs: list[bytes]) -> np.ndarray:
        return self._softmax(self.logits(paragraphs, self.weights, self.bias), self.temperature, self.offset)

    @staticmethod
    def _softmax(logits: np.ndarray, temperature: float, offset: float) -> np.ndarray:
        z = logits / temperature
        z[:, 0] += offset
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)

    @classmethod
    def fit(cls, paragraphs: list[bytes], classes: np.ndarray, notice: np.ndarray, penalty: float = 2e-5, steps: int = 250, rate: float = 6.0, seed: int = 3) -> Classifier:
        """notice: a number of the notice that a paragraph is a variant of."""
        n = len(paragraphs)
        x = np.zeros((n, _FEATURES), np.float32)
        x[rows_of(paragraphs)] = 1
        x /= np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))
        fold = np.random.default_rng(seed).integers(0, FOLDS, n)
        mixed = (classes == 0) & (notice >= 0)
        fold[mixed] = np.unique(notice[mixed], return_inverse=True)[1] % FOLDS
        logits, truth = [], []
        for k in range(FOLDS):
            held = fold == k
            if held.any() and not held.all():
                part = cls._weights(x[~held], classes[~held], penalty, max(1, steps // 2), rate)
                logits.append(x[held] @ part[0] + part[1])
                truth.append(classes[held])
        out = cls(*cls._weights(x, classes, penalty, steps, rate))
        if logits:
            z, t = np.concatenate(logits).astype(np.float64), np.concatenate(truth)
            # families weigh as much as the unknown class in all
            weigh = np.where(t > 0, 0.5 / max(1, (t > 0).sum()), 0.5 / max(1, (t == 0).sum()))
            loss = lambda a, o: -(weigh * np.log(np.maximum(1e-9, cls._softmax(z.copy(), a, o)[np.arange(len(t)), t]))).sum()
            out.temperature, out.offset = min(((a, o) for a in (0.15, 0.25, 0.35, 0.5, 0.7, 1, 1.5, 2, 3) for o in (-4, -3, -2, -1, -0.5, 0, 0.5, 1, 2, 3, 4)), key=lambda p: loss(*p))
        return out

    @classmethod
    def _weights(cls, train: np.ndarray, classes: np.ndarray, penalty: float, steps: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """Proximal gradient descent with momentum."""
        c = len(FAMILIES) + 1
        y = np.eye(c, dtype=np.float32)[classes]
        weights, bias = np.zeros((_FEATURES, c), np.float32), np.zeros(c, np.float32)
        ahead, before = weights.copy(), weights.copy()
        for k in range(steps):
            p = cls._softmax(train @ ahead + bias, 1.0, 0.0)
            g = (p - y) / len(train)
            weights = ahead - rate * (train.T @ g)
            weights = np.sign(weights) * np.maximum(0, np.abs(weights) - rate * penalty)
            bias -= rate * g.sum(0)
            ahead = weights + k / (k + 3) * (weights - before)
            before = weights
        return weights, bias


def training_set(corpus: list[bytes], variants: int = VARIANTS, seed: int = 5) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Varied notices by family, and corpus paragraphs and shuffled notices as unknown: texts, classes, notices' numbers (-1 for the corpus)."""
    rng = np.random.default_rng(seed)
    notices = {g for templates in _TEMPLATES.values() for t in templates for g in t}
    corpus = [p for p in sorted(set(corpus)) if not grams(words_of(p), 3) & notices]
    shuffled = sorted(corpus, key=lambda x: (xxhash.xxh64_intdigest(x, 1), x))
    pool = list(itertools.islice((w for p in shuffled for w in p.split()), POOL_WORDS)) or [b"words"]
    some = lambda most: [pool[k] for k in rng.integers(0, len(pool), rng.integers(0, most))]
    texts, classes, notice = [], [], []
    for c, f in enumerate(FAMILIES, start=1):
        for x in NOTICES[f]:
            words = x.encode().split()
            begin = len(texts)
            texts.append(x.encode())
            classes.append(c)
            for k in range(variants):
                got = list(words)
                if k % 3 == 1 and len(got) > 12:
                    got = [w for w in got if rng.random() > 0.1]
                if k % 4 == 2:
                    got = [w.upper() if rng.random() < 0.5 else w.lower() for w in got]
                if k % 2:
                    got = some(12 if k % 5 else 120) + got + some(12 if k % 5 else 120)
                texts.append(b" ".join(got))
                classes.append(c)
            for _ in range(variants // 3):
                few = [words[i] for i in rng.permutation(len(words))[: rng.integers(1, 5)]]
                texts.append(b" ".join([*some(40), *few, *some(40)]))
                classes.append(0)
            notice += [begin] * (len(texts) - begin)
    return [*texts, *corpus], np.array([*classes, *[0] * len(corpus)]), np.array([*notice, *[-1] * len(corpus)])


def corpus_sample(docs: DataFrame, rows: int = SAMPLE_DOCS) -> list[bytes]:
    """Paragraphs of at most ``rows`` documents, ``SAMPLE_LINES`` of each at most, by hash."""
    picked = docs.where("doc_id is not null").groupBy("doc_id").agg(F.lit(1).alias("one")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for text in raw(b.column(0)):
                lines = {x[k : k + SAMPLE_BYTES] for x in text.split(b"\n") for k in range(0, len(x), SAMPLE_BYTES)}
                got += sorted(lines, key=lambda x: (xxhash.xxh64_intdigest(x), x))[:SAMPLE_LINES]
            yield pa.record_batch([pa.array(got, pa.binary())], ["line"])

    # one text for each doc_id, the smallest, so that repeated ids can't exceed the bound
    texts = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    found = texts.select("text").mapInArrow(work, "line binary").collect()
    return [bytes(r[0]) for r in found]


def train(docs: DataFrame) -> Classifier:
    return Classifier.fit(*training_set(corpus_sample(docs)))


def confirmed(model: Classifier, paragraphs: list[bytes]) -> list[tuple[str | None, float, bool]]:
    """(predicted family or None, probability, whether a notice confirms it) of each paragraph."""
    p = model.probabilities(paragraphs)
    best = p[:, 1:].argmax(1)
    value = p[np.arange(len(p)), best + 1]
    out: list[tuple[str | None, float, bool]] = [(None, 0.0, False)] * len(paragraphs)
    for k in np.flatnonzero((value >= LEAST) & (value >= p[:, 0])).tolist():
        family = FAMILIES[best[k]]
        out[k] = (family, float(value[k]), covered(paragraphs[k], family) >= COVERAGE)
    return out


def in_blocks(model: Classifier, texts: list[bytes]) -> list[list[tuple[str, float]]]:
    """(family, probability) of the notices in each text's blocks of lines, each family once a block."""
    found = [(k, at, *x) for k, t in enumerate(texts) for at, block in enumerate(_BLANK.split(t)) for x in passages(block)]
    out: list[list[tuple[str, float]]] = [[] for _ in texts]
    if found:
        p = model.probabilities([x[3] for x in found])
        best: dict[tuple[int, int, str], float] = {}
        for (k, at, family, _), row in zip(found, p, strict=True):
            value = float(row[FAMILIES.index(family) + 1])
            if value >= LEAST and value >= row[0]:
                best[k, at, family] = max(value, best.get((k, at, family), 0.0))
        for (k, _, family), value in best.items():
            out[k].append((family, value))
    return out


def scan(docs: DataFrame, model: Classifier, docs_at_once: int = 200) -> DataFrame:
    """doc_id, licences (families, sorted, by comma), n_paragraphs, n_confirmed, n_unconfirmed, best (probability).

    n_paragraphs and n_unconfirmed are of lines; n_confirmed has lines, and
    notices of families that no line of the text confirms.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = raw(b.column(1))
        rows = []
        for k in range(0, len(texts), docs_at_once):
            lines = [t.split(b"\n") for t in texts[k : k + docs_at_once]]
            found = confirmed(sent.value, [p for x in lines for p in x])
            whole = in_blocks(sent.value, texts[k : k + docs_at_once])
            at = 0
            for x, more in zip(lines, whole, strict=True):
                own = [y for y in found[at : at + len(x)] if y[0]]
                at += len(x)
                sure = [y for y in own if y[2]]
                loose, lone = len(own) - len(sure), {y[0] for y in sure}
                sure += [y for y in more if y[0] not in lone]
                rows.append((",".join(sorted({y[0] for y in sure})), len(x), len(sure), loose, round(max((y[1] for y in sure), default=0.0), 6)))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.record_batch([b.column(0), *(pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "licences", "n_paragraphs", "n_confirmed", "n_unconfirmed", "best"])

    return per_document(docs, ["doc_id", "text"], "doc_id bigint, licences string, n_paragraphs bigint, n_confirmed bigint, n_unconfirmed bigint, best double", work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(docs))
