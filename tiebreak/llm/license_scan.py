"""Licence scan: a trained paragraph classifier, each finding confirmed against licence templates."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textarrays import LOWER, NO_ALNUM, arrow_schema, chunks, rolling, word_hashes, words

# How public licences name themselves in notices and headers, by family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0", "Apache License 2.0", "under the terms of the Apache License 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0"],
    "mit": [
        "Released under the MIT License", "Licensed under the MIT license", "Distributed under the MIT license", "The MIT License (MIT)", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction"],
    "gpl": [
        "licensed under the GNU General Public License, version 3", "licensed under the GNU General Public License, version 2",
        "GNU General Public License v3.0", "licensed under the GPL", "under the terms of the GNU GPL version 2",
        "distributed under the GNU GPL, version 3 or later", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"],
    "lgpl": [
        "licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-2.1-only",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "agpl": [
        "licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "bsd": [
        "Licensed under the BSD 3-Clause License", "Licensed under the BSD 2-Clause License", "Released under the BSD License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"],
    "mpl": [
        "Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License"],
    "cc-by": [
        "Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License",
        "available under the Creative Commons Attribution License"],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "available under the Creative Commons Attribution-ShareAlike License"],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0", "Licensed under CC BY-NC-SA 4.0", "Licensed under CC BY-NC-ND 4.0",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "public-domain": [
        "released into the public domain", "This work is in the public domain", "dedicated to the public domain under CC0 1.0",
        "Licensed under CC0 1.0 Universal", "This is free and unencumbered software released into the public domain"],
    "proprietary": [
        "All rights reserved", "All rights reserved. No part of this publication may be reproduced without prior written permission",
        "This software is proprietary and confidential. Unauthorized copying is strictly prohibited"],
}
# ways in which a notice begins and ends; training combines them with the templates
OPENINGS = ("", "This work is ", "This file is ", "Copyright 2021 the authors. ", "The code is ", "Except where noted, content is ",
            "Note: ", "This text is ")
ENDINGS = ("", " See the LICENSE file for details.", " Version of 2019.", " For more see our site.", " Thank you for reading.")
# sentences with the words of notices that are none
DECOYS = (
    "She renewed her driving license at the public office", "He studied physics at MIT for four years",
    "The Apache people lived in the southwest", "The general public was not admitted", "Version 3 of the plan was accepted",
    "The domain name is registered under the name of the owner", "All members reserved their seats", "A creative common room for students",
    "The software was released under pressure in 2.0 form", "The library is open to the public", "Permission was granted by the court",
    "The terms of the lease may not be modified", "The foundation published a free report", "under the bridge the river runs",
    "The restaurant was licensed to sell wine", "Fishing licenses are sold here", "The license plate was stolen", "the rights of the people",
    "Conditions are met by both parties", "The university of Berkeley is in California", "attribution of the painting is uncertain",
    "We distribute copies of the form to any person", "by nc and by sa are letters", "This work is hard", "This file is large",
    "See the file for details", "For more see our site", "Thank you for reading", "The code is short", "Copyright law is taught here")
NONE = "unknown"
FAMILIES = (NONE, *TEMPLATES)
GRAMS = 3
#: Corpus paragraphs that train the unknown class: those of the smallest hash in so many ranges.
SAMPLE = 2000
STEPS, RATE, RIDGE, LASSO = 300, 0.5, 1e-4, 2e-5
#: A finding's words follow a template if this share of its word pairs is in the paragraph.
SIMILARITY = 0.75
#: Words over which a wrapped notice may be spread, times those of its template.
SPREAD = 1.5


def _paragraphs(data, offsets):
    """(hash, paragraph, word number) of the words, and per paragraph its text and number in it."""
    line = np.flatnonzero(data == 10)
    first = np.unique(np.r_[offsets[:-1][np.diff(offsets) > 0], line[line + 1 < len(data)] + 1]) if len(data) else line
    starts, ends, _ = words(data, offsets, NO_ALNUM)
    h = word_hashes(LOWER[data], starts, ends)
    text_of = np.searchsorted(offsets, first, "right") - 1
    number = np.arange(len(first)) - np.searchsorted(text_of, text_of, "left")
    return h, np.searchsorted(first, starts, "right") - 1, text_of, number


def _of_strings(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.r_[0, np.cumsum([len(r) for r in raw])]
    starts, ends, text = words(data, offsets, NO_ALNUM)
    return word_hashes(LOWER[data], starts, ends), text


def _features(h, paragraph, vocabulary):
    """Distinct (paragraph, feature) pairs of the n-grams that are in the sorted vocabulary."""
    pairs = []
    for k in range(1, GRAMS + 1):
        g = rolling(h, k)
        if not len(g):
            break
        at = np.minimum(np.searchsorted(vocabulary, g), len(vocabulary) - 1)
        hit = np.flatnonzero((vocabulary[at] == g) & (paragraph[: len(g)] == paragraph[k - 1:]))
        pairs.append(paragraph[hit] * len(vocabulary) + at[hit])
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return both // len(vocabulary), both % len(vocabulary)


class Classifier:
    """Sorted n-gram hashes, weights per n-gram and family, bias, temperature, and the probability a finding must have."""

    def __init__(self, vocabulary, weights, bias, temperature=1.0, threshold=0.5):
        self.vocabulary, self.weights, self.bias = vocabulary, weights, bias
        self.temperature, self.threshold = temperature, threshold
        self.pairs = {f: [set(rolling(_of_strings([t])[0], 2).tolist()) for t in ts] for f, ts in TEMPLATES.items()}

        # of each template: family, word pairs, and those as rows (pair, template) in order of the pair
        self.templates = sorted(((f, t) for f, ts in self.pairs.items() for t in ts), key=lambda x: -len(x[1]))
        rows = sorted((g, i) for i, (_, t) in enumerate(self.templates) for g in t)
        self.pair, self.template = np.array([g for g, _ in rows], np.uint64), np.array([i for _, i in rows])

    def wrapped(self, h, paragraph, text_of):
        """(family, first line, last line) of stretches of two and more lines in which a template's word pairs stand together.

        Lines in a row that have words are one block; pairs may reach over a line end. Longest templates first.
        """
        block = np.cumsum(np.r_[0, (np.diff(paragraph) > 1) | (np.diff(text_of[paragraph]) > 0)]) if len(h) else paragraph
        g = rolling(h, 2)
        a, b = np.searchsorted(self.pair, g, "left"), np.searchsorted(self.pair, g, "right")
        hit = np.flatnonzero((b > a) & (block[: len(g)] == block[1:][: len(g)]))
        n = (b - a)[hit]
        at = np.repeat(hit, n)
        if not len(at):
            return
        row = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a[hit], n)
        group = self.template[row] * (int(block[-1]) + 1) + block[at]
        order = np.lexsort((at, group))
        at, row, group = at[order], row[order], group[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
        least = np.array([SIMILARITY * len(t) for _, t in self.templates])[self.template[row[cuts[:-1]]]]
        for c in np.flatnonzero((np.diff(cuts) >= least) & (paragraph[at[cuts[1:] - 1] + 1] > paragraph[at[cuts[:-1]]])):
            places, pairs = at[cuts[c]: cuts[c + 1]], row[cuts[c]: cuts[c + 1]]
            family, template = self.templates[self.template[pairs[0]]]
            reach = SPREAD * (len(template) + 1)
            left, held = 0, {}
            for right, pair in enumerate(pairs):
                held[pair] = held.get(pair, 0) + 1
                while held[pairs[left]] > 1 or places[right] + 2 - places[left] > reach:
                    held[pairs[left]] -= 1
                    if not held[pairs[left]]:
                        del held[pairs[left]]
                    left += 1
                first, last = paragraph[places[left]], paragraph[places[right] + 1]
                if len(held) >= least[c] and last > first:
                    yield family, int(first), int(last)

    def probabilities(self, h, paragraph):
        """(paragraphs with a known n-gram, their probabilities per family); all others are unknown by the bias alone."""
        par, feature = _features(h, paragraph, self.vocabulary)
        cut = np.flatnonzero(np.r_[True, par[1:] != par[:-1]]) if len(par) else np.zeros(0, np.int64)
        logits = np.zeros((0, len(FAMILIES)))
        if len(cut):
            logits = np.add.reduceat(self.weights[feature], cut, axis=0) + self.bias
        return par[cut], softmax(logits / self.temperature)

    def similarity(self, h, family):
        """Largest share of a template's word pairs that the words hold, over the family's templates."""
        held = set(rolling(h, 2).tolist())
        return max(len(t & held) / len(t) for t in self.pairs[family])


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
    return e / e.sum(axis=1, keepdims=True) if len(z) else z


def training_set(paragraphs):
    """(texts, family numbers): notices put together from the templates, decoys, and corpus paragraphs that follow no template."""
    texts, y = [], []
    for i, family in enumerate(FAMILIES[1:], 1):
        for t in TEMPLATES[family]:
            for a, opening in enumerate(OPENINGS):
                for b, ending in enumerate(ENDINGS):
                    if (a + b) % 2 == 0:
                        texts.append(f"{opening}{t}.{ending}")
                        y.append(i)
    probe = Classifier(np.zeros(1, np.uint64), np.zeros((1, len(FAMILIES))), np.zeros(len(FAMILIES)))
    for t in [*DECOYS, *paragraphs, *(o + e for o in OPENINGS for e in ENDINGS)]:
        h = _of_strings([t])[0]
        if max(probe.similarity(h, f) for f in TEMPLATES) < 0.5:
            texts.append(t)
            y.append(0)
    return texts, np.array(y)


def train(paragraphs=()):
    """Softmax regression on the presence of word n-grams; a fifth of the rows calibrates temperature and threshold.

    The vocabulary are the n-grams of the notices; small weights shrink to zero, so most
    n-grams of a family end up with no weight for the others. Deterministic.
    """
    texts, y = training_set(paragraphs)
    h, of = _of_strings(texts)
    known = np.flatnonzero(y[of] > 0)
    grams = [rolling(h, k)[(g := np.arange(len(h) - k + 1))[(of[: len(h) - k + 1] == of[k - 1:]) & np.isin(g, known)]]
             for k in range(1, GRAMS + 1)]
    vocabulary = np.unique(np.concatenate(grams))
    row, feature = _features(h, of, vocabulary)
    x = np.zeros((len(texts), len(vocabulary)), np.float32)
    x[row, feature] = 1
    held = np.arange(len(texts)) % 5 == 0
    target = np.eye(len(FAMILIES), dtype=np.float32)[y]
    # every family weighs the same in all, unknown as much as all of them
    share = np.bincount(y[~held], minlength=len(FAMILIES))
    weight = np.where(y == 0, len(FAMILIES) - 1.0, 1.0) / np.maximum(share[y], 1)
    weight = (weight / weight[~held].sum()).astype(np.float32)[:, None]
    w, b = np.zeros((len(vocabulary), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    b[0] = 1
    xt, tt, wt = x[~held], target[~held], weight[~held]
    for step in range(STEPS):
        error = (softmax(xt @ w + b) - tt) * wt
        w -= RATE * (xt.T @ error * 10 + RIDGE * w)
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * LASSO, 0)
        b -= RATE * error.sum(axis=0)
    z, t = x[held] @ w + b, y[held]
    temperatures = np.exp(np.linspace(np.log(0.05), np.log(5), 100))
    loss = [-np.log(np.maximum(softmax(z / c)[np.arange(len(t)), t], 1e-12)).mean() for c in temperatures]
    temperature = float(temperatures[int(np.argmin(loss))])
    p = softmax(z / temperature)
    top = 1 - p[:, 0]
    # halfway between the surest unknown and the least sure notice, where they part
    unknown, notice = top[t == 0].max(initial=0.0), top[t > 0].min(initial=1.0)
    threshold = float(np.clip((unknown + notice) / 2, 0.3, 0.9))
    return Classifier(vocabulary, w.astype(np.float64), b.astype(np.float64), temperature, threshold)


def _scan(shared, out):
    arrow = arrow_schema(out)

    def run(batches):
        model = shared.value
        for batch in batches:
            for part, data, offsets in chunks(batch):
                h, paragraph, text_of, number = _paragraphs(data, offsets)
                at, p = model.probabilities(h, paragraph)
                found = [[] for _ in range(part.num_rows)]
                for i in np.flatnonzero(1 - p[:, 0] >= model.threshold) if len(p) else ():
                    family = 1 + int(p[i, 1:].argmax())
                    own = h[np.searchsorted(paragraph, at[i], "left"): np.searchsorted(paragraph, at[i], "right")]
                    alike = model.similarity(own, FAMILIES[family])
                    found[text_of[at[i]]].append({
                        "paragraph": int(number[at[i]]), "family": FAMILIES[family], "probability": float(p[i, family]),
                        "similarity": alike, "confirmed": alike >= SIMILARITY})
                taken = {(text, f["paragraph"], f["family"]) for text, own in enumerate(found) for f in own if f["confirmed"]}
                for name, first, last in model.wrapped(h, paragraph, text_of):
                    if any((text_of[first], int(number[i]), name) in taken for i in range(first, last + 1)):
                        continue
                    own = h[np.searchsorted(paragraph, first, "left"): np.searchsorted(paragraph, last, "right")]
                    _, q = model.probabilities(own, np.zeros(len(own), np.int64))
                    if not len(q) or 1 - q[0, 0] < model.threshold:
                        continue
                    family = 1 + int(q[0, 1:].argmax())
                    alike = model.similarity(own, FAMILIES[family])
                    lines = {(text_of[first], int(number[i]), FAMILIES[family]) for i in range(first, last + 1)}
                    if alike >= SIMILARITY and taken.isdisjoint(lines):
                        taken |= lines
                        found[text_of[first]].append({
                            "paragraph": int(number[first]), "family": FAMILIES[family], "probability": float(q[0, family]),
                            "similarity": alike, "confirmed": True})
                found = [sorted(own, key=lambda f: f["paragraph"]) for own in found]
                yield pa.RecordBatch.from_arrays([
                    *(part.column(f.name) for f in arrow if f.name not in ("findings", "n_paragraphs")),
                    pa.array(np.bincount(text_of, minlength=part.num_rows).astype(np.int32)),
                    pa.array(found, arrow.field("findings").type)], arrow.names)
    return run


def learn(docs: DataFrame, sample: int = SAMPLE, text_col="text") -> Classifier:
    """The classifier; its unknown class learns from ``sample`` paragraphs of the corpus, fewer if it has fewer."""
    paragraph = docs.select(F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("t"))
    some = paragraph.where(F.length(F.trim("t")) > 0).select(F.xxhash64("t").alias("h"), "t")
    # the smallest hash of each of as many ranges: a row per range leaves a task, not a sample of its own
    least = [r.h for r in some.groupBy(F.pmod("h", F.lit(sample)).alias("range")).agg(F.min("h").alias("h")).collect()]
    chosen = some.where(F.col("h").isin(least)).select("h", "t").distinct().limit(2 * sample)
    return train([r.t for r in sorted(chosen.collect())])


def scan(docs: DataFrame, model: Classifier, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_paragraphs, findings, families) per row.

    Paragraphs are lines; words are runs of letters and digits, A-Z lower-cased. A finding is a paragraph that is a
    notice with at least the calibrated probability: its number, likeliest family, probability and
    similarity to that family's closest template. ``families`` are those of the findings that
    a template confirms, in order. What no template confirms stays a finding only. Lines in a row that hold a template's
    word pairs only together (a hard-wrapped notice, with comment marks or without) are judged as one, and found
    at the first of them if confirmed.

    Null and empty texts have no paragraph; null ids and repeated rows pass through; an empty
    table gives no row; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    finding = T.StructType([
        T.StructField("paragraph", T.IntegerType()), T.StructField("family", T.StringType()),
        T.StructField("probability", T.DoubleType()), T.StructField("similarity", T.DoubleType()), T.StructField("confirmed", T.BooleanType())])
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_paragraphs", T.IntegerType()), T.StructField("findings", T.ArrayType(finding))])
    found = rows.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(model), schema), schema)
    confirmed = F.filter("findings", lambda f: f["confirmed"])
    return found.withColumn("families", F.array_sort(F.array_distinct(F.transform(confirmed, lambda f: f["family"]))))
