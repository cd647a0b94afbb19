"""License scans: a trained paragraph classifier, with template comparison to confirm. DataFrame and SQL functions only.

A paragraph is a line of a text, or a sentence that is wrapped over several lines: runs of lines up to a blank one are
joined without comment signs and cut into sentences. A wrapped sentence stands for its lines if it is confirmed by a
greater overlap than any of them, otherwise its lines stand. A paragraph's distinct word 1- to 3-grams meet the sparse
weights of a multinomial logistic regression over licence families and the class `unknown`; probabilities are scaled by a
temperature fitted on held-back notices, so that `unknown` is calibrated. Where that is less likely than CERTAIN, the
likeliest family is the result that a template confirms, among those with a probability of PLAUSIBLE: enough of the word
pairs of one of its templates are in the paragraph, and no template of another family that is much like this one
(SIBLING of the pairs in common) has more. A document gets its best confirmed paragraph and the list of its families.

Only paragraphs with one of gate_words() are classified. These are chosen from the templates so that whoever has enough
pairs of any template to confirm it has one of them: the others can't be confirmed, so nothing is lost. Candidates, as
they are reported, are the paragraphs that name one of CUES or are confirmed.

The classifier is trained at the driver on notices made from TEMPLATES by seeded changes (lost, doubled and added words,
names, years, case) and on sentences that only sound alike; no row of the corpus is used. Scoring is a join with the
weights, whose number is bounded by the templates' n-grams, and sums grouped by paragraph.

Defined results: null and empty texts have no notice; a document without notice has family `none`; a candidate that no
template confirms counts as `unknown`; null identifiers and repeated rows are reported row by row; ties go to the
earlier paragraph; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SEED, PER_TEMPLATE, CONFIRM, CERTAIN, SIBLING, PLAUSIBLE = 9, 40, 0.6, 0.5, 0.5, 0.02
CUES = "licen[sc]|copyright|copyleft|public domain|rights reserved|warrant|permission|redistribut|creative commons|spdx"
UNKNOWN = "unknown"
#: What comments put around a line, and where a run of lines is cut: blank lines and ends of sentences. Marks (\x01 number
#: \x02) tell where lines begin.
SIGNS = r"^[ \t\r]*(?://+!?|/\*+|\*+/|\*+|#+|--+|;+|%+|<!--+|>+|\|+|\(\*|\{-|\.\.)?(?:[ \t\r]+|$)|^[ \t\r]*(?://+!?|/\*+|#+|--+|;+)|[ \t\r]*(?:\*+/|--+>|\*\)|-\}|\*+|#+)?[ \t\r]*$"
CUTS = r"\n[ \t\r\n]*\n|(?<=[.!?])[ \t\r\n]+(?=(?:\x01[0-9]+\x02)?[\"'(\[]?[A-Z])"
#: Short public notices by family. Fixed values.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
        'to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This software is released under the Apache 2.0 license",
        "SPDX-License-Identifier: Apache-2.0",
        'You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3",
        "Licensed under the GPLv3 license",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "redistribute it and/or modify it under the terms of the GNU General Public License version 2",
        "Licensed under the GPLv2 license",
        "SPDX-License-Identifier: GPL-2.0-only",
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.',
    ],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "redistribute it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-3.0-only",
        'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
    ],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-only",
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        'Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.',
        'Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
        'Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.',
        'SPDX-License-Identifier: BSD-2-Clause',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0",
        'If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.',
    ],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC",
        'provided that the above copyright notice and this permission notice appear in all copies.',
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed for noncommercial use only under CC BY-NC"],
    "CC0": ["Released into the public domain under CC0 1.0 license.", "To the extent possible under law, all copyright and related rights to this work are waived", "This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "Copyright 2024 Example Inc. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."],
}
ALIKE = [
    "He renewed his driving licence last week and the license plate too.",
    "She asked for permission to leave the room early.",
    "The warranty on the machine expired in spring.",
    "The bar lost its licence to sell alcohol.",
    "A licensed plumber should check the pipes.",
    "The copyright debate went on for years in parliament.",
    "They were granted permission to build a house under the new law.",
    "The city will redistribute the funds among the schools.",
    "Fishing without a license is not permitted in this lake.",
    "The public domain is a term that many readers know.",
    "Licence fees for television have risen again this year.",
    "The court found that the license had been revoked.",
]
_NOT_WORD = re.compile(r"[^a-z0-9.]+")


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(".") for x in _NOT_WORD.split(text.lower())) if w]


def grams_of(words: list[str], most: int = 3) -> set[str]:
    return {" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)}


def _varied(r: random.Random, text: str, noise: list[str]) -> str:
    w = text.split()
    w = [x for x in w if r.random() > 0.06] or w
    if r.random() < 0.5:
        w = r.choices(noise, k=r.randint(1, 12)) + w
    if r.random() < 0.5:
        w = w + r.choices(noise, k=r.randint(1, 12))
    if r.random() < 0.2:
        w = ["Copyright", str(r.randint(1990, 2026)), *r.choices(noise, k=2), *w]
    if r.random() < 0.1:
        w = [x.upper() for x in w]
    return " ".join(w)


def training_set(seed: int = SEED) -> list[tuple[str, str]]:
    r = random.Random(seed)
    noise = ["".join(r.choices("abcdefghilmnoprstu", k=r.randint(2, 9))) for _ in range(300)] + "the of and to a in is it this that for on with by".split()
    out = [(f, _varied(r, t, noise)) for f, ts in TEMPLATES.items() for t in ts for _ in range(PER_TEMPLATE)]
    known = sorted({w for ts in TEMPLATES.values() for t in ts for w in t.split()})
    out += [(UNKNOWN, _varied(r, t, noise)) for t in ALIKE for _ in range(PER_TEMPLATE)]
    out += [(UNKNOWN, " ".join(r.choices(noise, k=20) + r.choices(known, k=r.randint(0, 3)) + r.choices(noise, k=5))) for _ in range(10 * PER_TEMPLATE)]
    r.shuffle(out)
    return out


_MODEL: dict | None = None


def trained() -> dict:
    """families, weights {gram: [one a family]}, bias, temperature; trained once a process."""
    global _MODEL
    if _MODEL is not None:
        return _MODEL
    rows = training_set()
    families = [*TEMPLATES, UNKNOWN]
    known = {g for ts in [*TEMPLATES.values(), ALIKE] for t in ts for g in grams_of(words_of(t))}
    n = Counter(g for _, t in rows for g in grams_of(words_of(t)) if g in known)
    vocabulary = sorted(g for g, k in n.items() if k >= 5)
    at = {g: k for k, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, (_, t) in enumerate(rows):
        for g in grams_of(words_of(t)):
            if g in at:
                x[i, at[g]] = 1
    y = np.eye(len(families), dtype=np.float32)[[families.index(f) for f, _ in rows]]
    back = np.arange(len(rows)) % 5 == 4
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    mw, vw = np.zeros_like(w), np.zeros_like(w)
    xt, yt = x[~back], y[~back]
    for t in range(1, 251):
        z = xt @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        e = (p - yt) / len(xt)
        g = xt.T @ e + 1e-5 * w
        mw, vw = 0.9 * mw + 0.1 * g, 0.99 * vw + 0.01 * g * g
        w -= 0.1 * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.99**t)) + 1e-8)
        b -= e.sum(0) * 2
    w[np.abs(w) < 0.05] = 0
    z, best = x[back] @ w + b, None
    for temperature in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0):
        q = z / temperature
        nll = (np.log(np.exp(q - q.max(1, keepdims=True)).sum(1)) + q.max(1) - (q * y[back]).sum(1)).mean()
        if best is None or nll < best[0]:
            best = nll, temperature
    w, b = np.round(w.astype(float) / best[1], 4), np.round(b.astype(float) / best[1], 4)
    _MODEL = {
        "families": families,
        "weights": {g: w[k].tolist() for g, k in at.items() if w[k].any()},
        "bias": b.tolist(),
        "temperature": best[1],
        "accuracy": float((z.argmax(1) == y[back].argmax(1)).mean()),
    }
    return _MODEL


def _pairs(text: str) -> list[str]:
    w = words_of(text)
    return sorted({" ".join(x) for x in zip(w, w[1:], strict=False)}) or w


def gate_words() -> list[str]:
    """Words of which every paragraph that a template confirms has one, the fewest that a greedy choice finds."""
    common = set(
        "the of and to a an in is it this that for on with by or not be as any all at you may are from under can one was use used text work file form code free "
        "more only without following law possible prior general version provided available copy copies conditions products notice source obtain public".split()
    )
    missing = []  # for each template: its pairs without a chosen word, and how many of these are allowed
    for ts in TEMPLATES.values():
        for t in ts:
            pairs = _pairs(t)
            missing.append(({tuple(p.split()) for p in pairs}, math.ceil(CONFIRM * len(pairs) - 1e-9) - 1))
    chosen = []
    while short := [left for left, most in missing if len(left) > most]:
        gain = Counter(w for left in short for pair in left for w in set(pair) if w not in common)
        word = max(gain, key=lambda w: (gain[w], len(w), w))
        chosen.append(word)
        missing = [({p for p in left if word not in p}, most) for left, most in missing]
    return sorted(chosen)


def siblings() -> list[tuple[str, list[str], list[list[str]]]]:
    """family, pairs of every template, and the pairs of the templates of other families that are much like it."""
    own = [(f, _pairs(t)) for f, ts in TEMPLATES.items() for t in ts]
    return [(f, p, [q for g, q in own if g != f and len({*p} & {*q}) >= SIBLING * min(len(p), len(q))]) for f, p in own]


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One stored row for each paragraph (lines paragraph to until) that has a gate word or names a cue, and one (paragraph null) for each document without."""
    lines = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n")
    bare = F.transform("lines", lambda x: F.regexp_replace(F.translate(x, "\x01\x02", "  "), SIGNS, ""))
    marked = F.transform(bare, lambda x, i: F.when(x == "", "").otherwise(F.concat(F.lit("\x01"), i.cast("string"), F.lit("\x02"), x)))
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.monotonically_increasing_id().alias("rid"), lines.alias("lines"))
    plain = F.transform("lines", lambda x, i: F.struct(i.alias("paragraph"), i.alias("until"), x.alias("line")))
    wrapped = F.filter(F.split(F.array_join(marked, "\n"), CUTS), lambda x: F.regexp_replace(x, "^\n+|\n+$", "").contains("\n"))

    def sentence(x):
        first = F.regexp_extract(x, "\x01([0-9]+)\x02", 1).cast("int")
        last = F.regexp_extract(x, "(?s).*\x01([0-9]+)\x02", 1).cast("int")
        starts = F.regexp_replace(x, "^\n+", "").startswith("\x01")
        return F.struct((first - F.when(starts, 0).otherwise(1)).alias("paragraph"), last.alias("until"), F.regexp_replace(x, "\n?\x01[0-9]+\x02", " ").alias("line"))

    gate = f"(?i)(?<![a-z0-9])(?:{'|'.join(map(re.escape, gate_words()))})(?![a-z0-9])|{CUES}"
    named = F.filter(F.concat(plain, F.transform(wrapped, sentence)), lambda s: s["line"].rlike(gate))
    found = own.select("id", "rid", F.explode_outer(named).alias("p")).select("id", "rid", "p.paragraph", "p.until", "p.line")
    return materialize(found.withColumn("cue", F.coalesce(F.col("line").rlike(f"(?i){CUES}"), F.lit(False))), "candidates")


def _grams(words):
    """Distinct 1- to 3-grams of an array of words."""

    def k_grams(k):
        return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(words, k_grams(2), k_grams(3)))


def classify(found: DataFrame) -> DataFrame:
    """rid, paragraph, until, family, probability, overlap, confirmed of every candidate paragraph."""
    spark, model = found.sparkSession, trained()
    families = model["families"]
    words = F.filter(F.transform(F.split(F.lower("line"), "[^a-z0-9.]+"), lambda w: F.regexp_replace(w, r"^\.+|\.+$", "")), lambda w: w != "")
    own = found.where("paragraph IS NOT NULL").select("rid", "paragraph", "until", words.alias("words"))
    columns = [f"w{k}" for k in range(len(families))]
    weights = spark.createDataFrame([(g, *ws) for g, ws in model["weights"].items()], "gram string, " + ", ".join(f"{c} double" for c in columns))
    grams = own.select("rid", "paragraph", "until", F.explode(_grams(F.col("words"))).alias("gram"))
    sums = grams.join(F.broadcast(weights), "gram").groupBy("rid", "paragraph", "until").agg(*[F.sum(c).alias(c) for c in columns])  # as many weights as templates have n-grams
    z = F.array(*[F.round(F.col(c) + F.lit(b), 6) for c, b in zip(columns, model["bias"], strict=True)])
    scored = sums.select("rid", "paragraph", "until", z.alias("z")).withColumn("top", F.array_max("z"))
    scored = scored.withColumn("whole", F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    chance = F.transform("z", lambda x: F.round(F.exp(x - F.col("top")) / F.col("whole"), 6))
    named = F.arrays_zip(F.array(*map(F.lit, families)).alias("guess"), chance.alias("p"))
    scored = scored.select("rid", "paragraph", "until", F.round(1 / F.col("whole"), 6).alias("top_p"), F.element_at(chance, len(families)).alias("p_unknown"), named.alias("each"))
    plausible = F.filter("each", lambda x: (x["guess"] != UNKNOWN) & (x["p"] >= PLAUSIBLE))
    scored = scored.select("rid", "paragraph", "until", "top_p", "p_unknown", F.explode_outer(plausible).alias("t")).select("rid", "paragraph", "until", "top_p", "p_unknown", "t.guess", "t.p")
    templates = spark.createDataFrame(siblings(), "guess string, pairs array<string>, others array<array<string>>")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.col("words"), i, 2), " "))
    both = scored.join(own.select("rid", "paragraph", "until", F.array_distinct(pairs).alias("has")), ["rid", "paragraph", "until"]).join(F.broadcast(templates), "guess", "left")
    share = lambda p: F.size(F.array_intersect("has", p)) / F.size(p)
    both = both.withColumn("overlap", F.coalesce(share("pairs"), F.lit(0.0)))
    both = both.withColumn("fits", (F.col("overlap") >= CONFIRM) & (F.col("overlap") >= F.coalesce(F.array_max(F.transform("others", share)), F.lit(0.0))))
    both = both.groupBy("rid", "paragraph", "until", "top_p", "p_unknown").agg(F.max(F.struct("fits", "p", "overlap", "guess")).alias("best"))
    sure = F.coalesce((F.col("p_unknown") <= 1 - CERTAIN) & F.col("best.fits"), F.lit(False))
    return both.select(
        "rid",
        "paragraph",
        "until",
        F.when(sure, F.col("best.guess")).otherwise(F.lit(UNKNOWN)).alias("family"),
        F.when(sure, F.col("best.p")).otherwise(F.col("top_p")).alias("probability"),
        F.round("best.overlap", 6).alias("overlap"),
        sure.alias("confirmed"),
    )


def _standing(rows: DataFrame) -> DataFrame:
    """The rows without confirmed lines that a wrapped sentence stands for, and without sentences that their lines stand for."""
    long, sure = F.col("until") > F.col("paragraph"), F.col("confirmed")
    lines = rows.where(sure & ~long).select("rid", F.col("paragraph").alias("at"), F.col("overlap").alias("own"))
    over = rows.where(sure & long).select("rid", "paragraph", "until", "overlap", F.explode(F.sequence("paragraph", "until")).alias("at"))
    over = over.join(lines, ["rid", "at"], "left").groupBy("rid", "paragraph", "until", "overlap").agg(F.max("own").alias("own"))
    wins = F.col("own").isNull() | (F.col("overlap") > F.col("own"))
    stood_for = over.where(wins).select("rid", F.explode(F.sequence("paragraph", "until")).alias("paragraph")).distinct().withColumn("until", F.col("paragraph"))
    return rows.join(stood_for.union(over.where(~wins).select("rid", "paragraph", "until")), ["rid", "paragraph", "until"], "left_anti")


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, family, probability, overlap, n_notices, n_candidates, families."""
    found = candidates(docs, text, doc_id)
    place = ["rid", "paragraph", "until"]
    rows = materialize(classify(found), "classified")
    named = found.join(rows.select(*place, "confirmed"), place, "left").where(F.col("cue") | F.coalesce("confirmed", F.lit(False)))
    rows = _standing(rows.join(found.select(*place, "cue"), place).where("cue OR confirmed").drop("cue"))
    best = rows.groupBy("rid").agg(
        F.max_by(F.struct("family", "probability", "overlap"), F.struct("confirmed", "probability", -F.col("paragraph"), -F.col("until"))).alias("best"),
        F.sum(F.col("confirmed").cast("long")).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
    )
    per = found.select("id", "rid").distinct().join(named.groupBy("rid").agg(F.count("*").alias("n_candidates")), "rid", "left").na.fill({"n_candidates": 0})
    return per.join(best, "rid", "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("n_candidates") == 0, "none").otherwise(F.coalesce("best.family", F.lit(UNKNOWN))).alias("family"),
        F.coalesce("best.probability", F.lit(0.0)).alias("probability"),
        F.coalesce("best.overlap", F.lit(0.0)).alias("overlap"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        "n_candidates",
        F.coalesce("families", F.lit("")).alias("families"),
    )
