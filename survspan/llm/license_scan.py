"""Licence scan: a trained paragraph classifier with an unknown class and template confirmation.

Word n-grams (1 to 3) are the sparse features of a logistic regression per family, with one more regression for licence or
not. It is fitted on a bounded set: the notices below, whole and by line and embedded, with
counter-examples and `sample` lines of `SAMPLE_DOCS` documents (those of the smallest hashes), collected once and
fitted by gradient steps on the driver. On held-out notices of families never trained on, a threshold of the highest
probability is calibrated, below which a paragraph is `unknown` or none; which of the two, the regression of licence or not
tells, its cut calibrated on held-out licences against held-out ordinary lines. A prediction is
confirmed where enough of the n-grams of a notice of that family occur in the paragraph; one below the threshold stands
if it is so confirmed and is a licence.

A paragraph is a run of adjacent lines that hold an anchor word. Anchors are chosen from the fitted weights: every n-gram with a
positive weight holds one. A line without an anchor has no n-gram that speaks for a family or for a
licence; its probabilities cannot exceed those of an empty line, which lie below the threshold and the cut, so that the
classifier would call it none: the anchors lose nothing that the model would find. Weights, anchors and
notices are literals of the plan; scoring stays inside the row: no shuffle, whatever the size or skew.

Defined cases: null and empty texts have no paragraph and family `none`; repeated rows
get equal results; an empty table gives an empty result; of equally probable families the first by name
counts. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_or_empty

TOKEN_RE = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"

# Public licence notices; a line of a notice is an example of its own.
NOTICES = {
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
             "SPDX-License-Identifier: AGPL-3.0-only", "Licensed under the AGPL, version 3."],
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.\n"
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n"
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS,\n"
               "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
               "SPDX-License-Identifier: Apache-2.0", "Distributed under the Apache 2.0 terms."],
    "bsd": ["Released under the BSD 3-Clause License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
            "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.",
            "SPDX-License-Identifier: BSD-3-Clause", "Distributed under the BSD terms."],
    "cc-by": ["Licensed under CC BY 4.0.", "Licensed under CC-BY 4.0.",
              "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "Licensed under CC-BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "Licensed under CC-BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.\n"
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.\n"
            "See the GNU General Public License for more details.",
            "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPL, version 2."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
            "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.",
            "SPDX-License-Identifier: ISC", "Distributed under the ISC License."],
    "lgpl": ["This work is licensed under the GNU Lesser General Public License, version 3.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
             "SPDX-License-Identifier: LGPL-2.1", "Released under the LGPL, version 2.1."],
    "mit": ["Released under the MIT License.", "Distributed under the MIT terms.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction,\n"
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.\n"
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
            "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.",
            "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.\n"
            "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
            "Released under the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright 2020 Example Corp. All rights reserved.",
                    "Confidential and proprietary. Unauthorized copying is prohibited. All rights reserved."],
    "public-domain": ["This work has been dedicated to the public domain.", "Licensed under CC0 1.0 Universal public domain dedication.",
                      "This is free and unencumbered software released into the public domain.", "This work is released under CC0.",
                      "SPDX-License-Identifier: CC0-1.0"],
}
# Families held out of training, to calibrate the unknown class on.
HELD_OUT = ["Licensed under the EUPL, Version 1.2.", "Released under the zlib license.", "Licensed under the Artistic License 2.0.",
            "Made available under the Eclipse Public License v2.0.", "Released under the Boost Software License, Version 1.0.",
            "Distributed under the NTP licence.", "Licensed under the Open Font License, Version 1.1."]
COUNTER = ["He lost his driving licence in the harbour.", "She is a licensed plumber and electrician.",
           "The general public may enter from version to version.", "The warranty of the car had run out years ago.",
           "Copyright law was the subject of the lecture.", "They redistributed the harvest among the villages.",
           "The licence fee rose again this spring.", "A poet takes licence with the facts."]
# More held-out licences, to calibrate what tells a licence from none.
HELD_OTHER = ["License: Sendmail", "This library uses the Bitstream Vera License.", "Subject to the Redis License 2.0.", "Use is governed by the Adobe licence agreement.",
              "This file is covered by the Nokia license.", "Distribution is subject to the Sybase License Agreement."]
COUNTER += ["She got her license renewed last week.", "He drives without a license.", "The license plate was stolen from his car.",
            "Our pets need a license too.", "They gave him license to speak.", "You need a fishing license in this state.",
            "The dealer gave me a two year warranty.", "He had a warrant for their arrest.", "A licensed doctor looked at it.",
            "We bought the rights and the copyright to his songs.", "Taxes redistribute income.", "I asked if the software was licensed to us.",
            "My father kept his license in a drawer.", "She was a licensed teacher for ten years.", "The shop had a licence since the war.",
            "Our dog was licensed and fed.", "They subject him to the test without a license.", "The police came with a warrant to look at it."]
HELD_COUNTER = ["My brother lost his license again.", "The pilot had a licence since May.", "She was a licensed nurse for years.", "There is no warranty on my old phone.",
                "He wrote a book on copyright.", "The wealth was redistributed by the king.", "You can get a license at the office.", "The police had a warrant to search it."]
# Licences of no family: they train only what tells a licence from none.
OTHER = ["License: Zlib", "License: Beerware", "Licence: Unlicense-like", "This file is covered by the Sleepycat licence agreement.",
         "This file is covered by the Ruby license.", "This library uses the Vim License.", "Subject to the Confluent Community License 1.0.",
         "Source available; see the Functional Source License 1.1 for terms.", "Distribution is governed by the Intel Software License Agreement.",
         "Use of this software is governed by the Oracle licence agreement.", "Distributed under the PostgreSQL licence.",
         "Made available under the terms of the Python Software Foundation License.", "Licensed under the Academic Free License 3.0.",
         "See the LICENSE file for license terms.", "Released under the PHP License, version 3.01.",
         "Subject to the Server Side Public License 1.0.", "Subject to the Microsoft Public License 2.0.", "Subject to the terms of the Qt licence.",
         "This library uses the OpenSSL License.", "Use is subject to license terms."]
# Words that no anchor and no feature may consist of alone.
FILLERS = frozenset("a an and any are as at be by can do for from has have he her his i if in is it its may my no not of on or our out "
                    "she than that the their them there they this to up us was we were which will with you your".split())
FRAMES = ["{}", "{} .", "note : {}", "this file . {} see the file", "{} for details see the notice"]

SAMPLE = 1000      # ordinary lines to train on,
SAMPLE_DOCS = 200  # of so many documents
STEPS = 400
RATE = 4.0
DECAY = 1e-4
CONFIRM = 0.6
RARE = 0.01  # a word of more ordinary lines than this share is no feature and no anchor by itself


def grams(line: Column) -> Column:
    """Distinct word n-grams of 1 to 3 words."""
    def of(tokens):
        def n(k):
            return F.when(F.size(tokens) >= k, F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - (k - 1))),
                lambda i: F.array_join(F.slice(tokens, i, k), " "))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.array_distinct(F.concat(tokens, n(2), n(3)))
    return let(F.regexp_extract_all(F.lower(line), F.lit(TOKEN_RE), F.lit(0)), of)


def paragraphs(text: Column, anchors: str) -> Column:
    """Runs of adjacent lines that match `anchors` (in lower case), joined by blanks."""
    def runs(lines):
        return let(F.transform(lines, lambda x: F.lower(x).rlike(anchors)), lambda hit: joined(lines, hit))

    def joined(lines, hit):
        at = F.sequence(F.lit(0), F.size(lines) - 1)

        def edge(step):
            return F.filter(at, lambda i: F.get(hit, i) & ~F.coalesce(F.get(hit, i + step), F.lit(False)))

        return F.zip_with(edge(-1), edge(1), lambda a, b: F.array_join(F.slice(lines, a + 1, b - a + 1), " "))

    return F.when(F.lower(text).rlike(anchors), let(F.split(text, "\n", -1), runs)).otherwise(F.expr("cast(array() as array<string>)"))


def plain_grams(line: str) -> set[str]:
    """grams() for the bounded training rows."""
    words = re.findall(TOKEN_RE, line.lower())
    return {" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)}


def _examples() -> list[tuple[str, str, str]]:
    """(family, line, part): to fit on, and the held-out ones that calibrate."""
    pieces = [(family, text) for family, notices in NOTICES.items() for notice in notices
              for text in dict.fromkeys([notice.replace("\n", " "), *notice.split("\n")])]
    rows = [(family, frame.format(text), "fit") for family, text in pieces for frame in FRAMES]
    rows += [(family, frame.format(t), "fit") for family, lines in (("none", COUNTER), ("other", OTHER)) for t in lines for frame in FRAMES]
    rows += [("unknown", frame.format(t), "other") for t in HELD_OTHER for frame in FRAMES]
    rows += [("none", frame.format(t), "spared") for t in HELD_COUNTER for frame in FRAMES]
    rows += [(family, f"here : {text} thank you", "known") for family, text in pieces]
    return rows + [("unknown", frame.format(t), "held") for t in HELD_OUT for frame in FRAMES]


class Model:
    """Weights per feature and family, and last of licence or not; the threshold of a family, and the cut of a licence."""

    def __init__(self, families, bias, weights, threshold, cut, anchors):
        self.families, self.bias, self.weights = families, bias, weights
        self.threshold, self.cut, self.anchors = threshold, cut, anchors

    def logits(self, found: Column) -> Column:
        # One literal for all weights: the plan does not grow with the features.
        table = F.from_json(F.lit(json.dumps(self.weights)), "map<string,array<double>>")
        known = F.from_json(F.lit(json.dumps([*self.weights])), "array<string>")
        return F.aggregate(F.array_intersect(found, known), F.array(*map(F.lit, self.bias)), lambda a, g: F.zip_with(
            a, F.element_at(table, g), lambda x, y: x + y))

    def probabilities(self, found: Column) -> Column:
        """One logistic regression per family, and licence or not, side by side."""
        return F.transform(self.logits(found), lambda x: 1 / (1 + F.exp(-x)))


def ordinary_lines(docs: DataFrame, sample: int) -> list[str]:
    """At most `sample` distinct lines of the SAMPLE_DOCS documents of the smallest hashes: the same in every run."""
    some = docs.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE_DOCS)
    lines = some.select(F.explode(F.split(text_or_empty(), "\n", -1)).alias("line")).distinct()
    cue = "(?i)licen[sc]|copyright|rights reserved|spdx|public domain|creative commons|(^|\\W)cc[ -]?(by|0)"
    # Licences among them would be examples of the wrong class.
    return [r["line"] for r in lines.where(~F.col("line").rlike(cue)).orderBy(F.xxhash64("line"), "line").limit(sample).collect()]


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    ordinary = ordinary_lines(docs, sample)
    rows = _examples() + [("none", line, "fit") for line in ordinary]
    found = [plain_grams(line) for _f, line, _p in rows]
    often: dict[str, int] = {}
    for line in ordinary:
        for g in plain_grams(line):
            often[g] = often.get(g, 0) + 1
    most = max(3, RARE * len(ordinary))

    def common(word):
        return often.get(word, 0) > most or len(word) == 1 or word in FILLERS

    # Features: n-grams of notices and counter-examples that hold a word which ordinary lines seldom have.
    named = {g for t in [x for v in NOTICES.values() for n in v for x in n.split("\n")] + COUNTER + OTHER for g in plain_grams(t)}
    features = sorted(g for g in named if not all(map(common, g.split(" "))))
    at = {g: i for i, g in enumerate(features)}
    x = np.zeros((len(rows), len(features) + 1))
    x[:, -1] = 1
    for i, gs in enumerate(found):
        x[i, [at[g] for g in gs if g in at]] = 1
    families = sorted(NOTICES)
    truth = np.array([[f == family for family in families] + [f != "none"] for f, _l, _p in rows], float)
    fit = np.array([p == "fit" for _f, _l, p in rows])
    # Rows of the same features and class count together.
    packed = np.packbits(np.column_stack([x[fit], truth[fit]]).astype(bool), axis=1)
    _rows, first, times = np.unique(packed, axis=0, return_index=True, return_counts=True)
    xf, tf, times = x[fit][first].astype(np.float32), truth[fit][first], times[:, None]
    w = np.zeros((x.shape[1], len(families) + 1), np.float32)
    w[-1] = -4.0
    scale = RATE / np.sqrt(times.sum())
    for _ in range(STEPS):
        step = xf.T @ ((1 / (1 + np.exp(-np.clip(xf @ w, -60, 60))) - tf) * times * scale).astype(np.float32)
        step[-1] = 0.0  # the bias stays: an empty line is far from every class
        w = w * (1 - DECAY) - step
        w[-1] = -4.0
    keep = np.abs(w[:-1]).max(1) > 0.02  # sparse: weights that hardly count go
    w[:-1][~keep] = 0.0
    w = np.round(w.astype(float), 4)
    p = 1 / (1 + np.exp(-(x @ w)))
    part = np.array([p_ for _f, _l, p_ in rows])
    best = p[:, :-1].max(1)
    empty = float(1 / (1 + np.exp(4.0)))
    threshold = max(_threshold(best[part == "known"], best[part == "held"]), 1.01 * empty)
    cut = max(_threshold(p[np.isin(part, ["held", "other"]), -1], p[part == "spared", -1]), 1.01 * empty)
    weights = {g: w[i].tolist() for g, i in at.items() if keep[i]}
    return Model(families, w[-1].tolist(), weights, threshold, cut, _anchors(weights, common))


def _anchors(weights: dict[str, list[float]], common) -> str:
    """A pattern of words such that every n-gram with a positive weight holds one, few of them common."""
    left = {g: g.split(" ") for g, w in weights.items() if max(w) > 0}
    chosen: list[str] = []
    while left:
        count: dict[str, int] = {}
        for words in left.values():
            for word in set(words):
                if not common(word):
                    count[word] = count.get(word, 0) + 1
        word = min(count, key=lambda k: (-count[k], k))
        chosen.append(word)
        left = {g: words for g, words in left.items() if word not in words}
    # By their first letters, so that a word of the text is compared with few of them.
    heads: dict[str, list[str]] = {}
    for word in sorted(chosen):
        heads.setdefault(word[0], []).append(re.escape(word[1:]))
    return "(?<![a-z0-9])(?:" + "|".join(f"{re.escape(h)}(?:{'|'.join(tails)})" for h, tails in sorted(heads.items())) + ")(?![a-z0-9])"


def _threshold(known, unknown) -> float:
    """Between the two groups, where the two rates of error sum to the least; the middle of the best range."""
    cuts = np.unique(np.concatenate([[0.0, 1.0], known, unknown]))
    mids = (cuts[1:] + cuts[:-1]) / 2
    loss = np.array([(known < m).mean() + (unknown >= m).mean() for m in mids])
    best = mids[loss <= loss.min() + 1e-12]
    return float(best[len(best) // 2])


def classified(line: Column, model: Model) -> Column:
    """Struct (family, probability, similarity, confirmed) of one paragraph."""
    families = F.array(*map(F.lit, model.families))

    def judge(found):
        return let(model.probabilities(found), lambda p: judged(found, p))

    def judged(found, p):
        ranked = F.zip_with(F.slice(p, 1, len(model.families)), families, lambda p, f: F.struct(p.alias("p"), f.alias("family")))
        best = F.aggregate(ranked, F.struct(F.lit(-1.0).alias("p"), F.lit("").alias("family")),
                           lambda a, x: F.when(x["p"] > a["p"], x).otherwise(a))
        licence = F.element_at(p, -1) >= model.cut
        return let(best, lambda b: let(similarity(found, b["family"]), lambda s: F.struct(
            F.when((b["p"] >= model.threshold) | (licence & (s >= CONFIRM)), b["family"]).when(licence, "unknown").otherwise("none").alias("family"),
            b["p"].alias("probability"), s.alias("similarity"),
            (((b["p"] >= model.threshold) | licence) & (s >= CONFIRM)).alias("confirmed"))))

    return let(grams(line), judge)


def similarity(found: Column, family: Column) -> Column:
    """Largest share of a notice's n-grams that the paragraph holds, over the family's notices."""
    listed = {f: [sorted(plain_grams(n.replace("\n", " "))) for n in notices] for f, notices in NOTICES.items()}
    table = F.from_json(F.lit(json.dumps(listed)), "map<string,array<array<string>>>")
    return F.coalesce(F.array_max(F.transform(F.element_at(table, family), lambda n: F.size(F.array_intersect(found, n)) / F.size(n))),
                      F.lit(0.0))


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and `licenses`: one struct per licence paragraph."""
    model = train(docs, sample)
    found = F.transform(paragraphs(text_or_empty(), model.anchors), lambda x: classified(x, model))
    return docs.select("doc_id", F.filter(found, lambda x: x["family"] != "none").alias("licenses"))


def op4_license_scan(docs: DataFrame) -> DataFrame:
    """Per document its strongest licence paragraph and the set of its families."""
    def strongest(x):
        return F.aggregate(x, F.struct(F.lit("none").alias("family"), F.lit(0.0).alias("probability"), F.lit(0.0).alias("similarity"),
                                       F.lit(False).alias("confirmed")),
                           lambda a, b: F.when((a["family"] == "none") | (b["confirmed"] & ~a["confirmed"])
                                               | ((b["confirmed"] == a["confirmed"]) & (b["probability"] > a["probability"])), b).otherwise(a))
    return scan(docs).select("doc_id", "licenses", strongest(F.col("licenses")).alias("s")).select(
        "doc_id", F.size("licenses").cast("long").alias("n_paragraphs"), F.col("s.family").alias("family"),
        F.round("s.probability", 6).alias("probability"), F.round("s.similarity", 6).alias("similarity"), F.col("s.confirmed").alias("confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"]))), ",").alias("families"))
