"""The licence scan against a plain scorer, and lines of real licences."""

import math
import re

import pytest
from pyspark.sql import functions as F

from corpus_rows import empty, hard, hard_rows, small  # noqa: F401  (fixtures)
from survspan.llm import license_scan as scan

LINES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "Distributed under the MIT terms.": "mit", "This work is released under CC0.": "public-domain",
    "Redistributions of source code must retain the above copyright notice": "bsd", "WITHOUT WARRANTY OF ANY KIND": "mit",
    "Licensed under the Mozilla Public License 2.0": "mpl", "This file is covered by the CeCILL licence agreement.": "unknown",
    "License: WTFPL": "unknown", "This library uses the SIL Open Font License.": "unknown",
    "Subject to the Elastic License 2.0.": "unknown", "Licensed under the Ricoh Source Code terms.": "unknown",
    "Source available; see the Business Source License 1.1 for terms.": "unknown",
    "Distribution is governed by the NVIDIA Software License Agreement.": "unknown",
    "He lost his driving licence.": "none", "My sister lost her license.": "none", "The warranty of my phone ran out.": "none",
    "She studied copyright in Paris.": "none", "": "none", "Plain words about the harbour and the sea.": "none",
}
MIT = ("Copyright (c) 2019 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\n"
       "of this software and associated documentation files (the \"Software\"), to deal\n"
       "in the Software without restriction, including without limitation the rights\n"
       "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
       "copies of the Software, and to permit persons to whom the Software is\n"
       "furnished to do so, subject to the following conditions:\n\nNothing here.\nMy sister went home.")


@pytest.fixture(scope="module")
def model(spark):
    return scan.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def plain_score(line, model):
    """(family, probability, similarity, confirmed) in plain Python."""
    found = scan.plain_grams(line)
    logits = list(model.bias)
    for g in found:
        logits = [a + b for a, b in zip(logits, model.weights.get(g, [0.0] * len(logits)))]
    p = [1 / (1 + math.exp(-x)) for x in logits]
    best = max(range(len(model.families)), key=lambda i: (p[i], -i))
    family = model.families[best]
    notices = [scan.plain_grams(n.replace("\n", " ")) for n in scan.NOTICES[family]]
    alike = max(len(found & n) / len(n) for n in notices)
    sure, licence = p[best] >= model.threshold, p[-1] >= model.cut
    name = family if sure or (licence and alike >= scan.CONFIRM) else "unknown" if licence else "none"
    return name, round(p[best], 6), round(alike, 6), (sure or licence) and alike >= scan.CONFIRM


def plain_paragraphs(text, model):
    run, out = [], []
    for line in (text or "").split("\n") + [""]:
        if line and re.search(model.anchors, line.lower()):
            run.append(line)
        elif run:
            out.append(" ".join(run))
            run = []
    return out


def test_lines_of_licences(spark, model, monkeypatch):
    monkeypatch.setattr(scan, "train", lambda *a: model)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "doc_id long, text string")
    got = {r.doc_id: r.family for r in scan.op4_license_scan(docs).collect()}
    assert {line: got[i] for i, line in enumerate(LINES)} == LINES


def test_wrapped_licence_is_one_paragraph(spark, model, monkeypatch):
    monkeypatch.setattr(scan, "train", lambda *a: model)
    r = scan.scan(spark.createDataFrame([(1, MIT)], "doc_id long, text string")).first()
    families = [x.family for x in r.licenses]
    assert "mit" in families and len(families) <= 2


def test_plain_scorer(spark, model, hard, monkeypatch):
    """Every paragraph of hard rows, licence lines and generated documents, scored in plain Python."""
    monkeypatch.setattr(scan, "train", lambda *a: model)
    more = spark.createDataFrame([(10_000 + i, f"one\n{x}\n\n{y}\ntwo\n{y}") for i, (x, y) in enumerate(zip(LINES, reversed(LINES)))] +
                                 [(20_000, MIT), (20_001, "\n".join(LINES))], "doc_id long, text string")
    docs = (hard.select("doc_id", "text").union(more)
            .union(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 7 = 0").select("doc_id", "text")))
    want = sorted(((r.doc_id, [s for s in (plain_score(x, model) for x in plain_paragraphs(r.text, model)) if s[0] != "none"])
                   for r in docs.collect()), key=str)
    got = sorted(((r.doc_id, [(x.family, round(x.probability, 6), round(x.similarity, 6), x.confirmed) for x in r.licenses])
                  for r in scan.scan(docs).collect()), key=str)
    assert got == want and sum(len(x) for _, x in want) > 30


def test_anchors_lose_nothing(spark, model):
    """A line without an anchor is none by the model too, and every positive n-gram holds an anchor."""
    for g, w in model.weights.items():
        assert max(w) <= 0 or re.search(model.anchors, g), g
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    skipped = {line for r in texts for line in (r.text or "").split("\n") if not re.search(model.anchors, line.lower())}
    assert len(skipped) > 1000 and all(plain_score(x, model)[0] == "none" for x in skipped)


def test_tables(spark, hard, empty):
    assert len(scan.op4_license_scan(hard).collect()) == hard.count()
    assert scan.op4_license_scan(empty).count() == 0
    assert scan.op4_license_scan(hard.select("doc_id", F.lit(None).cast("string").alias("text"))).where("family <> 'none'").isEmpty()
