import numpy as np
import pytest

from tiebreak.llm import license_scan as ls, queries

from .conftest import ODD_TEXTS

NOTICES = {
    "apache": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.",
    "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0."}
PROSE = ["Erreth was ofretihaou the that edouhe", "La casa de la colina es de un amigo", "She took the MIT entrance test",
         "the general public likes free software of any kind", "The school is licensed to sell food under the new law"]


@pytest.fixture(scope="module")
def model():
    return ls.train(PROSE[:2])


def classify(model, text):
    h, _ = ls._of_strings([text])
    at, p = model.probabilities(h, np.zeros(len(h), int))
    if not len(p) or 1 - p[0, 0] < model.threshold:
        return ls.NONE
    return ls.FAMILIES[1 + p[0, 1:].argmax()]


def test_templates_and_prose(model):
    for family, templates in ls.TEMPLATES.items():
        for t in templates:
            assert classify(model, t) == family
            assert model.similarity(ls._of_strings([t])[0], family) == 1
    for text in [*PROSE, *ls.DECOYS, ""]:
        assert classify(model, text) == ls.NONE


def test_wordings_that_training_has_not_seen(model):
    cases = {
        "apache": "All of the sources below were licensed to you under the Apache License, Version 2.0, in 2015",
        "mit": "Our plugin was released under the MIT License some years ago",
        "gpl": "The tool itself is licensed under the GNU General Public License, version 2 (see COPYING)",
        "bsd": "The parser: Licensed under the BSD 3-Clause License, Copyright 1999 the team",
        "cc-by-sa": "Photos are licensed under CC BY-SA 4.0 unless stated"}
    for family, text in cases.items():
        assert classify(model, text) == family


def test_most_weights_are_zero(model):
    assert (model.weights == 0).mean() > 0.05 and 0.3 <= model.threshold <= 0.9


def test_query_finds_the_notices(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.QUERIES["op1_license_scan"](spark, sf).collect()}
    assert set(rows) == set(docs)
    for i, r in rows.items():
        want = sorted(f for f, n in NOTICES.items() if n in docs[i])
        assert [f for f in r.families if f != "proprietary"] == want
        assert all("All rights reserved" in docs[i] for f in r.families if f == "proprietary")
        assert r.n_paragraphs == len([1 for line in docs[i].removesuffix("\n").split("\n")])
        for f in r.findings:
            assert f.probability <= 1 and (not f.confirmed or f.similarity >= ls.SIMILARITY)


def test_odd_texts_and_empty_tables(frame, model):
    notice = NOTICES["mit"]
    texts = ODD_TEXTS + [f"one\n\n{notice}\nlast", "word " * 20000 + notice]
    docs = frame(texts).withColumnRenamed("fp", "families")
    rows = {r.doc_id: r for r in ls.scan(docs.union(docs), model).collect()}
    n = len(ODD_TEXTS)
    assert [rows[i].findings for i in range(n)] == [[]] * n and rows[0].n_paragraphs == rows[1].n_paragraphs == 0
    assert [(f.paragraph, f.family, f.confirmed) for f in rows[n].findings] == [(2, "mit", True)] and rows[n].families == ["mit"]
    assert rows[n + 1].families == ["mit"]
    assert ls.scan(docs.limit(0), model).count() == 0


HEADERS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:""",
    "gpl": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0""",
}


def test_wrapped_notices(frame, model):
    texts, want = [], []
    for family, header in HEADERS.items():
        for mark in ("", "# ", " * ", "// "):
            texts.append("A program.\n\n" + "\n".join(mark + line for line in header.split("\n")) + "\n\ncode goes here")
            want.append([family])
    texts += ["Some day she will be granted\nfree of charge a copy of the book\nand all its documentation", "All rights\n\nreserved"]
    want += [[], []]
    rows = {r.doc_id: r for r in ls.scan(frame(texts), model).collect()}
    assert [rows[i].families for i in range(len(texts))] == want
    assert all(2 in [f.paragraph for f in rows[i].findings if f.confirmed] for i in range(len(texts) - 2))
