import dataclasses

import numpy as np
import pytest

from phenoweave.llm import licenses

#: Notices that are no templates.
PARAPHRASES = [
    ("This project is released under the terms of the MIT License.", "mit"),
    ("Copyright 2021 Someone. Licensed under the Apache License, Version 2.0 (the License).", "apache"),
    ("All code here is licensed under the Apache License, Version 2.0.", "apache"),
    ("The documentation is licensed under a Creative Commons Attribution 4.0 International License.", "cc"),
    ("Unless stated otherwise, texts are licensed under CC BY-SA 3.0.", "cc"),
    ("These files are free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.", "gpl"),
    ("Licensed under the GNU GPL v3, see COPYING.", "gpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted.", "bsd"),
    ("The data set is licensed under CC BY-NC-SA 4.0 and comes as it is.", "cc-restricted"),
    ("No part of this book may be reproduced without prior written permission of the publisher.", "proprietary"),
    ("(c) 2019 Firm Ltd., all rights reserved worldwide.", "proprietary"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "mpl"),
]
PROSE = [
    "He was granted permission to use the software of the company without any further condition.",
    "The library is free and open to the public on weekdays, with rights of access for members.",
    "Apache helicopters and the Boost engine were shown under a warm sun.",
    "A license to drive is required by law; see the general rules for details.",
]


@pytest.fixture(scope="module")
def model(spark, sf):
    return licenses.fit(spark.read.parquet(f"{sf}/documents.parquet"))


def families(model, text):
    return licenses._document(model, text, licenses.LEAST, licenses.COVER)[1]


def test_cut_and_changed_texts(model):
    rng = np.random.default_rng(5)
    hit = total = 0
    for line, family in licenses.templates():
        words = line.replace("{v}", "3.0").split()
        if len(words) < 8:
            continue
        for _ in range(4):
            w = list(words)
            w[int(rng.integers(0, len(w)))] = "whatever"
            w = w[: int(len(w) * rng.uniform(0.8, 1))]
            total += 1
            hit += family in families(model, "Before it.\n" + " ".join(w) + "\nAfter it.")
    assert hit / total >= 0.9, (hit, total)


def test_paraphrases_and_prose(model):
    hit = [f in families(model, t) for t, f in PARAPHRASES]
    assert sum(hit) >= 10, [t for (t, _), h in zip(PARAPHRASES, hit, strict=True) if not h]
    assert not any(families(model, t) for t in PROSE)


def test_cues_pass_nothing_over(spark, sf, model):
    every = dataclasses.replace(model, cue=frozenset(w for g in model.vocabulary for w in g.split()))
    r = np.random.default_rng(2)
    pool = [t.split() for t, _ in licenses.templates()]
    lines = [" ".join(np.concatenate([pool[i][: r.integers(1, 40)] for i in r.integers(0, len(pool), 2)])) for _ in range(400)]
    lines += [t for t, _ in licenses.templates()]
    assert [families(model, x) for x in lines] == [families(every, x) for x in lines]
    assert model.cue != every.cue
