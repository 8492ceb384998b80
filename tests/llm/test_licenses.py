"""Standard notices as they stand in files, and key phrases against a plain search of all places."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from pairloom.llm import licenses

GPL = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."""
TEXTS = {
    GPL.format(2): {"gpl", "gpl-2.0"},
    GPL.format(3): {"gpl", "gpl-3.0"},
    GPL.format(3).replace("GNU General", "GNU Affero General"): {"gpl", "agpl", "agpl-3.0"},
    GPL.format("2.1").replace("GNU General", "GNU Lesser General"): {"gpl", "lgpl", "lgpl-2.1"},
    """ * This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this file""": {"mpl-2.0"},
    "// SPDX-License-Identifier: MIT": {"mit"},
    "# SPDX-License-Identifier: GPL-2.0-or-later": {"gpl-2.0"},
    "This work is under a Creative Commons Attribution 4.0 International License.": {"cc-by-4.0"},
    "Creative Commons Attribution-NonCommercial-ShareAlike 3.0": {"cc-by-nc-sa-3.0"},
    "under CC BY-NC-ND 4.0": {"cc-by", "cc-by-nc-nd-4.0"},
    """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.""": {"zlib"},
    "Copyright (c) 2009, 2011-2014 Example Society of Things and its friends. All rights reserved.": {"copyright", "reserved"},
    "Copyright law is wide. " + "It is long. " * 20 + "All rights reserved.": {"reserved"},
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that""": {"bsd"},
    """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License.""": {"apache-2.0"},
    "the version 2 of the public license general gnu": set(),
    "": set(),
}


def test_standard_notices(spark):
    long_ = " ".join(["filler words of the license"] * 3000)
    docs = spark.createDataFrame(
        [(k, t) for k, t in enumerate(TEXTS)] + [(99, long_ + " " + GPL.format(2) + " " + long_), (None, None)],
        "doc_id long, text string")
    got = {r["doc_id"]: (set(filter(None, r["labels"].split(","))), r["score"])
           for r in licenses.licenses_of_documents(docs).collect()}
    for k, want in enumerate(TEXTS.values()):
        assert got[k][0] == want, list(TEXTS)[k]
        assert 0 <= got[k][1] <= 1 and (got[k][1] > 0) == bool(want)
    assert got[99][0] == {"gpl", "gpl-2.0"} and got[None] == (set(), 0.0)


@pytest.mark.parametrize("seed", range(4))
def test_labels_equal_a_plain_search(seed):
    """Random texts of licence words: every template by trying all places of all its phrases."""
    draw = random.Random(seed)
    words = licenses.vocabulary()
    index = licenses.positional_index({w: draw.randint(0, 50) for w in words}, 50)
    number = {w: k for k, w in enumerate(words)}
    shapes = list(licenses.templates())

    def stands(text, keys, between, j, low, high):
        p = keys[j]
        for s in range(low, min(high, len(text) - len(p)) + 1):
            if text[s:s + len(p)] == p:
                end = s + len(p)
                if j + 1 == len(keys) or stands(text, keys, between, j + 1, end, end + between[j + 1][1]):
                    return True
        return False

    for _ in range(150):
        text = []
        for _ in range(draw.randint(1, 5)):
            _, keys, between = draw.choice(shapes)
            for p in keys:
                part = list(p)
                if draw.random() < 0.2:
                    part[draw.randrange(len(part))] = draw.choice(words)
                text += part + draw.choices(words + ["x"], k=draw.choice([0, 1, 3, 7, 20]))
        word = {k: number[w] for k, w in enumerate(text) if w in number}
        got = dict(licenses._templates(index, word))
        want = {label for label, keys, between in shapes if stands(text, keys, between, 0, 0, len(text))}
        assert set(got) == want and all(0 < s <= 1 for s in got.values())


def test_lookup_words_are_the_rarest_of_the_document():
    words = licenses.vocabulary()
    counts = {w: 5 for w in words} | {"affero": 0, "the": 50}
    index = licenses.positional_index(counts, 50)
    ranked = [words[k] for k in np.argsort(index["rank"])]
    assert ranked[0] == "affero" and ranked[-1] == "the"
    assert all(re.fullmatch("[a-z0-9]+", w) for w in words)
