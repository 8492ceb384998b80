"""License scan with a positional index of rare words.

A template is a licence header or notice with key phrases in brackets; the words between them may differ (years,
holders, other wording). The positional index has, for every word of a key phrase, the phrases and places it
stands at. Of each document its licence words are looked up from the highest IDF down, the IDF being that of all
documents, until every phrase whose words it all has was met by ``RARE`` of them (all, if it has fewer). Each
place votes for (phrase, start = place - place in the phrase); postings are intersected by that start, and
where all looked-up words agree the phrase is verified word for word. A template stands where all its key phrases
follow each other in order, with at most the words between them in the template and ``SLACK`` more in each gap (a
number in angle brackets allows so many further words). The score is the share of the template's words that stand
there in order; one base phrase makes it 1.

Three base phrases are counted at all their places, whatever stands around them.

Words are runs of letters and digits (anything beyond ASCII counts as a letter), A-Z lower-cased.
Defined results: NULL or word-less text has no words, places or labels, score 0. Rows are scanned one
by one, so repeated rows give equal results; the IDF counts every row. Ties of IDF go to the first word.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.columns import LETTERS, LOWER, KeyTable, SpanHash, flat, hash_words, slices

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Label and notice; key phrases in brackets, <n> for n words that differ from file to file.
NOTICES = [
    ("agpl", "[gnu affero general public license]"),
    ("agpl-3.0", "[gnu affero general public license] as published by the free software foundation [either version 3]"),
    ("agpl-3.0", "[gnu affero general public license version 3]"),
    ("apache-2.0", "licensed under the [apache license version 2 0]"),
    ("apache-2.0", "[licensed under the apache license version 2 0] the license you may not use this file except in "
     "[compliance with the license]"),
    ("artistic-2.0", "[artistic license 2 0]"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are [permitted]"),
    ("bsd-3-clause", "[redistribution and use in source and binary forms] with or without modification are permitted "
     "provided that the following conditions are met <90> [neither the name of] <12> nor the names of its contributors "
     "may be used to [endorse or promote products derived from this software]"),
    ("bsl-1.0", "[boost software license version 1 0]"),
    ("cc0-1.0", "[cc0 1 0 universal]"),
    ("copyright", "[copyright] c <12> [all rights reserved]"),
    ("epl-2.0", "[eclipse public license v 2 0]"),
    ("epl-2.0", "[eclipse public license 2 0]"),
    ("gpl-2.0", "[gnu general public license version 2]"),
    ("gpl-2.0", "[gnu general public license] as published by the free software foundation [either version 2]"),
    ("gpl-2.0", "[gnu general public license] as published by the free software foundation [version 2 of the license]"),
    ("gpl-3.0", "[gnu general public license version 3]"),
    ("gpl-3.0", "[gnu general public license] as published by the free software foundation [either version 3]"),
    ("gpl-3.0", "[gnu general public license] as published by the free software foundation [version 3 of the license]"),
    ("isc", "[permission to use copy modify and or distribute this software for any purpose] with or without fee is hereby "
     "granted"),
    ("isc", "[permission to use copy modify and distribute this software for any purpose with or without fee]"),
    ("lgpl", "[gnu lesser general public license]"),
    ("lgpl-2.1", "[gnu lesser general public license] as published by the free software foundation [either version 2 1]"),
    ("lgpl-2.1", "[gnu lesser general public license version 2 1]"),
    ("lgpl-3.0", "[gnu lesser general public license] as published by the free software foundation [either version 3]"),
    ("lgpl-3.0", "[gnu lesser general public license version 3]"),
    ("mit", "[permission is hereby granted free of charge to any person obtaining a copy] of this software and associated "
     "documentation files"),
    ("mit", "released [under the mit license]"),
    ("mpl-2.0", "[mozilla public license version 2 0]"),
    ("mpl-2.0", "this source code form is subject to the terms of the [mozilla public license v 2 0]"),
    ("unlicense", "this is [free and unencumbered software released into the public domain]"),
    ("wtfpl", "[do what the fuck you want to public license]"),
    ("zlib", "this software is [provided as is without any express or implied warranty] in no event will the authors be "
     "[held liable for any damages arising from the use of this software]"),
]
# Identifiers that stand after SPDX-License-Identifier.
SPDX = ("0BSD AGPL-3.0 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 EPL-2.0 GPL-2.0 GPL-3.0 ISC LGPL-2.1 "
        "LGPL-3.0 MIT MPL-2.0 Unlicense WTFPL Zlib").split()
# Parts of Creative Commons licences and how notices spell them out.
ELEMENTS = {"by": ["attribution"], "sa": ["sharealike", "share alike"], "nc": ["noncommercial", "non commercial"],
            "nd": ["noderivatives", "no derivatives", "noderivs"]}
KINDS = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"]
VERSIONS = ["2 0", "2 5", "3 0", "4 0"]


def commons():
    """Label and template of every Creative Commons licence: short form, and spelled out in each way."""
    for kind in KINDS:
        names = [""]
        for part in kind.split():
            names = [f"{n} {word}".strip() for n in names for word in ELEMENTS[part]]
        for version in VERSIONS:
            label = f"cc-{kind.replace(' ', '-')}-{version.replace(' ', '.')}"
            yield label, f"[cc {kind} {version}]"
            for name in names:
                yield label, f"[creative commons {name} {version}]"
                yield label, f"[creative commons {name} license version {version}]"


def templates():
    """Label, key phrases, and before each but the first the words between and how many may stand there."""
    ids = [(x.lower(), f"[spdx license identifier {' '.join(x.lower().replace('-', ' ').replace('.', ' ').split())}]")
           for x in SPDX]
    for label, notice in [*NOTICES, *commons(), *ids]:
        pieces = re.split(r"\[(.*?)\]", notice)
        between = []
        for piece in pieces[::2]:
            words = piece.split()
            free = sum(int(w[1:-1]) for w in words if w[0] == "<")
            own = [w for w in words if w[0] != "<"]
            between.append((own, len(own) + free + SLACK))
        yield label, [p.split() for p in pieces[1::2]], between


SLACK = 6  # words a gap may have beyond those of the template
RARE = 3  # words of a document by which a phrase is looked up
RESULT = ("struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,"
          "labels:string,score:double>")


def vocabulary() -> list[str]:
    own = {w for _, phrases, between in templates() for part in [*phrases, *(x for x, _ in between)] for w in part}
    return sorted(own | {w for b in BASE for w in b.split()})


def document_counts(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many of all documents each license word stands, and the number of documents."""
    words = vocabulary()

    def run(batches):
        hasher, table = SpanHash(), KeyTable(hash_words(words))
        held, n = np.zeros(len(words), np.int64), 0
        for batch in batches:
            data, offsets = flat(batch.column(0))
            n += batch.num_rows
            for _, _, part, at in slices(data, offsets):
                hashes, _, _, first = hasher.words(LOWER[part], at, LETTERS)
                word = table.find(hashes)
                hit = np.flatnonzero(word >= 0)
                row = np.searchsorted(first, hit, "right") - 1
                kinds = np.unique(row * len(words) + word[hit])
                held += np.bincount(kinds % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words) + 1)), pa.array(np.append(held, n))],
                                         names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n")).collect()
    counts = dict(map(tuple, rows))
    return {w: counts.get(k, 0) for k, w in enumerate(words)}, counts.get(len(words), 0)


def positional_index(counts: dict[str, int], n: int) -> dict:
    """Postings of the words of key phrases, words by IDF, and what there is to verify."""
    words = vocabulary()
    number = {w: k for k, w in enumerate(words)}
    idf = [np.log((n + 1) / (counts[w] + 1)) for w in words]
    phrases: dict[tuple, int] = {}
    shapes = []
    for label, keys, between in templates():
        keys = [phrases.setdefault(tuple(number[w] for w in p), len(phrases)) for p in keys]
        shapes.append((label, keys, [([number[w] for w in own], most) for own, most in between]))
    postings: dict[int, list] = {}
    for phrase, p in phrases.items():
        for w in dict.fromkeys(phrase):
            postings.setdefault(w, []).append((p, phrase.index(w)))
    rank = np.argsort(np.lexsort((np.arange(len(words)), -np.array(idf)))).tolist()
    base = [([number[w] for w in phrase.split()], label) for phrase, label in BASE.items()]
    return {"words": words, "rank": rank, "postings": postings, "phrases": [list(p) for p in phrases],
            "masks": [sum(1 << w for w in set(p)) for p in phrases], "shapes": shapes, "base": base}


def _phrases(index, word: dict[int, int], wanted: set[int]) -> dict[int, list[int]]:
    """Starts of the wanted phrases in a document; ``word`` maps places to word numbers."""
    where: dict[int, list[int]] = {}
    for place, w in word.items():
        where.setdefault(w, []).append(place)
    need = {p: min(RARE, len(set(index["phrases"][p]))) for p in wanted}
    votes: dict[int, dict[int, int]] = {p: {} for p in wanted}
    looked = dict.fromkeys(wanted, 0)
    open_ = len(wanted)
    for w in sorted(where, key=index["rank"].__getitem__):  # the document's words from the highest IDF down
        if not open_:
            break
        for p, k in index["postings"].get(w, ()):
            if p not in need or looked[p] == need[p]:
                continue
            own, met = votes[p], looked[p]
            if met:  # only starts that all words before agree on go on
                votes[p] = {at - k: met + 1 for at in where[w] if own.get(at - k) == met}
            else:
                votes[p] = {at - k: 1 for at in where[w]}
            looked[p] += 1
            open_ -= looked[p] == need[p]
    found = {}
    for p, own in votes.items():
        phrase = index["phrases"][p]
        starts = [s for s in own if all(word.get(s + k) == w for k, w in enumerate(phrase))]
        if starts:
            found[p] = sorted(starts)
    return found


def _in_order(word, own, low: int, high: int) -> int:
    """How many of the words ``own`` stand in order in places ``low`` to ``high`` - 1."""
    k, n = 0, 0
    for place in range(low, high):
        w = word.get(place)
        if w is not None and w in own[k:]:
            k = own.index(w, k) + 1
            n += 1
    return n


def _templates(index, word: dict[int, int]):
    """(label, share) of the templates that stand in a document."""
    present = 0
    for w in set(word.values()):
        present |= 1 << w
    having = [present & mask == mask for mask in index["masks"]]
    possible = [shape for shape in index["shapes"] if all(having[p] for p in shape[1])]
    if not possible:
        return
    found = _phrases(index, word, {p for _, keys, _ in possible for p in keys})
    for label, keys, between in possible:
        if not all(p in found for p in keys):
            continue
        # From the last phrase back: starts from which the rest follows, each with its next start.
        good, after = found[keys[-1]], []
        for j in range(len(keys) - 2, -1, -1):
            size, most = len(index["phrases"][keys[j]]), between[j + 1][1]
            nexts = {}
            for s in found[keys[j]]:
                at = bisect_left(good, s + size)
                if at < bisect_right(good, s + size + most):
                    nexts[s] = good[at]
            after.append(nexts)
            good = sorted(nexts)
        total = sum(len(index["phrases"][p]) for p in keys) + sum(len(own) for own, _ in between)
        best = 0
        for start in good:
            s, n = start, _in_order(word, between[0][0], start - len(between[0][0]), start)
            for j, p in enumerate(keys):
                size = len(index["phrases"][p])
                n += size
                if j + 1 < len(keys):
                    follow = after[len(keys) - 2 - j][s]
                    n += _in_order(word, between[j + 1][0], s + size, follow)
                    s = follow
                else:
                    n += _in_order(word, between[-1][0], s + size, s + size + len(between[-1][0]))
            best = max(best, n)
        if good:
            yield label, best / total


def scan(shared, text: Column) -> Column:
    """Struct of counts, base labels, all labels and score of a text."""

    def run(column: pa.Array) -> pa.Array:
        index, hasher = shared.value, SpanHash()
        table = KeyTable(hash_words(index["words"]))
        n = len(column)
        sizes, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        ends = [[None] * n, [None] * n]
        labels, base_labels, score = [""] * n, [""] * n, np.zeros(n)
        data, offsets = flat(column)
        for i, j, part, at in slices(data, offsets):
            hashes, _, _, first = hasher.words(LOWER[part], at, LETTERS)
            sizes[i:j] = np.diff(first)
            word = table.find(hashes)
            hit = np.flatnonzero(word >= 0)
            row = np.searchsorted(first, hit, "right") - 1
            cuts = np.searchsorted(row, np.arange(j - i + 1))
            for r in np.flatnonzero(np.diff(cuts)):
                where = (hit[cuts[r]:cuts[r + 1]] - first[r]).tolist()
                own = dict(zip(where, word[hit[cuts[r]:cuts[r + 1]]].tolist()))
                starts, base = [], set()
                for phrase, label in index["base"]:
                    at_ = [p for p, w in own.items() if w == phrase[0]
                           and all(own.get(p + k) == x for k, x in enumerate(phrase))]
                    starts += at_
                    if at_:
                        base.add(label)
                found = list(_templates(index, own))
                if starts:
                    total[i + r], ends[0][i + r], ends[1][i + r] = len(starts), min(starts), max(starts)
                base_labels[i + r] = ",".join(sorted(base))
                labels[i + r] = ",".join(sorted(base | {label for label, _ in found}))
                score[i + r] = 1.0 if base else max((s for _, s in found), default=0.0)
        return pa.StructArray.from_arrays(
            [pa.array(sizes), pa.array(total), pa.array(ends[0], pa.int64()), pa.array(ends[1], pa.int64()),
             pa.array(base_labels), pa.array(labels), pa.array(score)],
            names=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return F.arrow_udf(run, RESULT)(text)


def licenses_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id and the scan of every document."""
    index = positional_index(*document_counts(docs))
    shared = docs.sparkSession.sparkContext.broadcast(index)
    return docs.select("doc_id", scan(shared, F.col("text")).alias("_found")).select("doc_id", "_found.*")
