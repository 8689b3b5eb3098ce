"""Licence notices in files, through a positional index of rare words.

Every licence template is a list of words. A word that at most a quarter of the
templates hold is rare, and the rarer the heavier (inverse document frequency
over the templates). The index lists for each rare word where templates hold it.
A file's rare licence words are looked up; template words whose place in the file
less their place in the template agrees, within a few words, support one
position. A template is present where the supported weight is high enough and
each of its mandatory key phrases stands, word for word, at that position.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import blocks

# Phrases that give a label wherever they stand.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public licence notices, with the phrases that must stand in each.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["hereby granted free of charge", "deal in the software without restriction"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "This project is licensed under the terms of the MIT license", ["mit license"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license", "version 2 0"]),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["www apache org licenses license 2 0"]),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ["gnu general public license"]),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu general public license", "free software foundation", "version 3"]),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ["gnu general public license", "free software foundation", "version 2"]),
    ("lgpl", "licensed under the GNU Lesser General Public License", ["lesser general public license"]),
    ("agpl-3.0", "licensed under the GNU Affero General Public License", ["affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ["redistribution and use in source and binary forms", "conditions are met"]),
    ("bsd", "Released under the BSD License", ["bsd license"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license", "2 0"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted", "appear in all copies"]),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ["without any express or implied warranty", "in no event will the authors be held liable"]),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ["boost software license"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["released into the public domain"]),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["eclipse public license"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ["cc by nd"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under CC0", ["to the public domain worldwide"]),
    ("wtfpl", "This work is free. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License", ["do what the fuck you want to public license"]),
    ("proprietary", "This document is proprietary and confidential. Unauthorized copying, distribution or use of this material is strictly prohibited", ["proprietary and confidential", "strictly prohibited"]),
]
#: Words of one index; the index is broadcast.
MOST_WORDS = 500_000
#: Positions agree within so many words; a template counts from this percentage of its weight.
SLACK, PERCENT = 6, 60
RARE = 4
ADDED = ("n_words", "base_places", "matches")

_KEPT = np.where(blocks.LETTERS[blocks.LOWER], blocks.LOWER, 32).astype(np.uint8).tobytes()


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters and digits, a to z lowered; bytes over 127 are letters."""
    return text.translate(_KEPT).split()


def templates(spark: SparkSession) -> DataFrame:
    """The built-in templates: label, text, phrases."""
    return spark.createDataFrame(TEMPLATES, "label string, text string, phrases array<string>")


@dataclass
class Index:
    """Postings and phrases; made once on the driver from the templates."""

    labels: list[str]
    total: list[int]
    lengths: list[int]
    #: word -> (weight, [(template, position)])
    postings: dict[bytes, tuple[int, list[tuple[int, int]]]]
    #: template -> [(phrase words, position)]
    phrases: list[list[tuple[list[bytes], int]]]
    #: first word of a base phrase -> [(phrase words, label)]
    base: dict[bytes, list[tuple[list[bytes], str]]] = field(default_factory=dict)


def build_index(rows: DataFrame, base_phrases: dict[str, str] | None = None, most_words: int = MOST_WORDS) -> Index:
    """Index of the templates ``label, text, phrases``.

    Weights are whole thousandths of the natural logarithm of templates per template
    that holds the word. Every key phrase has to stand in its own template.
    Templates of more than ``most_words`` words together are refused, so what
    is collected and broadcast has a bound.
    """
    pattern = F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = rows.select("label", "phrases", F.regexp_extract_all(lower, pattern, F.lit(0)).alias("words"))
    size = cut.agg(F.sum(F.size("words"))).first()[0] or 0
    if size > most_words:
        raise ValueError(f"templates of {size} words; split them into indexes of {most_words}")
    known = sorted((r["label"], [w.encode() for w in r["words"]], [words_of(p.encode()) for p in r["phrases"] or []]) for r in cut.collect())
    holders: dict[bytes, int] = {}
    for _, words, _ in known:
        for w in set(words):
            holders[w] = holders.get(w, 0) + 1
    out = Index([k[0] for k in known], [], [len(k[1]) for k in known], {}, [])
    for t, (label, words, phrases) in enumerate(known):
        total = 0
        for j, w in enumerate(words):
            if RARE * holders[w] <= len(known):
                weight = int(np.floor(1000 * np.log(len(known) / holders[w])))
                out.postings.setdefault(w, (weight, []))[1].append((t, j))
                total += weight
        out.total.append(total)
        placed = []
        for phrase in phrases:
            at = next((j for j in range(len(words) - len(phrase) + 1) if words[j : j + len(phrase)] == phrase), None)
            if at is None or not phrase:
                raise ValueError(f"a key phrase of {label} is not in its template")
            placed.append((phrase, at))
        out.phrases.append(placed)
    for phrase, label in (BASE_PHRASES if base_phrases is None else base_phrases).items():
        words = words_of(phrase.encode())
        out.base.setdefault(words[0], []).append((words, label))
    return out


def _stretches(places: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of ``[place - slack, place]`` as starts and ends (exclusive)."""
    places = np.unique(places)
    apart = np.diff(places) > slack + 1
    first = np.concatenate([[True], apart])
    last = np.concatenate([apart, [True]])
    return places[first] - slack, places[last] + 1


def align(words: list[bytes], t: int, index: Index, found: dict[int, list[tuple[int, int]]], slack: int, percent: int) -> list[tuple[int, int]]:
    """Positions of template ``t`` in a file: ``(position, supported weight)``.

    ``found`` maps a template position to the file places of its word and its
    weight. One result for each unbroken range of accepted positions: the last
    position of its best supported part, the first of equals.
    """
    edges, weights, marks = [], [], []
    for j, (places, weight) in found.items():
        for ends, sign in zip(_stretches(places - j, slack), (1, -1)):
            edges.append(ends)
            weights.append(np.full(len(ends), sign * weight))
            marks.append(np.zeros(len(ends), dtype=np.int64))
    for phrase, k in index.phrases[t]:
        # Phrases are looked for only where the index brought up the template.
        n, places, at = len(phrase), [], -1
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if words[at : at + n] == phrase:
                places.append(at)
        if not places:
            return []
        for ends, sign in zip(_stretches(np.array(places) - k, slack), (1, -1)):
            edges.append(ends)
            weights.append(np.zeros(len(ends), dtype=np.int64))
            marks.append(np.full(len(ends), sign))
    edge, weight, mark = np.concatenate(edges), np.concatenate(weights), np.concatenate(marks)
    order = np.argsort(edge, kind="stable")
    edge, weight, mark = edge[order], np.cumsum(weight[order]), np.cumsum(mark[order])
    last = np.concatenate([edge[1:] != edge[:-1], [True]])
    edge, weight, mark = edge[last], weight[last], mark[last]
    good = (100 * weight >= percent * index.total[t]) & (weight > 0) & (mark == len(index.phrases[t]))
    out, at = [], 0
    while at < len(good):
        if not good[at]:
            at += 1
            continue
        to = at
        while to < len(good) and good[to]:
            to += 1
        best = at + int(np.argmax(weight[at:to]))
        out.append((int(edge[best + 1]) - 1, int(weight[best])))
        at = to
    return out


def scan(words: list[bytes], index: Index, slack: int = SLACK, percent: int = PERCENT) -> tuple[list, list]:
    """Base places ``(label, start, words)`` and matches ``(label, start, words, covered)``."""
    base, hits = [], {}
    postings, anchors = index.postings, index.base
    for i, w in enumerate(words):
        if w in anchors:
            for phrase, label in anchors[w]:
                if words[i : i + len(phrase)] == phrase:
                    base.append((label, i, len(phrase)))
        if w in postings:
            hits.setdefault(w, []).append(i)
    held: dict[int, dict[int, tuple]] = {}
    for w, places in hits.items():
        weight, listed = postings[w]
        places = np.array(places, dtype=np.int64)
        for t, j in listed:
            held.setdefault(t, {})[j] = (places, weight)
    matches = []
    for t, found in held.items():
        if 100 * sum(weight for _, weight in found.values()) < percent * index.total[t]:
            continue
        for at, weight in align(words, t, index, found, slack, percent):
            matches.append((index.labels[t], max(0, at), index.lengths[t], weight / index.total[t]))
    return base, sorted(matches)


def find_licences(
    docs: DataFrame, index: Index, text: str = "text", slack: int = SLACK, percent: int = PERCENT
) -> DataFrame:
    """``docs`` with the licence notices of each whole text.

    Adds ``n_words``, ``base_places`` (array of label, start, words: each place of
    a base phrase, by start, then label) and ``matches`` (array of label, start,
    words, covered: templates found, about where they start, their length, and the supported share of their weight).

    One pass without shuffle; a text is worked off alone. A null or empty text
    has no words and no labels. An empty index finds base phrases only. Repeated rows have no effect on each
    other; a notice that stands several times is reported as often. Columns of
    ``docs`` named like an added one are replaced.
    """
    keep = [c for c in docs.columns if c not in ADDED]
    docs = blocks.lean(docs.select(*keep))
    shared = docs.sparkSession.sparkContext.broadcast(index)
    base_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))
    match_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("covered", pa.float64())]))
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
        + [
            "n_words long",
            "base_places array<struct<label:string,start:long,words:long>>",
            "matches array<struct<label:string,start:long,words:long,covered:double>>",
        ]
    )

    def run(batches):
        known = shared.value
        for rows, raw, offsets in blocks.text_blocks(batches, text):
            n_words, base, matches = [], [], []
            for a, b in zip(offsets[:-1], offsets[1:]):
                words = words_of(raw[a:b].tobytes())
                n_words.append(len(words))
                places, hits = scan(words, known, slack, percent)
                base.append([dict(zip(("label", "start", "words"), p)) for p in sorted(places, key=lambda p: (p[1], p[0]))])
                matches.append([dict(zip(("label", "start", "words", "covered"), m)) for m in hits])
            yield pa.RecordBatch.from_arrays(
                [rows.column(i) for i in range(len(keep))]
                + [pa.array(n_words, pa.int64()), pa.array(base, base_type), pa.array(matches, match_type)],
                names=keep + list(ADDED),
            )

    return docs.mapInArrow(run, schema)
