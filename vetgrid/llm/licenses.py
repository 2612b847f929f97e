"""License scans by patience alignment.

A template is aligned with a text as a patience diff does it: words that occur exactly once in both
are anchors, the longest increasing subsequence of the anchors is kept, and the gaps between kept
anchors are aligned in the same way. Equal words directly before and behind an anchor belong to it.
A text can hold a template anywhere and more than once. Word pairs that it shares with the template vote
for the place where a copy would begin (place in the text minus place in the template); votes near each
other make a region of about one template length, so copies that follow one another directly get regions
of their own. Each region is aligned by itself, and coverage is the share of the template's words that
found a place, in order.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetgrid.llm import words as W

COVERAGE = 0.8
SLICE = 4 << 20  # bytes of text that a task works on at once
VOTES = 0.25  # share of a template's word pairs that a region shares at least

# Public license notices (fixed values).
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version."),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."),
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version."),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so"),
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."),
    "all-rights-reserved": "All rights reserved.",
}

_WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*").findall


def word_list(text: str) -> list[str]:
    return _WORDS(text.lower())


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Increasing pairs of equal words of ``a`` and ``b``. Gaps wait on a list, not on the call stack."""
    result, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            result.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            result.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in place]
        kept = increasing(anchors)
        if kept:
            result += kept
            ends = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])]
    return sorted(result)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence with increasing second parts, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            piles.append(n)
        else:
            tops[pile], piles[pile] = j, n
    result = []
    n = piles[-1] if piles else -1
    while n >= 0:
        result.append(pairs[n])
        n = back[n]
    return result[::-1]


def regions(words: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Stretches of the text, of about a template length, in which enough word pairs vote for one beginning."""
    places: dict[tuple[str, str], list[int]] = {}
    for j, pair in enumerate(zip(template, template[1:])):
        places.setdefault(pair, []).append(j)
    size = len(template)
    votes = sorted((i - j, i) for i, pair in enumerate(zip(words, words[1:])) for j in places.get(pair, ()))
    need, gap, spread = max(1, int(VOTES * (size - 1))), max(2, size // 4), max(2, size // 2)
    found, first = [], 0
    for n in range(1, len(votes) + 1):
        if n < len(votes) and votes[n][0] - votes[n - 1][0] <= gap and votes[n][0] - votes[first][0] <= spread:
            continue
        if len({i for _, i in votes[first:n]}) >= need:
            found.append((max(0, votes[first][0]), min(len(words), votes[n - 1][0] + size)))
        first = n
    return found


def telling(template: list[str], least: float) -> list[str]:
    """The longest words of a template, so many that a text without all of them covers less than ``least``."""
    counts, places, chosen = Counter(template), 0, []
    for word in sorted(counts, key=lambda w: (-len(w), w)):
        if places > (1 - least) * len(template):
            break
        places += counts[word]
        chosen.append(word)
    return chosen


def scan(text: str, templates: dict[str, list[str]], least: float) -> list[tuple[str, int, int, float]]:
    """``(license, first word, end word, coverage)`` of each stretch that covers enough of a template.

    Of stretches that overlap, whatever their licenses, the one with the most aligned words counts."""
    hits = []
    words: list[str] | None = None
    folded = text.lower()
    for name, template in templates.items():
        if len(template) < 2 or not any(w in folded for w in telling(template, least)):
            continue
        words = words if words is not None else word_list(text)
        for a, b in regions(words, template):
            pairs = aligned(words[a:b], template)
            if pairs and len(pairs) >= least * len(template):
                hits.append((len(pairs), name, a + pairs[0][0], a + pairs[-1][0] + 1, len(pairs) / len(template)))
    result: list[tuple[str, int, int, float]] = []
    for _, *hit in sorted(hits, key=lambda h: (-h[0], -h[4], h[2], h[1])):
        if all(hit[2] <= first or hit[1] >= end for _, first, end, _ in result):
            result.append(tuple(hit))
    return sorted(result, key=lambda h: h[1])


def license_findings(docs: DataFrame, templates: dict[str, str] | None = None, *, least: float = COVERAGE) -> DataFrame:
    """``(doc_id, license, word_first, word_end, coverage)`` for each notice in ``docs (doc_id, text, ...)``.

    ``templates`` maps names to texts of two words or more, for instance from a table. Word numbers count
    runs of letters and digits of the whole text. A notice that stands twice gives two rows, also directly
    one behind the other; where notices overlap, the one with the most words in place is reported. Null
    and empty texts give none; texts of any length are read whole; a null ``doc_id`` stays null; repeated
    rows repeat their findings; further columns are ignored; no rows give no rows.
    """
    lists = {name: word_list(text) for name, text in (templates or TEMPLATES).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.sliced(batches, "text", SLICE):
            found = [(doc, *hit) for doc, text in W.rows([batch], "doc_id", "text") if text
                     for hit in scan(text, lists, least)]
            columns = list(zip(*found)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "license", "word_first", "word_end", "coverage"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, license string, word_first long, word_end long, coverage double")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in ``documents``."""
    return license_findings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
