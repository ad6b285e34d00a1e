"""License notices, found by patience alignment with templates.

Words that come once in the text and once in the template are anchors. The
longest sequence of anchors in the same order in both is kept, and the gaps
between them are aligned in the same way, after taking equal words off their
ends. The part of the template's words that is aligned is its coverage.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vertexweave.llm.frames import fresh
from vertexweave.llm.workers import slices, texts

COVERAGE = 0.8
# Aligned words must fill at least this part of the span of text that they take.
DENSITY = 0.6
# Words of text looked at on either side of a word that is looked for, for each word of the template.
_REACH = 2
_WORD = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Template:
    """A notice. ``keys``, words that hardly any other text has, are looked for first; a match may lack them.

    Of ``names``, if there are any, a match must have one: without them, the same words name another license.
    """

    license: str
    keys: tuple[str, ...]
    text: str
    names: tuple[str, ...] = ()

    @property
    def words(self) -> list[str]:
        return _WORD.findall(self.text.lower())


# The wording of public licenses and of the notices that name them.
TEMPLATES = (
    Template("MIT", ("mit",), "Released under the MIT License.", ("mit",)),
    Template("MIT", ("mit",), "Licensed under the MIT License.", ("mit",)),
    Template(
        "MIT",
        ("sublicense",),
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    Template("Apache-2.0", ("apache",), "Licensed under the Apache License, Version 2.0.", ("apache",)),
    Template("Apache-2.0", ("apache",), "Released under the Apache License, Version 2.0.", ("apache",)),
    Template(
        "Apache-2.0",
        ("apache",),
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ("apache",),
    ),
    Template("GPL-3.0", ("gnu",), "This work is licensed under the GNU General Public License, version 3.", ("gnu", "general")),
    Template(
        "GPL-3.0",
        ("gnu",),
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    Template("GPL-2.0", ("gnu",), "This work is licensed under the GNU General Public License, version 2.", ("gnu", "general")),
    Template("LGPL-3.0", ("gnu",), "This work is licensed under the GNU Lesser General Public License, version 3.", ("gnu", "general")),
    Template("AGPL-3.0", ("gnu",), "This work is licensed under the GNU Affero General Public License, version 3.", ("gnu", "general")),
    Template(
        "MPL-2.0",
        ("mozilla",),
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        ("mozilla",),
    ),
    *(
        Template(
            license,
            ("gnu",),
            f"This {kind} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} "
            f"Public License as published by the Free Software Foundation; either version {version} of the License, or "
            "(at your option) any later version.",
        )
        for license, kind, name, version in (
            ("GPL-2.0", "program", "General", "2"),
            ("LGPL-2.1", "library", "Lesser General", "2.1"),
            ("LGPL-3.0", "library", "Lesser General", "3"),
            ("AGPL-3.0", "program", "Affero General", "3"),
        )
    ),
    Template("BSD-3-Clause", ("bsd",), "Released under the BSD 3-Clause License."),
    Template("BSD-2-Clause", ("bsd",), "Released under the BSD 2-Clause License."),
    Template(
        "ISC",
        ("hereby",),
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    Template("CC-BY-4.0", ("cc",), "Licensed under CC BY 4.0."),
    Template("CC-BY-SA-4.0", ("cc",), "Licensed under CC BY-SA 4.0."),
    Template("CC-BY-NC-4.0", ("cc",), "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-ND-4.0", ("cc",), "Licensed under CC BY-ND 4.0."),
    Template("CC-BY-NC-SA-4.0", ("cc",), "Licensed under CC BY-NC-SA 4.0."),
    Template("CC-BY-NC-ND-4.0", ("cc",), "Licensed under CC BY-NC-ND 4.0."),
    Template("CC0-1.0", ("cc0",), "Dedicated to the public domain under CC0 1.0.", ("cc0",)),
    Template(
        "CC-BY-4.0", ("creative",), "This work is licensed under a Creative Commons Attribution 4.0 International License."
    ),
    Template("Unlicense", ("unencumbered",), "This is free and unencumbered software released into the public domain."),
    Template("Proprietary", ("reserved",), "All rights reserved."),
)


# Words that make another license of the same notice.
RIVALS = frozenset((
    "lesser", "library", "affero", "documentation", "nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike",
))


def _of_another(words: Sequence[str], own: Sequence[str], pairs: list[tuple[int, int]]) -> bool:
    """Whether the text, where the notice should be, has words that make it one of another license.

    These are rivals that the template lacks, and, if a number of the template
    is not found, any other number. Where words are missing at either end, as
    many words of text are looked at.
    """
    (first, head), (last, tail) = pairs[0], pairs[-1]
    there = words[max(0, first - head) : last + len(own) - tail]
    if any(w in RIVALS and w not in own for w in there):
        return True
    aligned = {j for _, j in pairs}
    lost = any(w.isdigit() and j not in aligned for j, w in enumerate(own))
    return lost and any(w.isdigit() and w not in own for w in there)


def _longest_increasing(values: Sequence[int]) -> list[int]:
    """Places of a longest increasing subsequence of distinct values, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect.bisect_left(tops, v)
        before[i] = at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, ascending in both."""
    found: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {a[i]: i for i in range(a0, a1) if in_a[a[i]] == 1}
        anchors = [(place[b[j]], j) for j in range(b0, b1) if in_b[b[j]] == 1 and b[j] in place]
        kept = [anchors[k] for k in _longest_increasing([i for i, _ in anchors])]
        if not kept:
            continue
        found += kept
        ends = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        work += [(i0 + 1, i1, j0 + 1, j1) for (i0, j0), (i1, j1) in zip(ends, ends[1:])]
    return sorted(found)


@dataclass(frozen=True)
class Match:
    license: str
    coverage: float
    matched: int
    start: int
    end: int


@lru_cache(maxsize=4096)
def _plan(template: Template, coverage: float) -> tuple[list[str], Counter, int, dict[str, list[int]]]:
    """Words, their numbers, the least number aligned, and the words to look for with their places.

    So many are looked for that a notice that is covered cannot lack them all: their places are more than the words
    that may be missing. Words that come once are taken first, then keys, then long ones.
    """
    own = template.words
    times, need = Counter(own), max(1, math.ceil(coverage * len(own) - 1e-9))
    seeds: dict[str, list[int]] = {}
    left = len(own) - need + 1
    for w in sorted(times, key=lambda w: (times[w] > 1, w not in template.keys, -len(w), w)):
        if left <= 0:
            break
        seeds[w] = [j for j, x in enumerate(own) if x == w]
        left -= times[w]
    return own, times, need, seeds


def _around(words: Sequence[str], own: Sequence[str], at: int, j: int, low: int, high: int) -> list[tuple[int, int]]:
    """An alignment of ``words[low:high]`` that has ``words[at]`` at ``own[j]``."""
    before = [(low + i, k) for i, k in align(words[low:at], own[:j])]
    return [*before, (at, j), *((at + 1 + i, j + 1 + k) for i, k in align(words[at + 1 : high], own[j + 1 :]))]


def scan(
    text: str, templates: Sequence[Template] = TEMPLATES, coverage: float = COVERAGE, density: float = DENSITY
) -> list[Match]:
    """The notices in a text, in order, none overlapping: of those that do, the one with most words aligned stays,
    then the one with the higher coverage, then the first in the list of templates. Places are characters."""
    lower = text.lower()
    plans = [_plan(t, coverage) for t in templates]
    seeds = {w for _, _, _, own_seeds in plans for w in own_seeds if w in lower}
    if not seeds:
        return []
    spots = [(m.start(), m.end()) for m in _WORD.finditer(lower)]
    words = [lower[s:e] for s, e in spots]
    where: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w in seeds:
            where.setdefault(w, []).append(i)
    found: set[tuple[int, int, int, int]] = set()
    for number, (template, (own, times, need, own_seeds)) in enumerate(zip(templates, plans)):
        reach, done = _REACH * len(own), -1
        places = sorted((i, k, w) for w in own_seeds for k, i in enumerate(where.get(w, ())))
        for at, k, w in places:
            # Nothing is better than a notice that is there word for word.
            if at <= done:
                continue
            low, high = max(0, at - reach), min(len(words), at + reach + 1)
            there = Counter(x for x in words[low:high] if x in times)
            if sum(min(n, times[x]) for x, n in there.items()) < need:
                continue
            windows = {(low, high)}
            if times[w] == 1:
                # The notice may come again nearby, and so does this word then: each copy is aligned alone, too.
                others = where[w]
                windows.add((
                    max(low, others[k - 1] + 1 if k else 0), min(high, others[k + 1] if k + 1 < len(others) else high)
                ))
            tries = [_around(words, own, at, j, *window) for window in windows for j in own_seeds[w]]
            tries.append([(low + i, j) for i, j in align(words[low:high], own)])
            for pairs in tries:
                pairs = _tight(pairs, density)
                if len(pairs) < need or template.names and not any(own[j] in template.names for _, j in pairs):
                    continue
                if _of_another(words, own, pairs):
                    continue
                first, last = pairs[0][0], pairs[-1][0]
                found.add((number, first, last, len(pairs)))
                if len(pairs) == len(own) == last - first + 1 and first <= at <= last:
                    done = last
    ranked = sorted(found, key=lambda f: (-f[3], -f[3] / len(plans[f[0]][0]), f[0], f[2] - f[1], f[1]))
    # Of those that stay, first and last words; none overlap, so both ascend.
    firsts: list[int] = []
    lasts: list[int] = []
    chosen: list[Match] = []
    for number, first, last, matched in ranked:
        k = bisect.bisect_left(firsts, first)
        if (k and lasts[k - 1] >= first) or (k < len(firsts) and firsts[k] <= last):
            continue
        firsts.insert(k, first)
        lasts.insert(k, last)
        own = plans[number][0]
        chosen.append(Match(templates[number].license, matched / len(own), matched, spots[first][0], spots[last][1]))
    return sorted(chosen, key=lambda m: m.start)


def _tight(pairs: list[tuple[int, int]], density: float) -> list[tuple[int, int]]:
    """Drop outer pairs, at the wider gap first, until those left fill their span."""
    a, b = 0, len(pairs) - 1
    while b > a and b - a + 1 < density * (pairs[b][0] - pairs[a][0] + 1):
        if pairs[a + 1][0] - pairs[a][0] >= pairs[b][0] - pairs[b - 1][0]:
            a += 1
        else:
            b -= 1
    return pairs[a : b + 1]


_LICENSES = "array<struct<license:string,coverage:double,start:int,end:int>>"


def scan_licenses(
    docs: DataFrame,
    text_col: str = "text",
    templates: Sequence[Template] = TEMPLATES,
    coverage: float = COVERAGE,
    density: float = DENSITY,
) -> DataFrame:
    """``docs`` with an array ``licenses`` of ``license, coverage, start, end`` behind its columns.

    ``start`` and ``end`` count characters of the lower-case text. A null or
    empty text has none; texts may be of any length. Rows do not depend on each
    other, repeated ones get equal arrays, and an empty table gives an empty
    one. A notice whose wording is met but for a word or number that makes it
    another license is not reported as this one. A column of the name
    ``licenses`` in ``docs`` stays, and the array is then called ``licenses_``.
    """
    (result,) = fresh(docs, "licenses")
    schema = docs.withColumn(result, F.lit(None).cast(_LICENSES)).schema
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [scan(t, templates, coverage, density) for t in texts(batch, text_col)]
            flat = [m for ms in found for m in ms]
            matches = pa.StructArray.from_arrays(
                [
                    pa.array([m.license for m in flat], pa.string()),
                    pa.array([m.coverage for m in flat], pa.float64()),
                    pa.array([m.start for m in flat], pa.int32()),
                    pa.array([m.end for m in flat], pa.int32()),
                ],
                ["license", "coverage", "start", "end"],
            )
            offsets = np.concatenate([[0], np.cumsum([len(ms) for ms in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), matches)], [*names, result]
            )

    return docs.mapInArrow(run, schema)
