"""License scans by patience alignment.

A template and a stretch of text are anchored on words that both have exactly once; the
longest increasing run of anchors is kept and the gaps between are aligned the same way.
The share of the template's words that are aligned is its coverage.  Short notices differ in
a word or two, so a template also has words that must be aligned (a name, a version) and
words that must not stand in between (those of its relatives).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.llm.common import column, map_batches, widened

#: Notices and license texts to look for.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-notice": "Licensed under the GNU General Public License, version 3",
    "gpl-2.0-notice": "Licensed under the GNU General Public License, version 2",
    "lgpl-3.0-notice": "Licensed under the GNU Lesser General Public License, version 3",
    "lgpl-2.1-notice": "Licensed under the GNU Lesser General Public License, version 2.1",
    "agpl-3.0-notice": "Licensed under the GNU Affero General Public License, version 3",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ),
    "mit-notice": "Released under the MIT License",
    "bsd-notice": "Released under the BSD License",
    "isc-notice": "Released under the ISC License",
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission."
    ),
    "cc-by-4.0-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0",
    "cc-by-nd-4.0-notice": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-sa-4.0-notice": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nc-nd-4.0-notice": "Licensed under CC BY-NC-ND 4.0",
    "all-rights-reserved": "All rights reserved",
}


@dataclass(frozen=True)
class Rule:
    """Words of a template that have to be aligned, words that may not stand between aligned ones, and a
    template of which this one is a part, so that it counts only outside of it."""

    needed: frozenset[str] = frozenset()
    barred: frozenset[str] = frozenset()
    part_of: str | None = None


def _rule(needed: str = "", barred: str = "", part_of: str | None = None) -> Rule:
    return Rule(frozenset(needed.split()), frozenset(barred.split()), part_of)


#: What tells the templates from their relatives.
RULES = {
    "apache-2.0-notice": _rule("apache 2"),
    "apache-2.0-header": _rule("apache 2"),
    "gpl-3.0-notice": _rule("gnu general 3", "lesser library affero 2"),
    "gpl-2.0-notice": _rule("gnu general 2", "lesser library affero 3"),
    "lgpl-3.0-notice": _rule("lesser 3", "2"),
    "lgpl-2.1-notice": _rule("lesser 2 1", "3"),
    "agpl-3.0-notice": _rule("affero 3"),
    "gpl-3.0-header": _rule("gnu general 3", "lesser affero"),
    "mpl-2.0-notice": _rule("mozilla 2"),
    "mit-notice": _rule("mit"),
    "bsd-notice": _rule("bsd"),
    "isc-notice": _rule("isc"),
    "isc": _rule("fee"),
    "bsd-2-clause": _rule("redistribution", part_of="bsd-3-clause"),
    "bsd-3-clause": _rule("neither endorse"),
    "cc-by-4.0-notice": _rule("cc by 4", "nc sa nd"),
    "cc-by-sa-4.0-notice": _rule("cc by sa 4", "nc nd"),
    "cc-by-nd-4.0-notice": _rule("cc by nd 4", "nc sa"),
    "cc-by-nc-4.0-notice": _rule("cc by nc 4", "sa nd"),
    "cc-by-nc-sa-4.0-notice": _rule("cc by nc sa 4", "nd"),
    "cc-by-nc-nd-4.0-notice": _rule("cc by nc nd 4", "sa"),
}

WORD = re.compile(r"\w+")
MATCHES = "array<struct<license:string,start_word:int,end_word:int,coverage:double>>"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing run, by patience: piles and the pile before."""
    tops: list[int] = []
    top_at: list[int] = []
    before: list[int] = []
    for at, value in enumerate(values):
        pile = bisect_left(tops, value)
        before.append(top_at[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [value]
        top_at[pile : pile + 1] = [at]
    run, at = [], top_at[-1] if top_at else -1
    while at >= 0:
        run.append(at)
        at = before[at]
    return run[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two word lists, in order."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, m, j, n = gaps.pop()
        while i < m and j < n and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            found.append((m, n))
        if i == m or j == n:
            continue
        once = {w for w, c in Counter(a[i:m]).items() if c == 1} & {w for w, c in Counter(b[j:n]).items() if c == 1}
        if not once:
            continue
        place = {w: k for k, w in enumerate(b[j:n], j) if w in once}
        anchors = [(k, place[w]) for k, w in enumerate(a[i:m], i) if w in once]
        anchors = [anchors[k] for k in increasing([y for _, y in anchors])]
        found += anchors
        ends = [(i - 1, j - 1), *anchors, (m, n)]
        gaps += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(ends, ends[1:], strict=False)]
    return sorted(found)


def occurrences(template: list[str], text: list[str], coverage: float, rule: Rule = Rule()) -> list[tuple[int, int, float]]:
    """Stretches (first, last word, coverage) of a text that the template covers, without overlap.

    A window of twice the template's length begins at every word that a stretch may begin
    with, one of the template's first; so the place in the text plays no part.  Only windows
    with enough of the template's words are aligned.  Where a window has the template more
    than once, its words are not unique there, and a narrower one is tried as well.
    """
    size = len(template)
    wanted = Counter(template)
    need = coverage * size - 1e-9
    upto = [0]
    for w in text:
        upto.append(upto[-1] + (w in wanted))
    if upto[-1] < need:
        return []
    begin = frozenset(template[: size - ceil(need) + 1])
    must = {i for i, w in enumerate(template) if w in rule.needed}
    tried: list[tuple[float, int, int]] = []

    def attempt(start: int, width: int) -> None:
        window = text[start : start + width]
        there = Counter(window)
        if sum(min(c, there[w]) for w, c in wanted.items()) < need:
            return
        pairs = patience(template, window)
        if len(pairs) < need or not must.issubset(i for i, _ in pairs):
            return
        first, end = pairs[0][1], pairs[-1][1] + 1
        if not rule.barred.isdisjoint(window[first:end]):
            return
        tried.append((len(pairs) / size, -(start + first), start + end))

    for start, word in enumerate(text):
        end = min(start + 2 * size, len(text))
        if word not in begin or upto[end] - upto[start] < need:
            continue
        attempt(start, 2 * size)
        if upto[end] - upto[start] > size:
            attempt(start, size + size // 4 + 1)
    taken: list[tuple[int, int, float]] = []
    for share, first, end in sorted(tried, key=lambda t: (-t[0], t[2] + t[1], -t[1])):
        if all(end <= a or -first >= b for a, b, _ in taken):
            taken.append((-first, end, share))
    return sorted(taken)


def found_in(text: list[str], known: dict[str, list[str]], rules: dict[str, Rule], coverage: float) -> list[dict]:
    """The stretches of a text by template, those within the template that theirs is a part of left out."""
    there = frozenset(text)
    found: dict[str, list[tuple[int, int, float]]] = {}
    for name, template in known.items():
        rule = rules.get(name, Rule())
        if rule.needed.issubset(there) and sum(w in there for w in template) >= coverage * len(template) - 1e-9:
            found[name] = occurrences(template, text, coverage, rule)
    rows = []
    for name, stretches in found.items():
        whole = found.get(rules.get(name, Rule()).part_of or "", [])
        for a, b, share in stretches:
            if not any(c <= a and b <= d for c, d, _ in whole):
                rows.append({"license": name, "start_word": a, "end_word": b, "coverage": share})
    return rows


def with_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, *, rules: dict[str, Rule] | None = None, text: str = "text", coverage: float = 0.8
) -> DataFrame:
    """``docs`` with ``licenses``: the stretches of the whole text that templates cover.

    Words are runs of word characters in lower case; ``start_word`` and ``end_word`` (not
    included) count them.  ``rules`` tell templates from their relatives (``RULES`` for the
    built-in ones).  Null and empty texts and templates without words match nothing.  All
    rows and columns stay, a column ``licenses`` is replaced.
    """
    docs = docs.drop("licenses")
    known = {name: w for name, t in sorted((templates or TEMPLATES).items()) if (w := words(t))}
    rules = (rules or {}) if templates else RULES

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [found_in(words(value), known, rules, coverage) for value in column(batch, text)]
        kind = pa.list_(pa.struct([("license", pa.string()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("coverage", pa.float64())]))
        return batch.append_column("licenses", pa.array(found, kind))

    return map_batches(docs, scan, widened(docs, licenses=MATCHES))


def license_scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    *,
    rules: dict[str, Rule] | None = None,
    id_col: str = "doc_id",
    text: str = "text",
    coverage: float = 0.8,
) -> DataFrame:
    """``id_col, license, start_word, end_word, coverage`` for each stretch found."""
    found = with_licenses(docs.select(id_col, text), templates, rules=rules, text=text, coverage=coverage)
    return found.select(id_col, F.explode("licenses").alias("m")).select(id_col, "m.*")
