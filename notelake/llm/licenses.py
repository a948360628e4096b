"""License notices in notes, by patience alignment with templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from notelake.llm import common

COVERAGE = 0.8  # share of a template's words that must align
STRETCH = 1.25  # words of text per word of template, at most
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

BREAK = re.compile(r"[.,;:!?)\]\"'\n]")  # what ends a name before the words that follow
ARTICLES, JOINING = ("a", "an", "the"), ("and", "or", "as", "with")

# Notices of public licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
_ADVERTISING = (
    "All advertising materials mentioning features or use of this software must display the following acknowledgement: "
    "This product includes software developed by the organization."
)
_NEITHER = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_NEIGHBOURS = (
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", f"{_BSD} {_NEITHER}"),
    ("BSD-4-Clause", f"{_BSD} {_ADVERTISING} {_NEITHER}"),
    (
        "HPND",
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is "
        "hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and "
        "this permission notice appear in supporting documentation.",
    ),
)
# Families with a version: name, names in full, versions.
_GNU = (
    ("GPL", ("GNU General Public License", "General Public License", "GNU GPL", "GPL"), ("1", "2", "3")),
    ("LGPL", ("GNU Lesser General Public License", "GNU Library General Public License", "Lesser General Public License", "GNU LGPL", "LGPL"), ("2", "2.1", "3")),
    ("AGPL", ("GNU Affero General Public License", "Affero General Public License", "GNU AGPL", "AGPL"), ("3",)),
)
_CC = (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-ND", "Attribution-NoDerivs"),
    ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivs"),
)


def _versions(number: str) -> list[str]:
    """A version as notices write it."""
    numbers = [number] if "." in number and not number.endswith(".0") else [number.removesuffix(".0"), number.removesuffix(".0") + ".0"]
    return [f"{sign}{n}" for n in numbers for sign in ("version ", "v", "v. ", "")]


def _names() -> dict[str, list[str]]:
    """Of each license, the words that name it with version and variant; a family's own name stands for no or another version."""
    out: dict[str, list[str]] = {}
    for short, full, numbers in _GNU:
        out[short] = list(full)
        for n in numbers:
            joined = [f"{short}{sign}{v}" for v in dict.fromkeys((n, n if "." in n else n + ".0")) for sign in ("v", "-")]
            out[f"{short}-{n if '.' in n else n + '.0'}"] = [f"{name} {v}" for name in full for v in _versions(n)] + joined
    for short, full, numbers in (("Apache", "Apache", ("1.0", "1.1", "2.0")), ("MPL", "Mozilla Public", ("1.0", "1.1", "2.0"))):
        out[short] = [f"{full} License"] + ([short] if short != full else [])
        for n in numbers:
            out[f"{short}-{n}"] = (
                [f"{full} License {v}" for v in _versions(n)] + [f"{full} {v} License" for v in _versions(n)]
                + [f"{short} {v}" for v in _versions(n)] + [f"{short}-{n}"]
            )
    out["BSD"] = ["BSD", "BSD License"]
    for n, word, other in (("2", "two", "Simplified"), ("3", "three", "New"), ("3", "three", "Modified"), ("4", "four", "Original")):
        forms = [f"BSD {n}-Clause", f"{n}-Clause BSD", f"BSD-{n}-Clause", f"{word}-clause BSD", f"{n} clause BSD", f"BSD {n} clause", f"{other} BSD"]
        out.setdefault(f"BSD-{n}-Clause", []).extend(forms)
    out |= {"MIT": ["MIT"], "ISC": ["ISC"], "Unlicense": ["Unlicense"], "CC0-1.0": ["CC0", "CC0 1.0", "CC0-1.0"]}
    for n in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        for short, long in _CC:
            spaced = long.replace("-", " ")
            out.setdefault(f"CC-{short}-{n}", []).extend(
                [f"CC {short} {n}", f"CC-{short} {n}", f"CC-{short}-{n}", f"CC {short}-{n}", f"CC {short.replace('-', ' ')} {n}"]
                + [f"Creative Commons {x} {n}" for x in dict.fromkeys((long, spaced))]
                + [f"Creative Commons {x} License {n}" for x in dict.fromkeys((long, spaced))]
            )
    return {name: list(dict.fromkeys(forms)) for name, forms in out.items()}


NAMES = _names()
_LATER = "the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
_ONLY = "version 3 of the GNU General Public License as published by the Free Software Foundation"
# What names a license in its full notice: each of one of these groups has to be there as it is.
MARKS: dict[str, list[tuple[str, ...]]] = {
    "BSD-3-Clause": [("endorse or promote products",)],
    "BSD-4-Clause": [("advertising materials",)],
}
_GNU_NOTICES = []
for _short, _full, _numbers in _GNU:
    for _n in _numbers:
        for _name in (f for f in _full if f.startswith("GNU") and f.endswith("License")):
            _key, _text = f"{_short}-{_n if '.' in _n else _n + '.0'}", next(t for k, t in TEMPLATES[5:] if k == "GPL-3.0")
            MARKS.setdefault(_key, []).append((_name, f"version {_n}"))
            for _form in (_text, _text.replace(_LATER, _ONLY)):
                _GNU_NOTICES.append((_key, _form.replace("GNU General Public License", _name).replace("version 3", f"version {_n}")))
_LINES = tuple(
    (name, f"{ahead} {form}{after}")
    for name, forms in NAMES.items() for form in forms
    for ahead in ("Licensed under", "Licensed under the", "Released under", "Released under the")
    for after in (("", " License") if "icense" not in form else ("",))
)
# These and the ones of neighbouring licenses, versions and spellings.
ALL_TEMPLATES = tuple(dict.fromkeys((*TEMPLATES, *_NEIGHBOURS, *_GNU_NOTICES, *_LINES)))

LICENSES = "vault string, path string, license string, start bigint, end bigint, matched int, words int, coverage double"


def words_of(text: str) -> list[str]:
    return [_spelt(w) for w in WORD.findall(text.lower())]


def _spelt(word: str) -> str:
    return word.replace("licence", "license")


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of the first member, whose second members rise: piles of patience."""
    tops: list[int] = []  # of each pile, the pair on top
    under: list[int] = []
    for k, (_, j) in enumerate(pairs):
        low, high = 0, len(tops)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if pairs[tops[middle]][1] < j else (low, middle)
        under.append(tops[low - 1] if low else -1)
        tops[low : low + 1] = [k]
    out, k = [], tops[-1] if tops else -1
    while k >= 0:
        out.append(pairs[k])
        k = under[k]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places with equal words, rising in both lists.

    Words that occur once in either list anchor the alignment where they rise together; the gaps between
    anchors are aligned in the same way.  A gap without such words keeps its equal ends.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        places: list[dict[str, int]] = [{}, {}]
        for seen, words, start, end in ((places[0], a, a0, a1), (places[1], b, b0, b1)):
            for i in range(start, end):
                seen[words[i]] = -1 if words[i] in seen else i
        anchors = _rising([(i, places[1][w]) for w, i in places[0].items() if i >= 0 and places[1].get(w, -1) >= 0])
        if anchors:
            out += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False) if i + 1 < k and j + 1 < m]
    return sorted(out)


def _run(words: list[str], part: list[str]) -> int:
    """The first place of ``part`` in ``words``, or -1."""
    return next((i for i in range(len(words) - len(part) + 1) if words[i : i + len(part)] == part), -1)


@dataclass
class Template:
    name: str
    words: list[str]

    def __post_init__(self) -> None:
        n = len(self.words)
        self.need = -(-n * int(COVERAGE * 100) // 100)
        spare = n - self.need + 1
        # Of any n - need + 1 words one is among the aligned ones: of the longest, to pass texts over ...
        self.keys = sorted(set(sorted(self.words, key=len, reverse=True)[:spare]))
        # ... and of the first, to know where an alignment starts.
        self.first = set(self.words[:spare])
        self.all = set(self.words)
        # The words that identify the license, as stretches of the template.
        forms = sorted((words_of(f) for f in NAMES.get(self.name, ())), key=len, reverse=True)
        named = [(i, len(f)) for f in forms if (i := _run(self.words, f)) >= 0][:1]
        for marks in ([words_of(m) for m in group] for group in MARKS.get(self.name, ())):
            if not named and all(_run(self.words, m) >= 0 for m in marks):
                named = [(_run(self.words, m), len(m)) for m in marks]
        self.identity = [(i, i + k) for i, k in named]
        self.marks = [self.words[i:k] for i, k in self.identity]
        self.named = sorted({w for m in self.marks for w in m}, key=len, reverse=True)

    def likely(self, low: str) -> bool:
        return all(w in low for w in self.named) and any(k in low for k in self.keys)

    def find(self, words: list[str], where: dict[str, list[int]], ends) -> list[tuple[int, int, int]]:
        """``(first word, last word, words matched)`` of the alignments that suffice, from every place where one can start.

        ``where`` has the places of each word; ``ends(k)`` tells whether something follows word ``k`` that ends a name.
        """
        span = int(STRETCH * len(self.words)) + 1
        if self.marks:
            mark = self.marks[0]
            at = [p for p in where.get(mark[0], ()) if words[p : p + len(mark)] == mark]
            starts = sorted({k for p in at for k in range(max(0, p - span), p + 1) if words[k] in self.first})
        else:
            starts = sorted(p for w in self.first for p in where.get(w, ()))
        out = []
        for p in starts:
            part = words[p : p + span]
            if sum(w in self.all for w in part) < self.need:
                continue
            pairs = patience(part, self.words)
            if len(pairs) >= self.need and self._identified(pairs, words, p, ends):
                out.append((p + pairs[0][0], p + pairs[-1][0], len(pairs)))
        return out

    def _identified(self, pairs: list[tuple[int, int]], words: list[str], p: int, ends) -> bool:
        """The identifying words are there one after the other, and none is added beside them."""
        place = {j: i for i, j in pairs}
        for start, end in self.identity:
            if any(place.get(j, -1) != place.get(start, -2) + j - start for j in range(start, end)):
                return False
            ahead = [i for i, j in pairs if j < start]
            after = [i for i, j in pairs if j >= end]
            if ahead and any(w not in ARTICLES for w in words[p + ahead[-1] + 1 : p + place[start]]):
                return False
            # A name of one word may be the start of another one.
            if end < len(self.words) or end - start == 1:
                if not (after and after[0] == place[end - 1] + 1) and not ends(p + place[end - 1]):
                    return False
        return True


def find_licenses(notes: DataFrame, templates: tuple[tuple[str, str], ...] = ALL_TEMPLATES) -> DataFrame:
    """A row per license notice: ``vault, path, license, start, end, matched, words, coverage``.

    Words (letters and digits, in lower case, with inner dots and hyphens) of the text and of a
    template are aligned from those that are unique in both, by the longest rising run, gap by gap; a
    notice is found where ``coverage``, the share of the template's words that align, is 0.8 or more within
    1.25 times its length.  The words that identify the license (``NAMES``: name, version and variant; ``MARKS``
    in full notices) have to be there as they are, with none but an article added among or beside them; a family's name alone
    (``GPL``, ``BSD``, ...) is given where version or variant is missing or unknown.  Of overlapping notices
    of all licenses the one with most words matched, then the shortest, then the first, stays.  ``start`` and ``end`` are code points of the text.  Whole texts are
    searched.  Texts without notice, also empty and NULL ones, give no row; repeated rows give their rows each.
    """
    made = [Template(name, words_of(text)) for name, text in templates]
    made = [t for t in made if t.words]
    # Most texts lack the longest word of each name.
    groups: dict[str, list[Template]] = {}
    for t in made:
        groups.setdefault(t.named[0] if t.named else "", []).append(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            rows = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                low = _spelt(text.lower())
                likely = [t for key, group in groups.items() if key in low for t in group if t.likely(low)]
                if not likely:
                    continue
                # Positions are those of the text itself, whatever lower case does to its length.
                places = [m.span() for m in WORD.finditer(text)]
                words = [_spelt(text[s:e].lower()) for s, e in places]
                where: dict[str, list[int]] = {}
                for k, word in enumerate(words):
                    where.setdefault(word, []).append(k)

                def ends(k: int, text: str = text, words: list = words, places: list = places) -> bool:
                    return k + 1 == len(words) or words[k + 1] in JOINING or BREAK.search(text, places[k][1], places[k + 1][0]) is not None

                spans = {(-n, b - a, a, b, len(t.words), t.name) for t in likely for a, b, n in t.find(words, where, ends)}
                kept: list[tuple] = []
                for n, _, a, b, size, name in sorted(spans):
                    k = bisect_left(kept, (a,))
                    if (k == len(kept) or b < kept[k][0]) and (k == 0 or kept[k - 1][1] < a):
                        kept.insert(k, (a, b, -n, size, name))
                rows += [(i, name, places[a][0], places[b][1], n, size, n / size) for a, b, n, size, name in kept]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            at = pa.array(columns[0], pa.int64())
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at)] + [pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)],
                names=["vault", "path", "license", "start", "end", "matched", "words", "coverage"],
            )

    return common.keyed(notes).mapInArrow(run, LICENSES)
