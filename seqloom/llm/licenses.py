"""License notices in whole texts: winnowed fingerprints, then banded alignment.

Words are runs of letters and digits, in small ASCII letters. A fingerprint is the
hash of ``GRAM`` words in a row; of each ``WINDOW`` consecutive ones the smallest is
kept (winnowing), so any run of GRAM + WINDOW - 1 common words shares one. The
templates' fingerprints are an inverted index; a text's kept fingerprints look
themselves up in it. A hit that no notice found so far covers is a candidate: the
text's words are aligned with the template's inside a band around the hit's diagonal,
which tells how many template words are matched and where the first and the last of
them stand in the text. At least ``COVERAGE`` of the template's words and of the words in
the span must match, and names, version numbers and words such as "Lesser" or
"NonCommercial" must agree, so no notice passes for a license of like wording. A diagonal
is not aligned where fewer of the template's words occur at all.

The index grows with the templates only, which are a parameter, and is sent to the
tasks after its size is checked. Every candidate is aligned; a text may hold any
number of notices.

Defined results: null and empty texts have no notices; a notice of fewer than GRAM
words is found by its whole; of overlapping notices that with more matched words counts,
then more coverage, then the earlier one, then the earlier template; a very long text is
scanned as a whole in one slice of its own; repeated rows are reported once each; an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow, map_texts
from .textops import LOWER, WORD_BYTE, Hasher, Texts, char_offsets, shingles, slices, words

GRAM = 3
WINDOW = 2
BAND = 8
COVERAGE = 0.8
#: Template lengths of text that are looked at together.
STRETCH = 16
MAX_INDEX_BYTES = 64_000_000

# Wording of public licenses, their standard headers and short notices.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, "
    "are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions "
    "and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR "
    "ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE.",
)
_GNU = {
    "GPL-2.0": ("program", "General", "2"),
    "GPL-3.0": ("program", "General", "3"),
    "LGPL-2.0": ("library", "Library General", "2"),
    "LGPL-2.1": ("library", "Lesser General", "2.1"),
    "LGPL-3.0": ("library", "Lesser General", "3"),
    "AGPL-3.0": ("program", "Affero General", "3"),
}
_CC = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_BODIES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License.",
    ),
    # Its first sentence alone does not tell how many clauses follow.
    "BSD": (_BSD[0],),
    "BSD-2-Clause": (" ".join((_BSD[0], _BSD[1], _BSD[3])),),
    "BSD-3-Clause": (" ".join(_BSD),),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
#: Where one of these (or a number) stands in a template, a notice must have it too.
NAMING = frozenset(
    "mit apache gnu general public mozilla boost creative commons attribution cc by isc bsd clause gpl lgpl agpl mpl "
    "bsl unlicense unencumbered".split()
)
#: Words that make another license: a notice has them exactly where its template has.
DECIDING = re.compile(
    r"\b(?:lesser|library general|affero|non ?commercial|share ?alike|no ?deriv\w*|nc|sa|nd|endorse)\b"
)


def _templates() -> dict[str, tuple[str, ...]]:
    out = dict(_BODIES)
    for name, (kind, prefix, version) in _GNU.items():
        out[name] = (
            f"This work is licensed under the GNU {prefix} Public License, version {version}.",
            f"This {kind} is free software; you can redistribute it and/or modify it under the terms of the GNU "
            f"{prefix} Public License as published by the Free Software Foundation; either version {version} of "
            "the License, or (at your option) any later version.",
        )
    for code, title in _CC.items():
        for version, where in (("3.0", "Unported"), ("4.0", "International")):
            out[f"CC-{code}-{version}"] = (
                f"This work is licensed under a Creative Commons {title} {version} {where} License.",
                f"Licensed under CC {code} {version}.",
            )
    plain = [n for n in out if n != "BSD"]
    return {n: (*t, f"SPDX-License-Identifier: {n}") if n in plain else t for n, t in out.items()}


TEMPLATES = _templates()


@dataclass
class Index:
    """Template words and their kept fingerprints, sorted by hash."""

    names: list[str]
    texts: list[str]
    words: list[np.ndarray]
    hash: np.ndarray
    template: np.ndarray
    position: np.ndarray


def _winnowed(grams: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Numbers of the smallest gram of each window of WINDOW grams of one text."""
    n = len(grams)
    if not n:
        return np.empty(0, np.int64)
    kept = np.zeros(n, bool)
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    size = np.diff(np.append(first, n))
    last = np.repeat(first + size, size)  # end of each gram's text
    start = np.arange(n)
    # A text with fewer grams than a window is one window.
    whole = (start + WINDOW <= last) | np.repeat(size < WINDOW, size) & (start == np.repeat(first, size))
    start, last = start[whole], last[whole]
    best = start.copy()
    for k in range(1, WINDOW):
        other = np.minimum(start + k, n - 1)
        best = np.where((start + k < last) & (grams[other] <= grams[best]), other, best)
    kept[best] = True
    return np.flatnonzero(kept)


def _hashed(texts: Texts):
    found = words(texts, WORD_BYTE)
    own = Hasher(LOWER[texts.data])(found.start, found.end) if len(found.start) else np.empty(0, np.uint64)
    grams, text = shingles(own, found.of, GRAM)
    return found, own, grams, text


def build_index(templates: dict[str, str | tuple[str, ...]]) -> Index:
    """Index of all wordings; a license may have several."""
    wordings = [(k, t) for k, v in templates.items() for t in ((v,) if isinstance(v, str) else v) if t]
    names, shown = [k for k, _ in wordings], [_plain(t) for _, t in wordings]
    parts = list(slices(pa.array([t for _, t in wordings], pa.string()), 1 << 62))
    if not parts:
        return Index([], [], [], *(np.empty(0, t) for t in (np.uint64, np.int64, np.int64)))
    found, own, grams, text = _hashed(parts[0])
    first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(names)))])
    kept = _winnowed(grams, text)
    order = np.argsort(grams[kept], kind="stable")
    kept = kept[order]
    index = Index(
        names,
        shown,
        [own[i:j] for i, j in zip(found.of, found.of[1:], strict=False)],
        grams[kept],
        text[kept],
        kept - first[text[kept]],
    )
    size = index.hash.nbytes * 3 + sum(w.nbytes for w in index.words)
    if size > MAX_INDEX_BYTES:
        raise ValueError(f"the templates' index takes {size} bytes, over {MAX_INDEX_BYTES}")
    return index


def _plain(text: str) -> str:
    """Words in small letters, one space apart."""
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def same_license(template: str, notice: str) -> bool:
    """Whether plain texts agree in what tells licenses apart: names, numbers, deciding words."""
    has = set(notice.split())
    needed = {w for w in template.split() if w in NAMING or w.isdigit()}
    marks = [{m.replace(" ", "") for m in DECIDING.findall(t)} for t in (template, notice)]
    return needed <= has and marks[0] == marks[1]


def _possible(words_of: np.ndarray, rest: np.ndarray, low: int, high: int, least: float) -> bool:
    """Whether diagonals low..high may reach ``least`` matches: as many template words occur there."""
    near = rest[max(low - BAND, 0) : max(high + len(words_of) + BAND, 0)]
    return int(np.isin(words_of, near).sum()) >= least


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Longest common subsequence of words with |position in text - in template - shift| <= band.

    Returns matched words, and the first and the last matched word's number in the
    text. Of alignments with as many matches the one that ends first wins, then the
    one that starts last, so a span is no wider than it needs to be.
    """
    width = 2 * band + 1
    # Cells hold (matches, start of the match); start counts negated while none is matched.
    best = [(0, -1)] * (width + 2)
    ends = (0, 0, -1)  # matches, last word's number negated, first word's number
    for i, word in enumerate(template.tolist()):
        row = [(0, -1)] * (width + 2)
        for d in range(width):
            j = i + shift + d - band
            value = max(best[d + 2], row[d])  # skip a template word, or a word of the text
            if 0 <= j < len(text) and int(text[j]) == word:
                matches, start = best[d + 1]
                matched = (matches + 1, start if matches else j)
                value = max(value, matched)
                ends = max(ends, (matched[0], -j, matched[1]))
            row[d + 1] = value
        best = row
    return ends[0], ends[2], -ends[1]


def _matches(texts: Texts, index: Index, coverage: float) -> list[tuple]:
    """(text, template, matched, coverage, start byte, end byte) of every notice found."""
    found, own, grams, text = _hashed(texts)
    kept = _winnowed(grams, text)
    low = np.searchsorted(index.hash, grams[kept], "left")
    high = np.searchsorted(index.hash, grams[kept], "right")
    n = high - low
    if not n.any():
        return []
    gram = np.repeat(kept, n)
    entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])
    owner = text[gram]
    place = gram - first[owner]
    shift = place - index.position[entry]  # the diagonal
    template = index.template[entry]
    order = np.lexsort((place, template, owner))
    owner, template, place, shift = (x[order] for x in (owner, template, place, shift))
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (template[1:] != template[:-1])])
    out = []
    begins = np.flatnonzero(new)
    for a, b in zip(begins, np.append(begins[1:], len(new)), strict=True):
        i, t = int(owner[a]), int(template[a])
        base = found.of[i]
        rest = own[base : found.of[i + 1]].copy()
        words_of = index.words[t]
        least = coverage * len(words_of)
        done = -1  # hits up to here belong to notices that are found
        failed: set[int] = set()  # diagonals; words are only ever taken away
        hits, diagonals = place[a:b], shift[a:b]
        # Stretches of text that lack the template's words are passed over as a whole.
        stretch = hits // (STRETCH * len(words_of))
        cuts = np.flatnonzero(np.concatenate([[True], stretch[1:] != stretch[:-1]]))
        for c, d in zip(cuts, np.append(cuts[1:], len(hits)), strict=True):
            if not _possible(words_of, rest, int(diagonals[c:d].min()), int(diagonals[c:d].max()), least):
                continue
            for at, diagonal in zip(hits[c:d].tolist(), diagonals[c:d].tolist(), strict=True):
                while at > done and diagonal not in failed:
                    matched = 0
                    if _possible(words_of, rest, diagonal, diagonal, least):
                        matched, start, end = align(words_of, rest, diagonal, BAND)
                    if matched < least or matched < coverage * (end - start + 1):
                        failed.add(diagonal)
                        break
                    span = int(found.start[base + start]), int(found.end[base + end])
                    notice = bytes(texts.data[span[0] : span[1]]).decode(errors="replace")
                    if not same_license(index.texts[t], _plain(notice)):
                        failed.add(diagonal)
                        break
                    out.append((i, t, matched, matched / len(words_of), *span))
                    rest[start : end + 1] = 0  # no word's hash: a word is part of one notice
                    if start <= at:
                        done = max(done, end)
    return out


def _best(matches: list[tuple]) -> list[tuple]:
    """Of notices of one text that overlap, the one with more matched words, then more coverage."""
    kept: list[tuple] = []
    taken: dict[int, list[tuple[int, int]]] = {}
    for m in sorted(matches, key=lambda m: (m[0], -m[2], -m[3], m[4], m[1])):
        spans = taken.setdefault(m[0], [])
        if all(m[5] <= s or m[4] >= e for s, e in spans):
            spans.append((m[4], m[5]))
            kept.append(m)
    return sorted(kept, key=lambda m: (m[0], m[4]))


SCHEMA = "doc_id long, license string, matched int, coverage double, start int, end int"


def scan_licenses(
    docs: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None, coverage: float = COVERAGE
) -> DataFrame:
    """One row per notice: doc_id, license, matched words, coverage, code point span."""
    index = build_index(TEMPLATES if templates is None else templates)

    def run(texts: Texts, rows: pa.RecordBatch) -> pa.RecordBatch:
        found = _best(_matches(texts, index, coverage))
        at = []
        for m in found:
            first = texts.starts[m[0]]
            data = texts.data[first : texts.starts[m[0] + 1]]
            at.append(char_offsets(data, np.array([m[4] - first, m[5] - first])))
        return arrow(
            ["doc_id", "license", "matched", "coverage", "start", "end"],
            [
                rows.column("doc_id").take(pa.array([m[0] for m in found], pa.int64())),
                pa.array([index.names[m[1]] for m in found], pa.string()),
                pa.array([m[2] for m in found], pa.int32()),
                pa.array([m[3] for m in found], pa.float64()),
                pa.array([int(a[0]) for a in at], pa.int32()),
                pa.array([int(a[1]) for a in at], pa.int32()),
            ],
        )

    return map_texts(docs.select("doc_id", "text"), run, SCHEMA)
