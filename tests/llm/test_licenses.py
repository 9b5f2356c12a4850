import functools
import random
import time

import numpy as np
import pyarrow as pa
from llm_rows import labels, no_docs, no_labels, odd_docs, odd_rows, prose, table  # noqa: F401

from seqloom.llm import licenses
from seqloom.llm.textops import slices


def longest_common(a, b):
    @functools.cache
    def best(i, j):
        if i == len(a) or j == len(b):
            return 0
        if a[i] == b[j]:
            return 1 + best(i + 1, j + 1)
        return max(best(i + 1, j), best(i, j + 1))

    return best(0, 0)


def test_wide_band_equals_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(80):
        a = [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
        b = [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
        matched, start, end = licenses.align(np.array(a), np.array(b), 0, 20)
        assert matched == longest_common(tuple(a), tuple(b))
        if matched:
            assert longest_common(tuple(a), tuple(b[start : end + 1])) == matched
            assert b[start] in a and b[end] in a


def test_winnowing_keeps_the_smallest_of_each_window():
    grams = np.array([5, 3, 4, 4, 9, 1, 7], np.uint64)
    text = np.array([0, 0, 0, 0, 0, 1, 2])
    kept = set(licenses._winnowed(grams, text).tolist())
    for t in (0, 1, 2):
        own = np.flatnonzero(text == t)
        for i in range(max(len(own) - licenses.WINDOW + 1, 1)):
            window = own[i : i + licenses.WINDOW]
            assert any(grams[k] == grams[window].min() for k in kept if k in window)


def found(text, templates=None):
    index = licenses.build_index(licenses.TEMPLATES if templates is None else templates)
    part = next(slices(pa.array([text])))
    return [(index.names[m[1]], m[2], text.encode()[m[4] : m[5]].decode())
            for m in licenses._best(licenses._matches(part, index, 0.8))]


def test_changed_words_and_several_notices():
    text = f"{prose(1, 30)}\nRELEASED   under the (MIT) license.\n{prose(2, 30)} This work is licensed under the new GNU General Public License version 3. é"
    assert found(text) == [
        ("MIT", 5, "RELEASED   under the (MIT) license"),
        ("GPL-3.0", 12, "This work is licensed under the new GNU General Public License version 3"),
    ]
    assert found("under the license of my own " + prose(3, 50)) == []
    assert found("a b", {"short": "a b", "none": ""}) == [("short", 2, "a b")]
    assert found("x" + " Released under the MIT License." * 50) == [("MIT", 5, "Released under the MIT License")] * 50


def test_notices_of_the_corpus(spark):
    docs = table(spark, "documents", "0.01")
    got = licenses.scan_licenses(docs).toPandas()
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for name, notices in licenses.TEMPLATES.items():
        for d, t in text.items():
            assert t.count(notices[0]) <= ((got.doc_id == d) & (got.license == name)).sum()
    for r in got.itertuples():
        span = text[r.doc_id][r.start : r.end]
        assert span.split()[0] in {n.split()[0] for n in licenses.TEMPLATES[r.license]} or r.coverage < 1


def test_rows_nobody_likes(odd_docs, no_docs):
    assert licenses.scan_licenses(odd_docs).count() == 0
    assert licenses.scan_licenses(no_docs).count() == 0
    assert licenses.scan_licenses(odd_docs, {}).count() == 0
    odd = odd_docs.selectExpr("doc_id", "concat('é\\n', 'Released under the MIT License.') AS text", "score")
    got = licenses.scan_licenses(odd).toPandas()
    assert len(got) == odd.count()
    assert set(zip(got.start, got.end, strict=True)) == {(2, 32)}


def names(text):
    return [name for name, _, _ in found(text)]


def test_every_wording_bears_its_own_name():
    for name, notices in licenses.TEMPLATES.items():
        for notice in notices:
            assert names(f"{prose(4, 20)}\n{notice}\n{prose(5, 20)}") == [name]


def test_licenses_of_like_wording_are_told_apart():
    body = licenses.TEMPLATES["MIT"][1]
    assert names("Copyright 2020 A. B.\n" + body.replace("AUTHORS OR COPYRIGHT", "OWNERS OR COPYRIGHT")) == ["MIT"]
    assert names("Released under the XYZ License.") == []
    assert names("This work is licensed under the GNU General Public License, version 1.") == []
    assert names("SPDX-License-Identifier: EUPL-3.0") == []
    assert names("Licensed under CC BY-NC-SA 2.0.") == []
    assert names("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 5.0 International License.") == []
    gpl = licenses.TEMPLATES["GPL-3.0"][1].replace("This program", "This library").replace(";", ":")
    assert names(gpl) == ["GPL-3.0"]
    two = licenses.TEMPLATES["BSD-2-Clause"][0].replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in")
    assert names(two) == ["BSD-2-Clause"]


def plainly(text):
    """All notices by aligning every template on every diagonal."""
    index = licenses.build_index(licenses.TEMPLATES)
    part = next(slices(pa.array([text])))
    spans, own, _, _ = licenses._hashed(part)
    best = None
    for t, template in enumerate(index.words):
        for shift in range(-len(template), len(own)):
            matched, start, end = licenses.align(template, own, shift, licenses.BAND)
            if matched < 0.8 * len(template) or matched < 0.8 * (end - start + 1):
                continue
            notice = text.encode()[spans.start[start] : spans.end[end]].decode()
            if licenses.same_license(index.texts[t], licenses._plain(notice)):
                best = max(best or (0, 0, ""), (matched, matched / len(template), index.names[t]))
    return best and best[2]


def test_notices_equal_those_of_all_diagonals():
    rng = random.Random(7)
    short = [(n, t) for n, ts in licenses.TEMPLATES.items() for t in ts if 6 <= len(t.split()) < 16]
    for _ in range(12):
        name, notice = rng.choice(short)
        parts = notice.split()
        parts[rng.randrange(len(parts))] = rng.choice(["new", "the", "2", "lesser"])
        text = f"{prose(8, 6)} {' '.join(parts)} {prose(9, 6)}"
        best = plainly(text)
        assert names(text) == ([best] if best else [])


def test_repeated_beginnings_are_passed_over_quickly():
    start = time.time()
    assert names("licensed under the " * 60_000) == []
    assert time.time() - start < 5
