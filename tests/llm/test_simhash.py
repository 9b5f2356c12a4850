import random
import re

import numpy as np
import pytest
import xxhash
from llm_rows import no_docs, odd_docs, odd_rows, prose, row, SCHEMA, table  # noqa: F401
from pyspark.sql import functions as F

from seqloom.llm import simhash
from seqloom.llm.neardup import components


def brute_fingerprint(text):
    text = (text or "").translate({i: i + 32 for i in range(65, 91)})
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(found[i : i + 4]) for i in range(len(found) - 3)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values, budget=4):
    """Smallest value reachable, by comparing all pairs."""
    values = sorted(values)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= budget:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {v: find(v) for v in values}


def crowded(seed, centres, each, most=6):
    """Fingerprints around a few centres, and as many anywhere."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(centres * each)}
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(each):
            flips = rng.sample(range(64), rng.randint(0, most))
            out.add(centre ^ sum(1 << k for k in flips))
    return sorted(out | {0, 1, (1 << 64) - 1, 15, 31})


def test_xxh64_equals_the_library():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 20_000).astype(np.uint8)
    length = np.concatenate([np.arange(0, 140), rng.integers(900, 1200, 40)])
    start = rng.integers(0, len(data) - 1200, len(length))
    got = simhash.xxh64(data, start, length)
    assert [int(h) for h in got] == [
        xxhash.xxh64_intdigest(data[s : s + n].tobytes(), 42) for s, n in zip(start, length, strict=True)
    ]


@pytest.mark.parametrize("run", [5, 1 << 17])
def test_fingerprints_equal_brute_force(spark, odd_docs, odd_rows, monkeypatch, run):
    monkeypatch.setattr(simhash, "RUN", run)
    extra = [row(20 + i, t) for i, t in enumerate(["A", "A b", "a B c D", "É é X", "x" * 3000 + " y z w v", "a a a a a a"])]
    docs = spark.createDataFrame(extra, SCHEMA)
    got = simhash.classes(odd_docs.unionByName(docs)).select("doc_id", "fingerprint").collect()
    want = [(r[0], f"{brute_fingerprint(r[1]):016x}") for r in odd_rows + extra]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("leaf", [16, 4096])
def test_links_join_what_all_pairs_join(spark, leaf):
    values = crowded(leaf, 5, 60)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    keys = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    roots = components(simhash.links(keys, leaf=leaf))
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in roots.collect()}
    want = brute_roots(values)
    groups = {}
    for v in values:
        groups.setdefault(got.get(v, v), set()).add(v)
    expected = {}
    for v in values:
        expected.setdefault(want[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_links_are_a_forest_of_each_leaf_pair(spark):
    """One crowd of mutually near fingerprints does not hand on its pairs."""
    values = [(1 << i) | (1 << j) for i in range(40) for j in range(i)]
    keys = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    assert simhash.links(keys).count() < simhash.TURNS * len(values)


def test_classes_of_whole_documents_equal_brute_force(spark):
    docs = table(spark, "documents", "0.001")
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    roots = brute_roots({f for _, f in rows})
    least = {}
    for doc_id, f in rows:
        least[roots[f]] = min(doc_id, least.get(roots[f], doc_id))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.classes(docs).collect()}
    assert got == {d: (f"{f:016x}", least[roots[f]]) for d, f in rows}


def test_odd_rows(spark, odd_docs, no_docs):
    got = simhash.classes(odd_docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].fingerprint == rows[2].fingerprint == rows[10].fingerprint == "0" * 16
    assert rows[2].component_id == rows[10].component_id == 1
    assert rows[6].component_id == 5 and got.where("doc_id = 5").count() == 2
    assert rows[None].component_id is None
    assert simhash.classes(no_docs).count() == 0


def test_rows_without_id_join_classes(spark):
    text = prose(9, 50)
    docs = spark.createDataFrame([row(None, text), row(8, text), row(3, text + " more")], SCHEMA)
    got = simhash.classes(docs)
    near = bin(brute_fingerprint(text) ^ brute_fingerprint(text + " more")).count("1") <= 4
    assert {r.component_id for r in got.where(F.col("doc_id").isNull()).collect()} == {3 if near else 8}
