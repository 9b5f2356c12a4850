import math

import numpy as np
import pytest
from llm_rows import table

from seqloom.llm import neighbours
from seqloom.llm.queries import QUERIES


def brute_force(rows, asks, nearest):
    """Exact nearest ids of each query, ties to the smaller id."""
    good = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = np.array(v, float)
    ids = np.array(sorted(good))
    m = np.stack([good[i] for i in ids])
    out = {}
    for i in ids[[bool(asks(i)) for i in ids]]:
        score = m @ good[i]
        order = np.lexsort((ids, -score))
        out[int(i)] = [(int(ids[k]), float(score[k])) for k in order if ids[k] != i][:nearest]
    return out


def ranked(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        own = out.setdefault(r["query_id"], [])
        own.append((r["vec_id"], r["score"]))
        assert r["rank"] == len(own)
    return out


def test_odd_vectors_ties_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0, 0.5, 0.0, 0.0]) for i in range(100)]  # a large group of equal vectors
    rows += [(2000, None), (2001, []), (2002, [0.0] * 4), (2003, [None, 1.0, 1.0, 1.0]),
             (2004, [float("nan")] * 4), (2005, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), rows[0]]
    rows += [(3000, [9.0, 9.0, 9.0, 9.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = ranked(neighbours.nearest_neighbours(frame, frame["vec_id"] % 20 == 0, 20))
    want = brute_force(rows, lambda i: i % 20 == 0, 20)
    assert {q: [v for v, _ in x] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}
    for q, own in want.items():
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in own], abs=1e-12)


def test_few_and_no_rows(spark):
    two = spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = neighbours.nearest_neighbours(two, two["vec_id"] == 20).collect()
    assert [tuple(r) for r in got] == [(20, 1, 21, 0.5)]
    none = two.where("vec_id < 0")
    assert neighbours.nearest_neighbours(none, none["vec_id"] == 20).count() == 0
    alone = two.where("vec_id = 20")
    assert neighbours.nearest_neighbours(alone, alone["vec_id"] == 20).count() == 0


def test_candidates_share_the_longest_prefixes():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3000, 8))
    forest = neighbours.Forest(vectors, float(np.linalg.norm(vectors, axis=1).max()), trees=6)
    queries = rng.normal(size=(5, 8))
    lack = np.sqrt(np.maximum(forest._longest**2 - (vectors**2).sum(1), 0))
    keys = forest._strings(np.column_stack([vectors, lack]))
    asked = forest._strings(np.column_stack([queries, np.zeros(5)]))
    for q, found in enumerate(forest.candidates(queries, 200)):
        for depth in range(neighbours.BITS, -1, -1):
            same = (keys >> (neighbours.BITS - depth)) == (asked[:, q : q + 1] >> (neighbours.BITS - depth))
            if same.sum() >= 200:
                break
        assert found.tolist() == np.flatnonzero(same.any(0)).tolist()


def test_recall_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 700)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 40)
    monkeypatch.setattr(neighbours, "LEAST", 400)
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, "embeddings", "0.1").collect()]
    got = ranked(QUERIES["op3_nearest_neighbours"](spark, "/root/testdata/sf0.1"))
    want = brute_force(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
