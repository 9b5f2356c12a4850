import collections

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import SCHEMA, labels, no_docs, no_labels, odd_docs, odd_rows, prose, row, table  # noqa: F401

from seqloom.llm import neardup
from seqloom.llm.textops import slices


def bags(text):
    w = (text or "").split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def exact(a, b):
    """Probability Jaccard by its definition."""
    total = 0.0
    for i in a.keys() & b.keys():
        total += 1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys())
    return total


def near(a, b):
    plain = len(a.keys() & b.keys()) / max(len(a.keys() | b.keys()), 1)
    return plain >= 0.8 or exact(a, b) >= 0.8


def brute_force(docs):
    """class_id of each document from all pairs; equal texts share a class."""
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = [bags(t) for _, t in docs]
    for i in range(len(docs)):
        for j in range(i):
            if (docs[i][1] or "") == (docs[j][1] or "") or held[i] and near(held[i], held[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return {(d, t): least[find(i)] for i, (d, t) in enumerate(docs)}


def arrays(text):
    return neardup._by_text(next(slices(pa.array([text], pa.string()), 1 << 62)))[0]


def test_probability_jaccard_equals_its_definition():
    a, b = "a b c d e f a b c d e f g h", "a b c d e f g h i a b c d e"
    for x, y in ((a, b), (a, a), (a, "z"), ("one", "one")):
        assert neardup.probability_jaccard(arrays(x), arrays(y)) == pytest.approx(exact(bags(x), bags(y)))


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(0)
    base = prose(3, 400).split()
    texts = []
    for _ in range(60):
        own = list(base)
        for at in rng.integers(0, 400, 12):
            own[at] = f"w{rng.integers(1 << 40)}"
        texts.append(" ".join(own))
    part = next(slices(pa.array([" ".join(base), *texts]), 1 << 62))
    found = neardup.registers(*neardup.weighted_shingles(part), len(part))
    want = [exact(bags(" ".join(base)), bags(t)) for t in texts]
    got = (found[0] == found[1:]).mean(1)
    assert np.abs(got - want).mean() < 0.04
    assert abs(got.mean() - np.mean(want)) < 0.015


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    docs, number = [], 0
    for group in range(12):
        base = prose(100 + group, 120).split()
        for _ in range(14):
            own = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 4)):
                own[at] = f"w{rng.integers(1 << 40)}"
            docs.append((number, " ".join(own)))
            number += 1
    docs += [(number + i, t) for i, t in enumerate(["", "", None, "a b", "a b", "a c", "x"])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute_force(docs)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(frame).collect()}
    wrong = {d for (d, _), c in want.items() if got[d] != c}
    assert not wrong


def test_a_class_that_no_single_document_is_near_to(spark):
    """A chain of copies, each near the next only, is one class."""
    words = prose(9, 200).split()
    docs = []
    for i in range(30):
        docs.append((i, " ".join(words)))
        for k in range(4):
            words[(i * 4 + k) % 200] = f"new{i}x{k}"
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_force(docs)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(frame).collect()}
    assert got == {d: c for (d, _), c in want.items()}


def test_rows_nobody_likes(odd_docs, odd_rows, no_docs):
    got = neardup.classes(odd_docs).toPandas()
    assert len(got) == len(odd_rows)
    of = got.dropna(subset=["doc_id"]).groupby("doc_id").class_id.agg(set).to_dict()
    assert of[5] == {5} == of[6]
    assert of[1] == of[2] == of[10] == {1}
    kept = neardup.first_of_each_class(odd_docs)
    assert kept.schema == odd_docs.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 7, 8, 9]
    assert ids.count(None) == 1
    assert neardup.classes(no_docs).count() == 0
    assert neardup.first_of_each_class(no_docs).count() == 0


def test_large_group_of_copies(spark):
    base = prose(11, 100).split()
    rows = []
    for i in range(400):
        own = list(base)
        if i % 2:
            own[i % 100] = f"other{i}"
        rows.append(row(i, " ".join(own)))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert neardup.first_of_each_class(frame).count() == 1


def test_clean_documents_stay(spark):
    docs = table(spark, "documents")
    found = neardup.classes(docs).toPandas().merge(docs.toPandas(), on="doc_id")
    want = brute_force(list(zip(found.doc_id, found.text, strict=True)))
    assert {(d, t): c for d, t, c in zip(found.doc_id, found.text, found.class_id, strict=True)} == want


def test_sketch_does_not_depend_on_the_slice():
    texts = [prose(i, 50) for i in range(40)]
    whole = next(slices(pa.array(texts)))
    together = neardup.registers(*neardup.weighted_shingles(whole), 40)
    for i, part in enumerate(slices(pa.array(texts), 1)):
        assert (neardup.registers(*neardup.weighted_shingles(part), 1)[0] == together[i]).all()


def test_links_do_not_depend_on_pivots(spark, monkeypatch):
    """What no pivot links is still compared, in blocks of any size."""
    monkeypatch.setattr(neardup, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    test_classes_equal_brute_force(spark)


def test_a_block_is_verified_like_single_pairs():
    texts = ["a b c d e f g h i j " * n + f"k l m n o{n}" for n in (1, 2, 3, 9)] + [prose(1, 9), "a", "a b"]
    held = [arrays(t) for t in texts]
    for mine in held:
        for threshold in (0.3, 0.8):
            want = [max(neardup.probability_jaccard(mine, o), neardup.jaccard(mine[0], o[0])) >= threshold for o in held]
            assert neardup._near(mine, held, threshold).tolist() == want


def test_repeated_passages_by_plain_jaccard(spark):
    """Near by shingle sets, far by how often the shingles occur."""
    docs = []
    for i in range(12):
        x, y = prose(500 + i, 100), prose(600 + i, 100)
        docs += [(2 * i, f"{x} {y}"), (2 * i + 1, " ".join([x, *[y] * 20]))]
    a, b = arrays(docs[0][1]), arrays(docs[1][1])
    assert neardup.probability_jaccard(a, b) < 0.65 < 0.8 < neardup.jaccard(a[0], b[0])
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(frame).collect()}
    assert got == {d: d - d % 2 for d, _ in docs}


def test_null_and_equal_ids_with_different_texts(spark):
    """One row of every class, whatever the ids; near copies without an id are still found."""
    near = prose(21, 100)
    rows = [row(None, prose(i, 60)) for i in range(22, 27)]
    rows += [row(None, near), row(None, near + " end"), row(None, near)]
    rows += [row(7, prose(i, 60)) for i in range(27, 30)] + [row(7, prose(27, 60))]
    rows += [row(None, prose(30, 100)), row(8, prose(30, 100) + " end")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [(r["doc_id"], r["text"]) for r in neardup.first_of_each_class(frame).collect()]
    single = [(None, prose(i, 60)) for i in range(22, 27)] + [(7, prose(i, 60)) for i in range(27, 30)]
    assert sorted(x[1] for x in got if x in single) == sorted(x[1] for x in single)
    rest = [x for x in got if x not in single]
    assert len(rest) == 2
    assert (8, prose(30, 100) + " end") in rest
    assert {x for x in rest if x[0] is None} <= {(None, near), (None, near + " end")}
    held = neardup.classes(frame).collect()
    assert len(held) == len(rows)
    assert {r["class_id"] for r in held if r["doc_id"] == 7} == {7}
