import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import labels, no_docs, no_labels, odd_docs, odd_rows, prose, table  # noqa: F401

from seqloom.llm import toxicity
from seqloom.llm.queries import QUERIES
from seqloom.llm.textops import slices


def one(texts):
    return next(slices(pa.array(texts, pa.string()), 1 << 62))


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(0)
    model = toxicity.Field(np.zeros(1), rng.normal(size=(2, 2)), 0.3, np.zeros(4))
    model.trans[0, 0] = 0.0
    n = 6
    emit = np.zeros((toxicity.CHAIN, 1))
    emit[:n, 0] = rng.normal(size=n)
    chance, ahead, behind, e = toxicity.forward_backward(emit, np.array([n]), model)
    weight, marginal, moves = 0.0, np.zeros(n), np.zeros((2, 2))
    for path in itertools.product((0, 1), repeat=n):
        w = np.exp(
            path[0] * model.start
            + sum(emit[t, 0] * s for t, s in enumerate(path))
            + sum(model.trans[a, b] for a, b in itertools.pairwise(path))
        )
        weight += w
        marginal += w * np.array(path)
        for a, b in itertools.pairwise(path):
            moves[a, b] += w
    assert np.allclose(chance[:n, 0], marginal / weight)
    got = toxicity._expected_transitions(ahead, behind, e, np.array([n]), model.trans)
    assert np.allclose(got, moves / weight)


def test_learns_words_and_beginnings_and_reports_their_spans():
    clean = [prose(i, 40) for i in range(60)]
    bad = [prose(100 + i, 15) + f" grumbo{x} " + prose(200 + i, 15) for i, x in enumerate("abcdefghij" * 3)]
    label = np.array([0] * 60 + [1] * 30)
    model = toxicity.fit_field([one(clean), one(bad)], label)
    texts = one(["é the grumboz " + prose(7, 9), prose(8, 12), "", None])
    score, found, p = toxicity.score(texts, model)
    assert score[0] > 0.5 > score[1]
    assert score[2] == score[3] < 0.5
    assert [(s["start"], s["end"]) for s in toxicity.spans(texts, found, p)[0]] == [(6, 13)]


def test_rows_nobody_likes(odd_docs, no_docs, labels, no_labels):
    model = toxicity.train(odd_docs, labels)
    got = toxicity.score_toxicity(odd_docs, model).toPandas()
    assert len(got) == odd_docs.count()
    assert got["score"].between(0, 1).all()
    assert got[got.doc_id == 5]["score"].nunique() == 1
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    assert toxicity.reject_toxic(no_docs, model).columns == no_docs.columns
    blank = toxicity.train(no_docs, no_labels)
    assert toxicity.score_toxicity(odd_docs, blank).toPandas()["score"].max() < 0.01
    kept = toxicity.reject_toxic(odd_docs, blank)
    assert kept.schema == odd_docs.schema
    assert kept.count() == odd_docs.count()


@pytest.mark.parametrize("sf", ["0.01"])
def test_held_out_accuracy(spark, sf):
    got = QUERIES["op5_toxicity"](spark, f"/root/testdata/sf{sf}").toPandas()
    known = got[got.held_out].merge(table(spark, "labels", sf).toPandas(), on="doc_id")
    assert len(got) == table(spark, "documents", sf).count()
    right = (known.predicted == known.toxic).mean()
    assert right > 0.9


def test_copies_dilute_no_threshold():
    """A large group of toxic copies hides no word that few distinct toxic texts have."""
    clean = [prose(i, 40) for i in range(60)]
    common = prose(99, 40).split()
    copies = [" ".join([*common[:i], "x" + prose(900 + i, 1), *common[i + 1 :]]) for i in range(40)] * 15
    bad = [prose(100 + i, 15) + " grumbo " + prose(200 + i, 15) for i in range(8)]
    bad += [prose(300 + i, 15) + " zundel " + prose(400 + i, 15) for i in range(22)]
    texts = [*clean, *copies, *bad]
    label = np.array([0] * 60 + [1] * (len(copies) + len(bad)))
    model = toxicity.fit_field([one(texts)], label)
    score = toxicity.score(one(["the grumbo " + prose(7, 20), prose(8, 20)]), model)[0]
    assert score[0] > 0.5 > score[1]


def test_a_shared_passage_is_no_copy():
    """Texts with one long passage in common and different rests all count."""
    passage = prose(50, 20)
    texts = [f"{passage} {prose(i, 20)}" for i in range(30)] + [f"{passage} {prose(3, 20)}", prose(60, 30)]
    found, feats = toxicity.features(one(texts))
    own = toxicity.Hasher(toxicity.LOWER[one(texts).data])(found.start, found.end)
    assert np.flatnonzero(~toxicity._first_copies(found, own)).tolist() == [30]


def test_fit_holds_little_beside_its_features():
    """The field is fitted in the driver: memory beside the JVM counts. Parts do not matter."""
    rng = np.random.default_rng(8)
    vocabulary = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(5000)])
    label = np.arange(1500) % 2
    texts = pa.array([" ".join(rng.choice(vocabulary, 400)) + (" vile scum rot" if y else "") for y in label])
    toxicity.fit_field(list(slices(texts.slice(0, 40))), label[:40])  # caches
    tracemalloc.start()
    small = toxicity.fit_field(list(slices(texts, toxicity.SAMPLE_BYTES)), label, least_steps=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 13 * texts.nbytes
    whole = toxicity.fit_field(list(slices(texts, 1 << 30)), label, least_steps=1)
    assert (small.weights == whole.weights).all() and (small.doc == whole.doc).all()
