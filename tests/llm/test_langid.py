import itertools

import numpy as np
import pyarrow as pa
from llm_rows import labels, no_docs, no_labels, odd_docs, odd_rows, table  # noqa: F401

from seqloom.llm import langid
from seqloom.llm.queries import QUERIES
from seqloom.llm.textops import slices


def test_ngrams_equal_counting_them_and_ignore_neighbours():
    texts = ["Ab, éa 12!", "", "xyz" * 9, None, "Ab, éa 12!"]
    got = np.concatenate([langid.ngrams(s) for s in slices(pa.array(texts, pa.string()), 4)])
    whole = langid.ngrams(next(slices(pa.array(texts, pa.string()))))
    assert np.allclose(got, whole)
    assert np.allclose(got[0], got[4])
    assert np.allclose((got**2).sum(1), [1, 0, 1, 0, 1])
    # The same n-grams in any order of texts: each distinct one is one number.
    raw = "ab  éa    ".encode()
    grams = [raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)]
    assert (got[0] > 0).sum() <= len(set(grams))
    assert (got[0] > 0).sum() >= len(set(grams)) - 2


def test_codewords_are_apart():
    for k in (1, 2, 4, 7, 12, 40):
        code = langid.codewords(k)
        assert code.shape[0] == k
        near = [(a != b).sum() for a, b in itertools.combinations(code, 2)]
        assert k == 1 or min(near) >= max(1, code.shape[1] // 5)


def test_decoding_by_definition():
    rng = np.random.default_rng(2)
    model = langid.Codes(["a", "b", "c"], langid.codewords(3), rng.normal(size=(8, 3)), rng.normal(size=3))
    x = rng.normal(size=(20, 8))
    best, share = langid.decode(x, model)
    for i, r in enumerate(x):
        margin = r @ model.weights + model.bias
        loss = [sum(np.log1p(np.exp(-m * c)) for m, c in zip(margin, word, strict=True)) for word in model.words]
        assert best[i] == int(np.argmin(loss))
        assert np.isclose(share[i], np.exp(-min(loss)) / np.exp(-np.array(loss)).sum())


def test_rows_nobody_likes(odd_docs, odd_rows, no_docs):
    model = langid.train(odd_docs)
    assert model.languages == ["en", "fr", "xx"]
    got = langid.identify(odd_docs, model).toPandas()
    assert len(got) == len(odd_rows)
    assert got.score.between(0, 1).all()
    for d in (1, 2, 3, 8, 10):
        assert got[got.doc_id == d].lang_pred.tolist() == ["und"]
    assert langid.identify(no_docs, model).count() == 0
    none = langid.identify(odd_docs, langid.train(no_docs)).toPandas()
    assert set(none.lang_pred) == {"und"}
    one = langid.identify(odd_docs, langid.train(odd_docs.where("lang = 'fr'"))).toPandas()
    assert one[one.doc_id == 7].lang_pred.tolist() == ["fr"]


def test_held_out_accuracy(spark):
    got = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    known = got[got.held_out].merge(table(spark, "documents", "0.01").toPandas(), on="doc_id")
    assert (known.lang_pred == known.lang).mean() > 0.98
