import numpy as np
import pyarrow as pa
from llm_rows import labels, no_docs, no_labels, odd_docs, odd_rows, table  # noqa: F401

from seqloom.llm import quality
from seqloom.llm.queries import QUERIES
from seqloom.llm.textops import slices


def stats(texts, size=1 << 62):
    return np.concatenate([quality.statistics(s) for s in slices(pa.array(texts, pa.string()), size)])


def test_statistics_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["A b.\nA b.\n", "x" * 50, "", None, "ONE two two two! ### é", "a b c d a b c d"]
    assert np.allclose(stats(texts), stats(texts, 1))
    named = dict(zip(quality.STATISTICS, stats(texts)[4], strict=True))
    assert named["distinct_words"] == 5 / 6
    assert named["top_word"] == 2 / 6
    assert named["upper_words"] == 1 / 6
    assert dict(zip(quality.STATISTICS, stats(texts)[0], strict=True))["repeated_lines"] == 0.5
    assert (stats(texts)[2] == 0).all() and (stats(texts)[3] == 0).all()


def test_flat_traversal_equals_walking_each_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.fit_forest(x, y, trees=25)
    total = np.full(len(x), model.base)
    for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
        for i, r in enumerate(x):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if r[feature[node]] > cut[node] else 1)
            total[i] += leaf[node - len(feature)]
    assert np.allclose(model(x), 1 / (1 + np.exp(-total)))
    assert ((model(x) > 0.5) == (y == 1)).mean() > 0.97


def test_one_class_or_none():
    x = np.zeros((3, 2))
    assert np.allclose(quality.fit_forest(x, np.ones(3))(x), 1, atol=1e-5)
    assert np.allclose(quality.fit_forest(x[:0], np.ones(0))(x), 0.5)


def test_rows_nobody_likes(odd_docs, no_docs, labels, no_labels):
    model = quality.train(odd_docs, labels)
    got = quality.score_quality(odd_docs, model).toPandas()
    assert len(got) == odd_docs.count()
    assert got["score"].between(0, 1).all()
    assert quality.score_quality(no_docs, model).count() == 0
    kept = quality.keep_good(odd_docs, model, 0.0)
    assert kept.schema == odd_docs.schema and kept.count() == odd_docs.count()
    assert quality.keep_good(no_docs, quality.train(no_docs, no_labels)).count() == 0


def test_held_out_accuracy(spark):
    got = QUERIES["op4_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    known = got[got.held_out].merge(table(spark, "labels", "0.01").toPandas(), on="doc_id")
    assert len(got) == table(spark, "documents", "0.01").count()
    assert (known.predicted == known.quality).mean() > 0.97
