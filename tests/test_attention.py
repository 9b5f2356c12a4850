import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.catalog import views as v
from seqloom.functions import arrays
from seqloom.functions.constants import POOL_MODES, ZSCALE
from seqloom.operators import attention, residues


def plain_scores(seq, m, mode):
    """One sequence, one fold, written out position by position."""
    x = np.array([ZSCALE[a] for a in seq])
    k, half = m.feature_weight.shape[0], m.feature_weight.shape[0] // 2

    def conv(w, b):
        out = np.zeros((len(x), w.shape[2]))
        for p in range(len(x)):
            out[p] = b
            for t in range(k):
                if 0 <= p + t - half < len(x):
                    out[p] += x[p + t - half] @ w[t]
        return out

    f = conv(m.feature_weight, m.feature_bias)
    a = conv(m.attention_weight, m.attention_bias)
    soft = np.exp(a - a.max(axis=0)) / np.exp(a - a.max(axis=0)).sum(axis=0)
    z = f if mode.endswith("single_conv") else f * soft
    for i, layer in enumerate(m.head):
        z = z @ layer["weight"] + layer["bias"]
        if i < len(m.head) - 1:
            z = np.maximum(z, 0)
            if "gain" in layer:
                z = z * layer["gain"] + layer["offset"]
    o = z.mean(axis=1)
    p = 1 / (1 + np.exp(-o))
    sm = lambda u: np.exp(u - u.max()) / np.exp(u - u.max()).sum()
    if mode == "max":
        return p, p.max()
    if mode in ("mean", "mean_single_conv"):
        return p, p.mean()
    if mode == "sum":
        return o, 1 / (1 + np.exp(-o.sum()))
    if mode in ("weighted_mean", "weighted_mean_single_conv"):
        return p, (p * sm(p)).sum()
    if mode == "weighted_mean_two":
        return o, min((p * sm(o)).sum(), 1.0)
    return p, min((p * sm(o / max(m.temperature, 0.01))).sum(), 1.0)


SEQS = ["K", "AC", "ACDEFGHIKLMNPQRSTVWY" * 3, "WWWWW", "GAVLI"]


@pytest.fixture
def seqs(spark):
    rows = list(enumerate(SEQS)) + [(99, "")]
    return spark.createDataFrame(rows, "seq_id long, sequence string")


@pytest.mark.parametrize("mode", POOL_MODES)
@pytest.mark.parametrize("kernel", [1, 7])
def test_scores_match_plain_arithmetic(seqs, mode, kernel):
    models = v.fold_models(kernel=kernel, folds=2)
    rows = attention.score_folds(seqs, models, mode).collect()
    for r in rows:
        if not r["sequence"]:
            assert r["fold_scores"]["fold1"] is None and r["fold_residues"]["fold1"] == []
            continue
        means = []
        for m in models:
            residue, score = plain_scores(r["sequence"], m, mode)
            assert r["fold_residues"][m.fold] == pytest.approx(residue)
            assert r["fold_scores"][m.fold] == pytest.approx(score)
            means.append(score)
        assert r["ensemble_score"] == pytest.approx(np.mean(means))


@pytest.mark.parametrize("mode", POOL_MODES)
def test_pool_columns_match_kernel(seqs, mode):
    m = v.fold_models(folds=1)[0]
    rows = attention.residue_conv1d(seqs.where("sequence <> ''"), m)
    rows = attention.mlp_head(attention.attention_apply(rows, mode), m.head)
    pooled = rows.select(
        "seq_id",
        arrays.pool_scores(mode, F.col("logits"), m.temperature).alias("score"),
        arrays.residue_scores(mode, F.col("logits")).alias("res"),
    ).collect()
    for r in pooled:
        residue, score = plain_scores(SEQS[r["seq_id"]], m, mode)
        assert r["score"] == pytest.approx(score)
        assert r["res"] == pytest.approx(residue)


def test_embedding_input_equals_letters(seqs):
    models = v.fold_models()
    letters = attention.score_folds(seqs, models, "weighted_mean_three")
    vectors = seqs.withColumn("embedding", residues.encoded_array(F.col("sequence"), "zscale"))
    dense = attention.score_folds(vectors.drop("sequence"), models, "weighted_mean_three", "embedding")
    a = {r["seq_id"]: r["ensemble_score"] for r in letters.collect()}
    b = {r["seq_id"]: r["ensemble_score"] for r in dense.collect()}
    assert a == pytest.approx(b)


def test_scores_without_residues(seqs):
    models = v.fold_models()
    full = attention.score_folds(seqs, models, "weighted_mean_three")
    slim = attention.score_folds(seqs, models, "weighted_mean_three", with_residues=False)
    assert slim.columns == [c for c in full.columns if "residues" not in c]
    assert sorted(map(str, slim.collect())) == sorted(map(str, full.select(*slim.columns).collect()))


def test_partitioning_does_not_matter(seqs):
    models = v.fold_models()
    one = attention.score_folds(seqs.coalesce(1), models, "max").select("seq_id", "fold_scores")
    many = attention.score_folds(seqs.repartition(7), models, "max").select("seq_id", "fold_scores")
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_weights_table_round_trip(spark, seqs):
    models = v.fold_models()
    back = attention.models_from_table(attention.models_to_table(spark, models, "m"), "m")
    for a, b in zip(models, back):
        assert a.fold == b.fold and a.temperature == b.temperature and a.cutoff == b.cutoff
        assert np.array_equal(a.feature_weight, b.feature_weight)
        assert np.array_equal(a.attention_bias, b.attention_bias)
        assert all(np.array_equal(x["weight"], y["weight"]) for x, y in zip(a.head, b.head))
        assert np.array_equal(a.head[0]["gain"], b.head[0]["gain"])


def test_bad_inputs(seqs):
    with pytest.raises(ValueError, match="even"):
        v.fold_models(kernel=4)
    with pytest.raises(ValueError, match="pooling"):
        attention.score_folds(seqs, v.fold_models(), "median")


def test_cutoff_zero_is_valid_and_equal_passes(spark):
    long = spark.createDataFrame([("a", 0.0), ("b", 0.42), ("b", 0.41)], "fold string, seq_score double")
    rows = attention.apply_cutoff(long, {"a": 0.0, "b": 0.42}).collect()
    assert [r["y_pred"] for r in rows] == [1, 1, 0]


def test_batch_norm_folding():
    mean, var, w, b = (np.array([x]) for x in (2.0, 4.0, 3.0, 0.5))
    folded = attention.fold_batch_norm(mean, var, w, b, eps=0.0)
    assert 5.0 * folded["gain"] + folded["offset"] == pytest.approx((5.0 - 2.0) / 2.0 * 3.0 + 0.5)


def test_softmax_adds_up(spark):
    df = spark.createDataFrame([([1.0, 1000.0, -3.0],)], "a array<double>")
    row = df.select(arrays.softmax(F.col("a"), 2.0).alias("s")).first()
    assert sum(row["s"]) == pytest.approx(1.0)


def test_summary_positions(spark):
    df = spark.createDataFrame([([0.6, 0.5, 0.9],)], "a array<double>")
    row = df.select(attention.summary_column(F.col("a")).alias("s"), attention.summary_column(F.col("a"), base=1).alias("t")).first()
    assert row["s"]["high_risk_positions"] == [0, 2] and row["t"]["high_risk_positions"] == [1, 3]
    assert row["s"]["max"] == 0.9 and row["s"]["min"] == 0.5


LONG_SEQS = ["ACDEFGHIKLMNPQRSTVWY" * 30, "WYVTSRQPNMLKIHGFEDCA" * 11 + "K"]


@pytest.mark.parametrize("kernel", [1, 3, 5])
@pytest.mark.parametrize("scale", [1.0, 400.0])
def test_long_sequences_and_wide_logits(spark, kernel, scale):
    """Attended one by one; attention logits that no product of exponentials could hold."""
    models = v.fold_models(kernel=kernel, channels=3, hidden=(6, 4), folds=2, outputs=2)
    for m in models:
        m.attention_weight = m.attention_weight * scale
    df = spark.createDataFrame(list(enumerate(LONG_SEQS)), "seq_id long, sequence string")
    for mode in ("weighted_mean_three", "weighted_mean_single_conv"):
        for row in attention.score_folds(df.coalesce(1), models, mode).collect():
            for m in models:
                want, score = plain_scores(row["sequence"], m, mode)
                assert np.allclose(row["fold_residues"][m.fold], want, atol=1e-10)
                assert abs(row["fold_scores"][m.fold] - score) < 1e-10


def test_heads_without_attention_run_once_per_window(spark, monkeypatch):
    """What a task looks up is worked out ahead: its rows meet no head."""
    models = v.fold_models(channels=4, hidden=(8, 4), width=20, folds=2)
    prepared = attention._prepare(models, "onehot", "mean_single_conv")
    assert [len(p["windows"]) for p in prepared] == [21**3] * 2 and "feature" not in prepared[0]
    monkeypatch.setattr(attention, "WINDOWS", 100)
    plain = attention._prepare(models, "onehot", "mean_single_conv")
    batch = pa.RecordBatch.from_pydict({"sequence": LONG_SEQS + SEQS})
    for a, b in zip(prepared, plain, strict=True):
        looked_up = attention._read_input(batch, "onehot", a).logits(a, "mean_single_conv")
        assert np.allclose(looked_up, attention._read_input(batch, "onehot", b).logits(b, "mean_single_conv"), atol=1e-12)
    with pytest.raises(KeyError):
        plain[0]["windows"]
